"""Text forms shared by the operators: folding of look-alikes, words, numbers."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
        "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y",
        "ԝ": "w", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
        "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l",
        "’": "'", "‘": "'", "`": "'", "´": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"',
        "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "…": "...",
    }
)
WORD = re.compile(r"[^\W_]+(?:['][^\W_]+)*")
NUMBER_COMMA = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
CJK = re.compile("([㐀-鿿])")


class Plain(dict):
    """Character -> what is left of it, made when first met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)):
            kind = unicodedata.category(c)
            if kind == "Mn" or kind == "Cf" or (kind == "Cc" and c not in "\n\t\r"):
                continue
            out.append(c)
        self[code] = "".join(out).translate(LOOK_ALIKES)
        return self[code]


PLAIN = Plain()


def fold(text: str) -> str:
    """Lower case, compatibility forms, no marks, no invisible characters, look-alikes as Latin."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).casefold().translate(LOOK_ALIKES)
    return text if text.isascii() else text.translate(PLAIN)


def words(folded: str) -> list[str]:
    """The words and numbers of a folded text; 3,785 is one number, a CJK character one word."""
    text = NUMBER_COMMA.sub("", folded) if "," in folded else folded
    if not text.isascii():
        text = CJK.sub(r" \1 ", text)
    return WORD.findall(text)
