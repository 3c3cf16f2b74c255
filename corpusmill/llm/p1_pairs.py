"""Problem 1: defective answers of preference pairs.

Methods: language posteriors of a character n-gram naive Bayes model, compared between the
instruction and the answer; the likelihood of the end-of-text n-gram for truncation. Empty
answers, refusals and copies are told by what is left of an answer once markup, declining
clauses, or the instruction's own words are taken away.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.language import LANGUAGES, LanguageModel, fit_language_model
from corpusmill.llm.p4_grammar import THRESHOLD, score_text
from corpusmill.llm.words import fold, words
from corpusmill.plans.layout import table

# ---------------------------------------------------------------- empty answers
MARKUP = re.compile(r"<[/!]?[a-zA-Z][^<>]*>|&[a-z]+;|[\W_]")
# What stands for a missing answer, after markup is taken away.
STAND_INS = {
    "na", "none", "null", "nil", "nan", "undefined", "empty", "blank", "noresponse", "noanswer", "noanswergiven",
    "noreply", "nooutput", "nocontent", "response", "assistant", "answer", "output", "bot", "ai", "tbd", "todo",
    "emptyresponse", "emptyanswer", "missing", "notavailable", "noanswerprovided", "noresponsegiven", "ndef",
}


def is_empty(text: str | None) -> bool:
    """Null, blank, invisible, markup or punctuation only, or a stand-in for nothing."""
    if text is None:
        return True
    return (left := MARKUP.sub("", fold(text))) == "" or left in STAND_INS


# ---------------------------------------------------------------- refusals
DECLINE = re.compile(
    r"(?:can'?t|cannot|can not|won'?t|will not|unable to|not able to|not allowed to|not permitted to|not going to"
    r"|(?:am|feel) (?:not )?(?:un)?comfortable|comfortable|must decline|have to decline|decline to|have to refuse|i refuse"
    r"|rather not|prefer not|cannot and will not|keeps? me from|not in a position to)\b[^.!?]*?"
    r"\b(?:help|helping|assist|assisting|answer|answering|provid\w+|discuss\w*|respond\w*|do this|do that|writ\w+|talk\w*"
    r"|tak\w+ this|get into|engage|comply|fulfil\w*|support this|continue|say more|go there|cover that|give that|give you)\b"
    r"|off limits|against (?:the|my|our) (?:rules|guidelines|polic\w+|principles)|outside (?:of )?what i|beyond what i can"
    r"|hard pass|request (?:is )?(?:denied|declined|refused)|not doing (?:this|that)|do not deal with|don'?t deal with"
    r"|no choice but to|pass on this|look for somebody else|look for someone else|not something i (?:can|will)"
    r"|be appropriate for me|not appropriate for me|stays? silent on|change the subject|not my place to|i'?ll have to pass"
    r"|ne (?:peux|puis|pourrai) pas|refuser|prefere ne pas|m'est impossible|il m'est|pas en mesure|ne souhaite pas"
    r"|nicht helfen|ablehnen|nicht außern|nicht aussern|nicht beantworten|darf ich nicht|nicht in der lage|mochte ich nicht"
    r"|no puedo|prefiero no|no me esta permitido|me niego|no estoy autorizad\w|non posso|preferisco non|mi dispiace, ma"
    r"|nao posso|prefiro nao|nao me e permitido|lamento, mas|不能|无法|抱歉"
)
CLOSING = re.compile(
    r"(?:^|\b)(?:i hope you understand|(?:my )?apolog\w+|sorry|let'?s talk about|something else|anything else"
    r"|have a nice|have a good|take care|rephrase|try (?:a |another )?\w* ?(?:search|source|engine)|search engine"
    r"|contact a|please contact|consult a|professional|another topic|other questions?|thank you|thanks for"
    r"|bonne journee|comprenez|desole|verstandnis|schonen tag|leid|comprension|lo siento|disculp\w*|find a)\b"
)
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+|(?<=[。！？])")


def is_refusal(text: str) -> bool:
    """Declines, and nothing is left besides apologies, goodbyes and insults."""
    folded = fold(text)
    if not DECLINE.search(folded):
        return False
    for part in SENTENCE.split(folded):
        part = part.strip(" \t*_>-\"'")
        if not part or DECLINE.search(part) and not re.search(r"\b(?:but|still|so) (?:here|the|let)\b|enough for", part):
            continue
        if len(part) < 60 and CLOSING.search(part):
            continue
        if len(words(part)) < 3 or max(score_text(part)) >= THRESHOLD:
            continue
        return False
    return True


# ---------------------------------------------------------------- copies
LEAD = {"you", "asked", "wrote", "said", "question", "answer", "instruction", "prompt", "your", "the", "was", "request",
        "response", "user", "human", "assistant", "quote", "is", "ok", "okay", "so", "well", "q", "a"}


def near(a: str, b: str) -> bool:
    """One slip apart: a letter more, less, other, or two swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or len(a) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (
        a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    )


def is_copy(instruction: str, answer: str) -> bool:
    """Gives back the instruction, or a good part of it, and nearly nothing else.

    At any length an answer is a copy if, but for a lead-in, it is the instruction with a slip in some words;
    a part of fewer than six words may be an answer, and is none.
    """
    low, mine = answer.lower(), instruction.lower()
    have = words(fold(instruction))
    if len(have) < 6 or len(low) < 2 * len(mine):
        got = words(fold(answer))
        while len(got) > len(have) and got[0] in LEAD:
            got = got[1:]
        if have and len(got) == len(have) and all(map(near, got, have)):
            return True
    n = len(mine)
    probes = [mine[i : i + 7] for i in range(0, n - 7, max(1, n // 14))]
    if low.isascii() and mine.isascii() and sum(p in low for p in probes) < 0.3 * len(probes):
        return False
    have, got = words(fold(instruction)), words(fold(answer))
    got = [w for i, w in enumerate(got) if i > 5 or w not in LEAD or w in have[:6]]
    if len(got) < 6:
        return False
    own, pairs = set(have), set(zip(have, have[1:]))
    by_first: dict[str, list[str]] = {}
    for w in own:
        by_first.setdefault(w[:1], []).append(w)
        by_first.setdefault(w[1:2], []).append(w)
    foreign = [w for w in got if w not in own and not any(near(w, x) for x in by_first.get(w[:1], []))]
    if len(foreign) > max(2, 0.15 * len(got)):
        return False
    kept = sum(p in pairs for p in zip(got, got[1:])) / (len(got) - 1)
    # what stands outside stretches taken from the instruction
    covered = {w for p in zip(got, got[1:]) if p in pairs for w in p}
    return kept >= 0.5 and len(covered) >= 0.35 * len(own)


# ---------------------------------------------------------------- truncation
BITS = 18
ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s+\S")
TAIL = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d,.]*|[^\w\s]")
#: Tokens before a place that tell whether a text may end there.
ORDERS = 3
#: Codes of the start of a text and of a line end, and what sets list items apart.
START, LINE, IN_ITEM = 0x51AB3F, 0x7C0D21, 0x2E5A9F00
KINDS: dict[str, int] = {}


def token_kind(token: str) -> int:
    """The code of a token; numbers and names are classes."""
    known = KINDS.get(token)
    if known is None:
        if len(KINDS) > 300_000:
            KINDS.clear()
        kind = "#" if token[0].isdigit() else "Name" if token[0].isupper() and not token.isupper() else token.lower()
        known = KINDS[token] = zlib.crc32(kind.encode("utf-8", "surrogatepass"))
    return known


def token_kinds(text: str, several: bool | None = None) -> list[int]:
    """Codes of a text's tokens and line ends; those of list items are set apart in texts of several lines."""
    out: list[int] = []
    lines = text.split("\n")
    several = len(lines) > 1 if several is None else several
    for k, line in enumerate(lines):
        if k:
            out.append(LINE)
        if several and ITEM.match(line):
            out += [token_kind(t) ^ IN_ITEM for t in TAIL.findall(line)]
        else:
            out += map(token_kind, TAIL.findall(line))
    return out


def place_codes(kinds: np.ndarray) -> np.ndarray:
    """A row for each order: the bucket of the last one, two and three tokens up to each place, from the
    third on."""
    x = kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, h = [], np.zeros(len(x) - ORDERS + 1, np.uint64)
    for k in range(ORDERS):
        h = (h ^ x[ORDERS - 1 - k : len(x) - k]) * np.uint64(0xD6E8FEB86659FD93)
        rows.append((h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
    return np.stack(rows)


def last_codes(text: str) -> np.ndarray:
    """The buckets of a text's end."""
    start = text.rfind("\n", 0, max(0, len(text) - 160)) + 1  # whole lines, so items are known as such
    kinds = [START] * ORDERS + token_kinds(text[start:].rstrip(), "\n" in text)
    return place_codes(np.array(kinds[-ORDERS:], np.uint64))[:, 0]


class EndModel:
    """How likely a text ends after its last tokens, from the ends and all inner places of the corpus."""

    def __init__(self, ends: np.ndarray, inner: np.ndarray):
        whole = 1 << BITS
        # of all inner places together as many as there are ends
        scale = ends[:whole].sum() / max(1.0, float(inner[:whole].sum()))
        self.ends, self.inner = ends.astype(np.float32), (inner * scale).astype(np.float32)

    def likelihood(self, text: str) -> float:
        """P(end | last tokens), from short to long contexts, when ends and inner places are alike frequent.

        The text's own end is in the counts and is taken out.
        """
        p = 0.5
        for code in last_codes(text):
            e, i = max(0.0, float(self.ends[code]) - 1), float(self.inner[code])
            p = (e + 8 * p) / (e + i + 8)
        return p


def fit_end_model(df: DataFrame, sides: list[str]) -> EndModel:
    """Counts over the ends and all places inside the lines of all answers of `df`, whatever their number: each task
    adds up two arrays of fixed size, and these are summed by bucket before the driver gets them."""
    size = ORDERS << BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, inner = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for side in sides:
                kinds, last = [], []
                for text in batch[side]:
                    if text and not text.isspace():
                        kinds += [START] * (ORDERS - 1)
                        kinds += token_kinds(text.rstrip())
                        last.append(len(kinds) - ORDERS)
                if not last:
                    continue
                codes = place_codes(np.array(kinds, np.uint64))
                is_end = np.zeros(codes.shape[1], bool)
                is_end[[x for x in last if x >= 0]] = True
                # before and after a line end a text might stop, too: these places tell nothing
                line = np.array(kinds[ORDERS - 1 :], np.uint64) == LINE
                neither = is_end | line | np.append(line[1:], False)
                ends += np.bincount(codes[:, is_end].ravel(), minlength=size)
                inner += np.bincount(codes[:, ~neither].ravel(), minlength=size)
        used = np.flatnonzero(ends + inner)
        yield pd.DataFrame({"code": used.astype("int32"), "ends": ends[used], "inner": inner[used]})

    counts = (
        df.select(*sides)
        .mapInPandas(count, "code int, ends bigint, inner bigint")
        .groupBy("code")
        .agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner"))
        .toPandas()  # at most ORDERS << BITS rows, whatever the corpus
    )
    ends, inner = np.zeros(size), np.zeros(size)
    ends[counts["code"]], inner[counts["code"]] = counts["ends"], counts["inner"]
    return EndModel(ends, inner)


COMPLETE = re.compile(r"[.!?。！？…][\"'”’»)\]*_`]*$|[:;]-?[)D(P]$|[\"”»)\]}>]$|```$|[^\w\s,;:(\-–—'\"“„«`/&+=]$")
BROKEN = re.compile(r"[,;:(\[{\-–—/&+=“„«]$|(?:^|\n)\s*(?:\d+[.)]|[-*•])$")
OPEN_QUOTE = re.compile(r"[\s(][\"“„«][^\"”»]*$")
ADDRESS = re.compile(r"\S*[^\W\d_]\S*\.[^\W\d_]\w*(?:/\S*)?$|\S+@\S+$")
SIGNED = re.compile(r",\s*\n\s*[^\W\d_][\w .'-]{0,40}$")
# Words that leave a phrase open.
OPENERS = set(
    "a an the of in on at to for from with by and or but nor so if when while because although that which who whose this "
    "these those my your his her its our their some any each every is are was were be been has have had will would should "
    "could can may might must as than then into onto about over under between after before until since during without very "
    "more most too not it put take let ask".split()
)


def is_truncated(text: str, model: EndModel) -> bool:
    """Breaks off: an open code block, quote or bracket, or an end that texts don't end with."""
    text = text.rstrip()
    if text.count("```") % 2:
        return True
    if COMPLETE.search(text[-6:]):
        return False
    if OPEN_QUOTE.search(text[-80:]):
        return True
    if BROKEN.search(text[-12:]):
        return True
    if SIGNED.search(text[-60:]):
        return False
    last_line = text.rpartition("\n")[2]
    if ADDRESS.search(last_line[-60:]) and not ITEM.match(last_line):
        return False
    last = re.findall(r"[^\W_]+", last_line[-40:])
    opens = bool(last) and last[-1] in OPENERS
    likely = model.likelihood(text)
    if ITEM.match(last_line):
        return opens or likely < 0.2
    sentence = re.split(r"(?<=[.!?:])\s+", last_line)[-1]
    if max(score_text(sentence)) >= THRESHOLD:
        return False  # an insult in the style of a chat is whole without a stop
    before = text[: len(text) - len(sentence)].strip()
    alone = not before or all(max(score_text(s)) >= THRESHOLD for s in re.split(r"(?<=[.!?])\s+|\n+", before) if s.strip())
    if alone and len(words(fold(sentence))) <= 5:
        return opens
    return opens or likely < 0.75


# ---------------------------------------------------------------- language
# How the languages are called, in the languages.
LANGUAGE_NAMES = {
    "en": "english anglais englisch englische englischer ingles inglese",
    "fr": "french francais franzosisch frances francese",
    "de": "german allemand deutsch deutsche aleman tedesco alemao",
    "es": "spanish espagnol spanisch espanol castellano spagnolo espanhol",
    "it": "italian italien italienisch italiano",
    "pt": "portuguese portugais portugiesisch portugues portoghese",
    "zh": "chinese chinois chinesisch chino cinese chines mandarin",
}
NAME_OF = {n: k for k, ns in LANGUAGE_NAMES.items() for n in ns.split()}
NAMED = re.compile(r"\b(?:" + "|".join(NAME_OF) + r")\b")
#: Nats by which the answer's language must beat the instruction's, at least and for each character.
MARGIN, MARGIN_A_CHAR = 12.0, 0.12


def asked_languages(instruction: str) -> set[str]:
    """Languages that the instruction names; slips of one letter count."""
    folded = fold(instruction)
    asked = {NAME_OF[m] for m in NAMED.findall(folded)}
    for w in words(folded):
        if len(w) > 5 and w not in NAME_OF:
            asked |= {k for n, k in NAME_OF.items() if len(n) > 5 and near(w, n)}
    return asked


def find_defects(
    instructions: list[str | None], answers: list[str | None], languages: LanguageModel, ends: EndModel
) -> list[str | None]:
    """The kind of defect of each answer, or None."""
    spoken, asked_in = languages.score(answers), languages.score(instructions)
    out: list[str | None] = []
    for k, (instruction, answer) in enumerate(zip(instructions, answers)):
        if is_empty(answer):
            out.append("empty")
        elif is_refusal(answer):
            out.append("refusal")
        elif instruction and is_copy(instruction, answer):
            out.append("copy")
        else:
            found = None
            if instruction and not is_empty(instruction):
                i, a = int(asked_in[k].argmax()), int(spoken[k].argmax())
                if i != a and spoken[k, a] - spoken[k, i] > max(MARGIN, MARGIN_A_CHAR * len(answer)):
                    if LANGUAGES[a] not in asked_languages(instruction):
                        found = "language"
            out.append(found or ("truncated" if is_truncated(answer, ends) else None))
    return out


def pair_defects(
    pairs: DataFrame,
    languages: LanguageModel,
    ends: EndModel,
    key: str = "example_id",
    instruction: str = "instruction",
    sides: tuple[str, ...] = ("chosen", "rejected"),
) -> DataFrame:
    """(key, side, defect): one row for each defective answer.

    defect is empty, refusal, copy, language or truncated; the first that holds is given. Null,
    blank and invisible answers are empty. With a null, blank or invisible instruction only empty,
    refusal and truncated can occur. Repeated rows give repeated results, columns not named are not
    read, an empty table gives an empty one. Whole texts are judged, in one pass without a shuffle.
    """
    spark = pairs.sparkSession
    models = spark.sparkContext.broadcast((languages, ends))  # fixed sizes: 2 MB and 6 MB

    @F.pandas_udf("struct<" + ", ".join(f"s{k}: string" for k in range(len(sides))) + ">")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        lang, end = models.value
        for asked, *answers in batches:
            asked = asked.tolist()
            yield pd.DataFrame({f"s{k}": find_defects(asked, a.tolist(), lang, end) for k, a in enumerate(answers)})

    judged = pairs.select(F.col(key), judge(F.col(instruction), *[F.col(s) for s in sides]).alias("__d"))
    rows = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"__d.s{k}").alias("defect")) for k, s in enumerate(sides)])
    return (
        judged.select(key, F.explode(rows).alias("__r"))
        .select(key, F.col("__r.side").alias("side"), F.col("__r.defect").alias("defect"))
        .where(F.col("defect").isNotNull())
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective answer with its side and kind."""
    pairs = table(spark, sf_dir, "preference_examples")
    languages = fit_language_model(table(spark, sf_dir, "documents"))
    return pair_defects(pairs, languages, fit_end_model(pairs, ["chosen", "rejected"]))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers by side and kind."""
    return p1_found(spark, sf_dir).groupBy("side", "defect").agg(F.count(F.lit(1)).alias("answers"))
