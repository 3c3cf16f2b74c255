"""Scalar text functions: Column -> Column, inside the JVM. A null text gives null unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions.arrays import let


def _literal(text: str) -> str:
    """A replacement text for regexp_replace."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def mask(text: Column, pattern: str, mask_text: str) -> Column:
    return F.regexp_replace(text, pattern, _literal(mask_text))


def mask_emails(text: Column) -> Column:
    return mask(text, C.EMAIL, C.EMAIL_MASK)


def mask_ips(text: Column) -> Column:
    return mask(text, C.IP, C.IP_MASK)


def mask_phones(text: Column, mode: str = "corrected") -> Column:
    """Masks US phone numbers; mode "reference" keeps the pattern that never matches."""
    return mask(text, C.PHONE[mode], C.PHONE_MASK)


def desensitize(text: Column, mode: str = "corrected") -> Column:
    """E-mails, then phones, then addresses; the order decides overlaps."""
    return mask_ips(mask_phones(mask_emails(text), mode))


def split_words(text: Column) -> Column:
    """Words as Python's split() gives them: no empty words."""
    return F.filter(F.split(text, C.SPACE + "+"), lambda w: w != "")


def collapse_spaces(text: Column) -> Column:
    return F.array_join(split_words(text), " ")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return F.coalesce(F.size(split_words(text)) == 0, F.lit(True))


MEASURES = ("n_words", "mean_word_length", "ellipsis_ratio", "alpha_ratio")


def gopher_struct(text: Column) -> Column:
    """struct of MEASURES; words and lines are cut once. A text without words has 0 for each."""

    def measure(w: Column, lines: Column) -> Column:
        n = F.size(w).cast("bigint")
        dots = F.size(F.filter(lines, lambda x: x.rlike("\\.\\.\\." + C.SPACE + "*$")))
        letters = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
        alpha = F.size(F.filter(w, lambda x: x.rlike("\\p{L}")))
        share = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
        return F.struct(
            n.alias("n_words"),
            share(letters / n).alias("mean_word_length"),
            share(dots / F.size(lines)).alias("ellipsis_ratio"),
            share(alpha / n).alias("alpha_ratio"),
        )

    return let(split_words(text), lambda w: let(F.split(text, "\n"), lambda lines: measure(w, lines)))


def gopher_metrics(text: Column) -> dict[str, Column]:
    """The rule filter's measures by name."""
    found = gopher_struct(text)
    return {k: found[k] for k in MEASURES}


def gopher_keep(text: Column) -> Column:
    """alpha > 0.8, ellipsis < 0.3, 50 to 100000 words, mean length strictly between 3 and 10.

    Null texts and texts without words are not kept.
    """
    keep = lambda m: (
        (m["alpha_ratio"] > 0.8)
        & (m["ellipsis_ratio"] < 0.3)
        & m["n_words"].between(50, 100_000)
        & (m["mean_word_length"] > 3)
        & (m["mean_word_length"] < 10)
    )
    return F.coalesce(F.when(text.isNotNull(), let(gopher_struct(text), keep)), F.lit(False))


def char_shingles(text: Column, n: int) -> Column:
    """Distinct stretches of n characters, by one pass of a look-ahead; none if the text is shorter. A
    character outside the basic plane is one, too: no stretch starts inside it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?![\\uDC00-\\uDFFF])(?=(.{{{n}}}))"), F.lit(1)))


def pretokens(text: Column, pattern: str = C.PRETOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_specials(text: Column, specials: list[str], keep: bool = True) -> Column:
    """Splits at special tokens, the longest first; keep says whether they stay as pieces.

    Without special tokens the text is one piece.
    """
    if not specials:
        return F.array(text)
    alternatives = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    if not keep:
        return F.filter(F.split(text, alternatives), lambda x: x != "")
    pattern = f"(?s)(?:{alternatives})|(?:(?!{alternatives}).)+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fill(template: str, **fields: Column) -> Column:
    """A template with its {fields}; a null field gives null."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in fields:
            parts += [F.lit(template[at : m.start()]), fields[m[1]]]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def parse_choice(output: Column) -> Column:
    """The letter A to D of an answer: "the correct answer is X", else the first that stands alone."""
    stated = F.nullif(F.regexp_extract(output, "(?i)the\\s+correct\\s+answer\\s+is\\s*([ABCD])\\b", 1), F.lit(""))
    alone = F.nullif(F.regexp_extract(output, "(?i)\\b([ABCD])\\b", 1), F.lit(""))
    return F.upper(F.coalesce(stated, alone))


def parse_gold_number(answer: Column) -> Column:
    """The number after ####, without thousands separators."""
    return F.replace(F.nullif(F.regexp_extract(answer, f"####\\s*({C.NUMBER})", 1), F.lit("")), F.lit(","), F.lit(""))


def parse_last_number(output: Column) -> Column:
    """The last number of a text, without thousands separators."""
    found = F.regexp_extract_all(output, F.lit(C.NUMBER), F.lit(0))
    return F.replace(F.when(F.size(found) > 0, F.element_at(found, -1)), F.lit(","), F.lit(""))


def parse_turns(text: Column) -> Column:
    """array<struct<role, content>> of a conversation."""
    roles = F.regexp_extract_all(text, F.lit(C.TURN), F.lit(1))
    contents = F.regexp_extract_all(text, F.lit(C.TURN), F.lit(2))
    return F.arrays_zip(roles.alias("role"), F.transform(contents, strip).alias("content"))


def strip(text: Column) -> Column:
    """Without white space at either end, as Python's strip()."""
    return F.regexp_replace(text, f"^{C.SPACE}+|{C.SPACE}+$", "")


NESTED = 5


def nested(depth: int) -> str:
    """Text with braces that match, up to a depth."""
    return f"(?:[^{{}}]++|\\{{{nested(depth - 1)}\\}})*" if depth else "[^{}]*"


BOXED = f"\\\\boxed\\{{({nested(NESTED)})\\}}"


def answer_candidates(response: Column) -> Column:
    """Ordered distinct pieces of a response that may be its answer: the answer tag, the last box, what
    follows the thought, the last line, its trailing fraction, number or assignment, the last three
    fractions and numbers, and all of it. Braces inside a box may be nested NESTED times."""
    none = F.lit("")
    fraction, number = "\\\\frac\\{[^{}]+\\}\\{[^{}]+\\}", "-?[0-9]+(?:\\.[0-9]+)?(?:/[0-9]+)?"
    assignment = "[A-Za-z]\\s*=\\s*[-+]?[0-9]+(?:\\.[0-9]+)?"

    def pieces(text: Column) -> Column:
        tag = F.when(
            text.contains("<answer>") & text.contains("</answer>"),
            strip(F.element_at(F.split(F.element_at(F.split(text, "<answer>"), -1), "</answer>"), 1)),
        ).otherwise(none)
        boxes = F.regexp_extract_all(text, F.lit(BOXED), F.lit(1))
        box = let(boxes, lambda b: F.when(F.size(b) > 0, strip(F.element_at(b, -1))).otherwise(none))
        after = F.when(text.contains("</think>"), strip(F.element_at(F.split(text, "</think>"), -1))).otherwise(none)
        lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), strip), lambda x: x != "")
        bare = lambda x: strip(F.regexp_replace(x, "(?i)^(final answer|answer)\\s*[:：]\\s*", ""))
        last = let(lines, lambda ls: F.when(F.size(ls) > 0, bare(F.element_at(ls, -1))).otherwise(none))
        ends = let(last, lambda x: F.array(x, *[F.regexp_extract(x, f"({p})\\s*$", 1) for p in (fraction, number, assignment)]))
        tails = [let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: _last(m, 3)) for p in (fraction, number)]
        found = F.concat(F.array(tag, box, after), ends, *tails, F.array(text))
        return F.array_distinct(F.filter(found, lambda x: x != ""))

    return let(strip(response), pieces)


def _last(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS, or MM:SS below an hour."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.expr("0") + F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    long = F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), r.cast("int"))
    return F.when(s >= 3600, long).otherwise(F.format_string("%02d:%02d", m.cast("int"), r.cast("int")))


def cosine_rate(step: Column, top: float, low: float, warmup: int, cycle: int) -> Column:
    """Learning rate: linear warm-up, cosine to `low`, then `low`."""
    turn = (step - warmup) / (cycle - warmup)
    wave = F.lit(low) + (top - low) * (1 + F.cos(F.lit(3.141592653589793) * turn)) / 2
    return F.when(step < warmup, F.lit(top) * step / warmup).when(step > cycle, F.lit(low)).otherwise(wave)
