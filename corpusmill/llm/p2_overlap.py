"""Problem 2: the same or nearly the same requests in different splits.

Method: winnowing. Rolling hashes run over the informative words of a request; a gram takes as many
words as it needs to be rare, by the counts of words and of pairs of words, however many texts there
are. Of every window the minimum is selected, with one window on both sides. Selected hashes are joined
across splits; the words of a pair are aligned in order along collinear chains of shared seeds, whole
stretches may have moved; coverage is the share of words that the chains reach once extended. Identical
requests are one class and take part once; pairs of rows are made from classes at the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.alignment import MANY, Slips, align_words, longest_chain, slip
from corpusmill.llm.rarity import INFORMATIVE, Rarity, pair_rarity
from corpusmill.llm.words import fold, words
from corpusmill.plans.layout import materialise, spread, table

#: Grams of a window, of which the minimum is selected.
WINDOW = 3
#: Nats that a gram has, however many texts there are: a pair doesn't need longer grams for standing in a
#: larger table.
NEED = 10.0
#: Nats that each further word counts at least: words that only a family of like requests has tell
#: nothing beyond each other, yet its members must meet. Grams that are rare by this alone are joined
#: together with a quantity or name of the text, which the same request has too.
LEAST = 0.6
#: A request of whose words fewer than SPARSE are informative is perhaps one of very many near copies: it is
#: looked up by runs of DENSE words of any kind, too, of DENSE_WINDOW of which one is selected, each joined
#: together with the request's quantities.
SPARSE, DENSE, DENSE_WINDOW = 0.3, 4, 8
#: Letters up to which a request is short: it is looked up by its forms with one letter less.
SHORT = 24
LETTERS = re.compile(r"[\W_]+")
#: Rows made of a class pair are joined in so many parts.
SALTS = 16


def digest64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


#: The rolling hash is a polynomial in BASE modulo a Mersenne prime.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681
WORD_HASHES: dict[str, int] = {}


def word_hash(word: str) -> int:
    found = WORD_HASHES.get(word)
    if found is None:
        if len(WORD_HASHES) > 500_000:
            WORD_HASHES.clear()
        found = WORD_HASHES[word] = xxhash.xxh3_64_intdigest(word) >> 4
    return found


POWERS = [1]


class Rolling:
    """Hashes of all runs of a list of words, each in one step from the hashes of its beginnings."""

    def __init__(self, ws: list[str]):
        while len(POWERS) <= len(ws):
            POWERS.append(POWERS[-1] * BASE % PRIME)
        h, self.heads = 0, [0]
        for w in ws:
            h = (h * BASE + (WORD_HASHES.get(w) or word_hash(w))) % PRIME
            self.heads.append(h)

    def of(self, start: int, end: int) -> int:
        return (self.heads[end] - self.heads[start] * POWERS[end - start]) % PRIME


def quantities(ws: list[str]) -> list[int]:
    """Codes of a request's numbers, of which align() asks that another request has one, too, if it has any; none if
    it has no number, or a long one, which may be written apart."""
    numbers = {w for w in ws if w[0].isdigit()}
    if any(len(w) >= 5 for w in numbers):
        return []
    return sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) - (1 << 31) for w in numbers})


def rare_runs(known: list[tuple[float, int]], rarity: Rarity, need: float) -> list[tuple[int, int, bool]]:
    """(start, end, sure) of the shortest run from each looked-up word that is rare enough, to the text's end
    if need be; sure if it is so without LEAST."""
    n, out = len(known), []
    told = rarity.told(known)
    for i in range(n):
        got = honest = known[i][0]
        j = i + 1
        while got < need and j < n:
            x = told[j]
            got += x if x > LEAST else LEAST
            honest += x
            j += 1
        if got < need:
            break  # neither is any later run
        out.append((i, j, honest >= need))
    return out


def marks(ws: list[str], rarity: Rarity) -> list[str]:
    """What tells a request from others of its family: its numbers; without any, the heads and tails of
    its names; without these, nothing."""
    numbers = sorted({w for w in ws if w[0].isdigit()})
    names = sorted({w for w in ws if len(w) > 3 and rarity.of(w) >= NAME})
    return numbers or [f"<{w[:3]}" for w in names] + [f"{w[-3:]}>" for w in names] or [""]


def dense_grams(ws: list[str], informative: list[str]) -> list[tuple[int, int]]:
    """(hash, place) of selected runs of DENSE words, with all numbers of the text; without any, with the halves
    of each informative word; without these, as they are."""
    numbers = sorted({w for w in ws if w[0].isdigit()})
    halves = sorted({h for w in informative for h in (f"<{w[: max(2, len(w) // 2)]}", f"{w[-max(2, len(w) // 2) :]}>")})
    own = [" ".join(numbers)] if numbers else halves or [""]
    rolling, k = Rolling(ws), min(DENSE, len(ws))
    grams = [(rolling.of(i, i + k), i) for i in range(len(ws) - k + 1)]
    n = min(DENSE_WINDOW, len(grams))
    chosen = {min(grams[i : i + n]) for i in range(len(grams) - n + 1)}
    return [(digest64(f"{h} {m}"), place) for h, place in sorted(chosen) for m in own]


def select_grams(text: str, rarity: Rarity, window: int = WINDOW) -> list[tuple[int, int]]:
    """(hash, place) of the selected minima of a text; places count informative words.

    A short request gives the hashes of its letters and of its letters without one of them. A request
    that has no rare run among its informative words is looked up by runs of all its words, and if
    these have none either, by all its words and by all but one of them. A request with few informative
    words gives dense grams, too.
    """
    return grams_of(words(fold(text)), rarity, window)


def grams_of(everything: list[str], rarity: Rarity, window: int = WINDOW) -> list[tuple[int, int]]:
    """select_grams() of a text's words."""
    out = []
    letters = "".join(everything)
    if not letters:
        return []
    if len(letters) <= SHORT:
        out = [(digest64("=" + letters[:i] + letters[i + 1 :]), 0) for i in range(len(letters))]
        out.append((digest64("=" + letters), 0))
    all_known = [*map(rarity.look_up, everything)]
    ws = [w for w, k in zip(everything, all_known) if k[0] >= INFORMATIVE]
    if len(ws) < SPARSE * len(everything):
        out += dense_grams(everything, ws)
    runs = rare_runs([k for k in all_known if k[0] >= INFORMATIVE], rarity, NEED)
    if not runs:
        ws = everything
        runs = rare_runs(all_known, rarity, NEED)
    if not runs:
        forms = {" ".join(ws), *(" ".join(ws[:i] + ws[i + 1 :]) for i in range(len(ws)))}
        return out + [(digest64(f), 0) for f in sorted(forms) if f]
    rolling = Rolling(ws)
    grams = [(rolling.of(i, j), i, sure) for i, j, sure in runs]
    n = min(window, len(grams))
    least = map(min, *(grams[k:] for k in range(n))) if n > 1 else grams
    chosen = sorted(set(least), key=itemgetter(1))
    own = marks(everything, rarity) if not all(g[2] for g in chosen) else []
    for h, place, sure in chosen:
        out += [(h, place)] if sure else [(digest64(f"{h} {m}"), place) for m in own]
    return out


def chain(seeds: list[tuple[int, int]]) -> int:
    """Seeds of the longest collinear chain; seeds are places in both texts."""
    return len(longest_chain(seeds))


# Numbers as words of the languages that occur.
NUMBER_WORDS = set(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand first second third fourth fifth "
    "deux trois quatre cinq sept huit neuf dix zwei drei vier fünf funf sechs sieben acht neun zehn dos tres cuatro cinco seis "
    "siete ocho nueve diez".split()
)
#: Words of either text that may be left over after alignment, as a share.
LEFT_OVER = 0.28
#: Nats of rarity from which a word may be a name (if capital where no sentence starts), or surely is.
NAME, SURELY = 6.0, 8.0
CAPITAL = re.compile(r"(?<=[a-zß-ÿ,;:] )[A-ZÀ-Þ][\w'-]+")


def is_number(word: str) -> bool:
    return word[0].isdigit() or word in NUMBER_WORDS


def align(a: str, b: str, rarity: Rarity) -> float:
    """Share of the words of a and b that the extended chains of shared seeds cover; 0 if names or
    quantities differ.

    Words count in their order; stretches of sentences may have moved; a slip in a word doesn't matter.
    Words that only one side has are added or dropped; but if both sides have an own number, or both have
    an own rare word, the requests are about other quantities or names.
    """
    wa, wb = words(fold(a)), words(fold(b))
    if not wa or not wb:
        return 0.0
    only_a, only_b = Counter(wa), Counter(wb)
    both = only_a & only_b
    only_a, only_b = list((only_a - both).elements()), list((only_b - both).elements())
    joined_a, joined_b = "".join(wa), "".join(wb)  # words may be written together or apart
    if any(x[0].isdigit() and x not in joined_b for x in only_a) and any(x[0].isdigit() and x not in joined_a for x in only_b):
        return 0.0  # most pairs of one template end here
    rest_a, rest_b = pair_slips(only_a, only_b)
    # no order can cover more words than both sides have
    if uncovered(rest_a, rest_b, joined_a, joined_b, wa, wb) > LEFT_OVER or not agree(rest_a, rest_b, a, b, joined_a, joined_b, rarity):
        return 0.0
    if joined_a == joined_b:
        return 1.0
    at = align_words(wa, wb)
    taken = set(at)
    left_a, left_b = [x for x, j in zip(wa, at) if j < 0], [y for j, y in enumerate(wb) if j not in taken]
    return 1.0 - uncovered(left_a, left_b, joined_a, joined_b, wa, wb)


def pair_slips(only_a: list[str], only_b: list[str]) -> tuple[list[str], list[str]]:
    """Both lists without the words that are slips of each other."""
    if len(only_a) * len(only_b) > MANY:
        index, taken, rest_a = Slips(only_b), set(), []
        for x in only_a:
            hit = next((j for j in index.of(x) if j not in taken), None)
            if hit is None:
                rest_a.append(x)
            else:
                taken.add(hit)
        return rest_a, [y for j, y in enumerate(only_b) if j not in taken]
    rest_b, rest_a = list(only_b), []
    for x in only_a:
        hit = None if x[0].isdigit() else next((y for y in rest_b if not y[0].isdigit() and slip(x, y)), None)
        if hit is None:
            rest_a.append(x)
        else:
            rest_b.remove(hit)
    return rest_a, rest_b


def uncovered(only_a: list[str], only_b: list[str], joined_a: str, joined_b: str, wa: list[str], wb: list[str]) -> float:
    """The larger share of words without a counterpart; words that the other side writes together have one."""
    left = lambda ws, joined: sum(len(x) < 5 or x not in joined for x in ws)
    return max(left(only_a, joined_b) / len(wa), left(only_b, joined_a) / len(wb))


def agree(rest_a: list[str], rest_b: list[str], a: str, b: str, joined_a: str, joined_b: str, rarity: Rarity) -> bool:
    """Whether words that only one side has leave names and quantities the same."""
    rest_a = [x for x in rest_a if len(x) < 5 or x not in joined_b]
    rest_b = [x for x in rest_b if len(x) < 5 or x not in joined_a]
    if any(map(is_number, rest_a)) and any(map(is_number, rest_b)):
        return False
    if rest_a and rest_b:
        capitals = {fold(x) for t in (a, b) for x in CAPITAL.findall(t)}
        strong = lambda ws: any(
            (r := rarity.of(x)) >= SURELY or (r >= NAME and x in capitals) for x in ws if not x[0].isdigit() and len(x) > 3
        )
        weak = lambda ws: any(rarity.of(x) >= NAME for x in ws if not x[0].isdigit() and len(x) > 3)
        if (strong(rest_a) and weak(rest_b)) or (weak(rest_a) and strong(rest_b)):
            return False
    return True


def fold_requests(df: DataFrame, key: str, text: str, split: str, keep: list[str]) -> DataFrame:
    """(key, split, keep, class, text): class is the digest of a request's letters and digits alone.

    Null requests, requests without a letter or digit and rows without a split are left out.
    """

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_128_digest(s) if (s := LETTERS.sub("", fold(t))) else None for t in texts])

    rows = df.where(F.col(text).isNotNull() & F.col(split).isNotNull()).select(
        F.col(key).alias("id"), F.col(split).alias("split"), *keep, F.col(text).alias("text")
    )
    return rows.withColumn("class", digest("text")).where(F.col("class").isNotNull())


def class_pairs(rows: DataFrame, train: list[str], held: list[str]) -> DataFrame:
    """(held_class, train_class, coverage, chained): classes of different texts that are the same request."""
    texts = rows.groupBy("class").agg(
        F.min("text").alias("text"),  # of forms in other case, one with capitals
        F.max(F.col("split").isin(*train)).alias("t"),
        F.max(F.col("split").isin(*held)).alias("e"),
    )
    texts = materialise(texts.where("t or e"), "request-texts")
    rarity = pair_rarity(texts)
    shared = rows.sparkSession.sparkContext.broadcast(rarity)  # two arrays of 2^22 bytes

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            split = [words(fold(x)) for x in batch["text"]]
            chosen = [grams_of(ws, known) for ws in split]
            numbers = [quantities(ws) for ws in split]
            yield batch[["class", "t", "e"]].assign(
                hashes=[[h for h, _ in g] for g in chosen], places=[[p for _, p in g] for g in chosen], numbers=numbers
            )

    grams = texts.select("class", "text", "t", "e").mapInPandas(
        select, "class binary, t boolean, e boolean, hashes array<bigint>, places array<int>, numbers array<int>"
    )
    grams = grams.select("class", "t", "e", "numbers", F.explode(F.arrays_zip("hashes", "places")).alias("g"))
    grams = materialise(grams.select("class", "t", "e", "numbers", F.col("g.hashes").alias("hash"), F.col("g.places").alias("place")), "request-grams")
    ours = grams.where("e").select("hash", F.col("class").alias("held_class"), F.col("place").alias("pe"), F.col("numbers").alias("ne"))
    theirs = grams.where("t").select("hash", F.col("class").alias("train_class"), F.col("place").alias("pt"), F.col("numbers").alias("nt"))
    seeds = (
        ours.join(theirs, "hash")
        .where(F.col("held_class") != F.col("train_class"))
        .where((F.size("ne") == 0) | (F.size("nt") == 0) | F.arrays_overlap("ne", "nt"))  # align() gives 0 for others
        .groupBy("held_class", "train_class")
        .agg(F.collect_list(F.struct("pe", "pt")).alias("seeds"))  # of one pair of texts
    )
    named = lambda c: texts.select(F.col("class").alias(f"{c}_class"), F.col("text").alias(f"{c}_text"))
    seeds = seeds.join(named("held"), "held_class").join(named("train"), "train_class")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for e, t, seeds_, a, b in batch.itertuples(index=False):
                if (covered := align(a, b, known)) >= 1 - LEFT_OVER:
                    out.append((e, t, covered, chain([(s["pe"], s["pt"]) for s in seeds_])))
            yield pd.DataFrame(out, columns=["held_class", "train_class", "coverage", "chained"])

    return spread(seeds.select("held_class", "train_class", "seeds", "held_text", "train_text")).mapInPandas(
        verify, "held_class binary, train_class binary, coverage double, chained int"
    )


def split_overlaps(
    df: DataFrame,
    key: str = "example_id",
    text: str = "instruction",
    split: str = "split",
    source: str = "source",
    train: tuple[str, ...] = ("train",),
    held: tuple[str, ...] = ("val", "test"),
) -> DataFrame:
    """(held_id, held_split, held_source, train_id, train_source, coverage, chained): all pairs of a
    train row and a held-out row with the same request; coverage is the share of words aligned, chained
    the number of seeds in the longest collinear chain (0 for identical requests).

    Null requests, requests without letters or digits and rows of no or another split take no part;
    rows repeated under new ids give a pair each; a null source stays null; an empty table gives an
    empty one; columns not named are not read. Whole requests are compared, whatever their length.
    Classes of equal requests are compared once, so hot requests cost one comparison; their rows are
    joined at the end in SALTS parts.
    """
    rows = materialise(fold_requests(df, key, text, split, [F.col(source).alias("source")]), "requests")
    pairs = class_pairs(rows, list(train), list(held))
    held_rows = rows.where(F.col("split").isin(*held)).select(
        F.col("class").alias("held_class"), F.col("id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source")
    )
    train_rows = rows.where(F.col("split").isin(*train)).select(
        F.col("class").alias("train_class"), F.col("id").alias("train_id"), F.col("source").alias("train_source")
    )
    both = held_rows.select("held_class").distinct().join(
        train_rows.select(F.col("train_class").alias("held_class")).distinct(), "held_class"
    )
    pairs = pairs.unionByName(both.select("held_class", F.col("held_class").alias("train_class"), F.lit(1.0).alias("coverage"), F.lit(0).alias("chained")))
    salted = held_rows.join(pairs, "held_class").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        train_rows.withColumn("salt", F.pmod(F.xxhash64("train_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["train_class", "salt"])
        .select("held_id", "held_split", "held_source", "train_id", "train_source", "coverage", "chained")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and a val or test row with the same request."""
    found = split_overlaps(table(spark, sf_dir, "preference_examples"))
    return found.select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class, example_id, split, linked): every request with its class of identical texts, and with how many
    train and held-out classes of other texts its class is linked: membership, and pairs of
    representatives only, so a greeting repeated a million times is no product."""
    rows = materialise(fold_requests(table(spark, sf_dir, "preference_examples"), "example_id", "instruction", "split", []), "requests")
    pairs = class_pairs(rows, ["train"], ["val", "test"])
    ends = pairs.select(F.col("held_class").alias("class")).unionByName(pairs.select(F.col("train_class").alias("class")))
    links = ends.groupBy("class").agg(F.count(F.lit(1)).alias("linked"))
    joined = rows.select("class", "id", "split").join(links, "class", "left")
    return joined.select(F.hex("class").alias("class"), F.col("id").alias("example_id"), "split", F.coalesce("linked", F.lit(0)).alias("linked"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out split and source: pairs, rows that have one, and their mean best coverage."""
    found = split_overlaps(table(spark, sf_dir, "preference_examples"))
    best = found.groupBy("held_id", "held_split", "held_source").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("coverage").alias("best")
    )
    return best.groupBy(F.col("held_split").alias("split"), F.col("held_source").alias("source")).agg(
        F.sum("pairs").alias("pairs"),
        F.count(F.lit(1)).alias("rows_found"),
        F.round(F.avg("best"), 6).alias("mean_coverage"),
    )
