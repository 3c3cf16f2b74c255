"""Near-duplicate documents by MinHash signatures, bands and connected components."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.layout import discard, materialise

EMPTY = (1 << 63) - 1
#: A bucket of more rows is joined in parts of so many.
PART_ROWS = 4096
PUNCTUATION, SPACES = re.compile(r"[^\w\s]"), re.compile(r"\s+")


def normalise(text: str) -> str:
    """Lower case, no punctuation, single blanks, NFD, no marks; in this order."""
    text = SPACES.sub(" ", PUNCTUATION.sub("", text.lower())).strip()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def shingle_hashes(text: str, n: int, unit: str) -> np.ndarray:
    """64-bit hashes of the distinct shingles of n words or characters; none if the text is shorter."""
    items = text.split() if unit == "word" else list(text)
    if len(items) < n:
        return np.zeros(0, np.uint64)
    if unit == "word":
        memory: dict[str, int] = {}
        codes = np.array([memory.setdefault(w, hash_word(w)) for w in items], np.uint64)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def hash_word(word: str) -> int:
    """FNV-1a over the bytes of a word."""
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def signatures(df: DataFrame, key: str, text: str, k: int = 64, n: int = 5, unit: str = "word", seed: int = 1) -> DataFrame:
    """(id, normal, n, signature array<bigint>): K seeded minima over n distinct shingles; EMPTY where a text
    has no shingle."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    @F.pandas_udf("struct<normal: string, n: bigint, signature: array<bigint>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            normal = [normalise(t or "") for t in texts]
            out, sizes = [], []
            for t in normal:
                h = shingle_hashes(t, n, unit)
                sizes.append(len(h))
                if not len(h):
                    out.append([EMPTY] * k)
                    continue
                best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
                for start in range(0, len(h), 4096):  # bounds the memory of very long texts
                    mixed = h[start : start + 4096, None] * factors + shifts
                    best = np.minimum(best, (mixed ^ (mixed >> np.uint64(29))).min(0))
                out.append((best >> np.uint64(1)).astype(np.int64).tolist())
            yield pd.DataFrame({"normal": normal, "n": sizes, "signature": out})

    return df.select(F.col(key).alias("id"), sign(F.col(text)).alias("s")).select("id", "s.normal", "s.n", "s.signature")


def md5_signatures(df: DataFrame, key: str, shingles: Column, k: int) -> DataFrame:
    """(id, n, signature): K minima of 60-bit heads of md5 digests of shingle and seed, inside the JVM.

    A portable form for checks in other engines. `shingles` is an array of distinct texts; without any, or
    if it is null, the signature is EMPTY.
    """

    def seeded(seed: str):  # noqa: ANN202
        return lambda x: F.conv(F.substring(F.md5(F.concat(x, F.lit(seed))), 1, 15), 16, 10).cast("bigint")

    least = [F.array_min(F.transform("__s", seeded(f"#{i}"))) for i in range(k)]
    rows = df.select(F.col(key).alias("id"), F.coalesce(shingles, F.array().cast("array<string>")).alias("__s"))
    return rows.select("id", F.size("__s").alias("n"), F.array(*[F.coalesce(c, F.lit(EMPTY)) for c in least]).alias("signature"))


def agreement(a, b):  # noqa: ANN001, ANN201
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


#: Texts whose numbers of shingles differ by more than this factor can't be near duplicates; with a size column
#: buckets are split by classes of this width.
WIDTH = 1.25


def candidate_pairs(signed: DataFrame, bands: int, size: str | None = None) -> DataFrame:
    """(a, b, estimate) with a < b for each pair of signatures that shares a band.

    `signed` has rep and signature. K must be a multiple of bands. A band's rows are compared as a whole,
    not by a hash alone. Rows alone in their bucket, nearly all, go no further. Given a column of sizes,
    pairs whose sizes are apart by more than WIDTH never meet: rows join inside a size class and with the
    next one. A bucket of more than PART_ROWS rows is joined in as many parts as it needs; others aren't
    copied.
    """
    k = F.size("signature")
    width = (k / bands).cast("int")
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    weight = F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / math.log(WIDTH)).cast("int") if size else F.lit(0)
    rows = signed.select("rep", "signature", width.alias("width"), weight.alias("weight"), band)
    rows = rows.select("rep", "band", "weight", F.expr("slice(signature, band * width + 1, width)").alias("key"))
    counts = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(counts, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / PART_ROWS))
    left = rows.select(F.col("rep").alias("a"), "band", "weight", "key", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))) if size else F.lit(0)
    right = rows.withColumn("step", near).select(
        F.col("rep").alias("b"), "band", (F.col("weight") + F.col("step")).alias("weight"), "key",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
    )
    pairs = left.join(right, ["band", "weight", "key", "part"]).where("a < b").select("a", "b").distinct()
    of = lambda c: signed.select(F.col("rep").alias(c), F.col("signature").alias(f"s{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("estimate"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component; vertices has id, edges a and b.

    Least labels are passed on until none changes, and each label is replaced by its own label, so long
    chains take few rounds. A round's labels are written to the shared folder, which cuts the lineage and
    survives lost executors; the round before is deleted.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = materialise(both, "edges")
    labels = materialise(vertices.select("id", F.col("id").alias("component")), "labels")
    while True:
        offered = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("offer"))
        joined = labels.join(offered, "id", "left")
        step = materialise(
            joined.select("id", F.least("component", F.coalesce("offer", "component")).alias("component"), F.col("component").alias("before")),
            "labels",
        )
        changed = step.where("component <> before").limit(1).count()
        discard(labels)
        if not changed:
            discard(both)
            return step.select("id", "component")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = materialise(step.select("id", "component").join(jump, "component").select("id", F.col("further").alias("component")), "labels")
        discard(step)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 64, bands: int = 16, threshold: float = 0.8,
    n: int = 5, unit: str = "word",
) -> DataFrame:
    """(key, cluster, links): a row for each document with its cluster's least id and its number of links.

    Documents of equal normalised texts are one representative and take part once; links counts them and
    the near duplicates of the representative. Texts without shingles (null, empty, shorter than n) all
    agree and are one cluster. Repeated keys give repeated rows; an empty table gives an empty one.
    """
    if k % bands:
        raise ValueError("K must be a multiple of the number of bands")
    signed = materialise(signatures(df, key, text, k, n, unit), "signatures")
    # one representative of equal texts; texts without shingles are one class, whatever they say
    group = F.when(F.col("n") == 0, F.lit("")).otherwise(F.col("normal"))
    return cluster(signed.select("id", F.md5(group).alias("class"), "n", "signature"), key, bands, threshold)


def cluster(signed: DataFrame, key: str, bands: int, threshold: float) -> DataFrame:
    """(key, cluster, links) of signed rows: id, class (of equal texts), n shingles, signature.

    Classes are compared once; then their members get the result back, so copies are never paired. At an
    estimate of 0.8 or more sizes differ by a fourth at most, so buckets are split by size.
    """
    reps = materialise(
        signed.groupBy("class").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")
        ),
        "representatives",
    )
    found_pairs = candidate_pairs(reps, bands, "n" if threshold >= 0.8 else None)
    pairs = materialise(found_pairs.where(F.col("estimate") >= threshold), "near-pairs")
    found = components(reps.select(F.col("rep").alias("id")), pairs)
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("o")).union(pairs.select("b", "a"))
    size = reps.select(F.col("rep").alias("o"), "copies")
    links = ends.join(size, "o").groupBy("rep").agg(F.sum("copies").alias("near"))
    all_reps = reps.select("class", "rep", "copies").join(found.withColumnRenamed("id", "rep"), "rep").join(links, "rep", "left")
    return signed.select("id", "class").join(all_reps, "class").select(
        F.col("id").alias(key), F.col("component").alias("cluster"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")
    )
