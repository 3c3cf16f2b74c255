"""Byte-pair tables, encoding and decoding with a given vocabulary.

Tokenizers are not trained here: counts, the best pair and the merge of a given pair are operators, the
training loop is left out.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import constants as C
from corpusmill.functions.text import pretokens, split_specials
from corpusmill.plans.layout import get, put

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def byte_table() -> dict[int, str]:
    """byte -> its printable stand-in in vocabulary files: itself where printable, else 256 on. A fixed table of
    the file format."""
    table, extra = {}, 0
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        table[b] = chr(b) if printable else chr(256 + extra)
        extra += not printable
    return table


def pretoken_counts(df: DataFrame, text: str = "text", specials: list[str] | None = None) -> DataFrame:
    """(pretoken, n): counts over all documents, combined before the shuffle; specials are dropped."""
    pieces = df.select(F.explode(split_specials(F.col(text), specials or [], keep=False)).alias("piece"))
    words = pieces.select(F.explode(pretokens(F.col("piece"))).alias("pretoken"))
    return words.groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, n): adjacent pieces as hex, weighted by the pre-token's count; counts has pretoken or pieces."""
    pieces = F.col("pieces") if "pieces" in counts.columns else byte_pieces(F.col("pretoken"))
    rows = counts.select("n", pieces.alias("b")).where(F.size("b") > 1)
    pairs = rows.select("n", F.explode(F.arrays_zip(F.expr("slice(b, 1, size(b) - 1)").alias("l"), F.expr("slice(b, 2, size(b) - 1)").alias("r"))).alias("p"))
    return pairs.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equal ones the largest bytes."""
    return pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(1)


def highest_ids(tokens: DataFrame) -> DataFrame:
    """(token, id): of tokens with equal bytes the highest id; the way back from bytes to ids."""
    return tokens.groupBy("token").agg(F.max("id").alias("id"))


def merge_pair(counts: DataFrame, left: str, right: str) -> DataFrame:
    """(pieces array<string>, n): pre-tokens as pieces of hex bytes in which a given pair is merged, from
    left to right without overlaps.

    counts has pretoken and n, or pieces and n from an earlier merge. An expression inside the JVM.
    """
    if "pieces" not in counts.columns:
        counts = counts.select(byte_pieces(F.col("pretoken")).alias("pieces"), "n")
    merged = F.aggregate(
        "pieces",
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("fresh")),
        lambda a, x: F.when(
            (F.size(a["done"]) > 0) & ~a["fresh"] & (x == right) & F.coalesce(F.try_element_at(a["done"], F.lit(-1)) == left, F.lit(False)),
            F.struct(F.concat(F.slice(a["done"], 1, F.size(a["done"]) - 1), F.array(F.lit(left + right))).alias("done"), F.lit(True).alias("fresh")),
        ).otherwise(F.struct(F.concat(a["done"], F.array(x)).alias("done"), F.lit(False).alias("fresh"))),
    )["done"]
    return counts.select(merged.alias("pieces"), "n")


def byte_pieces(text: Column) -> Column:
    """The utf-8 bytes of a text, each as two hex digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))


def initial_vocabulary(spark: SparkSession, specials: list[str], size: int = 1 << 30) -> DataFrame:
    """(id, token binary): the 256 bytes, then the special tokens, repeated ones once, up to `size` entries."""
    rows = [(i, bytes([i])) for i in range(256)]
    for s in specials:
        if len(rows) >= size:
            break
        if s.encode() not in {t for _, t in rows}:
            rows.append((len(rows), s.encode()))
    return spark.createDataFrame(rows, "id int, token binary")


def local_path(path: str) -> str:
    """A vocabulary's path on this machine: as given, or where addFile() put it."""
    return path if "://" in path or os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def load(path: str, merges: str | None = None) -> tuple[dict[str, int], dict[tuple[str, str], int]]:
    """Token -> id and pair -> rank of a vocabulary: one file with both, or a file of ids and one of merges
    by line.

    Of the merges only a first line that starts with #version is a header; blank lines and lines of other
    than two tokens are skipped.
    """
    vocab = json.loads(get(local_path(path)))
    if merges is None:
        vocab, pairs = vocab["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in vocab["model"]["merges"]]
    else:
        rows = [line.rstrip("\r").split(" ") for line in get(local_path(merges)).decode().split("\n")]
        pairs = [tuple(r) for i, r in enumerate(rows) if len(r) == 2 and all(r) and not (i == 0 and r[0].startswith("#version"))]
    return vocab, {m: i for i, m in enumerate(pairs)}


def write_vocabulary(vocab: dict[str, int], ranks: dict[tuple[str, str], int], folder: str) -> tuple[str, str]:
    """A file of ids and one of merges, without loss; their paths."""
    paths = f"{folder}/vocab.json", f"{folder}/merges.txt"
    put(paths[0], json.dumps(vocab, ensure_ascii=False).encode())
    put(paths[1], ("#version: 1\n" + "".join(f"{a} {b}\n" for a, b in sorted(ranks, key=ranks.get))).encode())
    return paths


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, token binary); of equal token bytes the highest id is kept."""
    back = {c: b for b, c in byte_table().items()}
    rows = [(i, bytes(back[c] for c in t)) for t, i in load(path)[0].items() if all(c in back for c in t)]
    return highest_ids(spark.createDataFrame(rows, "id int, token binary")).select("id", "token")


def encode_word(word: str, vocab: dict[str, int], ranks: dict[tuple[str, str], int], table: dict[int, str]) -> list[int]:
    """Merges of lowest rank first, of equal ones the leftmost, by a queue over linked pieces."""
    parts: list[str | None] = [table[b] for b in word.encode("utf-8", "surrogatepass")]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if parts[i] != a or j >= len(parts) or parts[j] != b:
            continue  # one of them is merged already
        parts[i], parts[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(queue, (r, i, parts[i], parts[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get((parts[k], parts[i]))) is not None:
            heapq.heappush(queue, (r, k, parts[k], parts[i]))
    return [vocab[p] for p in parts if p is not None]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", specials: dict[str, int] | None = None, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): special tokens become their ids, all else the merges of lowest rank first.

    Null and empty texts give an empty array. Pre-tokens are cut inside the JVM; each worker remembers
    the encodings of the pre-tokens it has seen.
    """
    specials = specials or {}

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {s: [i] for s, i in specials.items()}
        table, (vocab, ranks) = byte_table(), load(path)
        for pieces in batches:
            out = []
            for words in pieces:
                ids: list[int] = []
                for w in words if words is not None else ():
                    if w not in known:
                        if len(known) > 500_000:
                            known = {s: [i] for s, i in specials.items()}
                        known[w] = encode_word(w, vocab, ranks, table)
                    ids += known[w]
                out.append(ids)
            yield pd.Series(out)

    pieces = split_specials(F.col(text), list(specials))
    special = F.array(*[F.lit(s) for s in specials]) if specials else F.array().cast("array<string>")
    words = F.flatten(F.transform(pieces, lambda p: F.when(F.array_contains(special, p), F.array(p)).otherwise(pretokens(p, C.PRETOKEN))))
    return df.select(F.col(key), run(F.coalesce(words, F.array().cast("array<string>"))).alias("ids"))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", specials: dict[str, int] | None = None, path: str = VOCABULARY) -> DataFrame:
    """(key, text): bytes of the ids joined, invalid utf-8 replaced; an unknown id gives <unk>."""
    extra = {i: s.encode() for s, i in (specials or {}).items()}

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = {c: b for b, c in byte_table().items()}
        token = {i: bytes(back[c] for c in t) for t, i in load(path)[0].items() if all(c in back for c in t)} | extra
        for rows in batches:
            yield pd.Series([b"".join(token.get(i, b"<unk>") for i in r).decode("utf-8", "replace") if r is not None else None for r in rows])

    return df.select(F.col(key), run(F.col(ids)).alias("text"))
