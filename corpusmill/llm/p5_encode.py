"""Problem 5: encoding of a corpus with a byte-level BPE vocabulary.

Method: the distinct words of a batch are put into a trie of bytes. A depth-first walk gives
every node its last-token state: the last token of the encoding of the bytes up to the node.
That token is unique, so the encoding of a word is read off by jumping back from its node by
the length of the last token. Prefixes that words share are computed once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.bpe import byte_table, local_path
from corpusmill.plans.layout import get, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The pre-token pattern of byte-level BPE vocabularies of this family (a fixed value).
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words a Python worker remembers between batches; beyond it the memory is emptied
#: (only speed depends on it).
REMEMBERED = 400_000


class TrieEncoder:
    """Encodes words by a depth-first walk over their trie."""

    def __init__(self, path: str = VOCABULARY):
        model = json.loads(get(local_path(path)))["model"]
        back = {letter: byte for byte, letter in byte_table().items()}
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in back for c in s)}
        self.longest = max(map(len, self.ids))
        self.merge: dict[tuple[int, int], int] = {}  # pair of ids -> rank
        born = {}  # id -> (rank, left id, right id) of the merge that makes it
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = rank
            born.setdefault(made, (rank, left, right))
        self.born = born
        self.size = {i: len(b) for b, i in self.ids.items()}
        self.by_tail: dict[int, list[tuple[int, bytes]]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits_cache: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PRETOKEN).findall

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the right (side 1) or left (0) end of `token` while it is being built, with
        the rank of the merge that absorbs each."""
        found = self.edges[side].get(token)
        if found is None:
            found, end, t = [(token, float("inf"))], 0.0, token
            while t in self.born:
                end, left, right = self.born[t]
                t = right if side else left
                found.append((t, end))
            self.edges[side][token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b can stand side by side: no merge crosses the border between them.

        A merge of rank r crosses if both its parts stand at the border before they are absorbed
        themselves. With equal ranks the merge further left comes first.
        """
        known = self.fits_cache.get((a, b))
        if known is None:
            known = not any(
                (rank := self.merge.get((x, y))) is not None and rank < end_x and rank <= end_y
                for x, end_x in self.edge(a, 1)
                for y, end_y in self.edge(b, 0)
            )
            if len(self.fits_cache) > 2_000_000:
                self.fits_cache.clear()
            self.fits_cache[a, b] = known
        return known

    def encode_words(self, distinct: list[str]) -> None:
        """Put the encodings of all words of `distinct` into self.known."""
        root: list = [{}, None]  # children, words that end here
        for word in distinct:
            node = root
            for byte in word.encode("utf-8", "surrogatepass"):
                node = node[0].setdefault(byte, [{}, None])
            node[1] = word
        ids, fits, longest = self.ids, self.fits, self.longest
        last, text = [-1], bytearray()  # last-token state by depth; bytes on the path
        # a stack of (depth, byte, node); -1 marks nothing on the path yet
        stack = [(1, byte, child) for byte, child in root[0].items()]
        while stack:
            depth, byte, node = stack.pop()
            del text[depth - 1 :], last[depth:]
            text.append(byte)
            state = -1
            for n in range(min(depth, longest), 0, -1):
                t = ids.get(bytes(text[depth - n :]))
                if t is not None and (n == depth or fits(last[depth - n], t)):
                    # a token of one piece from the start is an encoding only if merges build it
                    if n > 1 and t not in self.born:
                        continue
                    state = t
                    break
            last.append(state)
            if node[1] is not None:
                out, at = [], depth
                while at:
                    out.append(last[at])
                    at -= self.size[last[at]]
                self.known[node[1]] = tuple(reversed(out))
            stack += [(depth + 1, b, child) for b, child in node[0].items()]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null and empty texts give an empty list."""
        pieces = [self.split(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for p in pieces for w in p if w not in known}
        if new:
            self.encode_words(list(new))
        return [[i for w in p for i in known[w]] for p in pieces]


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> TrieEncoder:
    """One encoder for each Python worker."""
    return TrieEncoder(path)


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(key, ids array<int>): the token ids of each row's whole text, without special tokens.

    Null and empty texts give an empty array, blank texts are encoded as they are; repeated keys
    and null keys keep their rows. Other columns are not read. An empty table gives an empty one.
    The batches go through Arrow once; there is no shuffle, and each worker keeps one trie's
    results, so a word is encoded about once a worker whatever its frequency.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = enc.encode(batch.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    return (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens bigint (0 for null and empty texts), by the same trie."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n = len(keep)
            counts = pa.array([len(x) for x in enc.encode(batch.column(n).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], counts], names=[*keep, "n_tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, n_tokens bigint")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), vocabulary=os.environ.get("BYTE_BPE_50K", VOCABULARY))
