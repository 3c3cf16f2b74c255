"""How rare words, and pairs of words in sequence, are among texts: counts of all texts in arrays of fixed size."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.words import fold, words

#: Buckets of a table of counts as a power of two, and of those that one task packs. A table has 2^BITS
#: bytes whatever the number of texts; with more texts than buckets can tell apart only the rarest words
#: look less rare than they are.
BITS, BLOCK = 22, 14
#: Nats of rarity from which a word is informative, and that a word which no text has is given at least.
INFORMATIVE, UNSEEN = 2.5, 8.5
#: Steps of a stored count: code = STEPS log2(count + 1), so a count is kept to about a tenth.
STEPS = 5
VALUES = np.exp2(np.arange(256) / STEPS) - 1
LOGS = [0.0, *np.log(np.maximum(VALUES[1:], 1.0)).tolist()]
PAIR = 0x9E3779B1


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def bucket(word: str) -> int:
    return code(word) >> (32 - BITS)


def pair_bucket(before: int, after: int) -> int:
    """Of the codes of two words in sequence."""
    return ((before * PAIR + after) & 0xFFFFFFFF) * PAIR >> (64 - BITS) & ((1 << BITS) - 1)


class Rarity:
    """-log of the share of texts that have a word; what a word tells beyond the one before it."""

    def __init__(self, texts: int, ones: np.ndarray, twos: np.ndarray | None = None):
        self.texts, self.ones = max(texts, 1), ones.tobytes()
        self.twos = None if twos is None else twos.tobytes()
        #: Codes of counts up to which a bucket tells no more than chance does.
        noise = 2.0 if twos is None else max(2.0, 2 * float(VALUES[twos].sum()) / len(twos))
        self.noise = int(STEPS * math.log2(noise + 1))
        self.top = math.log(self.texts + 1)
        self.memory: dict[str, tuple[float, int]] = {}

    @staticmethod
    def from_counts(texts: int, counts: dict[str, int]) -> Rarity:
        """Of given counts of words; all others, and all pairs, are as rare as can be."""
        ones = np.zeros(1 << BITS, np.uint8)
        for w, n in counts.items():
            ones[bucket(w)] = round(STEPS * math.log2(n + 1))
        return Rarity(texts, ones, np.zeros(1 << BITS, np.uint8))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def look_up(self, word: str) -> tuple[float, int]:
        """Nats of rarity and code of a word; looked-up words are remembered."""
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) > 500_000:
                self.memory.clear()
            c = code(word)
            stored = self.ones[c >> (32 - BITS)]
            found = self.memory[word] = max(0.0 if stored else UNSEEN, self.top - LOGS[stored]), c
        return found

    def of(self, word: str) -> float:
        return self.look_up(word)[0]

    def told(self, known: list[tuple[float, int]]) -> list[float]:
        """Nats that each of some looked-up words adds to the one before it: all its own unless the pair is
        known to be frequent."""
        twos, noise, top = self.twos, self.noise, self.top
        beyond, before, code_before = [], 0.0, 0
        for own, code_ in known:
            x = own
            if beyond and (stored := twos[pair_bucket(code_before, code_)]) > noise:
                x = top - LOGS[stored] - before
                x = 0.0 if x < 0 else own if x > own else x
            beyond.append(x)
            before, code_before = own, code_
        return beyond

    def informative(self, ws: list[str]) -> list[str]:
        return [w for w in ws if self.of(w) >= INFORMATIVE]


def packed(rows: DataFrame, pack, kind: str) -> np.ndarray:  # noqa: ANN001
    """Rows with `block` made into one array of bytes: `pack` gives each block's bytes, all of one length.

    What reaches the driver is the finished array, whose size is fixed beforehand.
    """

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "bytes": [pack(group)]})

    found = rows.groupBy("block").applyInPandas(one, f"block {kind}, bytes binary").collect()
    return {r["block"]: np.frombuffer(bytes(r["bytes"]), np.uint8) for r in found}


def count_table(texts: DataFrame, known: Rarity | None) -> tuple[int, np.ndarray]:
    """Number of texts, and the codes of the counts of their words, or with `known` of their pairs of
    informative words. A text counts a word once. Counted by bucket in each task, then summed."""
    shared = texts.sparkSession.sparkContext.broadcast(known)  # 2^BITS bytes

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity = shared.value
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for t in batch["text"]:
                ws = words(fold(t))
                if rarity is not None:
                    known = [c for x, c in map(rarity.look_up, ws) if x >= INFORMATIVE]
                    ws = map(pair_bucket, known, known[1:])
                counts.update(set(ws))
                total += 1
        folded: Counter = Counter({-1: total})
        for w, c in counts.items():
            folded[bucket(w) if rarity is None else w] += c
        yield pd.DataFrame({"b": list(folded), "n": list(folded.values())}, dtype="int64")

    summed = texts.select("text").mapInPandas(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    blocks = summed.select(F.shiftright("b", BLOCK).cast("int").alias("block"), "b", "n")  # the total is in block -1

    def pack(group: pd.DataFrame) -> bytes:
        if group["b"].iloc[0] < 0:
            return int(group["n"].iloc[0]).to_bytes(8, "little")
        codes = np.zeros(1 << BLOCK, np.uint8)
        codes[group["b"].to_numpy() & ((1 << BLOCK) - 1)] = np.round(STEPS * np.log2(group["n"].to_numpy() + 1.0))
        return codes.tobytes()

    found = packed(blocks, pack, "int")
    table = np.zeros(1 << BITS, np.uint8)
    for block, codes in found.items():
        if block >= 0:
            table[block << BLOCK : (block + 1) << BLOCK] = codes
    return int.from_bytes(found[-1].tobytes(), "little") if -1 in found else 0, table


def word_rarity(texts: DataFrame) -> Rarity:
    """Of single words."""
    return Rarity(*count_table(texts, None))


def pair_rarity(texts: DataFrame) -> Rarity:
    """Of words and of pairs of informative words in sequence."""
    known = word_rarity(texts)
    return Rarity(known.texts, np.frombuffer(known.ones, np.uint8), count_table(texts, known)[1])
