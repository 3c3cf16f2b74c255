"""Problem 6: mixing sources to target weights.

Method: the documents of a source, in pseudorandom order, form one stream of tokens that is cut into
blocks of fixed length; the last block of a source may be shorter. A mix has as many tokens as its
scarcest source allows; each source owns its share of them, as slots for blocks. The counts of sources in
each output shard are a multinomial draw given the totals, so the totals are met. A source's slots go
through pseudorandom permutations of its block indices, a new one each round, so a block is used at most
max_repeats times. Blocks are then joined by index with the pieces of documents in them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.p5_encode import token_counts
from corpusmill.plans.layout import materialise, table

#: Tokens of a block. What a source reaches differs from its target by a block at most.
LENGTH = 128
#: Documents of a source that one task puts in order; a source has as many parts as it needs.
PART_ROWS = 200_000
#: Slots of an output shard.
SHARD = 1024


# ---------------------------------------------------------------- permutations
def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """Numbers scrambled by a key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def permute(k: np.ndarray, n: int, name: str) -> np.ndarray:
    """The places of k under a pseudorandom permutation of [0, n), which the name chooses.

    A Feistel network of four rounds over the least even number of bits that hold n; what falls outside
    goes through it again.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [zlib.crc32(f"{name} {r}".encode()) | zlib.crc32(f"{r} {name}".encode()) << 32 for r in range(4)]
    out = k.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for key in keys:
            left, right = right, left ^ (mixed(right, key) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


# ---------------------------------------------------------------- streams
def source_streams(documents: DataFrame, targets: DataFrame, part_rows: int = PART_ROWS, **tokens: str) -> DataFrame:
    """(source, doc_id, n_tokens, start): where each document stands in its source's stream.

    Only documents of listed sources are counted. Offsets are added up in two steps, within parts of a
    source and over the parts; the number of parts follows the source's documents, so no task orders
    more than some `part_rows` of them.
    """
    listed = targets.where("source is not null").select("source").distinct()
    wanted = documents.select("doc_id", "source", "text").join(F.broadcast(listed), "source", "left_semi")  # a list of sources
    sized = token_counts(wanted, ["doc_id", "source"], **tokens).where("n_tokens > 0").withColumn("order", F.xxhash64("doc_id", F.lit(6)))
    sized = materialise(sized, "mix-sizes")
    rows = {r["source"]: r["count"] for r in sized.groupBy("source").count().collect()}  # one row a listed source
    if not rows:
        return sized.select("source", "doc_id", "n_tokens", F.lit(0).cast("bigint").alias("start"))
    parts = F.create_map(*[x for s, n in rows.items() for x in (F.lit(s), F.lit(-(-n // part_rows)))])
    sized = sized.withColumn("part", F.pmod("order", parts[F.col("source")].cast("bigint")))
    sums = sized.groupBy("source", "part").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(sums, ["source", "part"])
        .select("source", "doc_id", "n_tokens", (F.col("offset") + F.col("within")).alias("start"))
    )


# ---------------------------------------------------------------- plans
def read_targets(targets: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """mix -> source -> (share, repeats) of the small table of targets.

    Rows with a null mix, source, share or repeats don't count; of a source listed twice in a mix the
    shares add up and the smaller number of repeats holds.
    """
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_id", "source", "target_share", "max_repeats").collect():
        if None in (r["mix_id"], r["source"], r["target_share"], r["max_repeats"]):
            continue
        share, repeats = mixes.setdefault(r["mix_id"], {}).get(r["source"], (0.0, r["max_repeats"]))
        mixes[r["mix_id"]][r["source"]] = share + float(r["target_share"]), min(repeats, r["max_repeats"])
    return mixes


def plan_mixes(mixes: dict[str, dict[str, tuple[float, int]]], sizes: dict[str, int], length: int = LENGTH) -> dict[str, dict[str, tuple[int, int]]]:
    """mix -> source -> (slots, blocks).

    Sources without tokens, and those whose share or repeats aren't above 0, get no slots, and the others
    keep their shares in proportion; every other source gets one at least, however small it is.
    """
    plan = {}
    for mix, wanted in sorted(mixes.items()):
        there = {s: x for s, x in sorted(wanted.items()) if x[0] > 0 and x[1] > 0 and sizes.get(s, 0) > 0}
        tokens = min((r * sizes[s] / w for s, (w, r) in there.items()), default=0.0)  # of a share of 1
        plan[mix] = {}
        for s, (w, r) in there.items():
            blocks = -(-sizes[s] // length)
            wanted_blocks = w * tokens * blocks / sizes[s]
            plan[mix][s] = min(max(1, round(wanted_blocks)), r * blocks), blocks
    return plan


@lru_cache(maxsize=4096)
def split_counts(counts: tuple[int, ...], take: int, name: str) -> tuple[int, ...]:
    """How many of each source are among `take` slots drawn without replacement from `counts`.

    Beyond a thousand million slots a draw is rounded from the normal law that it follows there.
    """
    rng = np.random.default_rng([zlib.crc32(name.encode()), zlib.crc32(name[::-1].encode())])
    left, rest, out = sum(counts), take, []
    for n in counts:
        left -= n
        if rest == 0 or n == 0:
            got = 0
        elif left == 0:
            got = rest
        elif n + left < 10**9:
            got = int(rng.hypergeometric(n, left, rest))
        else:
            p, all_ = n / (n + left), n + left
            got = round(rng.normal(rest * p, (rest * p * (1 - p) * (all_ - rest) / (all_ - 1)) ** 0.5))
            got = min(max(got, rest - left, 0), n, rest)
        out.append(got)
        rest -= got
    return tuple(out)


def shard_counts(counts: tuple[int, ...], shards: int, shard: int, name: str) -> tuple[list[int], list[int]]:
    """(slots of each source in earlier shards, slots of each in this one).

    The slots are halved down to the shard by draws without replacement: the law of independent
    multinomial shards given their totals. No task needs the shards before it.
    """
    before, first, last = [0] * len(counts), 0, shards
    while last - first > 1:
        middle = (first + last) // 2
        low = split_counts(counts, min(sum(counts), (middle - first) * SHARD), f"{name} {first} {last}")
        if shard < middle:
            counts, last = low, middle
        else:
            before = [a + b for a, b in zip(before, low)]
            counts, first = tuple(a - b for a, b in zip(counts, low)), middle
    return before, list(counts)


def draw_slots(spark: SparkSession, plan: dict[str, dict[str, tuple[int, int]]]) -> DataFrame:
    """(mix_id, shard, place, source, block): every slot with its block and place; shards are drawn by themselves."""
    todo = []
    for mix, sources in plan.items():
        shards = -(-sum(n for n, _ in sources.values()) // SHARD)
        if shards:
            todo.append(spark.range(shards).select(F.lit(mix).alias("mix_id"), F.col("id").alias("shard")))
    schema = "mix_id string, shard bigint, place int, source string, block bigint"
    if not todo:
        return spark.createDataFrame([], schema)
    rows = todo[0]
    for more in todo[1:]:
        rows = rows.unionByName(more)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mix, shard in batch.itertuples(index=False):
                sources = plan[mix]
                counts = tuple(n for n, _ in sources.values())
                shards = -(-sum(counts) // SHARD)
                before, here = shard_counts(counts, shards, shard, mix)
                places = permute(np.arange(sum(here)), sum(here), f"{mix} shard {shard}")
                out, done = [], 0
                for (source, (_, blocks)), first, n in zip(sources.items(), before, here):
                    k = np.arange(first, first + n)
                    block = np.empty(n, np.int64)
                    for turn in np.unique(k // blocks):  # a new permutation each round through the blocks
                        now = k // blocks == turn
                        block[now] = permute(k[now] % blocks, blocks, f"{mix} {source} round {turn}")
                    out.append(pd.DataFrame({"mix_id": mix, "shard": shard, "place": places[done : done + n].astype("int32"), "source": source, "block": block}))
                    done += n
                yield pd.concat(out)

    return rows.mapInPandas(draw, schema)


def cut_pieces(streams: DataFrame, length: int = LENGTH) -> DataFrame:
    """(source, block, doc_id, n_tokens, from_token, to_token): parts of documents by block."""
    first, last = F.expr(f"start div {length}"), F.expr(f"(start + n_tokens - 1) div {length}")
    pieces = streams.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * length - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * length - F.col("start"), F.col("n_tokens"))
    return pieces.select("source", "block", "doc_id", "n_tokens", low.alias("from_token"), high.alias("to_token"))


def prepare(documents: DataFrame, targets: DataFrame, length: int, **tokens: str) -> tuple[DataFrame, dict]:
    """Streams (written) and plan."""
    streams = materialise(source_streams(documents, targets, **tokens), "mix-streams")
    sizes = {r["source"]: r["n"] for r in streams.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return streams, plan_mixes(read_targets(targets), sizes, length)


def mix_selection(documents: DataFrame, targets: DataFrame, length: int = LENGTH, **tokens: str) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, copies, tokens_used): the documents that each mix uses.

    copies is how often a document's most used token occurs, at most max_repeats; tokens_used counts
    all its tokens with repeats. Null and empty texts, null sources and sources that no mix lists are
    never used; texts repeated under other ids count as documents of their own; clashing further
    columns are not read. Empty documents or targets give an empty selection.
    """
    streams, plan = prepare(documents, targets, length, **tokens)
    uses = draw_slots(documents.sparkSession, plan).groupBy("mix_id", "source", "block").agg(F.count(F.lit(1)).alias("uses"))
    return (
        cut_pieces(streams, length)
        .join(uses.hint("merge"), ["source", "block"])  # both sides grow with the corpus
        .groupBy("mix_id", "source", "doc_id", "n_tokens")
        .agg(F.max("uses").alias("copies"), F.sum(F.col("uses") * (F.col("to_token") - F.col("from_token"))).alias("tokens_used"))
    )


def mix_blocks(documents: DataFrame, targets: DataFrame, length: int = LENGTH, **tokens: str) -> DataFrame:
    """(mix_id, shard, place, source, block, doc_id, from_token, to_token): the mixes block by block."""
    streams, plan = prepare(documents, targets, length, **tokens)
    return (
        draw_slots(documents.sparkSession, plan)
        .join(cut_pieces(streams, length), ["source", "block"])
        .select("mix_id", "shard", "place", "source", "block", "doc_id", "from_token", "to_token")
    )


def mix_shares(documents: DataFrame, targets: DataFrame, length: int = LENGTH, **tokens: str) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, documents, most_copies, tokens_used, actual_share):
    what each source of a mix reaches; a source that is not there reaches 0."""
    used = mix_selection(documents, targets, length, **tokens).groupBy("mix_id", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.sum("tokens_used").alias("tokens_used")
    )
    joined = targets.select("mix_id", "source", "target_share", "max_repeats").join(F.broadcast(used), ["mix_id", "source"], "left")  # a row a target
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = joined.select("mix_id", "source", "target_share", "max_repeats", zero("documents"), zero("most_copies"), zero("tokens_used"))
    total = F.sum("tokens_used").over(Window.partitionBy("mix_id"))
    share = F.coalesce(F.try_divide(F.col("tokens_used"), total), F.lit(0.0))
    return joined.withColumn("actual_share", F.round(share, 6))


def p6_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that each mix uses."""
    return mix_selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes block by block, by output shard."""
    return mix_blocks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that sources really reach."""
    return mix_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
