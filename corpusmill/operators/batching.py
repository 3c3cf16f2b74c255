"""Orders, splits, batches and packing. All random choices are hashes of a key, so they can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.plans.layout import materialise

#: Rows that one task puts in order when global positions are added up; the number of parts follows.
PART_ROWS = 200_000


def shuffled(key: Column, seed: int = 42) -> Column:
    """The sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")))


def positions(df: DataFrame, order: Column, ties: list[str], weight: Column | None = None, rows: int | None = None) -> DataFrame:
    """df with `position`: the sum of the weights (1 each) before a row in the given order of hex digests,
    then of the columns `ties`.

    Added up in two steps, within parts by the digest's head and over the parts' sums, so that no task
    orders everything; digests are spread evenly, and the number of parts follows the number of rows.
    """
    parts = max(1, -(-(df.count() if rows is None else rows) // PART_ROWS))
    head = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    return add_up(df.withColumn("__part", F.expr("0L") + F.floor(head * parts / (1 << 32)).cast("bigint")), [order, *map(F.col, ties)], weight)


def add_up(df: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """df, whose parts `__part` follow each other, with `position`; `__part` is taken away."""
    rows = df.withColumn("__w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint"))
    sums = rows.groupBy("__part").agg(F.sum("__w").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sums = sums.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
        .join(sums, "__part")
        .withColumn("position", F.col("__in") + F.col("__offset"))
        .drop("__part", "__w", "__in", "__offset")
    )


def split_by_ratio(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """df with split: the first floor(n ratio) rows of the shuffle are val, the others train."""
    n = df.count()
    placed = positions(df, shuffled(F.col(key), seed), [key], rows=n)
    return placed.withColumn("split", F.when(F.col("position") < int(n * ratio), "val").otherwise("train")).drop("position")


def split_by_count(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """df with split: `size` rows are val; raises if there aren't more rows than that."""
    n = df.count()
    if n <= size:
        raise ValueError(f"{n} rows can't give {size} for validation and some for training")
    placed = positions(df, shuffled(F.col(key), seed), [key], rows=n)
    return placed.withColumn("split", F.when(F.col("position") < size, "val").otherwise("train")).drop("position")


def cap(df: DataFrame, key: str, limit: int, seed: int = 42) -> DataFrame:
    """A seeded sample of at most `limit` rows; all rows if it is not above 0."""
    return df if limit <= 0 else df.orderBy(shuffled(F.col(key), seed), key).limit(limit)


def sample_prompts(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows with `draw`: without repeats if there are enough rows, else round after round."""
    n = df.count()
    if n == 0:
        return df.withColumn("draw", F.lit(0).cast("bigint"))
    placed = positions(df, shuffled(F.col(key), seed), [key], rows=n)
    rounds = -(-size // n)
    many = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return many.withColumn("draw", F.col("position") + F.col("round") * n).where(F.col("draw") < size).drop("position", "round")


def minibatches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """(batch, keys): shuffled slices of `size`; the last may be shorter."""
    placed = positions(df.select(key), shuffled(F.col(key), seed), [key])
    grouped = placed.groupBy(F.expr(f"position div {size}").alias("batch"))
    keys = F.array_sort(F.collect_list(F.struct("position", key)))  # `size` rows
    return grouped.agg(F.transform(keys, lambda x: x[key]).alias("keys"))


def stream_positions(df: DataFrame, key: str, ids: str, seed: int | None = None) -> DataFrame:
    """(key, ids, position): where each sequence starts in one stream, in the key's order or a seeded shuffle.

    In the key's order parts are ranges of keys with about as many rows each, whatever the keys' values.
    """
    rows = df.select(key, F.col(ids).alias("ids"))
    if seed is not None:
        return positions(rows, shuffled(F.col(key), seed), [key], F.size("ids"))
    parts = max(1, -(-rows.count() // PART_ROWS))
    ranged = rows.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id().cast("bigint"))
    return add_up(materialise(ranged, "ranges"), [F.col(key), F.col("ids")], F.size("ids"))


def pack(df: DataFrame, key: str, ids: str, length: int, bos: int, eos: int, seed: int | None = None) -> DataFrame:
    """(chunk, input_ids, labels): all sequences as bos + ids + eos in one stream, cut into chunks of
    `length` tokens with labels shifted by one; the tail that fills no chunk is dropped.

    Null and empty sequences count as bos + eos. The stream's order is the key's, or a seeded shuffle.
    Sequences stay arrays: each gives one slice to each chunk it reaches.
    """
    full = F.concat(F.array(F.lit(bos)), F.coalesce(F.col(ids), F.array().cast("array<int>")), F.array(F.lit(eos)))
    placed = stream_positions(df.select(key, full.alias("ids")), key, "ids", seed)
    # a token at a border is the last label of the chunk before, too
    low = F.expr(f"greatest(position - 1, 0L) div {length}")
    chunk = F.explode(F.sequence(low, F.expr(f"(position + size(ids) - 1) div {length}")))
    reached = placed.withColumn("chunk", chunk)
    start = F.greatest(F.col("position"), F.col("chunk") * length)
    end = F.least(F.col("position") + F.size("ids"), (F.col("chunk") + 1) * length + 1)
    part = F.slice("ids", (start - F.col("position") + 1).cast("int"), (end - start).cast("int"))
    grouped = reached.select("chunk", F.struct(start.alias("at"), part.alias("part")).alias("s")).groupBy("chunk")
    whole = grouped.agg(F.flatten(F.array_sort(F.collect_list("s")).getField("part")).alias("t")).where(F.size("t") == length + 1)
    return whole.select("chunk", F.slice("t", 1, length).alias("input_ids"), F.slice("t", 2, length).alias("labels"))


def lm_batches(stream: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """(row, x, y): `length` tokens from each start, y one place further. stream has at and token, starts
    row and start; both sides meet by chunk, so no range join is needed."""
    wide = F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + {length}) div {length}"))).alias("chunk")
    asked = starts.select("row", "start", wide)
    near = stream.withColumn("chunk", F.expr(f"at div {length}")).join(asked, "chunk")
    near = near.where((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("start") + length))
    grouped = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    values = F.transform("t", lambda x: x["token"])
    return grouped.where(F.size("t") == length + 1).select("row", F.slice(values, 1, length).alias("x"), F.slice(values, 2, length).alias("y"))


def random_starts(n: int, length: int, step: int, seed: int = 42) -> Column:
    """Hash-drawn start of `row` in [0, n - length - 1); the last valid start is left out. The hash is the head
    of an md5 digest, which other engines have, too."""
    name = F.concat(F.lit(f"{seed}|{step}|"), F.col("row").cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint"), F.lit(n - length - 1))


def sequential_starts(batch: int, mode: str = "corrected") -> Column:
    """Start of `row` in validation; mode "reference" gives all rows of a batch the same start."""
    return F.col("row") if mode == "corrected" else F.expr(f"(row div {batch}) * {batch}")


def batch_count(tokens: Column, batch: int) -> Column:
    """Whole batches in a number of tokens."""
    return F.floor(tokens / batch).cast("bigint")


def pad_pairs(df: DataFrame, key: str, prompt: str, response: str, pad: int, batch: str | None = None) -> DataFrame:
    """(key, input_ids, labels, response_mask): prompt + response padded to the longest row of its batch,
    input without the last place, labels without the first, and a mask of the places whose label is of the
    response. Without a column `batch` all rows are one batch. A null side counts as empty.
    """
    none = F.array().cast("array<int>")
    rows = df.select(key, F.col(batch).alias("__b") if batch else F.lit(0).alias("__b"),
                     F.coalesce(prompt, none).alias("__p"), F.coalesce(response, none).alias("__r"))
    longest = rows.groupBy("__b").agg(F.max(F.size("__p") + F.size("__r")).alias("__n"))
    rows = rows.alias("l").join(longest.alias("m"), F.col("l.__b").eqNullSafe(F.col("m.__b")))
    gap = F.col("__n") - F.size("__p") - F.size("__r")
    full = F.concat("__p", "__r", F.array_repeat(F.lit(pad), gap))
    flags = lambda value, n: F.array_repeat(F.lit(value), n)
    mask = F.concat(flags(False, F.size("__p")), flags(True, F.size("__r")), flags(False, gap))
    n = F.greatest(F.col("__n") - 1, F.lit(0))
    return rows.select(
        key, F.slice(full, F.lit(1), n).alias("input_ids"), F.slice(full, F.lit(2), n).alias("labels"), F.slice(mask, F.lit(2), n).alias("response_mask")
    )


def check_batches(train_batch: int, accumulation: int, rollout_batch: int, group: int) -> dict[str, int]:
    """Sizes that follow from a run's batch settings; raises where they don't divide."""
    for what, a, b in (("train batch", train_batch, accumulation), ("rollout batch", rollout_batch, group), ("rollout batch", rollout_batch, train_batch)):
        if b < 1 or a % b:
            raise ValueError(f"{what} {a} is not divisible by {b}")
    if train_batch < group:
        raise ValueError(f"train batch {train_batch} is smaller than a group of {group}")
    return {"microbatch": train_batch // accumulation, "prompts": rollout_batch // group, "updates": rollout_batch // train_batch}


def parse_steps(text: str, steps: int) -> set[int]:
    """"1,50" as numbers; a blank text gives the first, middle and last step."""
    if not text.strip():
        return {1, max(1, steps // 2), steps}
    return {int(x) for x in text.split(",") if x.strip()}
