"""Mixes reach their shares, use no block too often, and keep documents whole in sum."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import p6_mixing as P

TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def corpus(spark):
    rows = [(i, f"word{i} and some more text to count here " * (1 + i % 7), "big" if i % 3 else "small") for i in range(400)]
    rows += [(1000, None, "big"), (1001, "", "big"), (1002, "lost text", None), (1003, "unlisted text", "else"), (1004, rows[0][1], "small")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("block", F.lit(1)).withColumn("start", F.lit(1))


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "absent", 0.1, 5), ("n", "small", 1.0, 2), ("o", None, 1.0, 1)], TARGETS)
    docs = corpus(spark)
    shares = {(r["mix_id"], r["source"]): r for r in P.mix_shares(docs, targets).collect()}
    assert abs(shares["m", "big"]["actual_share"] - 5 / 9) < 0.01 and abs(shares["m", "small"]["actual_share"] - 4 / 9) < 0.01
    assert shares["m", "absent"]["tokens_used"] == 0 and shares["n", "small"]["actual_share"] == 1.0
    assert shares["m", "big"]["most_copies"] <= 1 and shares["m", "small"]["most_copies"] <= 3
    chosen = P.mix_selection(docs, targets).collect()
    assert not {r["doc_id"] for r in chosen} & {1000, 1001, 1002, 1003}
    assert all(r["tokens_used"] <= r["copies"] * r["n_tokens"] for r in chosen)
    blocks = P.mix_blocks(docs, targets).collect()
    places, size = Counter(), defaultdict(int)
    for r in blocks:
        size[r["mix_id"], r["shard"], r["place"]] += r["to_token"] - r["from_token"]
        places[r["mix_id"], r["shard"], r["place"], r["source"]] += 1
    lengths = Counter(size.values())
    assert max(lengths, key=lengths.get) == P.LENGTH and max(lengths) == P.LENGTH  # the last block of a source is shorter
    assert sum(1 for n in size.values() if n < P.LENGTH) <= 2 * (1 + 3 + 2)
    used = defaultdict(int)
    for r in blocks:
        used[r["mix_id"], r["source"]] += r["to_token"] - r["from_token"]
    assert all(used[k] == shares[k]["tokens_used"] for k in used)


def test_permutation():
    for n in (1, 2, 3, 10, 97, 1024, 5000):
        orders = [P.permute(np.arange(n), n, f"x round {turn}").tolist() for turn in range(2)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        if n > 50:  # the next round is another order, not the same one turned
            steps = [Counter((b - a) % n for a, b in zip(o, o[1:])).most_common(1)[0][1] for o in orders]
            assert orders[0] != orders[1] and max(steps) < n / 10
            shifts = Counter((a - b) % n for a, b in zip(*orders))
            assert shifts.most_common(1)[0][1] < n / 5


def test_shards_are_draws_with_fixed_totals():
    counts, shards = (70_000, 25_000, 5_000, 240), 98
    drawn = [P.shard_counts(counts, shards, k, "m") for k in range(shards)]
    assert [sum(here[s] for _, here in drawn) for s in range(4)] == list(counts)
    assert all(sum(here) == P.SHARD for _, here in drawn[:-1])
    for (before, here), (after, _) in zip(drawn, drawn[1:]):
        assert [a + b for a, b in zip(before, here)] == after
    spread = np.var([here[1] for _, here in drawn[:-1]])
    assert 0.5 < spread / (P.SHARD * 0.25 * 0.75) < 1.7  # as wide as a multinomial draw
    big = (7 * 10**11, 3 * 10**11)
    before, here = P.shard_counts(big, -(-(10**12) // P.SHARD), 123_456, "m")
    assert sum(here) == P.SHARD and abs(here[0] / P.SHARD - 0.7) < 0.1 and abs(before[0] / sum(before) - 0.7) < 0.01


def test_small_sources_keep_their_share():
    sizes = {"big": 10**9, "tiny": 300, "drop": 7}
    plan = P.plan_mixes({"m": {"big": (1 - 1e-5, 1), "tiny": (1e-5, 4), "drop": (1e-9, 1), "none": (0.1, 1)}}, sizes)["m"]
    assert plan["tiny"][1] == 3 and plan["tiny"][0] == 12 and plan["drop"][0] == 1 and "none" not in plan
    tokens = plan["big"][0] * P.LENGTH
    assert abs(tokens * 1e-5 / 1200 - 1) < 0.01


def test_parts_follow_the_source(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3)], TARGETS)
    for rows in (7, 10**6):
        got = sorted((r["source"], r["start"], r["n_tokens"]) for r in P.source_streams(docs, targets, rows).collect())
        for (s, start, n), (t, after, _) in zip(got, got[1:]):
            assert (start + n == after) if s == t else after == 0


def test_empty(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 1)], TARGETS)
    docs = corpus(spark)
    assert P.mix_selection(docs.where("false"), targets).count() == 0
    assert P.mix_selection(docs, targets.where("false")).count() == 0
    assert P.mix_shares(docs.where("false"), targets).first()["actual_share"] == 0.0
