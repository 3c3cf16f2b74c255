"""Relational operators against brute force on small tables, empty and odd ones included."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import batching, bpe, classify, evaluation, lines, minhash, reward, scaling

DOCS = "doc_id bigint, text string"


def test_lines(spark):
    texts = ["a\nb\n", "b\nc", "c\n", None, "", "a\r\nz", "a\nb\n"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    counts = {r["line"]: r["n"] for r in lines.line_counts(df).collect()}
    assert counts == {"a\n": 3, "b\n": 3, "c": 1, "c\n": 1, "z": 1}
    kept = {r["doc_id"]: r["text"] for r in lines.unique_lines(df).collect()}
    assert kept == {0: "", 1: "c", 2: "c\n", 3: "", 4: "", 5: "z", 6: ""}
    assert lines.unique_lines(df.where("false")).count() == 0


def jaccard(a, b, n=5):
    s = lambda t: set(zip(*[t.split()[i:] for i in range(n)]))
    return len(s(a) & s(b)) / len(s(a) | s(b)) if s(a) | s(b) else 1.0


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        w = t.split()
        w[rng.randrange(120)] = "other"
        texts += [" ".join(w), t.upper() + "!"]
    texts += [None, "", "too short", "short too"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("cluster", F.lit(0)).withColumn("id", F.lit(1))
    found = {r["doc_id"]: (r["cluster"], r["links"]) for r in minhash.near_duplicates(df).collect()}
    assert len(found) == len(texts)
    normal = [minhash.normalise(t or "") for t in texts]
    for i in range(24):
        for j in range(i):
            if jaccard(normal[i], normal[j]) >= 0.88:
                assert found[i][0] == found[j][0]
            elif jaccard(normal[i], normal[j]) < 0.3:
                assert found[i][0] != found[j][0]
    assert len({found[i][0] for i in range(24, 28)}) == 1
    assert found[0][1] == 2
    assert minhash.near_duplicates(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, k=10, bands=4)


def test_components(spark):
    v = spark.range(12)
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(8, 9), (8, 9)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in minhash.components(v, e).collect()}
    assert got == {i: 0 for i in range(7)} | {7: 7, 8: 8, 9: 8, 10: 10, 11: 11}


def test_normalise():
    assert minhash.normalise("Ab,  C_d\né!") == "ab c_d e"


def test_byte_pairs(spark):
    df = spark.createDataFrame([(1, "aa ab"), (2, "aa"), (3, None), (4, "")], DOCS)
    counts = bpe.pretoken_counts(df)
    assert {r["pretoken"]: r["n"] for r in counts.collect()} == {"aa": 2, " ab": 1}
    pairs = {(r["left"], r["right"]): r["n"] for r in bpe.pair_counts(counts).collect()}
    assert pairs == {("61", "61"): 2, ("20", "61"): 1, ("61", "62"): 1}
    assert bpe.best_pair(bpe.pair_counts(counts)).first()["left"] == "61"


def test_encode_and_decode(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello  world, naïve 東京 🙂\n\tx'll 12345", "", None, "a<|endoftext|>b", " ​", "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    special = {r["doc_id"]: r["ids"] for r in bpe.encode(df, specials={"<|endoftext|>": 50256}).collect()}
    t.encode_special_tokens = True
    for i, x in enumerate(texts):
        assert ids[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    assert special[3] == [*ids[3][:1], 50256, *t.encode("b").ids]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    odd = spark.createDataFrame([(1, [999999])], "doc_id bigint, ids array<int>")
    assert bpe.decode(odd).first()["text"] == "<unk>"
    assert bpe.vocabulary(spark).count() > 50_000


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i * 7, [rng.randrange(9) for _ in range(rng.randrange(12))]) for i in range(90)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k bigint, ids array<int>")
    stream = [x for _, ids in rows for x in [100, *(ids or []), 101]]
    for seed in (None, 5):
        got = sorted(batching.pack(df, "k", "ids", 16, 100, 101, seed).collect())
        assert [r["chunk"] for r in got] == list(range((len(stream) - 1) // 16))
        flat = [x for r in got for x in r["input_ids"]]
        assert all(r["input_ids"][1:] == r["labels"][:-1] for r in got)
        if seed is None:
            assert flat == stream[: len(flat)]
    assert batching.pack(df.where("false"), "k", "ids", 16, 100, 101).count() == 0


def test_splits_and_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    split = {r["k"]: r["split"] for r in batching.split_by_ratio(df, "k", 0.1).collect()}
    assert Counter(split.values()) == {"val": 10, "train": 90}
    assert batching.split_by_count(df, "k", 7).where("split = 'val'").count() == 7
    with pytest.raises(ValueError):
        batching.split_by_count(df, "k", 100)
    assert batching.cap(df, "k", 0).count() == 100 and batching.cap(df, "k", 9).count() == 9
    drawn = batching.sample_prompts(df, "k", 250).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(250))
    assert set(Counter(r["k"] for r in drawn).values()) == {2, 3}
    batches = batching.minibatches(df, "k", 32).collect()
    assert sorted(len(r["keys"]) for r in batches) == [4, 32, 32, 32]
    assert sorted(k for r in batches for k in r["keys"]) == list(range(100))


def test_language_model_batches(spark):
    stream = spark.range(50).select(F.col("id").alias("at"), (F.col("id") * 2).cast("int").alias("token"))
    starts = spark.createDataFrame([(0, 0), (1, 13), (2, 41)], "row bigint, start bigint")
    got = {r["row"]: r for r in batching.lm_batches(stream, starts, 8).collect()}
    assert got[1]["x"] == [2 * i for i in range(13, 21)] and got[1]["y"] == [2 * i for i in range(14, 22)]
    assert sorted(got) == [0, 1, 2]
    drawn = spark.range(500).withColumnRenamed("id", "row").select(batching.random_starts(50, 8, 0).alias("s")).collect()
    assert {r["s"] for r in drawn} == set(range(41))


def test_padding(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], [3]), (2, 0, [4], [5, 6, 7]), (3, 1, [8], [9]), (4, None, None, [1])], "k int, b int, p array<int>, r array<int>")
    got = {r["k"]: r for r in batching.pad_pairs(df.where("b = 0"), "k", "p", "r", 0).collect()}
    assert got[1]["input_ids"] == [1, 2, 3] and got[1]["labels"] == [2, 3, 0]
    assert got[1]["response_mask"] == [False, True, False] and got[2]["response_mask"] == [True, True, True]
    got = {r["k"]: r for r in batching.pad_pairs(df, "k", "p", "r", 0, "b").collect()}
    assert got[3]["input_ids"] == [8] and got[3]["labels"] == [9] and len(got[2]["labels"]) == 3
    assert got[4]["input_ids"] == [] and got[4]["response_mask"] == []
    assert batching.pad_pairs(df.where("false"), "k", "p", "r", 0).count() == 0


def test_batch_settings():
    assert batching.check_batches(64, 16, 128, 8) == {"microbatch": 4, "prompts": 16, "updates": 2}
    for bad in ((65, 16, 130, 8), (64, 16, 100, 8), (4, 2, 64, 8), (64, 16, 96, 8)):
        with pytest.raises(ValueError):
            batching.check_batches(*bad)
    assert batching.parse_steps("1, 50,", 9) == {1, 50} and batching.parse_steps(" ", 9) == {1, 4, 9}


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(batching, "PART_ROWS", 7)
    df = spark.range(100).withColumnRenamed("id", "k").withColumn("w", F.lit(3))
    many = {r["k"]: r["position"] for r in batching.positions(df, batching.shuffled(F.col("k")), ["k"], F.col("w")).collect()}
    monkeypatch.setattr(batching, "PART_ROWS", 10**6)
    one = {r["k"]: r["position"] for r in batching.positions(df, batching.shuffled(F.col("k")), ["k"], F.col("w")).collect()}
    assert many == one and sorted(one.values()) == list(range(0, 300, 3))
    monkeypatch.setattr(batching, "PART_ROWS", 7)
    skewed = spark.createDataFrame([(2**i, [i, i]) for i in range(60)], "k bigint, ids array<int>")
    placed = {r["k"]: r["position"] for r in batching.stream_positions(skewed, "k", "ids").collect()}
    assert placed == {2**i: 2 * i for i in range(60)}


def test_merges(spark):
    counts = spark.createDataFrame([("aaab", 2), (" tt t", 1), ("", 5)], "pretoken string, n bigint")
    once = bpe.merge_pair(counts, "61", "61")
    assert sorted((r["pieces"], r["n"]) for r in once.collect()) == [([], 5), (["20", "74", "74", "20", "74"], 1), (["6161", "61", "62"], 2)]
    twice = bpe.merge_pair(once, "6161", "61")
    assert ["616161", "62"] in [r["pieces"] for r in twice.collect()]
    pairs = {(r["left"], r["right"]): r["n"] for r in bpe.pair_counts(twice).collect()}
    assert pairs[("616161", "62")] == 2 and pairs[("20", "74")] == 2


def test_vocabulary_files(spark, tmp_path):
    vocab, ranks = {"a": 0, "b": 1, "#": 2, "ab": 3, "#a": 4, "Ġ": 5}, {("#", "a"): 0, ("a", "b"): 1}
    paths = bpe.write_vocabulary(vocab, ranks, str(tmp_path))
    with open(paths[1], "a") as f:
        f.write("\nnot a pair of tokens\n")
    assert bpe.load(*paths) == (vocab, ranks)
    assert bpe.encode_word("#ab", vocab, ranks, bpe.byte_table()) == [4, 1]
    tokens = spark.createDataFrame([(b"x", 1), (b"x", 7), (b"y", 2)], "token binary, id int")
    assert {(bytes(r["token"]), r["id"]) for r in bpe.highest_ids(tokens).collect()} == {(b"x", 7), (b"y", 2)}


def test_long_words_merge_in_time():
    vocab, ranks = bpe.load(bpe.VOCABULARY)
    table = bpe.byte_table()

    def slow(word):
        parts = [table[b] for b in word.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [vocab[p] for p in parts]

    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aabcdeinost é") for _ in range(rng.randrange(1, 40)))
        assert bpe.encode_word(word, vocab, ranks, table) == slow(word)
    assert len(bpe.encode_word("ab" * 100_000, vocab, ranks, table)) > 1000


def test_hot_buckets_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [1, 2, rng.randrange(4), rng.randrange(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "rep bigint, signature array<bigint>")
    whole = {tuple(r) for r in minhash.candidate_pairs(df, 2).collect()}
    monkeypatch.setattr(minhash, "PART_ROWS", 7)
    assert {tuple(r) for r in minhash.candidate_pairs(df, 2).collect()} == whole
    assert len(whole) == 60 * 59 // 2


def test_sizes_split_buckets_without_loss(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(3) for _ in range(4)], rng.randrange(1, 200)) for i in range(80)]
    df = spark.createDataFrame(rows, "rep bigint, signature array<bigint>, n bigint")
    all_pairs = {(r["a"], r["b"]) for r in minhash.candidate_pairs(df, 2).collect()}
    sized = {(r["a"], r["b"]) for r in minhash.candidate_pairs(df, 2, "n").collect()}
    size = {i: n for i, _, n in rows}
    assert sized <= all_pairs
    assert {p for p in all_pairs if max(size[p[0]], size[p[1]]) <= 1.25 * min(size[p[0]], size[p[1]])} <= sized


def test_evaluation_tables(spark):
    df = spark.createDataFrame([(i, "A", "A" if i % 3 else "B") for i in range(30)], "k int, p string, g string")
    wrong = evaluation.wrong_sample(df, "k", F.col("p"), F.col("g"), 4).collect()
    assert len(wrong) == 4 and all(r["k"] % 3 == 0 for r in wrong)
    assert tuple(evaluation.validation_mean(df.withColumn("r", F.col("k") * 1.0), "k", "r", 3).first()) == (3, 1.0)
    assert tuple(evaluation.validation_mean(df.where("false").withColumn("r", F.lit(1.0)), "k", "r", 3).first()) == (0, 0.0)
    typed = spark.createDataFrame([(1.5, ["a", None], None)], "x double, y array<string>, z string")
    got = typed.select(*[evaluation.ground_truths(typed, c).alias(c) for c in "xyz"]).first()
    assert tuple(got) == (["1.5"], ["a"], [])
    lines_ = spark.createDataFrame([("__label__hq a",), ("__label__lq b",), ("x",)], "value string")
    assert tuple(classify.count_positives(lines_).first()) == (1, 1)
    assert tuple(classify.count_positives(lines_.where("value = 'x'")).first()) == (0, 10_000)
    assert classify.merge_samples(lines_, None) is None


def test_rewards(spark):
    rows = [(1, 0, 1.0), (2, 0, 0.0), (3, 1, 1.0), (4, None, 1.0), (5, None, None), (6, 0, 1.0)]
    df = spark.createDataFrame(rows, "id int, g int, reward double").withColumn("__mean", F.lit(9))
    got = {r["id"]: r["advantage"] for r in reward.group_advantages(df.drop("__mean"), ["g"], "reward").collect()}
    assert len(got) == 6 and got[3] == 0.0 and got[5] is None
    assert abs(got[1] + got[2] + got[6]) < 1e-6
    best = {r["g"]: r["id"] for r in reward.best_in_group(df, ["g"], "id", "reward").collect()}
    assert best == {0: 1, 1: 3, None: 4}
    twice = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c"), (2, 1, "c")], "k int, t int, v string")
    assert {tuple(r) for r in reward.latest(twice, "k", "t").collect()} == {(1, 7, "b"), (2, 1, "c")}
    tokens = spark.createDataFrame([(0, [1.0, 2.0], [1, 0]), (0, [4.0], [1])], "s int, l array<double>, m array<int>")
    assert reward.batch_loss(tokens, ["s"], "l", "m").first()["loss"] == 2.5


def test_scaling(spark):
    rows = [(10 ** (2 + c), 10.0**c, 1.0) for c in range(1, 5)] + [(5, 10.0, 2.0), (7, 10.0, None), (None, 10.0, 0.1)]
    rows = [(p, c, x) for p, c, x in rows]
    df = spark.createDataFrame(rows, "parameters bigint, compute_budget double, final_loss double")
    fit = scaling.power_law(scaling.best_by_budget(df))
    assert abs(fit.first()["a"] - 1) < 1e-9 and abs(fit.first()["log10_alpha"] - 2) < 1e-9
    far = scaling.extrapolate(fit, 1e6).first()
    assert abs(far["parameters"] - 1e8) < 1 and abs(far["tokens"] * 6 * far["parameters"] - 1e6) < 1e-3
    assert scaling.fit_series(fit, 0, 1, 11).count() == 11


def test_accuracy(spark):
    df = spark.createDataFrame([("A", "A"), (None, None), ("B", "A"), (None, "C")], "p string, g string")
    got = evaluation.accuracy_summary(df, F.col("p"), F.col("g")).first()
    assert tuple(got) == (4, 0.5, 2, 0.5)
    assert tuple(evaluation.accuracy_summary(df.where("false"), F.col("p"), F.col("g")).first()) == (0, 0.0, 0, 0.0)


def test_preferences(spark):
    turn = lambda p, r: f"\n\nHuman: {p}\n\nAssistant: {r}"
    rows = [(1, turn("q", "a"), turn("q", "b")), (2, turn("q", "a"), turn("z", "b")), (3, None, turn("q", "b"))]
    got = {r["id"]: r for r in evaluation.parse_preferences(spark.createDataFrame(rows, "id int, chosen string, rejected string")).collect()}
    assert got[1]["instruction"] == "q" and got[1]["rejected"] == "b"
    assert [got[i]["status"] for i in (1, 2, 3)] == ["kept", "prompts_differ", "unparsed"]


def test_classifier(spark):
    rows = [(f"the cat number {i} sat on a mat", "en") for i in range(30)] + [(f"die katze {i} sass auf der matte", "de") for i in range(30)]
    df = spark.createDataFrame(rows + [(None, "en"), ("", "de"), ("x", None)], "text string, label string")
    model = classify.fit_classifier(df, "text", "label", "char", buckets=1 << 10)
    got = classify.classify(model, df, "text", ["label"]).collect()
    assert len(got) == 63
    right = defaultdict(int)
    for r in got[:60]:
        right[r["label"] == r["predicted"]] += 1
    assert right[True] >= 58


def test_dedup_form_of_all_documents(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    texts = ["Plain, text_1", "Café\tau lait\r\nÉTÉ!", "Ελλάδα — 中文。", "a\tb  c", "", "  ", None, "e\u0301 x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        kept = "".join(c for c in t.lower() if c.isalnum() or c == "_" or c.isspace() or not re.match(r"[^\w\s]", c))
        return "".join(c for c in unicodedata.normalize("NFD", " ".join(kept.split())) if unicodedata.category(c) != "Mn")

    want = {i: t if t is None else hashlib.md5(brute(t).encode()).hexdigest() for i, t in enumerate(texts)}
    from corpusmill.queries import QUERIES

    assert {r["doc_id"]: r["digest"] for r in QUERIES["dedup_normal"](spark, str(tmp_path)).collect()} == want


def test_alpaca_of_all_rows(spark, tmp_path):
    from corpusmill.queries import QUERIES

    rows = [(1, "Fill {response} in", "done"), (2, "Say it", "it"), (3, None, None)]
    spark.createDataFrame(rows, "example_id bigint, instruction string, chosen string").write.parquet(f"{tmp_path}/preference_examples.parquet")
    assert {r["example_id"] for r in QUERIES["alpaca_texts"](spark, str(tmp_path)).collect()} == {1, 2, 3}


def test_written_tables_are_deleted(spark):
    import os

    from corpusmill.plans import layout

    df = layout.materialise(spark.range(5), "test")
    path = df.written.removeprefix("file://")
    assert os.path.isdir(path) and df.count() == 5
    layout.discard(df)
    assert not os.path.exists(path)
    before = set(layout.WRITTEN)
    v = spark.range(40)
    e = v.where("id < 39").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert minhash.components(v, e).select("component").distinct().count() == 1
    assert len(set(layout.WRITTEN) - before) == 1  # only the result is left
