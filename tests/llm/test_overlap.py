"""Same requests across splits, against brute force on a fixture."""

import random

from pyspark.sql import functions as F

from corpusmill.llm import p2_overlap as P
from corpusmill.llm import rarity as R
from corpusmill.llm.alignment import align_words, longest_chain

SCHEMA = "example_id bigint, instruction string, split string, source string"


def request(rng):
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)).capitalize()
    made = lambda: rng.choice("lamp kettle ladder basket violin compass drum mailbox saw anchor bell candle".split())
    kind = lambda: rng.choice("red old tiny heavy loud round dusty sharp broken quiet green wooden".split())
    return (
        f"My neighbour {name()} moved to {name()} with {rng.randrange(13, 900)} {kind()} boxes and keeps asking about a {kind()} {made()}. "
        f"Give me {rng.randrange(13, 900)} ideas for a {kind()} {made()} that {name()} of {name()} could build for {name()} next to the {made()}."
    )


def slips(rng, text):
    words = text.lower().split(" ")
    at = rng.choice([i for i, w in enumerate(words) if len(w) > 4])
    words[at] = words[at][:2] + "x" + words[at][2:]
    return "Hi there! " + " ".join(words).replace("keeps asking", "goes on asking") + "  Thanks"


def test_pairs(spark):
    rng = random.Random(4)
    base = [request(rng) for _ in range(120)]
    rows = [(i, t, "train", "a") for i, t in enumerate(base)]
    rows += [(200 + i, slips(rng, base[i]), rng.choice(["val", "test"]), None) for i in range(30)]
    rows += [(300 + i, request(rng), "val", "b") for i in range(30)]
    rows += [(400, base[0], "test", "a"), (401, base[0], "train", "a"), (402, None, "test", "a"), (403, "", "val", "a"), (404, base[1], None, "a")]
    rows += [(405, "Hello", "train", "a"), (406, "Hello", "train", "a"), (407, "hello!", "test", "a")]
    sibling = base[5].replace("Give me", "Give me 9", 1)
    rows += [(408, " ".join("77" if w.isdigit() else w for w in base[6].split()), "val", "b"), (409, sibling, None, "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class", F.lit(1)).withColumn("text", F.lit("x"))
    got = {tuple(sorted((r["held_id"], r["train_id"]))) for r in P.split_overlaps(df).collect()}
    want = {(i, 200 + i) for i in range(30)} | {(0, 400), (400, 401), (200, 401), (405, 407), (406, 407)}
    assert got == {tuple(sorted(p)) for p in want}
    assert P.split_overlaps(df.where("false")).count() == 0


def test_selection_and_chain():
    rarity = R.Rarity.from_counts(1000, {})
    assert P.select_grams("", rarity) == []
    assert len(P.select_grams("one two three four five six seven", rarity)) >= 2
    assert P.chain([(0, 5), (3, 8), (4, 2), (9, 9)]) == 3 and P.chain([]) == 0


def test_align():
    rarity = R.Rarity.from_counts(10**6, {w: 400_000 for w in "the a of to ideas for party give me in".split()})
    assert P.align("Give me 12 ideas for the party in Zorbu", "give me 12 idaes for party in the zorbu", rarity) >= 1 - P.LEFT_OVER
    assert P.align("Give me 12 ideas for the party in Zorbu", "Give me 14 ideas for the party in Zorbu", rarity) == 0
    assert P.align("Give me 12 ideas for the party in Zorbu", "Give me 12 ideas for the party in Makelo", rarity) == 0
    assert P.align("", "x", rarity) == 0


def test_grams_at_every_size():
    ws = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    for nats in (4.25, 5.5, 9.0, 30.0):
        for texts in (10**4, 10**6, 10**8, 10**10):
            counts = {w: max(1, round(texts * 2.718281828**-nats)) for w in ws}
            grams = P.select_grams(" ".join(ws), R.Rarity.from_counts(texts, counts))
            assert len(grams) >= 60 // P.WINDOW, (nats, texts)


def test_frequent_words_alone():
    text = "please tell me what the time is in the town"
    rarity = R.Rarity.from_counts(1000, {w: 900 for w in text.split()})
    a, b = P.select_grams(text, rarity), P.select_grams(text.replace("please ", ""), rarity)
    assert {h for h, _ in a} & {h for h, _ in b}


def test_rolling_hash():
    ws = "a b c a b c d".split()
    r = P.Rolling(ws)
    assert r.of(0, 3) == r.of(3, 6) != r.of(1, 4) and r.of(0, 7) == P.Rolling(ws).of(0, 7)


def test_order_counts():
    rarity = R.Rarity.from_counts(1000, {})
    text = "give the red book to anna before noon"
    assert P.align(text, " ".join(reversed(text.split())), rarity) < 0.5
    first, second = "the keeper of the mill has nine boats", "tell me how many nets each of them carries"
    assert P.align(f"{first}. {second}?", f"{second}? {first}.", rarity) == 1.0


def test_alignment():
    assert longest_chain([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    a, b = "x the old mill stands by the river y".split(), "p q the old mlil stands by a river".split()
    at = align_words(a, b)
    assert [j for j in at] == [-1, 2, 3, 4, 5, 6, -1, 8, -1]
    long = [f"w{i % 977}" for i in range(20000)]
    assert align_words(long, ["z", *long]) == list(range(1, 20001))
    assert align_words([], ["a"]) == [] and align_words(["a"], []) == [-1]


def test_classes(spark, tmp_path):
    rows = [(1, "Hello", "train", "a"), (2, "Hello", "train", "a"), (3, "hello!", "test", "a"), (4, "helo", "val", "a"), (5, None, "val", "a")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/preference_examples.parquet")
    got = {r["example_id"]: (r["class"], r["linked"]) for r in P.p2_classes(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == got[3] and got[4][0] != got[1][0] and got[4][1] == got[1][1] == 1 and len(got) == 4


def test_very_long_requests():
    import time

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 10)))
    rarity = R.Rarity.from_counts(1000, {})
    a, b = [word() for _ in range(20000)], [word() for _ in range(20000)]
    began = time.time()
    assert P.align(" ".join(a), " ".join(b), rarity) < 0.5
    half = a[:12000] + b[:8000]
    assert P.align(" ".join(a), " ".join(half), rarity) < 0.72
    swapped = [w if i % 50 else w[:2] + "x" + w[2:] for i, w in enumerate(a)]
    assert P.align(" ".join(a), " ".join(swapped), rarity) > 0.99
    assert len(P.select_grams(" ".join(a), rarity)) > 5000
    assert time.time() - began < 60
    few, many = [word() for _ in range(40)], [word() for _ in range(200)]
    slow = [next((y for y in many if P.slip(x, y)), None) for x in few]
    index = P.Slips(many)
    assert slow == [many[js[0]] if (js := index.of(x)) else None for x in few]


def test_a_third_of_all_rows_alike(spark):
    # one request copied with slips over and over, among others: its words are as frequent as can be, yet all copies meet
    rng = random.Random(12)
    base = request(rng)
    rows = [(i, slips(rng, base), "train", "a") for i in range(40)] + [(100 + i, slips(rng, base), "val", "a") for i in range(20)]
    rows += [(200 + i, request(rng), "train", "b") for i in range(120)] + [(400 + i, request(rng), "test", "b") for i in range(20)]
    got = {(r["train_id"], r["held_id"]) for r in P.split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(i, 100 + j) for i in range(40) for j in range(20)}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_grams_are_no_longer_in_a_larger_table():
    ws = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    grams = set()
    for texts in (10**4, 10**6, 10**8):
        counts = {w: max(1, round(texts * 2.718281828**-5.5)) for w in ws}  # words as frequent at any size
        grams.add(tuple(P.select_grams(" ".join(ws), R.Rarity.from_counts(texts, counts))))
    assert len({len(g) for g in grams}) == 1 and len(grams) == 1


def test_requests_without_a_common_number_are_never_the_same():
    rng, rarity = random.Random(3), R.Rarity.from_counts(1000, {})
    form = "Give {} ideas for {} lamps and {} of them that the keeper of the mill could build"
    number = lambda: rng.choice(["3", "30", "345", "12", "12345", "2345", "two", "1230", "9", ""])
    for _ in range(2000):
        a, b = (form.format(number(), number(), number()) for _ in range(2))
        na, nb = (set(P.quantities(P.words(P.fold(x)))) for x in (a, b))
        assert not na or not nb or na & nb or P.align(a, b, rarity) == 0
