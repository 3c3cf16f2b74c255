"""Every query that has SQL gives the SQL's rows; the others are compared with brute force, here or beside their operators."""

import json
import math
from collections import Counter

import duckdb
import pytest
import regex
from compare import difference

from conftest import DATA
from corpusmill import constants as C
from corpusmill import queries_data  # noqa: F401
from corpusmill.functions.html import page_text
from corpusmill.operators import bpe, minhash
from corpusmill.queries import QUERIES, SQL

WITHOUT_SQL = {
    "minhash_signature", "dup_clusters", "dedup_keep", "bpe_encode", "answer_candidates", "relaxed_rewards", "language_id",
    "moderation_classifier", "nsfw_classifier", "toxic_classifier", "html_texts", "negative_samples", "quality_classifier",
}


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").to_arrow_table().to_pylist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, DATA, QUERIES[name], SQL[name]) == ""


def test_all_queries_are_compared():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def test_signatures(spark):
    got = {r["doc_id"]: r["signature"] for r in QUERIES["minhash_signature"](spark, DATA).collect()}
    rows = table("documents")
    assert len(got) == len(rows)
    sets = {}
    for r in rows:
        w = minhash.normalise(r["text"] or "").split()
        sets[r["doc_id"]] = set(zip(*[w[i:] for i in range(5)]))
    ids = [i for i, s in sets.items() if len(s) > 20]
    errors = []
    for a, b in zip(ids, ids[1:]):
        estimate = sum(x == y for x, y in zip(got[a], got[b])) / 64
        errors.append(abs(estimate - len(sets[a] & sets[b]) / len(sets[a] | sets[b])))
    assert max(errors) < 0.3
    assert all((got[i] == [minhash.EMPTY] * 64) == (not s) for i, s in sets.items())


def test_clusters(spark):
    got = {r["doc_id"]: (r["cluster"], r["links"]) for r in QUERIES["dup_clusters"](spark, DATA).collect()}
    rows = table("documents")
    normal = {r["doc_id"]: minhash.normalise(r["text"] or "") for r in rows}
    shingles = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in normal.items()}
    for a in normal:
        for b in normal:
            if a < b:
                x, y = shingles[a], shingles[b]
                share = len(x & y) / len(x | y) if x | y else 1.0
                if share >= 0.9:
                    assert got[a][0] == got[b][0]
    keep = {r["doc_id"] for r in QUERIES["dedup_keep"](spark, DATA).collect()}
    assert keep == {c for c, _ in got.values()}
    sizes = Counter(c for c, _ in got.values())
    assert all(links < sizes[c] for c, links in got.values())


def test_encoding_equals_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    theirs.encode_special_tokens = True
    for r in QUERIES["bpe_encode"](spark, DATA).join(spark.read.parquet(f"{DATA}/preference_examples.parquet"), "example_id").collect():
        assert r["ids"] == (theirs.encode(r["instruction"], add_special_tokens=False).ids if r["instruction"] else [])
    # documents hold more kinds of white space
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in bpe.encode(documents).join(documents, "doc_id").collect():
        assert r["ids"] == (theirs.encode(r["text"], add_special_tokens=False).ids if r["text"] else [])


def test_pretokens_of_all_white_space(spark):
    from pyspark.sql import functions as F

    from corpusmill.functions.text import pretokens

    pattern = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = [t for s in spaces for t in (f"a{s}b", f"a{s}{s}b", f"a {s}b", f"a{s} b", f"{s}", f"x{s}", f"a{s}\n{s}1{s}.")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", pretokens(F.col("text")).alias("t")).collect():
        assert r["t"] == pattern.findall(r["text"]), repr(r["text"])
    assert C.PRETOKEN_SIMPLE.count("x{3000}") == 2


def test_pages(spark):
    got = {r["doc_id"]: r["text"] for r in QUERIES["html_texts"](spark, DATA).collect()}
    assert got == {r["doc_id"]: page_text(r["text"]) for r in table("documents")}


def test_negatives(spark):
    got = [r["url"] for r in QUERIES["negative_samples"](spark, DATA).orderBy("url").collect()]
    pages = sorted(str(r["doc_id"]) for r in table("documents") if r["doc_id"] % 2 == 0 and r["text"] and len(page_text(r["text"].encode()).strip()) > 100)
    assert got == pages[:100]


def test_rewards(spark):
    candidates = {r["rollout_id"]: r["candidates"] for r in QUERIES["answer_candidates"](spark, DATA).collect()}
    rewards = {r["rollout_id"]: r for r in QUERIES["relaxed_rewards"](spark, DATA).collect()}
    answers = {r["item_id"]: r["answer"] for r in table("math_problems")}
    items = {r["rollout_id"]: r["item_id"] for r in table("rollouts")}
    assert set(candidates) == set(rewards)
    for k, found in candidates.items():
        if found and answers.get(items[k]) in found:
            assert rewards[k]["reward"] == 1.0
        if not found:
            assert rewards[k]["reward"] == 0.0
        assert rewards[k]["reward"] in (0.0, 1.0) and rewards[k]["format_reward"] <= rewards[k]["reward"]


@pytest.mark.parametrize("name", ["moderation_classifier", "nsfw_classifier", "toxic_classifier", "quality_classifier"])
def test_held_out_accuracy(spark, name):
    rows = QUERIES[name](spark, DATA.replace("sf0.001", "sf0.01")).collect()
    n = sum(r["n"] for r in rows)
    assert sum(r["recall"] * r["n"] for r in rows) / n > 0.6
    assert all(0 <= r["precision"] <= 1 and not math.isnan(r["precision"]) for r in rows)


def test_languages(spark):
    got = {r["doc_id"]: r["predicted"] for r in QUERIES["language_id"](spark, DATA).collect()}
    known = [(r["doc_id"], r["lang"]) for r in table("documents") if r["lang"] and r["text"] and len(r["text"]) > 200]
    assert len(got) == len(table("documents"))
    assert sum(got[i] == x for i, x in known) / len(known) > 0.7  # some labels are wrong
    assert json.dumps(sorted(set(got.values())))
