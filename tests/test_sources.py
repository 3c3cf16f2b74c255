"""Readers and sinks on files made here."""

import gzip
import json

from pyspark.sql import functions as F

from corpusmill.sources import files, warc
from corpusmill.streaming import incremental


def record(kind, url, content, body):
    page = f"HTTP/1.1 200 OK\r\nContent-Type: {content}\r\n\r\n".encode() + body if kind == "response" else body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: {len(page)}\r\n\r\n"
    return head.encode() + page + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    long = b"<html><body><p>" + b"words and more words " * 12 + b"me@site.org</p></body></html>"
    parts = [record("warcinfo", "", "", b"x"), record("response", "http://a/1", "text/html; charset=utf-8", long),
             record("response", "http://a/2", "text/html", b"<p>short"), record("response", "http://a/3", "image/png", long)]
    with gzip.open(tmp_path / "one.warc.gz", "wb") as f:
        f.write(b"".join(parts))
    (tmp_path / "two.wet.gz").write_bytes(b"")
    archive = warc.read_warc(spark, str(tmp_path))
    assert archive.count() == 4
    got = warc.negative_samples(archive).collect()
    assert [r["url"] for r in got] == ["http://a/1"]
    assert got[0]["text"].endswith("|||EMAIL_ADDRESS|||")
    assert [r["url"] for r in warc.negative_samples(archive, 5).collect()] == ["http://a/1"]
    (tmp_path / "three.warc").write_bytes(record("request", "u", "", b"GET") + b"WARC/1.0\r\nContent-Length: x\r\n\r\nrest")
    assert warc.read_warc(spark, f"file://{tmp_path}").count() == 5
    assert [p.rpartition("/")[2] for p in warc.list_archives(str(tmp_path))] == ["one.warc.gz", "three.warc"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/wiki_00").write_text('{"text": "a"}\n\n{bad\n{"text": "b"}\n')
    assert sorted(r["text"] for r in files.read_jsonl(spark, str(tmp_path / "j"), "text string").where("text is not null").collect()) == ["a", "b"]
    (tmp_path / "arr.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert files.read_json_array(spark, str(tmp_path / "arr.json"), "x bigint").count() == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.txt").write_bytes(b"one\ntwo\xff")
    assert files.read_whole_files(spark, str(tmp_path / "w")).count() == 1
    assert files.read_bytes_ignoring(spark, str(tmp_path / "w")).first()["text"] == "one\ntwo"


def test_mmlu_files(spark, tmp_path):
    (tmp_path / "high_school_test.csv").write_text('"q, one",1,2,3,4, b \nshort,1\nq,1,2,3,4,A,extra\n')
    (tmp_path / "other_val.csv").write_text("q,1,2,3,4,A\n")
    got = files.read_mmlu(spark, str(tmp_path)).collect()
    assert [(r["subject"], r["question"], r["answer"]) for r in got] == [("high school", "q, one", "B")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("hq", "a\nb"), ("lq", None)], "label string, text string")
    files.write_labelled(df, F.col("label"), F.col("text"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["__label__hq a b"]
    files.append_metrics(df.limit(1), str(tmp_path / "m"))
    files.append_metrics(df.limit(1), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_preference_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        row = {"chosen": "\n\nHuman: q\n\nAssistant: a", "rejected": "\n\nHuman: q\n\nAssistant: b"}
        (tmp_path / name / "train.jsonl").write_text(json.dumps(row) + "\n")
    got = files.read_preferences(spark, ["one", "two"], str(tmp_path)).collect()
    assert sorted(r["source"] for r in got) == ["one", "two"] and {r["status"] for r in got} == {"kept"}


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:10:00", 1.0), (2, "2024-01-01 00:20:00", 0.0)]
    df = spark.createDataFrame(rows, "rollout_id bigint, logged_at string, reward double").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = incremental.windowed_rewards(stream).writeStream.format("memory").queryName("rewards").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["n"], r["mean_reward"]) for r in spark.sql("select * from rewards").collect()] == [(2, 0.5)]


def test_strict_lines(spark, tmp_path):
    import pytest

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x bigint", strict=True).count() == 2
    for name, bad in (("b.jsonl", '{"x": 1}\n\n{"x": 2}\n'), ("c.jsonl", '{"x": 1}\n{x\n')):
        (tmp_path / name).write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            files.read_jsonl(spark, str(tmp_path / name), "x bigint", strict=True).collect()
    assert files.read_bytes_ignoring(spark, str(tmp_path / "absent")).first()["text"] == ""
    (tmp_path / "p.txt").write_text("Be kind.\n")
    assert files.read_text(spark, str(tmp_path / "p.txt"), "x") == "Be kind.\n" and files.read_text(spark, None, "x") == "x"
    files.write_ids(spark.createDataFrame([(1, [3, 4])], "k int, ids array<int>"), str(tmp_path / "ids"))
    assert spark.read.parquet(str(tmp_path / "ids")).first()["ids"] == [3, 4]
    files.write_json(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"a":"é","b":null}'


def test_appended_stream(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    incremental.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.schema("id bigint").json(str(tmp_path / "out")).collect()) == list(range(7))
