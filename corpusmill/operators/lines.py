"""Exact line operators: a line keeps its terminator, so "a" and "a\\n" differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "[^\\n]*\\n|[^\\n]+"


def split_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line). Line ends are made \\n first; null and empty texts have no line."""
    unified = F.regexp_replace(F.col(text), "\\r\\n?", "\n")
    return df.select(F.col(key), F.posexplode(F.regexp_extract_all(unified, F.lit(LINE), F.lit(0))).alias("pos", "line"))


def line_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(line, n): counts are combined inside each task before the shuffle."""
    return split_lines(df, key, text).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def unique_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the documents with only those lines that occur once in the whole corpus, every copy
    of a repeated line being dropped. A document that loses all lines, or is null, keeps an empty text.

    One aggregate over 128-bit digests of the lines: copies are combined before the shuffle, so a hot line,
    a blank one say, costs a row a task; lines that occur once go on to their documents.
    """
    lines = split_lines(df, key, text).withColumn("h", F.unhex(F.md5("line")))
    counted = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos", "line")).alias("one"))
    once = counted.where("n = 1").select(F.col(f"one.{key}").alias(key), "one.pos", "one.line")
    marks = df.select(key, F.lit(-1).alias("pos"), F.lit("").alias("line"))  # every document has one
    joined = once.unionByName(marks).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    return joined.select(key, F.array_join(F.col("parts.line"), "").alias(text))


def skip_reasons(df: DataFrame, blank, kept) -> DataFrame:  # noqa: ANN001
    """(reason, n) with reasons blank, rejected and kept."""
    reason = F.when(blank, "blank").when(~kept, "rejected").otherwise("kept")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
