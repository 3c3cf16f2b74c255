"""Readers and writers of the file formats that corpora, benchmarks and samples come in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.evaluation import mmlu_gold, parse_preferences


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, pattern: str | None = None) -> DataFrame:
    """Objects by line, in sub-folders too; bad and blank lines are dropped, or with strict raise."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if not strict:
        return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)
    line = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value"))
    return reader.text(path).select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a document a file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_bytes_ignoring(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): bytes that aren't utf-8 are dropped; a path that isn't there is one empty text."""
    if not exists(spark, path):
        return spark.createDataFrame([(path, "")], "path string, text string")

    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", decode("content").alias("text"))


def read_text(spark: SparkSession, path: str | None, otherwise: str) -> str:
    """A prompt from a small file, or the given one where no path is set."""
    return spark.read.text(path, wholetext=True).first()["value"] if path else otherwise


def read_mmlu(spark: SparkSession, path: str) -> DataFrame:
    """(subject, question, a, b, c, d, answer) of *_test.csv without headers; rows of other than six
    fields are dropped, the subject is the file's name."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "a", "b", "c", "d", "answer", "more")])
    rows = spark.read.schema(fields).option("multiLine", "true").option("escape", '"').option("pathGlobFilter", "*_test.csv").csv(path)
    subject = F.regexp_replace(F.regexp_extract("_metadata.file_name", "^(.*)_test\\.csv$", 1), "_", " ")
    whole = rows.select(subject.alias("subject"), "*").where(F.col("answer").isNotNull() & F.col("more").isNull())
    return whole.select("subject", "question", "a", "b", "c", "d", mmlu_gold(F.col("answer")).alias("answer"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A csv file with a header and fields over several lines; all columns are strings."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def read_folders(spark: SparkSession, folders: list[str], root: str, schema: str) -> DataFrame:
    """Objects by line of several folders, with source the folder; a missing folder raises."""
    parts = [spark.read.schema(schema).json(f"{root}/{f}").withColumn("source", F.lit(f)) for f in folders]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def read_preferences(spark: SparkSession, folders: list[str], root: str) -> DataFrame:
    """Parsed preference pairs of several folders of JSON lines, with source the folder."""
    return parse_preferences(read_folders(spark, folders, root, "chosen string, rejected string"))


def write_labelled(df: DataFrame, label: Column, text: Column, path: str) -> None:
    """Lines "__label__L text"; line ends in a text become blanks."""
    line = F.concat(F.lit("__label__"), label, F.lit(" "), F.regexp_replace(text, "[\\r\\n]+", " "))
    df.select(line.alias("value")).where("value is not null").write.mode("overwrite").text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """Filtered texts keyed by id, so equal file names can't overwrite each other."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_kept(documents: DataFrame, kept: DataFrame, key: str, path: str) -> None:
    """The documents whose key is among `kept`, keyed by id."""
    write_documents(documents.join(kept.select(key).distinct(), key, "left_semi"), key, path)


def write_json(df: DataFrame, path: str) -> None:
    """Objects by line; letters of all scripts are written as they are, null fields too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_ids(df: DataFrame, path: str) -> None:
    """Token ids as a table, to be read again with spark.read.parquet instead of encoded again."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
