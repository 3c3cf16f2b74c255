"""Web archives as a data source: spark.read.format("warc").load(folder)."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions import text as X
from corpusmill.functions.html import html_text
from corpusmill.plans.layout import file_system, materialise

SCHEMA = "rec_type string, url string, date string, content_type string, payload binary"


def list_archives(path: str) -> list[str]:
    """*.warc.gz and *.warc files below a folder, in order, without *.wet.gz; a file is itself."""
    files, inside = file_system(path)
    root = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    info = files.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [path]
    found = files.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    return sorted(root + f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".warc.gz", ".warc")) and not f.path.endswith(".wet.gz"))


def headers(stream) -> dict[str, str] | None:  # noqa: ANN001
    """The next block of headers, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    out = {"": line.decode("utf-8", "replace").strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(stream) -> Iterator[tuple]:  # noqa: ANN001
    """(type, url, date, content type, payload) of each record; responses give their page's own type."""
    while (head := headers(stream)) is not None:
        size = head.get("content-length", "0") or "0"
        if not size.isdigit():
            return  # nothing tells where the next record starts
        body = stream.read(int(size))
        kind, content = head.get("warc-type", ""), head.get("content-type", "")
        if kind == "response" and b"\r\n\r\n" in body:
            top, _, body = body.partition(b"\r\n\r\n")
            content = next((x.partition(b":")[2].decode("latin-1").strip() for x in top.split(b"\r\n") if x.lower().startswith(b"content-type:")), "")
        yield kind, head.get("warc-target-uri", ""), head.get("warc-date", ""), content, body


class ArchiveReader(DataSourceReader):
    """A partition a file: gzip can't be split."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in list_archives(self.path)] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            files, inside = file_system(partition.value)
            with files.open_input_stream(inside, compression=None) as raw:
                with gzip.GzipFile(fileobj=raw) if inside.endswith(".gz") else io.BufferedReader(raw) as f:
                    yield from records(f)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ArchiveReader(self.options["path"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def html_responses(archive: DataFrame) -> DataFrame:
    """The responses whose content type is html."""
    return archive.where((F.col("rec_type") == "response") & F.lower("content_type").contains("text/html"))


def long_enough(text: Column, least: int = 100) -> Column:
    """Whether a text has more than `least` characters once stripped."""
    return F.length(X.strip(text)) > least


def page_texts(archive: DataFrame, least: int = 100) -> DataFrame:
    """(url, text) of the html responses whose text is longer than `least` characters."""
    texts = html_responses(archive).select("url", html_text("payload").alias("text"))
    return texts.where(long_enough(F.col("text"), least))


def negative_samples(archive: DataFrame, limit: int = 0) -> DataFrame:
    """(url, text): page texts, masked, on one line; the rule filter isn't applied. With a limit the first
    by address are taken: addresses are ordered first, and only as many pages are read out as it takes to
    find that many texts, twice as many at each try.
    """

    def texts(pages: DataFrame) -> DataFrame:
        rows = page_texts(pages).where(~X.is_blank(F.col("text")))
        return rows.select("url", X.collapse_spaces(X.desensitize(F.col("text"))).alias("text"))

    if limit <= 0:
        return texts(archive)
    asked, pages = 2 * limit, None
    html = html_responses(archive)
    while True:
        pages = html.orderBy("url").limit(asked)
        found = materialise(texts(pages).orderBy("url").limit(limit), "negatives")
        if found.count() >= limit or pages.count() < asked:
            return found
        asked *= 2
