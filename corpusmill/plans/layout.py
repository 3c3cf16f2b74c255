"""Reading tables and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; a parquet file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Only in a local session without that setting (tests, a laptop) a local folder is made, and set, so that
    later calls and checkpoint() use the same one; on a cluster a missing setting raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders written by this process and not yet deleted.
WRITTEN: set[str] = set()
OWNER = os.getpid()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which sweep() deletes."""
    path = f"{shared_dir(spark)}/corpusmill/{name}-{uuid.uuid4().hex}"
    WRITTEN.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a parquet table under shared_dir and read it back.

    Cuts the lineage with files that outlive any executor. Unlike checkpoint(), which runs
    the plan once to count and once to write, the plan runs a single time.
    """
    path = fresh(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that no plan reads any more."""
    delete(df.sparkSession, df.written)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this process has written: once the results that rest on them are stored."""
    for path in list(WRITTEN):
        delete(spark, path)


@atexit.register
def sweep_local() -> None:
    """At the end of the process that wrote them, local folders too; a copy of it that ends leaves them."""
    for path in WRITTEN if os.getpid() == OWNER else ():
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("///", "/", 1).replace("//", "/", 1), ignore_errors=True)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (local, hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def put(path: str, data: bytes) -> None:
    """Write a small file on any file system, with its folders."""
    files, inside = file_system(path)
    files.create_dir(inside.rpartition("/")[0], recursive=True)
    with files.open_output_stream(inside, compression=None) as f:
        f.write(data)


def get(path: str) -> bytes:
    files, inside = file_system(path)
    with files.open_input_stream(inside, compression=None) as f:
        return f.read()


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many tasks as the session shuffles to, for rows that are small but cost time each.

    With a given number the engine doesn't merge the parts by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
