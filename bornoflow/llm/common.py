"""What the operators share: the shared folder, written tables, word patterns, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters per slice of an Arrow batch that a Python step holds as Python objects at once.
SLICE_CHARS = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir, with its file system's scheme: Spark and Arrow then mean the same place.

    Where that is unset, a temporary folder in local mode (tests); on a cluster an error, as executors wouldn't share it."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="bornoflow-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_uri(spark: SparkSession) -> str:
    """shared_dir() as a URI, which file systems are found by."""
    base = shared_dir(spark)
    if base.startswith("file:/") and not base.startswith("file://"):
        return "file://" + base[5:]
    return base if "://" in base else "file://" + base


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: its lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(system, own: str, name: str) -> None:
    """Give a file its name. One that another attempt of the task has left there is the same, and stays."""
    from pyarrow import fs

    there = lambda: system.get_file_info(name).type == fs.FileType.File
    if not there():
        try:
            return system.move(own, name)
        except OSError:
            if not there():
                raise
    system.delete_file(own)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, folder)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over: it does so when the driver collects its garbage, else after half an hour."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    """spark.sql.shuffle.partitions: what the cluster's owner sets in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_CHARS):
    """The batch in zero-copy slices whose texts hold about `limit` bytes at most, or one text."""
    import numpy as np

    array = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df has none of: those given, with underscores after them where they clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
