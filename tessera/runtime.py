"""What every operator needs from the session: the shared folder, and the package on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Folders that this process made in the shared folder, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder of the context, which spark.checkpoint.dir names unless it was set by a call.
    Where there is none, a local run gets a temporary one; on a cluster that would be one machine's own, so it is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    found = found.rstrip("/")
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, there until close()."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def close(spark: SparkSession) -> None:
    """Deletes what this application's operators left in the shared folder. Results that read from there must have been written or collected by then."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes the rows to the shared folder and reads them back, so that no later loss recomputes what came before."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of a table's bytes; None where it has none, as for rows that aren't from files. No job is run."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def text_bytes(df: DataFrame, text: str) -> int:
    """input_bytes, or the bytes of the texts where it isn't known."""
    size = input_bytes(df)
    return size if size is not None else df.agg(F.sum(F.octet_length(text))).first()[0] or 0


#: Bytes for each core up to which an input is spread.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to as many tasks as there are cores if the input is estimated to be small: a small file may be one task's however many there are.
    Larger inputs come as they are. No job is run for the estimate."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    return df.repartition(cores) if size is not None and size < cores * SPREAD_BYTES else df


#: Rows of an Arrow batch within small_batches(), where each may hold whole texts.
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within send Python batches of BATCH_ROWS rows at most. A batch stands in the executor's memory outside the heap, while it is filled with room to
    grow, and in the worker's; by the default it has 10,000 rows, which is hundreds of MB for pairs of texts in two tasks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, min(BATCH_ROWS, int(was)) if int(was) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Kept:
    """Tables written to the shared folder by one job, by name; a table that no later step reads can be dropped before the job ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_dir(spark, label)

    def put(self, name: str, df: DataFrame, compression: str = "snappy") -> DataFrame:
        df.write.parquet(f"{self.root}/{name}", compression=compression)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables, and lets the driver's garbage collector find the shuffles that they were made by, whose files go then."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        delete(self.spark, self.root)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for sessions whose executors don't have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), "tessera"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
