"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. One that comes in fewer pieces than there are cores (a file of one row group is one task) is spread over them; larger ones stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a session with a local master gets a folder of its own; on a cluster
    there is no such folder to be had, and an error says so.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = found.get() if found.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(known)
    return known


BATCH_ROWS = 2000
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it: lineage ends there, and a lost executor costs nothing.

    The table stays until discard() or discard_all(), as frames made from it are read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    # Small batches for Python workers while this is written; then the session is as it was.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    try:
        if not 0 < int(own) <= BATCH_ROWS:
            spark.conf.set(name, str(BATCH_ROWS))
        df.write.parquet(path)
    finally:
        spark.conf.set(name, own)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    _delete(df.sparkSession, df._path)
    _written[df.sparkSession.sparkContext.applicationId].remove(df._path)


def discard_all(spark: SparkSession) -> int:
    """Delete all tables of materialize() that this application wrote: for when its results are written. How many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def word_count(text):
    """Words of a text, divided by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class Numbered:
    """A frame whose columns go by place, so that names may clash with each other or with ours, in any case of letters."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"_c{k}" for k in range(len(self.names))])

    def __getitem__(self, name: str) -> Column:
        """The first column of that name, to the letter if there is one."""
        return F.col(f"_c{self.place(name)}")

    def place(self, name: str) -> int:
        exact = [k for k, n in enumerate(self.names) if n == name] or [k for k, n in enumerate(self.names) if n.lower() == name.lower()]
        if not exact:
            raise ValueError(f"no column {name}; there are {', '.join(self.names)}")
        return exact[0]

    def row(self) -> Column:
        return F.struct(*[F.col(c) for c in self.df.columns])

    def restored(self, df: DataFrame) -> DataFrame:
        """The columns of row(), here named row, under their names."""
        return df.select(*[F.col(f"row._c{k}").alias(n) for k, n in enumerate(self.names)])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by new name, from those of df by name."""
    by_place = Numbered(df)
    return by_place.df.select(*[by_place[c].alias(n) for n, c in columns.items()])


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def release() -> None:
    """Give what this process has freed back to the system. Python workers outlive their tasks, and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with release() at the end of the partition."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of few rows. Spark bounds the bytes of those that it sends (64 MB), which a single longer text alone exceeds."""
    return df.mapInArrow(releasing(lambda batches: run(in_slices(batches))), schema)
