"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words in every operator on words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is set a temporary one serves, but only in local mode, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-hopgauge-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


#: With it Spark removes the shuffle files of a query that is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is computed once. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/hopgauge/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words (maximal runs without ASCII white space) of a text; null: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: What the operator that a Python worker serves remembers there.
_remembered: dict[Hashable, object] = {}


def remembered[T](key: Hashable, make: Callable[[], T]) -> T:
    """make(), kept in a Python worker until a task asks for another key: workers serve one operator after the other and hold what one of them remembers, not all."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Drops what is ``remembered`` in a Python worker."""
    _remembered.clear()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system; else the C library and Arrow keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal[B](task: Callable[[Iterator[B]], Iterator[B]]) -> Callable[[Iterator[B]], Iterator[B]]:
    """A task on batches that gives back its memory after each of them."""

    def each(batches: Iterator[B]) -> Iterator[B]:
        for batch in batches:
            yield batch
            give_back()

    def run(batches: Iterator[B]) -> Iterator[B]:
        yield from task(each(batches))
        give_back()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
