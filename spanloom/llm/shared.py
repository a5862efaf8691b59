"""Tables in the shared folder, and prefix sums over many small groups."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A lookup side with at most this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes that go to Python at once where small_batches holds.
BATCH_BYTES = 2_000_000

_local: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="spanloom-"))


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/spanloom/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written table that no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside goes to Python by batches of about BATCH_BYTES, else by 10,000 rows however long: an executor has such a batch outside its heap, up to three times, for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers, and one task's peak would stay in the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """A function over a task's batches that gives its memory back at the end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def tidy_group(run: Callable, sides: int = 1) -> Callable:
    """The same for a function over a group's table, or two tables."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    def two(a: pa.Table, b: pa.Table) -> pa.Table:
        out = run(a, b)
        release()
        return out

    return one if sides == 1 else two


def small_or_shuffled(side: DataFrame, rows: int | None = None) -> DataFrame:
    """The side of a join with a broadcast hint if it is counted as small, else without one."""
    rows = side.count() if rows is None else rows
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def prefix_offsets(counts: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """key, out: the sum of value over all smaller keys.

    The keys (integers, each once) are summed in two levels, blocks of keys
    first, so that one task sees one row a block and not one a key.
    """
    c = counts.withColumn("_block", F.floor(F.col(key) / block))
    blocks = c.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return c.join(blocks, "_block").select(
        key, (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long").alias(out)
    )
