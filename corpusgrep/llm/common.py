"""Shared folder, written stages, gapless numbering and Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of one row that one array element run stands for.
RUN = 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the executors are threads of this machine, as in tests, it is a folder of
    our own; on a cluster a folder of one machine would lose data, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = kept or "file://" + tempfile.mkdtemp(prefix="corpusgrep-")
        if not kept:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a batch for Python, by Spark's own limit, and that limit's default, which says that nobody has set it.
_BATCH_LIMIT, _UNSET, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20
#: For jobs that write a stage: adaptive execution joins small partitions up to its advisory size, so that a small
#: stage makes few tasks and files.
SETTINGS = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python have about BATCH_BYTES in this session, unless it has a limit of its own.

    The limit by rows that Spark has besides would let long texts make batches of any size.
    """
    if int(str(spark.conf.get(_BATCH_LIMIT)).removesuffix("b")) == _UNSET:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


#: The one object that this Python process keeps from task to task, under its name.
_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What make gives, kept by this Python process until a task of another kind begins."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """run, for Python workers that wait for other tasks afterwards: freed memory goes back to the system.

    Unless run keeps something itself, what the tasks before have kept goes first.
    """
    def whole(batches: Iterator) -> Iterator:
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
                trim(0)
    return whole


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold inside; what was set before holds again afterwards."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Stages:
    """Tables written to the shared folder to cut lineage; they go when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._fs(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back."""
        with settings(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove stages that nothing still to run reads."""
        for name in names:
            self._fs(self.root).delete(self._path(self.path(name)), True)


def partitions_for(df: DataFrame, mb: int = 16, least: int = 1) -> int:
    """Partitions of about mb MB by the optimizer's estimate of df's size, as far as a driver can hold that many tasks."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(100_000, -(-size // (mb << 20))))


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], rank: str, rows: int) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... without putting a group into one task.

    Equal rows are folded to a count first, so a row repeated any number of times costs one row of
    the shuffle for each task.  The order within a group is by hash bucket, then by ``order``.
    ``groups`` must not be null.  A group has as many buckets as the square root of ``rows``, the
    size of df, so that neither a bucket nor the buckets of a group are more than about that many
    rows for one task, even if one group has them all.
    """
    buckets = max(1, isqrt(rows))
    folded = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).withColumn(
        "__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)) if buckets > 1 else F.lit(0).cast("long"))
    totals = folded.groupBy(*groups, "__bucket").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*groups, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = folded.withColumn("__at", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    joined = placed.join(bases, [*groups, "__bucket"])
    runs = joined.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {RUN}"))))
    each = runs.withColumn("__one", F.explode(F.sequence(
        F.col("__run") * RUN, F.least(F.col("__n"), (F.col("__run") + 1) * RUN) - 1)))
    return each.select(*df.columns, (F.col("__base") + F.col("__at") + F.col("__one")).alias(rank))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores more as it takes for df to have no such column."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def text_bytes(col: Column | str) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a column's texts come to limit bytes at most; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
