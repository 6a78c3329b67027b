"""Corpora from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_table(df: DataFrame, path: Column, content: str, explicit: Column | None = None) -> DataFrame:
    """(path, basename, content, length, explicit) of a table's rows; only the columns used are read."""
    data = F.col(content).cast("binary")
    return df.select(path.alias("path"), data.alias("content"), (F.lit(False) if explicit is None else explicit).alias("explicit")).select(
        "path", F.substring_index("path", "/", -1).alias("basename"), "content", F.octet_length("content").cast("long").alias("length"), "explicit")


#: Bytes for each core up to which a table is dealt out anew.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores, since a file of one row group makes one task however many cores there are.

    Tables of more than SPREAD_BYTES for each core, by the optimizer's estimate, have tasks enough
    and are left as they are, so the shuffle is of bounded size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if cores > 1 and size <= cores * SPREAD_BYTES else df
