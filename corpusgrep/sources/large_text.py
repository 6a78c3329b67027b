"""Lines of files too large for one row.

Spark's text source splits a file at line ends into blocks.  Lines keep the
order that they are read in, so a line's number is its place in its block and
the counts of the blocks before it in the file; only these counts, a row for
each block, are shuffled, and no file needs to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def large_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with line in the Latin-1 view, for grep_lines."""
    def read() -> DataFrame:
        return spark.read.option("lineSep", "\n").text(path).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")

    blocks = read().groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", (before - F.col("first") + 1).alias("add"))
    joined = read().join(starts, ["path", "block"])
    return joined.select("path", (F.col("at") + F.col("add")).alias("line_no"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))
