"""Generated text of a given size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua\n"


def repeated_text(spark: SparkSession, size: int, rows_of: int = 1 << 20, last: str = "") -> DataFrame:
    """(path, content) rows of the block repeated, size bytes in all at least; the last row ends with ``last``."""
    each = max(1, rows_of // len(BLOCK))
    rows = -(-size // (each * len(BLOCK)))
    body = F.repeat(F.lit(BLOCK), F.lit(each))
    return spark.range(rows).select(
        F.format_string("part-%08d.txt", "id").alias("path"), F.when(F.col("id") == rows - 1, F.concat(body, F.lit(last))).otherwise(body).alias("content"))
