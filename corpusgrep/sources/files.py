"""Files from rows, in a folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which must be mounted everywhere; a temporary one where executors are threads of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    local = found.removeprefix("file://")
    if not local.startswith("/") and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a mounted folder that driver and executors share")
    if local.startswith("/"):
        os.makedirs(local, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=local if local.startswith("/") else None)


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below root; the number of files.

    A file appears whole or not at all, and a task that runs again writes the same ones; of equal
    paths the last written stays.  Null contents become empty files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = os.path.join(root, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with tempfile.NamedTemporaryFile(dir=root, prefix=".new-", delete=False) as f:
                    f.write(content or b"")
                os.replace(f.name, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
