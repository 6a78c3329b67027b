"""Counts over matches and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrep.operators.match import newline_count


def per_file(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matched lines of each file that has any."""
    return matches.groupBy(*keys).agg(F.count("*").alias("matched_lines"))


def nested(matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file with its matches as an array in line order."""
    one = F.struct("line_no", "col", "pre", "match", "post", "line")
    return matches.groupBy(*keys).agg(F.count("*").alias("matched_lines"), F.sort_array(F.collect_list(one)).alias("matches"))


def total(matches: DataFrame) -> DataFrame:
    """Matched lines in all, and the exit code: 0 with a match, 1 without."""
    return matches.agg(F.count("*").alias("total_matched_lines")).withColumn("exit_code", F.when(F.col("total_matched_lines") == 0, 1).otherwise(0))


def scanned(files: DataFrame, content: str = "content") -> DataFrame:
    """Files, bytes and line feeds; empty files are counted apart."""
    size = F.coalesce(F.octet_length(F.col(content).cast("binary")), F.lit(0))
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum((size == 0).cast("long")), F.lit(0)).alias("empty_files"),
        F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(newline_count(F.coalesce(F.col(content).cast("binary"), F.lit(b"")))), F.lit(0)).alias("newlines"))


def traversal(files: DataFrame, selected: Column) -> DataFrame:
    """How many files were found, how many are searched, and in how many directories they lie."""
    directory = F.regexp_replace("path", "/[^/]*$", "")
    return files.agg(
        F.count("*").alias("files_found"), F.coalesce(F.sum(F.when(selected, 1).otherwise(0)), F.lit(0)).alias("files_scanned"),
        F.coalesce(F.sum(F.when(selected, 0).otherwise(1)), F.lit(0)).alias("files_rejected"), F.countDistinct(directory).alias("directories"))


def throughput(files: DataFrame, seconds: float, content: str = "content") -> DataFrame:
    """scanned() with megabytes a second for a search that took so long."""
    return scanned(files, content).withColumn("mb_per_second", F.round(F.col("bytes") / 1e6 / F.lit(float(seconds)), 3))


def search_counts(files: DataFrame, walked: dict[str, int], content: str = "content") -> DataFrame:
    """One row with the counts of a walk and of what was read: files, bytes, and files that couldn't be read (a null content)."""
    read = files.agg(
        F.count(content).alias("files_scanned"), (F.count("*") - F.count(content)).alias("files_unreadable"),
        F.coalesce(F.sum(F.octet_length(F.col(content).cast("binary")).cast("long")), F.lit(0)).alias("bytes_scanned"))
    return read.select(*(F.lit(n).cast("long").alias(f"walk_{name}") for name, n in walked.items()), "*")
