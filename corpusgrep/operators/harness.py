"""The relational parts of a benchmark harness: the matrix of runs, statistics of timings, the reference result, and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes are escaped by a backslash, and blanks after a delimiter don't count."""
    return spark.read.option("header", True).option("escape", "\\").option("ignoreLeadingWhiteSpace", True).option("inferSchema", False).csv(path)


def matrix(cases: DataFrame, programs: DataFrame, options: DataFrame, extra: str = "") -> DataFrame:
    """Each case with each program that knows any options of its kind, and the option text for the case's file type.

    The three tables describe a benchmark and have tens of rows; the product is what is asked for.
    """
    known = programs.join(options.select(F.col("opt_id").alias("opt_only_lang_type")), "opt_only_lang_type")
    pairs = cases.crossJoin(known)
    texts = options.select(F.col("opt_id").alias("o"), F.col("opt_lang_id").alias("l"), F.col("opt_text").alias("opt_filetype"))
    joined = pairs.join(texts, (F.col("file_type") == F.col("l")) & (F.col("opt_only_lang_type") == F.col("o")), "left")
    return joined.select("test_case_id", "desc_long", "prog_id", "exename", "pre_options", F.lit(extra).alias("other_options"), "opt_filetype", "regex", "corpus").distinct()


def statistics(timings: DataFrame, key: str, value: str) -> DataFrame:
    """Runs, mean, sample standard deviation and standard error of the mean by key."""
    sd, n = F.stddev_samp(value), F.count(value)
    return timings.groupBy(key).agg(n.alias("n"), F.avg(value).alias("average"), sd.alias("sample_stddev"), (sd / F.sqrt(n)).alias("sem"))


def reference_result(counts: DataFrame, preferred: list[str], program: str = "prog_id", n: str = "matched_lines") -> DataFrame:
    """The one row to compare with: of the preferred programs the latest in the list, of its rows the one with most lines."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col(program))
    return counts.where(rank > 0).agg(F.max_by(F.struct(program, n), F.struct(rank, n, program)).alias("best")).select(f"best.{program}", f"best.{n}")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more.  Each side is read once, and counted before the shuffle."""
    right = right.select(*left.columns)
    both = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    more = both.groupBy(*left.columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    side = F.when(F.col("__n") > 0, "left").otherwise("right")
    return more.withColumn("side", side).withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))).select(*left.columns, "side")


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """The template with each ``${name}`` replaced by its value; a null value counts as empty, unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def report_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): a row of a Markdown table for each row; nulls are empty, and bars inside a cell are escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(df: DataFrame, columns: list[str], path: str) -> None:
    """Append the rows of a report as text files."""
    report_rows(df, columns).write.mode("append").text(path)
