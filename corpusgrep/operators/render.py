"""Matches as text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours of the file name, the line number and the match, and the end of each.
FILE_COLOUR, LINE_COLOUR, MATCH_COLOUR, PLAIN = "\x1b[32;1m\x1b[K", "\x1b[33;1m\x1b[K", "\x1b[30;43;1m\x1b[K", "\x1b[0m\x1b[K"


@dataclass(frozen=True)
class Output:
    """heading: the file name on a line of its own before its matches, not before each."""

    heading: bool = False
    line_number: bool = True
    column: bool = False
    colour: bool = False
    null: bool = False


def display_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def _painted(text: Column, colour: str, on: bool) -> Column:
    return F.concat(F.lit(colour), text, F.lit(PLAIN)) if on else text


def match_line(out: Output) -> Column:
    """A match without its file name; a column is only shown after a line number."""
    parts: list[Column] = []
    if out.line_number or out.column:
        parts += [_painted(F.col("line_no").cast("string"), LINE_COLOUR, out.colour), F.lit(":")]
        if out.column:
            parts += [F.col("col").cast("string"), F.lit(":")]
    return F.concat(*parts, F.col("pre"), _painted(F.col("match"), MATCH_COLOUR, out.colour), F.col("post"))


def prefixed(matches: DataFrame, out: Output, path: str = "path") -> DataFrame:
    """(path, line_no, value): one text line per match."""
    name = _painted(display_path(F.col(path)), FILE_COLOUR, out.colour)
    return matches.select(F.col(path).alias("path"), "line_no", F.concat(name, F.lit("\x00" if out.null else ":"), match_line(out)).alias("value"))


def grouped(matches: DataFrame, out: Output, path: str = "path") -> DataFrame:
    """(path, value): one text block per file, its name first.  Blocks are joined by a blank line."""
    blocks = matches.select(F.col(path).alias("path"), F.struct("line_no", match_line(out).alias("text")).alias("one")).groupBy("path").agg(
        F.sort_array(F.collect_list("one")).alias("all"))
    name = _painted(display_path(F.col("path")), FILE_COLOUR, out.colour)
    return blocks.select("path", F.concat(name, F.lit("\x00" if out.null else ""), F.lit("\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n")).alias("value"))


def render(matches: DataFrame, out: Output, path: str = "path") -> DataFrame:
    return grouped(matches, out, path) if out.heading else prefixed(matches, out, path)


def type_listing(types: DataFrame) -> DataFrame:
    """(type, value): a line for each type with its extensions, then its file names."""
    numbered = types.withColumn("__at", F.monotonically_increasing_id())
    lists = numbered.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("__at", "kind", "filter"))).alias("all"))
    of = lambda kind, dot: F.array_join(F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: F.concat(F.lit(dot), x["filter"])), " ")
    extensions, names = of("ext", "."), of("is", "")
    between = F.when((extensions != "") & (names != ""), F.lit("; ")).otherwise(F.lit(""))
    pad = F.when(F.length("type") < 15, F.rpad("type", 15, " ")).otherwise(F.col("type"))
    return lists.select("type", reduce(F.concat, [F.lit("  "), pad, extensions, between, names]).alias("value"))
