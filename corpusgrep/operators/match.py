"""Lines of files and the first match on each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrep.functions import latin1
from corpusgrep.plans.spec import SearchSpec

MATCH_COLUMNS = ["line_no", "col", "pre", "match", "post", "line"]


def _body(content: Column) -> Column:
    """The Latin-1 view without a line feed at its end, which ends the last line and begins none."""
    data = content.cast("binary")
    return latin1.view(F.when(F.endswith(data, F.lit(b"\n")), F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data))


def lines(df: DataFrame, content: str = "content", having: Column | None = None) -> DataFrame:
    """One row per line in place of the content: line_no from 1, and ``line`` in the Latin-1 view.

    Empty and null contents have no lines.  Only line feeds end lines.  No shuffle; the rows of a
    file are made in its own task.  Only contents for which ``having`` holds are split.  It isn't a
    filter, since the optimizer would move that below a repartition of the contents, to run in the
    few tasks that read them.
    """
    keep = [c for c in df.columns if c not in (content, "line_no", "line")]
    some = df.where(F.octet_length(F.col(content).cast("binary")) > 0)
    split = F.split(_body(F.col(content)), "\n")
    split = some.select(*keep, F.posexplode(split if having is None else F.when(having, split)).alias("__pos", "line"))
    return split.select(*keep, (F.col("__pos") + 1).cast("long").alias("line_no"), "line")


def newline_count(content: Column) -> Column:
    view = latin1.view(content)
    return (F.length(view) - F.length(F.replace(view, F.lit("\n"), F.lit("")))).cast("long")


def _outputs(keep: list[str], line: Column, column: Column, match: Column) -> list[Column | str]:
    """Match columns from a Latin-1 line, the match's place (from 1) and its text."""
    size = F.length(match)
    return [*keep, "line_no", column.cast("long").alias("col"),
            latin1.back(F.substring(line, F.lit(1), column - 1)).alias("pre"), latin1.back(match).alias("match"),
            latin1.back(F.substring(line, column + size, F.length(line))).alias("post"), latin1.back(line).alias("line")]


def grep(df: DataFrame, spec: SearchSpec, content: str = "content") -> DataFrame:
    """One row for each line that matches, with the leftmost match: MATCH_COLUMNS after the other columns.

    Columns count bytes.  Whole files are tested, for a string that every match has and for any match
    at all, before they are split into lines; filters on other columns reach the scan.
    Columns named like the results are replaced.
    """
    translated = spec.translated()
    keep = [c for c in df.columns if c != content and c not in MATCH_COLUMNS]
    df = df.select(*keep, content)
    if spec.never:
        df = df.where(F.lit(False))
    if spec.needle:
        df = df.where(F.contains(F.col(content).cast("binary"), F.lit(spec.needle.encode("utf-8", "surrogateescape"))))
    engine = spec.chosen_engine()
    if engine == "jvm":
        having = None
        if spec.plain is None and translated.java_file is not None:
            # Stops at a file's first match, and spares the others from being split.
            having = F.rlike(latin1.view(content), F.lit(translated.java_file))
        return _of_lines(lines(df, content, having), spec, keep)
    return _python(df, content, keep, translated.whole if engine == "whole" else translated.python, engine == "whole")


def _of_lines(found: DataFrame, spec: SearchSpec, keep: list[str]) -> DataFrame:
    line, translated = F.col("line"), spec.translated()
    if spec.plain is not None:
        text = F.lit(latin1.literal(spec.plain))
        return found.where(F.contains(line, text)).select(*_outputs(keep, line, F.instr(line, text), text))
    if spec.needle:
        found = found.where(F.contains(line, F.lit(latin1.literal(spec.needle))))
    rx = F.lit(translated.java)
    return found.where(F.rlike(line, rx)).select(*_outputs(keep, line, F.regexp_instr(line, rx), F.regexp_extract(line, translated.java, 0)))


def grep_lines(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """grep() on (line_no, line) rows, with line in the Latin-1 view, such as those of files too large for one row.

    No shuffle.  Patterns that could see other lines can't be searched for in lines of their own.
    """
    keep = [c for c in df.columns if c not in MATCH_COLUMNS]
    if spec.chosen_engine() == "whole":
        raise ValueError("the pattern looks beyond a line")
    if spec.never:
        df = df.where(F.lit(False))
    if spec.chosen_engine() == "jvm":
        return _of_lines(df, spec, keep)
    found = _python(df.withColumnRenamed("line_no", "__line_no").withColumn("line", F.encode("line", "ISO-8859-1")), "line", [*keep, "__line_no"], spec.translated().python, False)
    return found.select(*keep, F.col("__line_no").alias("line_no"), *MATCH_COLUMNS[1:])


def _python(df: DataFrame, content: str, keep: list[str], pattern: str, whole: bool) -> DataFrame:
    """grep() by Python's regexes over the bytes of Arrow batches, one line at a time or on whole files."""
    names = [f"__c{i}" for i in range(len(keep))]
    rows = df.where(F.octet_length(F.col(content).cast("binary")) > 0).select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(content).cast("binary").alias("__content"))

    def hits(data: bytes, rx: re.Pattern) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        if data.endswith(b"\n"):
            data = data[:-1]
        if not whole:
            for i, line in enumerate(data.split(b"\n")):
                if m := rx.search(line):
                    yield i + 1, m.start() + 1, line[: m.start()], m[0], line[m.end():], line
            return
        start, number = 0, 1
        for m in rx.finditer(data):
            if m.start() < start:  # the line has a match already
                continue
            number += data.count(b"\n", start, m.start()) if m.start() > start else 0
            begin = data.rfind(b"\n", 0, m.start()) + 1
            end = data.find(b"\n", m.end())
            end = len(data) if end < 0 else end
            yield number, m.start() - begin + 1, data[begin:m.start()], m[0], data[m.end():end], data[begin:end]
            start, number = end + 1, number + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern.encode("latin-1"))
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(hits(batch.column("__content")[i].as_py(), rx))
                for a in range(0, len(found), 5000):
                    part = found[a:a + 5000]
                    same = pa.array([i] * len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(n).take(same) for n in names), *(pa.array([x[k] for x in part], pa.int64() if k < 2 else pa.binary()) for k in range(6))],
                        [*names, *MATCH_COLUMNS])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, ", ".join(filter(None, [kinds, "line_no long, col long, pre binary, match binary, post binary, line binary"])))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "line_no", "col", *(F.col(c).cast("string").alias(c) for c in MATCH_COLUMNS[2:]))
