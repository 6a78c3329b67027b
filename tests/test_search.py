import re

import pytest

from corpusgrep.functions.regex import BadPattern
from corpusgrep.operators import aggregate
from corpusgrep.operators.match import grep, lines
from corpusgrep.operators.render import Output, render
from corpusgrep.plans.spec import SearchSpec

MODIFIERS = "Generated test file\nptr\nPTR_at_start_of_word\nat_end_of_word_PtR\ninside-ptr-sentence\n"
LITERALS = "Generated test file for --literal\nn\nN\n[n]\nblah [N] bl.h\nbl.h\nblahbl.h\nblah\nsomething BL.H\nsomething Bl.H somethingelse\n"
SMART = "Generated test file for smart-case test\nabc def\ndef ABC\ndef AbC xyz\n"
BLANKS = "abcd  efgh\nFour spaces at the end of the next line\nefgh    \n    ijkl\nefgh    ijkl\n"


def count(spark, text, pattern, **kw):
    df = spark.createDataFrame([("f", text)], "path string, content string")
    return grep(df, SearchSpec(pattern, **kw)).count()


@pytest.mark.parametrize("text,pattern,kw,n", [
    (MODIFIERS, "ptr", {"case": "ignore"}, 4), (MODIFIERS, "ptR", {"case": "ignore"}, 4), (MODIFIERS, "ptr", {"word": True, "case": "sensitive"}, 2),
    (MODIFIERS, "ptr", {"word": True, "case": "ignore"}, 2), (MODIFIERS, "PtR", {}, 1),
    (LITERALS, "[n]", {"literal": True, "case": "sensitive"}, 1), (LITERALS, "[n]", {"literal": True, "case": "ignore"}, 2),
    (LITERALS, "bl.h", {"literal": True, "word": True, "case": "sensitive"}, 2), (LITERALS, "bl.h", {"literal": True, "case": "sensitive"}, 3),
    (LITERALS, "bl.h", {"case": "sensitive"}, 4), (LITERALS, "bl.h", {"literal": True, "word": True, "case": "ignore"}, 4),
    (SMART, "abc", {}, 3), (SMART, "AbC", {}, 1), (SMART, "abc", {"case": "sensitive"}, 1), (SMART, "AbC", {"case": "ignore"}, 3),
    (BLANKS, "efgh\\s+", {}, 2), (BLANKS, "efgh    \n    ijkl", {"literal": True}, 0), ("abcd  efgh\nijkl\n", "efgh\nijkl", {"literal": True, "case": "sensitive"}, 0),
])
@pytest.mark.parametrize("engine", ["auto", "python", "whole"])
def test_counts(spark, text, pattern, kw, n, engine):
    assert count(spark, text, pattern, engine=engine, **kw) == n


def test_bad_pattern(spark):
    with pytest.raises(BadPattern):
        count(spark, "a", "*")


def brute(data: bytes, pattern: str):
    rx = re.compile(pattern.encode())
    body = data[:-1] if data.endswith(b"\n") else data
    for i, line in enumerate(body.split(b"\n") if data else []):
        if m := rx.search(line):
            yield i + 1, m.start() + 1, m[0], line


@pytest.mark.parametrize("engine", ["jvm", "python", "whole"])
@pytest.mark.parametrize("pattern", ["x*", "a.", "[^a]", "é", "\\w+", "^", "$", "b\\b", "\\S\\s"])
def test_bytes(spark, engine, pattern):
    files = [b"", b"\n", b"a\n\n", "é aé\r\nab\tä\n".encode(), b"a\x00b\n\xff\xfea", b"\xc3\n\xa9", "x😀abc\nab".encode(), b"ab"]
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)] + [(99, None)], "id int, content binary")
    got = sorted((r.id, r.line_no, r.col, r.match, r.line) for r in grep(df, SearchSpec(pattern, "sensitive", engine=engine)).selectExpr(
        "id", "line_no", "col", "hex(cast(match as binary)) match", "hex(cast(line as binary)) line").collect())
    want = sorted((i, n, c, m.hex().upper(), line.hex().upper()) for i, f in enumerate(files) for n, c, m, line in brute(f, pattern))
    assert got == want


def test_other_lines_are_seen_by_lookarounds_only(spark):
    assert count(spark, "foo\nbar\nfoo\nbaz", "foo(?=\\sbar)") == 1
    assert count(spark, "foo\nfoo", "\\Afoo") == 1


def test_parts_and_other_columns(spark):
    df = spark.createDataFrame([("f", "k", "é if(x) y", 7)], "path string, line string, content string, col int")
    row = grep(df, SearchSpec("IF\\(.\\)", "ignore")).collect()[0].asDict()
    assert row == {"path": "f", "line_no": 1, "col": 4, "pre": "é ", "match": "if(x)", "post": " y", "line": "é if(x) y"}


def test_deep_patterns_do_not_overflow(spark):
    assert count(spark, "ab" * 30000 + "c", "^(?:a|b)*c$") == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, "abc", "x") for i in range(50)], "id int, content string, other string").write.parquet(str(tmp_path / "t"))
    found = grep(spark.read.parquet(str(tmp_path / "t")).select("id", "content"), SearchSpec("b")).where("id < 5").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,5)" in plan and "other" not in plan and "Exchange" not in plan
    assert found.count() == 5


def test_totals(spark):
    df = spark.createDataFrame([("a", "x\ny\nx"), ("b", "y"), ("c", ""), ("d", None)], "path string, content string")
    found = grep(df, SearchSpec("x"))
    assert aggregate.total(found).collect()[0][:] == (2, 0)
    assert aggregate.total(grep(df, SearchSpec("q"))).collect()[0][:] == (0, 1)
    assert aggregate.per_file(found, ["path"]).collect()[0][:] == ("a", 2)
    assert [m.line_no for m in aggregate.nested(found, ["path"]).collect()[0].matches] == [1, 3]
    assert aggregate.scanned(df).collect()[0][:] == (4, 2, 6, 2)
    assert lines(df).count() == 4


IF = "if(0)\n{\n\t//< tab\n\tdo_something();\n    //< spaces\n    do_something_else();\n}\n"


@pytest.mark.parametrize("out,want", [
    (Output(column=True), ["test_file.cpp:4:2:\tdo_something();", "test_file.cpp:6:5:    do_something_else();"]),
    (Output(), ["test_file.cpp:4:\tdo_something();", "test_file.cpp:6:    do_something_else();"]),
    (Output(line_number=False), ["test_file.cpp:\tdo_something();", "test_file.cpp:    do_something_else();"]),
    (Output(null=True), ["test_file.cpp\x004:\tdo_something();", "test_file.cpp\x006:    do_something_else();"]),
    (Output(heading=True, column=True), ["test_file.cpp\n4:2:\tdo_something();\n6:5:    do_something_else();"]),
    (Output(heading=True), ["test_file.cpp\n4:\tdo_something();\n6:    do_something_else();"]),
])
def test_presentation(spark, out, want):
    df = spark.createDataFrame([("./test_file.cpp", IF)], "path string, content string")
    assert [r["value"] for r in render(grep(df, SearchSpec("do_some")), out).collect()] == want


def test_colours(spark):
    df = spark.createDataFrame([("t.cpp", "abcd\nefgh\nabcd\n")], "path string, content string")
    name, number, end = "\x1b[32;1m\x1b[Kt.cpp\x1b[0m\x1b[K", "\x1b[33;1m\x1b[K%d\x1b[0m\x1b[K", "\x1b[0m\x1b[K"
    hit = "a\x1b[30;43;1m\x1b[Kbc" + end + "d"
    assert [r["value"] for r in render(grep(df, SearchSpec("bc")), Output(colour=True)).collect()] == [f"{name}:{number % n}:{hit}" for n in (1, 3)]
    assert [r["value"] for r in render(grep(df, SearchSpec("bc")), Output(colour=True, heading=True)).collect()] == [f"{name}\n{number % 1}:{hit}\n{number % 3}:{hit}"]


def test_no_regex_below_a_repartition(spark):
    files = spark.createDataFrame([("a", "one\ntwo one\n"), ("b", "three"), ("c", "tw\no")], "path string, content string").repartition(3)
    found = grep(files, SearchSpec("tw[a-z]", "sensitive"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.split("Repartition")[0] and "RLIKE" not in plan.split("Repartition")[1]
    assert [(r.path, r.line_no, r.match) for r in found.collect()] == [("a", 2, "two")]
