import pytest
from pyspark.sql import functions as F

from corpusgrep.operators import render
from corpusgrep.operators.selection import DirExclusion, Selection, SelectionError, select_files
from corpusgrep.operators.type_table import BUILTIN

HITS = {"test_file.cpp": 2, "test_file.html": 3}
SHARED = {"a.cpp": 1, "a.c": 1, "a.h": 1}
OWN = {"test_file.xqz": 1, "UserDefinedName": 1, "test_file.7": 1, "test_file.h": 1}
T = lambda *names: [("type", n) for n in names]
SET = [("set", "type1:ext:xqz,7"), ("set", "type2:is:UserDefinedName")]
CASES = [
    (HITS, [], 5), (HITS, T("cpp"), 2), (HITS, T("cpp", "html"), 5), (HITS, T("cpp", "html", "nocpp"), 3),
    (HITS, [("ignore-file", "ext:html")], 2), (HITS, [("ignore-file", "ext:cpp")], 3), (HITS, [("ignore-file", "ext:cpp"), ("ignore-file", "ext:html")], 0),
    (HITS, [("ignore-file", "ext:cpp"), ("ignore-file", "ext:html"), *T("cpp", "html")], 5),
    (HITS, [("exclude", "*.xyz")], 5), (HITS, [("exclude", "*.cpp")], 3), (HITS, [("exclude", "*.cpp"), ("exclude", "*.html")], 0),
    (HITS, [("exclude", "*.cpp"), ("exclude", "*.html"), *T("cpp", "html")], 0),
    (HITS, [("include", "*.xyz")], 0), (HITS, [("include", "*.cpp")], 2), (HITS, [("include", "*.cpp"), ("include", "*.html")], 5),
    (HITS, [("include", "*.cpp"), ("include", "*.html"), *T("nocpp", "nohtml")], 5),
    (HITS, [("include", "*.cpp"), ("exclude", "*.cpp")], 0), (HITS, [("include", "*.cpp"), ("exclude", "*.cpp"), ("include", "*.cpp")], 2),
    (HITS, [("include", "*.cpp"), ("exclude", "*.cpp"), ("include", "*.html")], 3),
    (SHARED, T("cpp"), 2), (SHARED, T("nohh"), 2), (SHARED, T("cpp", "nocc"), 1), (SHARED, T("nocpp", "cc"), 2), (SHARED, T("nocpp", "nocc"), 0),
    (SHARED, T("nocpp", "nocc", "hh"), 1), (SHARED, [], 3),
    (OWN, [], 1), (OWN, SET, 4), (OWN, SET + T("type1"), 2), (OWN, SET + T("notype1"), 2), (OWN, [SET[0], ("add", "type1:is:UserDefinedName"), *T("type1")], 3),
]


@pytest.mark.parametrize("hits,selectors,n", CASES)
def test_algebra(hits, selectors, n):
    selection = Selection.of(selectors)
    assert sum(k for name, k in hits.items() if selection.accepts(name)) == n


def test_predicate_is_the_same_on_the_jvm(spark):
    names = sorted({*HITS, *SHARED, *OWN, ".sh", "a.tar.gz", "Makefile", ".x.cpp", "noext", "a.", "x.CPP", "configure", "CMakeLists.txt", "a\nb.c"})
    df = spark.createDataFrame([(n,) for n in names], "basename string")
    for _, selectors, _ in CASES:
        selection = Selection.of(selectors)
        got = {r.basename for r in df.where(selection.predicate(F.col("basename"))).collect()}
        assert got == {n for n in names if selection.accepts(n)}, selectors


@pytest.mark.parametrize("selectors", [[("add", "fhqz")], [("add", "fgh:lll:abc")], T("nosuch"), T("nonosuch")])
def test_errors(selectors):
    with pytest.raises(SelectionError):
        Selection.of(selectors)


def test_names():
    assert Selection().names_like("py") == ["python"] and len(Selection().names_like("c")) > 1
    assert Selection().names_like("js") == ["js"] and len(Selection(strict=True).names_like("js")) == 3
    assert [n for n in BUILTIN if len(Selection(strict=True).names_like(n)) > 1] == ["asp", "js", "objc", "perl", "tex"]
    assert len(BUILTIN) == 72


def test_explicit_files_and_directories(spark):
    rows = [("a/.git/x.c", "x.c", False), ("a/.git/y.c", "y.c", True), ("a/b/x.c", "x.c", False), ("a/b/x.q", "x.q", False), ("a/b/z.q", "z.q", True), ("d/x.c", "x.c", False)]
    df = spark.createDataFrame(rows, "path string, basename string, explicit boolean")
    got = {r.path for r in select_files(df, Selection(), DirExclusion([("d", True), ("b", True), ("b", False), (".git", False)])).collect()}
    assert got == {"a/.git/y.c", "a/b/x.c", "a/b/z.q"}


def test_listing(spark):
    shown = {r["type"]: r["value"] for r in render.type_listing(Selection().table(spark)).collect()}
    assert shown["python"] == "  python         .py" and shown["cmake"] == "  cmake          .cmake; CMakeLists.txt" and len(shown) == 72


def test_first_lines(spark):
    rows = [("a", "#!/usr/bin/env python3\nx"), ("b", "#!/bin/bash"), ("c", "x\n#!/bin/bash"), ("d", "<?xml version"), ("e", None), ("f", "")]
    df = spark.createDataFrame(rows, "path string, content string")
    hits = lambda s: {r.path for r in df.where(s.first_line_predicate(F.col("content"))).collect()}
    assert hits(Selection()) == {"a", "b", "d"} and hits(Selection.of(T("shell"))) == {"b"}
