from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrep.operators import harness
from corpusgrep.operators.match import grep, grep_lines
from corpusgrep.plans.cli import usage
from corpusgrep.plans.spec import SearchSpec
from corpusgrep.sources import tree


def test_difference_counts_copies(spark):
    rng = np.random.default_rng(0)
    left, right = ([(int(a), None if b == 3 else str(b)) for a, b in rng.integers(0, 4, (60, 2))] for _ in range(2))
    got = Counter(map(tuple, harness.difference(*(spark.createDataFrame(x, "a int, b string") for x in (left, right))).collect()))
    want = Counter({(*k, "left"): n for k, n in (Counter(left) - Counter(right)).items()}) + Counter({(*k, "right"): n for k, n in (Counter(right) - Counter(left)).items()})
    assert got == want and want


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    assert sorted(r.value for r in harness.report_rows(df, ["name", "n"]).collect()) == ["|  | 2 |", "| a\\|b | 1 |"]


def test_template(spark):
    row = spark.range(1).select(harness.substitute(F.lit("${a}${b}${c} $a"), {"a": F.lit(1), "b": F.lit(None)}).alias("x")).first()
    assert row.x == "1${c} $a"


@pytest.mark.parametrize("engine", ["auto", "python"])
def test_grep_lines_as_grep(spark, engine):
    df = spark.createDataFrame([("f", "ab\nxabc é\n\nb")], "path string, content string")
    spec = SearchSpec("b.?", "sensitive", engine=engine)
    from corpusgrep.operators.match import lines
    assert sorted(grep_lines(lines(df), spec).collect()) == sorted(grep(df, spec).collect())
    with pytest.raises(ValueError):
        grep_lines(lines(df), SearchSpec("b(?=\\sx)"))


def test_unreadable_files(capsys):
    found = [("/nosuch/file", True, 7), (__file__, False, 9)]
    for errors in ("true", "false"):
        rows = list(tree._Reader({"errors": errors}).read(tree._Files(found)))
        assert len(rows) == (2 if errors == "true" else 1) and rows[-1][1] == "test_harness.py"
        if errors == "true":
            assert rows[0] == ("/nosuch/file", "file", None, None, True, "No such file or directory")
    assert "could not read /nosuch/file" in capsys.readouterr().err


def test_help_names_all_options():
    assert all(len(x) < 140 for x in usage().splitlines()) and "--type-set=VALUE" in usage()
