import io
import os

import pytest

from corpusgrep.functions.paths import clean_up
from corpusgrep.plans import rc
from corpusgrep.plans.cli import main, parse
from corpusgrep.plans.rc import ArgumentError
from corpusgrep.sources.large_text import large_lines
from corpusgrep.sources.generated import BLOCK, repeated_text
from corpusgrep.sources.tree import deal, read_tree, walk
from corpusgrep.streaming.search import grep_stream, write_matches
from corpusgrep.plans.spec import SearchSpec


@pytest.fixture
def tree(tmp_path, monkeypatch):
    for path, text in {"dir1/dir2/file1.py": "line 1\nline2\nline3\n", "dir1/dir3/file1.s": "line 4\nline 5\nline 6\n", "dir1/file1a.py": "line a\n", "dir1/empty.py": "",
                       "dir1/.git/x.py": "line\n", "dir1/_under.c": "line u\n", ".hidden_no_extension": "line h\n", ".hidden_with_extension.sh": "line s\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    return tmp_path


def search(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    code = main(["--noenv", *args], spark, out, err)
    return code, out.getvalue().splitlines(), err.getvalue().splitlines()


def test_search(spark, tree):
    code, out, _ = search(spark, "line", "dir1")
    assert code == 0 and len(out) == 8 and "dir1/dir2/file1.py:2:line2" in out and "dir1/_under.c:1:line u" in out
    assert len(search(spark, "line", "dir1", "--no-recurse")[1]) == 2
    assert len(search(spark, "--ignore-dir=dir1", "line", "dir1")[1]) == 8 and len(search(spark, "--ignore-dir=dir2", "line", "dir1")[1]) == 5
    code, out, err = search(spark, "--exclude=file1.s", "line", "dir1/dir3/file1.s", "./nosuchdir")
    assert (code, len(out), len(err)) == (0, 3, 1)
    assert search(spark, "line", "nosuch")[0] == 1 and search(spark, "nomatch", "dir1")[0] == 1 and search(spark, "*", "dir1")[0] == 255
    assert search(spark, "line")[1][0] == ".hidden_with_extension.sh:1:line s"
    assert len(search(spark, "line", ".hidden_with_extension.sh", ".hidden_no_extension")[1]) == 2
    assert search(spark, "-H", "--column", "--nocolor", "--py", "line2", "dir1")[1] == ["dir1/dir2/file1.py:2:1:line2"]
    assert search(spark, "-h", "--s", "--asm", "line 5", "dir1")[0] == 255
    assert search(spark, "-h", "--asm", "line 5", "dir1")[1] == ["dir1/dir3/file1.s", "2:line 5"]
    assert search(spark, "--help-types")[1][0].startswith("  actionscript   .as .mxml") and search(spark, "--version")[0] == 0
    assert search(spark, "--nosuchoption", "x")[0] == 255 and search(spark)[0] == 255


def test_links(tree):
    os.symlink("../dir3", tree / "dir1/dir2/link_to_dir3")
    os.symlink("../dir2", tree / "dir1/dir3/link_to_dir2")
    os.remove(tree / "dir1/file1a.py"), os.remove(tree / "dir1/_under.c"), os.remove(tree / "dir1/empty.py")
    accepts, excludes = (lambda n: n.endswith((".py", ".s"))), (lambda n: n == ".git")
    assert len(walk(["dir1"], accepts=accepts, excludes=excludes).files) == 2
    found = walk(["dir1"], follow=True, accepts=accepts, excludes=excludes)
    assert len(found.files) == 4 and found.counts["loops"] == 2
    os.symlink("dir1", tree / "start")
    assert len(walk(["start"], accepts=accepts, excludes=excludes).files) == 2
    assert len(walk(["dir1", "dir1/"], accepts=accepts, excludes=excludes).files) == 4


def test_rows(spark, tree):
    rows = {r.path.split("/")[-1]: r for r in read_tree(spark, [str(tree / "dir1"), str(tree / ".hidden_no_extension")]).collect()}
    assert rows[".hidden_no_extension"].explicit and not rows["file1.py"].explicit and bytes(rows["_under.c"].content) == b"line u\n" and "empty.py" not in rows
    assert read_tree(spark, [str(tree / "nosuch")]).count() == 0
    assert [len(p) for p in deal([("a", False, 10), ("b", False, 10), ("c", False, 1 << 30), ("d", False, 1)], 1 << 20)] == [2, 1, 1]


@pytest.mark.parametrize("path,want", [("./foo", "foo"), ("foo/", "foo"), ("a/b//", "a/b"), (".", "."), ("./", "."), ("/", "/"), ("/x", "/x"), ("../a", "../a")])
def test_start_paths(path, want):
    assert clean_up(path) == want


def test_arguments():
    assert parse(["a", "-i", "b", "c"]).paths == ["b", "c"] and parse(["--", "--noenv"]).pattern == "--noenv"
    assert parse(["--py", "x"]).selectors == [("type", "python")] and parse(["--nopy", "x"]).selectors == [("type", "nopython")]
    assert parse(["--ignore-c", "x"]).case == "ignore" and parse(["-j4", "-wQ", "x"]).jobs == 4
    cases = {("abc",): "smart", ("--smart-case", "abc"): "smart", ("--no-smart-case", "abc"): "sensitive", ("--nosmart-case", "-i", "abc"): "ignore", ("-i", "--smart-case", "AbC"): "smart"}
    assert {k: parse(list(k)).case for k in cases} == cases
    assert parse(["--no-line-number", "--column", "x"]).line_number and parse(["--type-set=foo:ext:z", "--foo", "x"]).selectors[-1] == ("type", "foo")
    for bad in (["--c", "x"], ["--nocs", "x"], ["--zzz", "x"], ["-j0", "x"], ["--jobs=a", "x"], [], ["--include="], ["-Z", "x"]):
        with pytest.raises(ArgumentError):
            parse(bad)


def test_configuration(tmp_path):
    assert rc.parse("# note\n  --cpp\r\n\n-i\n\t--type=html") == ["--cpp", "-i", "--type=html"]
    for bad in ("word", "--"):
        with pytest.raises(ArgumentError):
            rc.parse(bad)
    home, project = tmp_path / "home", tmp_path / "home/p/q"
    project.mkdir(parents=True)
    (home / rc.RC_NAME).write_text("--cpp\n")
    assert rc.options(str(project), str(home)) == ["--cpp"]
    (home / "p" / rc.RC_NAME).write_text("--html\n")
    assert rc.options(str(project), str(home)) == ["--cpp", "--html"] and rc.options(str(project), str(home), user=False) == ["--html"]


def test_large_files(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i} é\n" for i in range(40000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    got = large_lines(spark, str(tmp_path / "big.txt")).selectExpr("line_no", "cast(split(line, ' ')[0] as long) n").where("line_no != n + 1").count()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == 0


def test_generated(spark):
    df = repeated_text(spark, 3_000_000, last="the end\n")
    size, n = df.selectExpr("sum(octet_length(content))", "count_if(endswith(content, 'the end\n'))").collect()[0]
    assert 3_000_000 <= size < 3_000_000 + (1 << 20) + len(BLOCK) and n == 1


def test_stream(spark, tmp_path):
    schema = "path string, content string"
    spark.createDataFrame([("a", "x\ny\nxx"), ("b", "y")], schema).write.parquet(str(tmp_path / "in"))
    found = grep_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), SearchSpec("x"))
    for _ in range(2):  # the second run has nothing new
        write_matches(found, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert sorted((r.path, r.line_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 3)]
    with pytest.raises(ValueError):
        grep_stream(spark.createDataFrame([], schema), SearchSpec("x"))
