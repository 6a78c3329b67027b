"""Registered queries of sources, sinks, configuration and the command line, with their SQL.

The documents are written as a tree of files, once for each table, and searched
there; what has no table behind it is compared with constants.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrep.functions import paths
from corpusgrep.functions.regex import BadPattern, UnsupportedPattern
from corpusgrep.operators import aggregate, harness, render
from corpusgrep.operators.match import grep, grep_lines
from corpusgrep.operators.selection import Selection
from corpusgrep.plans import cli, rc
from corpusgrep.plans.spec import SearchSpec
from corpusgrep.sources.files import shared_folder, write_files
from corpusgrep.sources.generated import BLOCK, repeated_text
from corpusgrep.sources.large_text import large_lines
from corpusgrep.sources.tree import Found, read_tree, walk
from corpusgrep.streaming.search import grep_stream, write_matches

_DIRS, _EXTENSIONS = ["src", ".git", "doc", "build", "CVS"], [".cpp", ".h", ".c", ".py", ".html", ".sh", ".txt", ".xyz"]
_SPEC, _PATTERN = SearchSpec("th[a-z]+sh", "sensitive"), "th[a-z]+sh"
_roots: dict[tuple[str, str], str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pick(values: list[str], nth: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (nth + 1).cast("int"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The root of a tree with a file for every document: language, a directory, for some one more, and a name."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        k = F.col("doc_id")
        path = F.concat_ws("/", "lang", _pick(_DIRS, k % 5), F.when(k % 3 == 0, "deep"), F.concat(F.lit("doc_"), k.cast("string"), _pick(_EXTENSIONS, k % 8)))
        root = shared_folder(spark, "tree")
        write_files(_documents(spark, sf_dir).select(path.alias("path"), F.col("text").alias("content")), root)
        _roots[key] = root
    return _roots[key]


_SQL_DIR = "(CASE doc_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN '.git' WHEN 2 THEN 'doc' WHEN 3 THEN 'build' ELSE 'CVS' END)"
_SQL_EXT = "(CASE doc_id % 8 WHEN 0 THEN 'cpp' WHEN 1 THEN 'h' WHEN 2 THEN 'c' WHEN 3 THEN 'py' WHEN 4 THEN 'html' WHEN 5 THEN 'sh' WHEN 6 THEN 'txt' ELSE 'xyz' END)"
_SQL_TREE = (f"t AS (SELECT doc_id, lang, text, {_SQL_DIR} AS dir, {_SQL_EXT} AS ext, doc_id % 3 = 0 AS deep, 'doc_' || doc_id || '.' || {_SQL_EXT} AS basename, "
             f"lang || '/' || {_SQL_DIR} || (CASE WHEN doc_id % 3 = 0 THEN '/deep' ELSE '' END) || '/doc_' || doc_id || '.' || {_SQL_EXT} AS path, "
             f"CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE strlen(text) > 0)")
_LINES = "l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no FROM {})"


def _read(spark: SparkSession, sf_dir: str, starts: tuple[str, ...] = ("",), **how) -> DataFrame:
    """Files of the tree below the starts, with paths from its root."""
    root = _tree(spark, sf_dir)
    files = read_tree(spark, [os.path.join(root, s) for s in starts], **how)
    return files.withColumn("path", F.substring(F.col("path"), len(root) + 2, 1 << 30))


def _files(starts: tuple[str, ...] = ("",), **how):
    return lambda spark, sf_dir: _read(spark, sf_dir, starts, **how).select("path", "basename", "length", "explicit")


def _tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(_read(spark, sf_dir).select("path", "content"), _SPEC).select("path", "line_no", "col", "match")


def _walk(spark: SparkSession, sf_dir: str, **how) -> Found:
    return walk([_tree(spark, sf_dir)], **how)


def _stat_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by name ending, from the walk alone."""
    found = spark.createDataFrame([(os.path.splitext(path)[1][1:], size) for path, _, size in _walk(spark, sf_dir).files], "ext string, size long")
    return found.where("size > 0").groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _walk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = Selection.of([("type", "cpp")])
    found = _walk(spark, sf_dir, accepts=selection.accepts, excludes=lambda name: name == "build")
    files = read_tree(spark, [], found=found, errors=True)
    counts = aggregate.search_counts(files, {k: found.counts[k] for k in ("files", "files_rejected", "links_skipped", "loops")})
    return counts.crossJoin(aggregate.throughput(files, 2.0).select("mb_per_second"))  # one row each


def _linked(spark: SparkSession) -> str:
    """Two directories, each with a link to the other, and a link to start from."""
    root = shared_folder(spark, "links")
    for name, text in (("dir2/file1.py", "line 1\nline2\nline3\n"), ("dir3/file1.s", "line 4\nline 5\nline 6\n")):
        os.makedirs(os.path.join(root, "dir1", os.path.dirname(name)))
        with open(os.path.join(root, "dir1", name), "w") as f:
            f.write(text)
    os.symlink("../dir3", os.path.join(root, "dir1/dir2/link_to_dir3"))
    os.symlink("../dir2", os.path.join(root, "dir1/dir3/link_to_dir2"))
    os.symlink("dir1", os.path.join(root, "start"))
    return root


def _links(follow: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = _linked(spark)
        found = walk([f"{root}/start"], follow=follow, accepts=Selection().accepts)
        lines = grep(read_tree(spark, [], found=found).select("path", "content"), SearchSpec("line"))
        return lines.agg(F.count("*").alias("matched_lines")).withColumns({"loops": F.lit(found.counts["loops"]), "links_skipped": F.lit(found.counts["links_skipped"])})
    return query


def _bad_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search says that has one good start path and one that doesn't exist, and its exit code."""
    root, out, err = _linked(spark), io.StringIO(), io.StringIO()
    codes = [cli.run(spark, cli.Request("line", some), out, err) for some in ([f"{root}/dir1", f"{root}/nosuch"], [f"{root}/nosuch"])]
    rows = [(codes[0], codes[1], len(out.getvalue().splitlines()), err.getvalue().replace(root, "")),]
    return spark.createDataFrame(rows, "code int, code_alone int, n_lines int, notices string")


def _constants(rows: list[tuple], schema: str):
    return lambda spark, sf_dir: spark.createDataFrame(rows, schema)


_STARTS = ["./foo", "foo/", "a/b//", ".", "./", "/", "/x", "../a"]


def _start_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = cli.parse(["pattern"]).paths[0]
    return spark.createDataFrame([(s, paths.clean_up(s), default) for s in _STARTS], "start string, path string, default_path string")


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _linked(spark)
    names = ["dir1/../dir1/./dir2", "start//dir3", "dir1/dir2/link_to_dir3/file1.s", "/"]
    rows = [(n, paths.canonical(n, root).removeprefix(root), os.path.samefile(os.path.join(root, n), f"{root}/dir1/dir3")) for n in names]
    return spark.createDataFrame(rows, "path string, canonical string, same_as_dir3 boolean")


def _configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = shared_folder(spark, "home")
    os.makedirs(f"{home}/project/deep")
    for folder, text in ((home, "# user\n--cpp\r\n\n  -i\n"), (f"{home}/project", "--type=html\n\t--column\n")):
        with open(f"{folder}/{rc.RC_NAME}", "w") as f:
            f.write(text)
    options = cli.arguments(["--nocolumn", "x"], f"{home}/project/deep", home)
    request = cli.parse(options)
    return spark.createDataFrame([(i, o, request.case, request.column) for i, o in enumerate(options)], "nth int, option string, case_mode string, with_column boolean")


_ARGUMENTS = [["--py", "x"], ["--nopy", "x"], ["--ignore-c", "X"], ["-i", "--smart-case", "x"], ["--c", "x"], ["--nocs", "x"], ["--zzz", "x"], ["-j0", "x"], ["-wQ", "a.b", "src", "doc"], ["--", "-x"], []]


def _argument_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for argv in _ARGUMENTS:
        try:
            r = cli.parse(argv)
            rows.append((" ".join(argv), 0, r.pattern, ",".join(r.paths), r.case, r.word, ",".join(v for _, v in r.selectors)))
        except rc.ArgumentError:
            rows.append((" ".join(argv), 255, None, None, None, None, None))
    return spark.createDataFrame(rows, "argv string, code int, pattern string, paths string, case_mode string, word boolean, types string")


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for argv in (["x"], ["-H", "x"], ["-h", "x"], ["--nocolor", "x"], ["--color", "--column", "--no-line-number", "x"]):
        for terminal in (False, True):
            how = cli.style(cli.parse(argv), terminal)
            rows.append((" ".join(argv), terminal, how.heading, how.colour, how.line_number, how.column))
    return spark.createDataFrame(rows, "argv string, terminal boolean, heading boolean, colour boolean, line_number boolean, with_column boolean")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for pattern in ("*", "a(", "a)", "[a", "a{2,1}", "\\C", "(?C1)", "(?R)", "a+b", "(?<n>a)", "[[:alpha:]]"):
        try:
            SearchSpec(pattern).translated()
            rows.append((pattern, "taken"))
        except BadPattern:
            rows.append((pattern, "bad"))
        except UnsupportedPattern:
            rows.append((pattern, "unsupported"))
    return spark.createDataFrame(rows, "pattern string, verdict string")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    with open(f"{folder}/t.csv", "w") as f:
        f.write('case_id, desc_short, regex\nTC1, "first, \\"quoted\\"", BOOST.*HPP\nTC2, , 007\n')
    return harness.read_csv(spark, f"{folder}/t.csv")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = repeated_text(spark, 3_000_000, last="the end\n")
    return df.select("path", F.octet_length("content").cast("long").alias("bytes"), F.endswith("content", F.lit("the end\n")).alias("ends"))


def _text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches written as text by the executors, and read again."""
    folder = shared_folder(spark, "text")
    shown = render.prefixed(grep(_read(spark, sf_dir).select("path", "content"), _SPEC), render.Output(column=True))
    shown.select("value").write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/out")
    return spark.read.option("lineSep", "\n").text(f"{folder}/out")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "report")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stats = harness.statistics(events, "event_type", "value").select("event_type", "n", F.when(F.col("n") < 0, "never").alias("note"))
    for some in (stats.where("event_type < 'm'"), stats.where("event_type >= 'm'")):  # a report is appended to
        harness.write_report(some, ["event_type", "n", "note"], f"{folder}/report")
    return spark.read.text(f"{folder}/report")


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("search --${lang} ${missing} '${lang}/${id}' # ${n}")
    return _documents(spark, sf_dir).select("doc_id", harness.substitute(template, {"lang": F.col("lang"), "id": F.col("doc_id"), "n": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))}).alias("command"))


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some of them with a script's first line before their text, by an active type's first-line patterns."""
    script = F.when(F.col("doc_id") % 4 == 1, "#!/bin/bash\n").when(F.col("doc_id") % 4 == 2, "#!/usr/bin/env python3\n").otherwise("")
    docs = _documents(spark, sf_dir).select("doc_id", F.concat(script, "text").alias("text"))
    return docs.where(Selection.of([("type", "shell")]).first_line_predicate(F.col("text"))).select("doc_id")


def _output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grep(_documents(spark, sf_dir).select("lang", "doc_id", "text"), _SPEC, "text")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return found.orderBy("lang", "doc_id", "line_no").select("lang", "doc_id", "line_no", nth.alias("nth"))


def _types_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type with the next one in the listing."""
    names = [r["type"] for r in render.type_listing(Selection.of([("set", "mine:ext:xyz"), ("del", "python")]).table(spark)).orderBy("type").collect()]
    return spark.createDataFrame([(names[i], names[i + 1]) for i in range(len(names) - 1) if names[i][0] in "lmnopr"], "type string, next string")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, searched until all there is has been read, twice: the second time finds nothing new."""
    folder = shared_folder(spark, "stream")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    stream = spark.readStream.schema(_documents(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
    for _ in range(2):
        write_matches(grep_stream(stream, _SPEC, "text"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(grep(docs, _SPEC, "text").schema).parquet(f"{folder}/out").select("doc_id", "line_no", "match")


def _large_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file in many blocks; line numbers count from its beginning."""
    folder = shared_folder(spark, "large")
    text = spark.range(0, 200_000, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(" ü of line "), (F.col("id") % 1000).cast("string")).alias("value"))
    text.write.text(f"{folder}/file")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300000")
    try:
        found = grep_lines(large_lines(spark, f"{folder}/file"), SearchSpec(r"line 99[0-9]$", "sensitive"))
        out = f"{folder}/found"
        found.select("line_no", "col", "match").write.parquet(out)  # while the blocks are small
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out)


def _help(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options by what their line of the help says about short names and values."""
    lines = [x.split() for x in cli.usage().splitlines()[2:]]
    rows = [(x[0][1] if x[0][1] != "-" else None, next(w for w in x if w.startswith("--"))[2:]) for x in lines]
    return spark.createDataFrame([(s, o.removesuffix("=VALUE"), o.endswith("=VALUE")) for s, o in rows], "short string, option string, takes_value boolean")


def _version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(cli.version().splitlines()[0], len(cli.version().splitlines()))], "version string, n_lines int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tree_scan": _files(), "tree_all_files": _files(select=False, dirs=[("build", True)]), "tree_no_recurse": _files(("en/src", "de/doc"), recurse=False),
        "tree_explicit_directory": _files(("en/.git", "en/CVS")), "tree_predicates": _files(accepts=lambda name: name.endswith("7.py"), excludes=lambda name: name == "deep"),
        "tree_search": _tree_search, "tree_sizes": _stat_sizes, "tree_counts": _walk_counts, "links_followed": _links(True), "links_skipped": _links(False), "bad_start_path": _bad_start,
        "start_paths": _start_paths, "canonical_paths": _canonical, "configuration_files": _configuration, "command_arguments": _argument_table, "output_modes": _modes,
        "rejected_patterns": _patterns, "csv_source": _csv, "generated_text": _generated, "text_sink": _text_sink, "report_writer": _report, "template_substitution": _template,
        "first_line_types": _first_lines, "output_order": _output_order, "types_sorted": _types_sorted, "stream_search": _stream, "large_file": _large_file, "help_options": _help, "version": _version,
    }


def oracle_sql() -> dict[str, str]:
    shown = "SELECT path, basename, length, {} AS explicit FROM t WHERE {}"
    known = "ext <> 'xyz'"
    entered = "dir NOT IN ('.git', 'CVS')"
    tree = lambda explicit, where: f"WITH {_SQL_TREE} {shown.format(explicit, where)}"
    hits = f"WITH {_SQL_TREE}, {_LINES.format(f'(SELECT * FROM t WHERE {entered} AND {known})')}, h AS (SELECT path, line_no, line, regexp_extract(line, '{_PATTERN}') AS match FROM l WHERE regexp_matches(line, '{_PATTERN}'))"
    column = f"CAST(strlen(regexp_extract(line, '(?s)^(.*?){_PATTERN}', 1)) + 1 AS BIGINT)"
    rows = -(-3_000_000 // ((1 << 20) // len(BLOCK) * len(BLOCK)))
    docs = _LINES.format("(SELECT doc_id AS path, text FROM documents WHERE strlen(text) > 0)")
    return {
        "tree_scan": tree("false", f"{entered} AND {known}"),
        "tree_all_files": tree("false", f"{entered} AND dir <> 'build'"),
        "tree_no_recurse": tree("false", f"{known} AND NOT deep AND (lang = 'en' AND dir = 'src' OR lang = 'de' AND dir = 'doc')"),
        "tree_explicit_directory": tree("false", f"{known} AND lang = 'en' AND dir IN ('.git', 'CVS')"),
        "tree_predicates": tree("false", "basename LIKE '%7.py' AND NOT deep"),
        "tree_search": f"{hits} SELECT path, line_no, {column} AS col, match FROM h",
        "tree_sizes": f"WITH {_SQL_TREE} SELECT ext, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes FROM t GROUP BY ext",
        "tree_counts": f"""WITH {_SQL_TREE}, a AS (SELECT {_SQL_DIR} AS dir, {_SQL_EXT} AS ext FROM documents),
f AS (SELECT count(*) FILTER (ext IN ('cpp', 'h')) AS walk_files, count(*) FILTER (ext NOT IN ('cpp', 'h')) AS walk_files_rejected FROM a WHERE dir <> 'build')
SELECT walk_files, walk_files_rejected, CAST(0 AS BIGINT) AS walk_links_skipped, CAST(0 AS BIGINT) AS walk_loops, n AS files_scanned, CAST(0 AS BIGINT) AS files_unreadable, b AS bytes_scanned,
       round(CAST(b AS DOUBLE) / 1e6 / 2.0, 3) AS mb_per_second FROM f, (SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS b FROM t WHERE dir <> 'build' AND ext IN ('cpp', 'h'))""",
        "links_followed": "SELECT CAST(12 AS BIGINT) AS matched_lines, 2 AS loops, 0 AS links_skipped",
        "links_skipped": "SELECT CAST(6 AS BIGINT) AS matched_lines, 0 AS loops, 2 AS links_skipped",
        "bad_start_path": "SELECT 0 AS code, 1 AS code_alone, 6 AS n_lines, repeat('corpusgrep: error: could not open /nosuch: No such file or directory' || chr(10), 2) AS notices",
        "start_paths": "SELECT *, '.' AS default_path FROM (VALUES ('./foo', 'foo'), ('foo/', 'foo'), ('a/b//', 'a/b'), ('.', '.'), ('./', '.'), ('/', '/'), ('/x', '/x'), ('../a', '../a')) t(start, path)",
        "canonical_paths": "SELECT * FROM (VALUES ('dir1/../dir1/./dir2', '/dir1/dir2', false), ('start//dir3', '/dir1/dir3', true), ('dir1/dir2/link_to_dir3/file1.s', '/dir1/dir3/file1.s', false), ('/', '/', false)) t(path, canonical, same_as_dir3)",
        "configuration_files": "SELECT *, 'ignore' AS case_mode, false AS with_column FROM (VALUES (0, '--cpp'), (1, '-i'), (2, '--type=html'), (3, '--column'), (4, '--nocolumn'), (5, 'x')) t(nth, option)",
        "command_arguments": """SELECT * FROM (VALUES ('--py x', 0, 'x', '.', 'smart', false, 'python'), ('--nopy x', 0, 'x', '.', 'smart', false, 'nopython'), ('--ignore-c X', 0, 'X', '.', 'ignore', false, ''),
  ('-i --smart-case x', 0, 'x', '.', 'smart', false, ''), ('-wQ a.b src doc', 0, 'a.b', 'src,doc', 'smart', true, ''), ('-- -x', 0, '-x', '.', 'smart', false, ''),
  ('--c x', 255, NULL, NULL, NULL, NULL, NULL), ('--nocs x', 255, NULL, NULL, NULL, NULL, NULL), ('--zzz x', 255, NULL, NULL, NULL, NULL, NULL), ('-j0 x', 255, NULL, NULL, NULL, NULL, NULL),
  ('', 255, NULL, NULL, NULL, NULL, NULL)) t(argv, code, pattern, paths, case_mode, word, types)""",
        "output_modes": """SELECT argv, terminal, coalesce(heading, terminal) AS heading, coalesce(colour, terminal) AS colour, true AS line_number, argv LIKE '%--column%' AS with_column
FROM (VALUES ('x', NULL, NULL), ('-H x', false, NULL), ('-h x', true, NULL), ('--nocolor x', NULL, false), ('--color --column --no-line-number x', NULL, true)) a(argv, heading, colour), (VALUES (false), (true)) b(terminal)
WHERE argv NOT LIKE '%--no-line-number%' UNION ALL SELECT '--color --column --no-line-number x', terminal, terminal, true, false, true FROM (VALUES (false), (true)) b(terminal)""",
        "rejected_patterns": "SELECT * FROM (VALUES ('*', 'bad'), ('a(', 'bad'), ('a)', 'bad'), ('[a', 'bad'), ('a{2,1}', 'bad'), ('\\C', 'bad'), ('(?C1)', 'unsupported'), ('(?R)', 'unsupported'), ('a+b', 'taken'), ('(?<n>a)', 'taken'), ('[[:alpha:]]', 'taken')) t(pattern, verdict)",
        "csv_source": "SELECT * FROM (VALUES ('TC1', 'first, \"quoted\"', 'BOOST.*HPP'), ('TC2', NULL, '007')) t(case_id, desc_short, regex)",
        "generated_text": f"SELECT 'part-' || lpad(CAST(i AS VARCHAR), 8, '0') || '.txt' AS path, CAST({len(BLOCK)} * ({1 << 20} // {len(BLOCK)}) + CASE WHEN i = {rows - 1} THEN 8 ELSE 0 END AS BIGINT) AS bytes, i = {rows - 1} AS ends FROM range({rows}) r(i)",
        "text_sink": f"{hits} SELECT path || ':' || line_no || ':' || {column} || ':' || line AS value FROM h",
        "report_writer": "SELECT '| ' || event_type || ' | ' || count(value) || ' |  |' AS value FROM events GROUP BY event_type",
        "template_substitution": "SELECT doc_id, 'search --' || lang || ' ${missing} ''' || lang || '/' || doc_id || ''' # ' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS command FROM documents",
        "first_line_types": "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND text IS NOT NULL",
        "output_order": f"WITH {docs} SELECT lang, doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS nth FROM l JOIN documents ON doc_id = path WHERE regexp_matches(line, '{_PATTERN}')",
        "types_sorted": """SELECT * FROM (VALUES ('less', 'lisp'), ('lisp', 'lua'), ('lua', 'm4'), ('m4', 'make'), ('make', 'matlab'), ('matlab', 'mine'), ('mine', 'miscellaneous'), ('miscellaneous', 'objc'), ('objc', 'objcpp'), ('objcpp', 'ocaml'),
  ('ocaml', 'parrot'), ('parrot', 'perl'), ('perl', 'perltest'), ('perltest', 'php'), ('php', 'plone'), ('plone', 'rake'), ('rake', 'rr'), ('rr', 'rst'), ('rst', 'ruby'), ('ruby', 'rust'), ('rust', 'sass')) t(type, next)""",
        "stream_search": f"WITH {docs} SELECT path AS doc_id, line_no, regexp_extract(line, '{_PATTERN}') AS match FROM l WHERE regexp_matches(line, '{_PATTERN}')",
        "large_file": "SELECT i + 1 AS line_no, CAST(length(CAST(i AS VARCHAR)) + 8 AS BIGINT) AS col, 'line ' || (i % 1000) AS match FROM range(200000) r(i) WHERE i % 1000 BETWEEN 990 AND 999",
        "help_options": """SELECT * FROM (VALUES ('i', 'ignore-case', false), (NULL, 'smart-case', false), ('w', 'word-regexp', false), ('Q', 'literal', false), ('H', 'with-filename', false), ('h', 'no-with-filename', false),
  ('n', 'line-number', false), (NULL, 'column', false), (NULL, 'color', false), (NULL, 'null', false), ('r', 'recurse', false), (NULL, 'follow', false), ('k', 'known-types', false), (NULL, 'ignore-dir', true),
  (NULL, 'include', true), (NULL, 'exclude', true), (NULL, 'ignore-file', true), (NULL, 'type', true), (NULL, 'type-set', true), (NULL, 'type-add', true), (NULL, 'type-del', true), (NULL, 'dirjobs', true), ('j', 'jobs', true),
  (NULL, 'noenv', false), ('?', 'help', false), (NULL, 'help-types', false), ('V', 'version', false)) t(short, option, takes_value)""",
        "version": "SELECT 'corpusgrep 0.1' AS version, 3 AS n_lines",
    }
