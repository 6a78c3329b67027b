"""Registered search queries and their SQL.

The SQL is written by hand for the tables; it shares nothing with the engine
but the pattern texts.  SQL patterns are ASCII and match per line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrep.functions import paths
from corpusgrep.operators import aggregate, harness, render
from corpusgrep.operators.match import grep, lines
from corpusgrep.operators.selection import DirExclusion, Selection, select_files
from corpusgrep.plans import scenarios
from corpusgrep.plans.spec import SearchSpec
from corpusgrep.sources.table import from_table, spread

#: File names that documents are given, and the same in SQL.
_EXTENSIONS = [".cpp", ".h", ".c", ".py", ".html", ".sh", ".txt", ".xyz"]
_DIRS = ["src", ".git", "doc", "build", "CVS"]
_SQL_NAME = """(CASE WHEN doc_id % 31 = 0 THEN 'Makefile' WHEN doc_id % 37 = 0 THEN '.sh' WHEN doc_id % 41 = 0 THEN '_u.py'
  ELSE 'doc_' || doc_id || (CASE doc_id % 8 WHEN 0 THEN '.cpp' WHEN 1 THEN '.h' WHEN 2 THEN '.c' WHEN 3 THEN '.py' WHEN 4 THEN '.html' WHEN 5 THEN '.sh' WHEN 6 THEN '.txt' ELSE '.xyz' END) END)"""
_SQL_DIR = "(CASE doc_id % 5 WHEN 0 THEN 'src' WHEN 1 THEN '.git' WHEN 2 THEN 'doc' WHEN 3 THEN 'build' ELSE 'CVS' END)"
_SQL_PATH = f"lang || '/' || {_SQL_DIR} || '/' || {_SQL_NAME}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _virtual_name() -> Column:
    k = F.col("doc_id")
    extension = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (k % 8 + 1).cast("int"))
    return F.when(k % 31 == 0, "Makefile").when(k % 37 == 0, ".sh").when(k % 41 == 0, "_u.py").otherwise(F.concat(F.lit("doc_"), k.cast("string"), extension))


def _virtual_path() -> Column:
    return F.concat("lang", F.lit("/"), F.element_at(F.array(*map(F.lit, _DIRS)), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("/"), _virtual_name())


def _corpus(spark: SparkSession, sf_dir: str, explicit: Column | None = None) -> DataFrame:
    return from_table(_table(spark, sf_dir, "documents"), _virtual_path(), "text", explicit)


def _lines_sql(table: str, keys: str, text: str) -> str:
    return (f"l AS (SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, "
            f"CAST(generate_subscripts(string_split({text}, chr(10)), 1) AS BIGINT) AS line_no FROM {table} WHERE strlen({text}) > 0)")


def _match_sql(pattern: str, flags: str = "c") -> str:
    p = pattern.replace("'", "''")
    pre = f"regexp_extract(line, '(?s)^(.*?)(?:{p})', 1, '{flags}')"
    match = f"regexp_extract(line, '{p}', 0, '{flags}')"
    return (f"CAST(strlen({pre}) + 1 AS BIGINT) AS col, {pre} AS pre, {match} AS match, "
            f"substr(line, length({pre}) + length({match}) + 1) AS post, line")


def _where(pattern: str, flags: str = "c") -> str:
    return f"regexp_matches(line, '{pattern.replace(chr(39), chr(39) * 2)}', '{flags}')"


#: Searches of documents: name, request, the pattern for SQL and its flags.
SEARCHES: list[tuple[str, SearchSpec, str, str]] = [
    ("grep_regex", SearchSpec(r"th[a-z]+ion\s+[a-z]+sh", "sensitive"), r"th[a-z]+ion\s+[a-z]+sh", "c"),
    ("grep_literal", SearchSpec("MIT License.", "sensitive", literal=True), r"MIT License\.", "c"),
    ("grep_plain_word", SearchSpec("License", "sensitive"), "License", "c"),
    ("grep_ignore_case", SearchSpec("the", "ignore"), "the", "i"),
    ("grep_word", SearchSpec("der", "sensitive", word=True), r"\bder\b", "c"),
    ("grep_word_ignore_case", SearchSpec("the", "ignore", word=True), r"\bthe\b", "i"),
    ("grep_literal_quoted", SearchSpec("a.", "sensitive", literal=True), r"a\.", "c"),
    ("grep_literal_word", SearchSpec("License", "sensitive", literal=True, word=True), r"\bLicense\b", "c"),
    ("grep_smart_case_lower", SearchSpec("licensed under"), "licensed under", "i"),
    ("grep_smart_case_upper", SearchSpec("Licensed"), "Licensed", "c"),
    ("grep_class", SearchSpec(r"[[:digit:]]{1,3}(\.[0-9]{1,3}){3}", "sensitive"), r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "c"),
    ("grep_alternation", SearchSpec("Apache|MIT|token = ", "sensitive"), "Apache|MIT|token = ", "c"),
    ("grep_named_group", SearchSpec(r"(?<a>[0-9a-f]{40})", "sensitive"), "[0-9a-f]{40}", "c"),
    ("grep_anchors", SearchSpec(r"^The\b.*[.]$", "sensitive"), r"^The\b.*[.]$", "c"),
    ("grep_zero_length", SearchSpec("x*", "sensitive"), "x*", "c"),
    ("grep_non_ascii", SearchSpec("ü[a-z]+", "sensitive"), "ü[a-z]+", "c"),
    ("grep_python_engine", SearchSpec(r"[a-z]+ | ed", "sensitive", engine="python"), "[a-z]+ | ed", "c"),
    ("grep_repeated_alternatives", SearchSpec(r"(?:an|th)+ ", "sensitive"), "(?:an|th)+ ", "c"),
]

#: Selections of documents by virtual path: name, selectors, and the SQL test of (name).
_EXT = "(CASE WHEN strpos(substr(name, 2), '.') > 0 THEN string_split(name, '.')[-1] END)"


def _in(*values: str) -> str:
    return ", ".join(f"'{v}'" for v in values)


_CPP, _CC, _HTML, _PY, _SH, _TXT = ("cpp", "cc", "cxx", "m", "hpp", "hh", "h", "hxx"), ("c", "h", "xs"), ("htm", "html"), ("py",), ("sh", "bash", "csh", "tcsh", "ksh", "zsh", "fish"), ("txt",)
_DEFAULT = f"({_EXT} IN ({_in('cpp', 'h', 'c', 'py', 'html', 'sh', 'txt')}) OR name = 'Makefile')"
SELECTIONS: list[tuple[str, list[tuple[str, str]], str]] = [
    ("types_default", [], _DEFAULT),
    ("type_cpp", [("type", "cpp")], f"{_EXT} IN ({_in(*_CPP)})"),
    ("type_nohh", [("type", "nohh")], f"({_EXT} IN ({_in('cpp', 'c', 'py', 'html', 'sh', 'txt')}) OR name = 'Makefile')"),
    ("type_cpp_nocc", [("type", "cpp"), ("type", "nocc")], f"{_EXT} IN ({_in('cpp', 'cc', 'cxx', 'm', 'hpp', 'hh', 'hxx')})"),
    ("type_nocpp_nocc_hh", [("type", "nocpp"), ("type", "nocc"), ("type", "hh")], f"{_EXT} IN ({_in('h')})"),
    ("include_glob", [("include", "*.xyz")], "name GLOB '*.xyz'"),
    ("exclude_glob", [("exclude", "doc_1*")], f"{_DEFAULT} AND NOT name GLOB 'doc_1*'"),
    ("include_exclude_sequence", [("include", "*.cpp"), ("exclude", "doc_2*"), ("include", "doc_24.*")], "CASE WHEN name GLOB 'doc_24.*' THEN true WHEN name GLOB 'doc_2*' THEN false ELSE name GLOB '*.cpp' END"),
    ("exclude_before_type", [("exclude", "*.cpp"), ("type", "cpp"), ("type", "html")], f"{_EXT} IN ({_in(*_CPP, *_HTML)}) AND NOT name GLOB '*.cpp'"),
    ("ignore_file_ext", [("ignore-file", "ext:html,py")], f"({_EXT} IN ({_in('cpp', 'h', 'c', 'sh', 'txt')}) OR name = 'Makefile')"),
    ("user_type_ext_is", [("set", "mine:ext:xyz,txt"), ("add", "mine:is:Makefile"), ("type", "mine")], f"({_EXT} IN ({_in('xyz', 'txt')}) OR name = 'Makefile')"),
    ("user_type_removed", [("add", "mine:ext:xyz"), ("del", "python"), ("type", "notext")], f"({_EXT} IN ({_in('cpp', 'h', 'c', 'html', 'sh', 'xyz')}) OR ({_EXT} = 'py') OR name = 'Makefile')"),
]


def _search(spec: SearchSpec):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grep(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), spec, "text")
    return query


def _selection(selectors: list[tuple[str, str]], explicit: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = _corpus(spark, sf_dir, F.col("doc_id") % 50 == 7 if explicit else None)
        return select_files(corpus, Selection.of(selectors)).groupBy("basename").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return query


_SPEC = SearchSpec("th[a-z]+sh", "sensitive")
_SQL_PATTERN = "th[a-z]+sh"


def _matches(spark: SparkSession, sf_dir: str, spec: SearchSpec = _SPEC) -> DataFrame:
    return grep(spread(_corpus(spark, sf_dir).select("path", "content")), spec)


def _rendered(out: render.Output):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return render.render(_matches(spark, sf_dir), out).select("value")
    return query


_HITS = f"WITH d AS (SELECT *, {_SQL_PATH} AS path FROM documents), {_lines_sql('d', 'path', 'text')}, h AS (SELECT path, line_no, {_match_sql(_SQL_PATTERN)} FROM l WHERE {_where(_SQL_PATTERN)})"
_E = "chr(27)"
_FILE, _LINE, _MARK, _END = (f"{_E} || '{c}' || {_E} || '[K'" for c in ("[32;1m", "[33;1m", "[30;43;1m", "[0m"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(spread(_table(spark, sf_dir, "pages").select("page_id", "html")), SearchSpec("<h[1-6]>[^<]*", "sensitive"), "html")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep(spread(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), SearchSpec("and", "ignore", word=True), "text")


def _per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.per_file(_search(_SPEC)(spark, sf_dir), ["doc_id"])


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregate.nested(_search(_SPEC)(spark, sf_dir), ["doc_id"])
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["line_no"], m["col"], m["match"])), "|")
    return found.select("doc_id", "matched_lines", shown.alias("matches"))


def _total(spec: SearchSpec):
    return lambda spark, sf_dir: aggregate.total(_search(spec)(spark, sf_dir))


def _line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def _bytes_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.scanned(_table(spark, sf_dir, "documents"), "text")


def _ignore_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _corpus(spark, sf_dir).where(DirExclusion([("build", True), ("doc", True), ("doc", False), (".git", False)]).predicate(F.col("path")))
    return kept.groupBy(paths.dirname(F.col("path")).alias("directory")).agg(F.count("*").alias("n"))


def _traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return aggregate.traversal(corpus, Selection.of([("type", "cpp")]).predicate(F.col("basename")))


def _help_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.type_listing(Selection.of([("set", "mine:ext:xyz,txt"), ("add", "mine:is:Makefile")]).table(spark))


def _path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    split = paths.split_nonempty(F.concat(F.lit("/"), p, F.lit("//x")), "/")
    return _corpus(spark, sf_dir).select(
        "path", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), F.size(split).cast("long").alias("n_parts"), paths.join_nonempty(split, "+").alias("joined"),
        paths.is_absolute(p).alias("absolute"), render.display_path(F.concat(F.lit("./"), p)).alias("shown"), paths.hexadecimal(F.col("length")).alias("hex_length"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir).select("path", "line_no")
    return found.unionByName(found.where(F.startswith("path", F.lit("en/")))).groupBy("path", "line_no").agg(F.count("*").alias("n"))


_CASES = [("TC1", "first", "opts_cpp_only", "BOOST.*HPP", "a"), ("TC4", "fourth", "opts_c_only", "PM_RESUME", "b"), ("TC7", "seventh", "opts_any", "Sherlock Holmes", "c")]
_PROGRAMS = [("one", "one", "--noenv", "only_ack"), ("two", "rg", "-Sun", "only_rg"), ("three", "grep", "-Ern", "only_grep"), ("four", "x", "", "only_none")]
_OPTIONS = [("only_ack", "opts_c_only", "--cc"), ("only_ack", "opts_cpp_only", "--cpp"), ("only_ack", "opts_any", None), ("only_rg", "opts_c_only", "-t c"), ("only_rg", "opts_cpp_only", "-t cpp"), ("only_grep", "opts_c_only", "--include=*.c")]


def _bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.matrix(
        spark.createDataFrame(_CASES, "test_case_id string, desc_long string, file_type string, regex string, corpus string"),
        spark.createDataFrame(_PROGRAMS, "prog_id string, exename string, pre_options string, opt_only_lang_type string"),
        spark.createDataFrame(_OPTIONS, "opt_id string, opt_lang_id string, opt_text string"), " -j2")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


def _bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = harness.statistics(_table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("average", "sample_stddev", "sem")))


def _bench_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = grep(_table(spark, sf_dir, "documents").select("source", "text"), _SPEC, "text").groupBy(F.col("source").alias("prog_id")).agg(F.count("*").alias("matched_lines"))
    return harness.reference_result(counts, ["src3", "src1", "src7"])


def _result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (grep(_table(spark, sf_dir, "documents").select("doc_id", "text"), SearchSpec(p, "sensitive"), "text").select("doc_id", "line_no") for p in ("thsh", "sh[a-z]*th"))
    return harness.difference(left, right)


def _best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three files of each language with most matched lines (a report)."""
    counts = grep(_table(spark, sf_dir, "documents").select("lang", "doc_id", "text"), _SPEC, "text").groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "doc_id"))
    return counts.withColumn("place", rank).where("place <= 3")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _search(spec) for name, spec, _, _ in SEARCHES}
    out |= {name: _selection(selectors) for name, selectors, _ in SELECTIONS}
    out |= {
        "explicit_bypass": _selection([("type", "cpp")], True), "grep_pages_html": _pages, "grep_conversations": _conversations,
        "count_per_file": _per_file, "matches_nested": _nested, "total_matches": _total(_SPEC), "exit_code_nomatch": _total(SearchSpec("NO_MATCH_AT_ALL")),
        "newline_literal": _total(SearchSpec("a\nb", literal=True)), "line_count": _line_count, "bytes_scanned": _bytes_scanned, "ignore_dir": _ignore_dir, "traversal_stats": _traversal,
        "render_prefixed": _rendered(render.Output()), "render_column": _rendered(render.Output(column=True)), "render_no_line_number": _rendered(render.Output(line_number=False)),
        "render_color": _rendered(render.Output(colour=True, column=True)), "render_heading": _rendered(render.Output(heading=True)), "render_heading_color": _rendered(render.Output(heading=True, colour=True)), "render_null": _rendered(render.Output(null=True)),
        "help_types": _help_types, "path_functions": _path_functions, "multi_root_union": _roots,
        "bench_matrix": _bench_matrix, "bench_stats": _bench_stats, "bench_argmax": _bench_argmax, "result_diff": _result_diff, "best_files": _best_lines,
    }
    return out | scenarios.queries()


def oracle_sql() -> dict[str, str]:
    documents = _lines_sql("documents", "doc_id", "text")
    out = {name: f"WITH {documents} SELECT doc_id, line_no, {_match_sql(p, flags)} FROM l WHERE {_where(p, flags)}" for name, _, p, flags in SEARCHES}
    named = f"SELECT *, {_SQL_NAME} AS name FROM documents"
    summary = "SELECT name AS basename, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes"
    out |= {name: f"WITH d AS ({named}) {summary} FROM d WHERE {test} GROUP BY name" for name, _, test in SELECTIONS}
    hits = f"WITH {documents}, h AS (SELECT doc_id, line_no, {_match_sql(_SQL_PATTERN)} FROM l WHERE {_where(_SQL_PATTERN)})"
    prefix = "path || ':' || line_no || ':'"
    out |= {
        "explicit_bypass": f"WITH d AS ({named}) {summary} FROM d WHERE doc_id % 50 = 7 OR {_EXT} IN ({_in(*_CPP)}) GROUP BY name",
        "grep_pages_html": f"WITH {_lines_sql('pages', 'page_id', 'html')} SELECT page_id, line_no, {_match_sql('<h[1-6]>[^<]*')} FROM l WHERE {_where('<h[1-6]>[^<]*')}",
        "grep_conversations": f"WITH {_lines_sql('conversations', 'conv_id, turn', 'text')} SELECT conv_id, turn, line_no, {_match_sql(chr(92) + 'band' + chr(92) + 'b', 'i')} FROM l WHERE {_where(chr(92) + 'band' + chr(92) + 'b', 'i')}",
        "count_per_file": f"{hits} SELECT doc_id, count(*) AS matched_lines FROM h GROUP BY doc_id",
        "matches_nested": f"{hits} SELECT doc_id, count(*) AS matched_lines, string_agg(line_no || ':' || col || ':' || match, '|' ORDER BY line_no) AS matches FROM h GROUP BY doc_id",
        "total_matches": f"{hits} SELECT count(*) AS total_matched_lines, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS exit_code FROM h",
        "exit_code_nomatch": f"WITH {documents} SELECT count(*) AS total_matched_lines, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS exit_code FROM l WHERE contains(line, 'NO_MATCH_AT_ALL')",
        "newline_literal": "SELECT CAST(0 AS BIGINT) AS total_matched_lines, 1 AS exit_code",
        "line_count": f"WITH {documents} SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id",
        "bytes_scanned": "SELECT count(*) AS files, CAST(sum(CASE WHEN strlen(coalesce(text, '')) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS newlines FROM documents",
        "ignore_dir": f"SELECT lang || '/' || {_SQL_DIR} AS directory, count(*) AS n FROM documents WHERE {_SQL_DIR} NOT IN ('build', '.git', 'CVS') GROUP BY 1",
        "traversal_stats": f"WITH d AS (SELECT *, {_SQL_NAME} AS name FROM documents) SELECT count(*) AS files_found, count(*) FILTER (WHERE {_EXT} IN ({_in(*_CPP)})) AS files_scanned, count(*) FILTER (WHERE NOT coalesce({_EXT} IN ({_in(*_CPP)}), false)) AS files_rejected, count(DISTINCT lang || '/' || {_SQL_DIR}) AS directories FROM d",
        "render_prefixed": f"{_HITS} SELECT {prefix} || line AS value FROM h",
        "render_column": f"{_HITS} SELECT {prefix} || col || ':' || line AS value FROM h",
        "render_no_line_number": f"{_HITS} SELECT path || ':' || line AS value FROM h",
        "render_color": f"{_HITS} SELECT {_FILE} || path || {_END} || ':' || {_LINE} || line_no || {_END} || ':' || col || ':' || pre || {_MARK} || match || {_END} || post AS value FROM h",
        "render_heading": f"{_HITS} SELECT path || chr(10) || string_agg(line_no || ':' || line, chr(10) ORDER BY line_no, line) AS value FROM h GROUP BY path",
        "render_heading_color": f"{_HITS} SELECT {_FILE} || path || {_END} || chr(10) || string_agg({_LINE} || line_no || {_END} || ':' || pre || {_MARK} || match || {_END} || post, chr(10) ORDER BY line_no, pre || {_MARK} || match || {_END} || post) AS value FROM h GROUP BY path",
        "render_null": f"{_HITS} SELECT path || chr(0) || line_no || ':' || line AS value FROM h",
        "help_types": """SELECT * FROM (VALUES ('actionscript', '  actionscript   .as .mxml'), ('ada', '  ada            .ada .adb .ads'), ('asm', '  asm            .asm .s .S'), ('asp', '  asp            .asp'),
  ('aspx', '  aspx           .master .ascx .asmx .aspx .svc'), ('autoconf', '  autoconf       .ac .in'), ('automake', '  automake       .am .in'), ('awk', '  awk            .awk'),
  ('batch', '  batch          .bat .cmd'), ('cc', '  cc             .c .h .xs'), ('cfmx', '  cfmx           .cfc .cfm .cfml'), ('clojure', '  clojure        .clj'),
  ('cmake', '  cmake          .cmake; CMakeLists.txt'), ('coffeescript', '  coffeescript   .coffee'), ('cpp', '  cpp            .cpp .cc .cxx .m .hpp .hh .h .hxx'), ('csharp', '  csharp         .cs'),
  ('css', '  css            .css'), ('dart', '  dart           .dart'), ('delphi', '  delphi         .pas .int .dfm .nfm .dof .dpk .dproj .groupproj .bdsgroup .bdsproj'), ('elisp', '  elisp          .el'),
  ('elixir', '  elixir         .ex .exs'), ('erlang', '  erlang         .erl .hrl'), ('fortran', '  fortran        .f .f77 .f90 .f95 .f03 .for .ftn .fpp'), ('go', '  go             .go'),
  ('groovy', '  groovy         .groovy .gtmpl .gpp .grunit .gradle'), ('haskell', '  haskell        .hs .lhs'), ('hh', '  hh             .h'), ('html', '  html           .htm .html'),
  ('jade', '  jade           .jade'), ('java', '  java           .java .properties'), ('js', '  js             .js'), ('json', '  json           .json'),
  ('jsp', '  jsp            .jsp .jspx .jhtm .jhtml'), ('less', '  less           .less'), ('lisp', '  lisp           .lisp .lsp'), ('lua', '  lua            .lua'), ('m4', '  m4             .m4'),
  ('make', '  make           .mk .mak; makefile Makefile Makefile.Debug Makefile.Release'), ('matlab', '  matlab         .m'), ('mine', '  mine           .xyz .txt; Makefile'),
  ('miscellaneous', '  miscellaneous  .qbk .w .ipp .patch; configure'), ('objc', '  objc           .m .h'), ('objcpp', '  objcpp         .mm .h'), ('ocaml', '  ocaml          .ml .mli'),
  ('parrot', '  parrot         .pir .pasm .pmc .ops .pod .pg .tg'), ('perl', '  perl           .pl .pm .pod .t .psgi'), ('perltest', '  perltest       .t'),
  ('php', '  php            .php .phpt .php3 .php4 .php5 .phtml'), ('plone', '  plone          .pt .cpt .metadata .cpy .py'), ('python', '  python         .py'), ('rake', '  rake           Rakefile'),
  ('rr', '  rr             .R'), ('rst', '  rst            .rst'), ('ruby', '  ruby           .rb .rhtml .rjs .rxml .erb .rake .spec; Rakefile'), ('rust', '  rust           .rs'),
  ('sass', '  sass           .sass .scss'), ('scala', '  scala          .scala'), ('scheme', '  scheme         .scm .ss'), ('shell', '  shell          .sh .bash .csh .tcsh .ksh .zsh .fish'),
  ('smalltalk', '  smalltalk      .st'), ('smarty', '  smarty         .tpl'), ('sql', '  sql            .sql .ctl'), ('stylus', '  stylus         .styl'), ('tcl', '  tcl            .tcl .itcl .itk'),
  ('tex', '  tex            .tex .cls .sty'), ('text', '  text           .txt; ChangeLog README'), ('tt', '  tt             .tt .tt2 .ttml'), ('vb', '  vb             .bas .cls .frm .ctl .vb .resx'),
  ('verilog', '  verilog        .v .vh .sv'), ('vhdl', '  vhdl           .vhd .vhdl'), ('vim', '  vim            .vim'), ('xml', '  xml            .xml .dtd .xsl .xslt .ent'),
  ('yaml', '  yaml           .yaml .yml')) t(type, value)""",
        "path_functions": f"""WITH d AS (SELECT {_SQL_PATH} AS path, strlen(text) AS n FROM documents)
SELECT path, string_split(path, '/')[-1] AS base, array_to_string(string_split(path, '/')[:-2], '/') AS dir, CAST(4 AS BIGINT) AS n_parts, replace(path, '/', '+') || '+x' AS joined,
       path LIKE '/%' AS absolute, path AS shown, '0x' || lower(to_hex(n)) AS hex_length FROM d""",
        "multi_root_union": f"{_HITS}, u AS (SELECT path, line_no FROM h UNION ALL SELECT path, line_no FROM h WHERE path LIKE 'en/%') SELECT path, line_no, count(*) AS n FROM u GROUP BY ALL",
        "bench_matrix": f"""WITH t(test_case_id, desc_long, file_type, regex, corpus) AS (VALUES {_values(_CASES)}), p(prog_id, exename, pre_options, opt_only_lang_type) AS (VALUES {_values(_PROGRAMS)}),
  o(opt_id, opt_lang_id, opt_text) AS (VALUES {_values(_OPTIONS)})
SELECT DISTINCT test_case_id, desc_long, prog_id, exename, pre_options, ' -j2' AS other_options,
       (SELECT opt_text FROM o WHERE o.opt_lang_id = t.file_type AND o.opt_id = p.opt_only_lang_type) AS opt_filetype, regex, corpus
FROM t, p, o AS l WHERE p.opt_only_lang_type = l.opt_id""",
        "bench_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS average, round(stddev_samp(value), 6) AS sample_stddev, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM events GROUP BY event_type",
        "bench_argmax": f"""WITH {_lines_sql('documents', 'source', 'text')}, c AS (SELECT source AS prog_id, count(*) AS matched_lines FROM l WHERE {_where(_SQL_PATTERN)} GROUP BY source)
SELECT prog_id, matched_lines FROM c WHERE prog_id IN ('src3', 'src1', 'src7') ORDER BY CASE prog_id WHEN 'src7' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END DESC, matched_lines DESC LIMIT 1""",
        "result_diff": f"""WITH {documents}, a AS (SELECT doc_id, line_no FROM l WHERE {_where('thsh')}), b AS (SELECT doc_id, line_no FROM l WHERE {_where('sh[a-z]*th')})
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
        "best_files": f"""WITH {_lines_sql('documents', 'lang, doc_id', 'text')}, c AS (SELECT lang, doc_id, count(*) AS n FROM l WHERE {_where(_SQL_PATTERN)} GROUP BY lang, doc_id)
SELECT lang, doc_id, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) AS INTEGER) AS place FROM c QUALIFY place <= 3""",
    }
    return out | scenarios.oracle_sql()
