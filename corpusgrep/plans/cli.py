"""Command line: options to a search request, a run, and the exit code."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusgrep.functions.regex import BadPattern, UnsupportedPattern
from corpusgrep.operators import render
from corpusgrep.operators.match import grep
from corpusgrep.operators.selection import DirExclusion, Selection, SelectionError
from corpusgrep.plans import rc
from corpusgrep.plans.rc import ArgumentError
from corpusgrep.plans.spec import SearchSpec
from corpusgrep.sources.tree import Found, read_tree, walk

VERSION = "corpusgrep 0.1"
#: Long options without and with a value.
FLAGS = ("smart-case", "nosmart-case", "no-smart-case", "ignore-case", "word-regexp", "literal", "with-filename", "no-with-filename", "line-number", "no-line-number",
         "column", "nocolumn", "color", "colour", "nocolor", "nocolour", "null", "recurse", "no-recurse", "follow", "nofollow", "known-types", "noenv",
         "help", "help-types", "list-file-types", "usage", "version", "test-log-all", "test-noenv-user", "test-use-mmap")
VALUES = ("ignore-dir", "ignore-directory", "noignore-dir", "noignore-directory", "no-ignore-dir", "no-ignore-directory", "include", "exclude", "ignore", "ignore-file",
          "type", "type-set", "type-add", "type-del", "dirjobs", "jobs")
SHORT = {"i": "ignore-case", "w": "word-regexp", "Q": "literal", "H": "with-filename", "h": "no-with-filename", "n": "line-number", "r": "recurse", "R": "recurse",
         "k": "known-types", "j": "jobs", "?": "help", "V": "version"}


@dataclass
class Request:
    pattern: str = ""
    paths: list[str] = field(default_factory=list)
    case: str = "smart"
    word: bool = False
    literal: bool = False
    heading: bool | None = None
    line_number: bool = True
    column: bool = False
    colour: bool | None = None
    null: bool = False
    recurse: bool = True
    follow: bool = False
    jobs: int = 0
    dirjobs: int = 4
    selectors: list[tuple[str, str]] = field(default_factory=list)
    dirs: list[tuple[str, bool]] = field(default_factory=list)
    #: help, usage, version or types: print and stop.
    info: str = ""


def _long(name: str, types: Selection) -> tuple[str, str | None]:
    """The option that a long name means, or a type selector."""
    if name in FLAGS or name in VALUES:
        return name, None
    for prefix, rest in (("", name), ("no", name[2:] if name.startswith("no") else "")):
        if rest and (found := types.names_like(rest)):
            if len(found) > 1:
                raise ArgumentError(f"option '--{name}' is ambiguous; possibilities: " + " ".join(f"'--{prefix}{f}'" for f in found))
            return "type", prefix + found[0]
    found = [o for o in (*FLAGS, *VALUES) if o.startswith(name)] if len(name) >= 2 else []
    if len(found) == 1:
        return found[0], None
    if found:
        raise ArgumentError(f"option '--{name}' is ambiguous; possibilities: " + " ".join(f"'--{f}'" for f in found))
    raise ArgumentError(f"unrecognized option '--{name}'")


def parse(argv: list[str], strict: bool = False) -> Request:
    """A request from options in their order; options may follow operands, and ``--`` ends them."""
    out, operands, types = Request(), [], Selection(strict)
    smart, ignore = True, False
    last_case = ""
    at, ended = 0, False
    jobs: dict[str, int] = {}
    while at < len(argv):
        arg = argv[at]
        at += 1
        if ended or arg == "-" or not arg.startswith("-"):
            operands.append(arg)
            continue
        if arg == "--":
            ended = True
            continue
        if arg.startswith("--"):
            name, eq, value = arg[2:].partition("=")
            option, picked = _long(name, types)
            given = [(option, picked if picked is not None else value if eq else None)]
        else:
            given = []
            body = arg[1:]
            while body:
                if body[0] not in SHORT:
                    raise ArgumentError(f"invalid option -- '{body[0]}'")
                option, body = SHORT[body[0]], body[1:]
                if option in VALUES:
                    given.append((option, body or None))
                    break
                given.append((option, None))
        for option, value in given:
            if option in VALUES and value is None:
                if at >= len(argv):
                    raise ArgumentError(f"option '--{option}' requires an argument")
                value, at = argv[at], at + 1
            if option in VALUES and value == "":
                raise ArgumentError(f"option '--{option}' requires a non-empty argument")
            if option in ("smart-case", "nosmart-case", "no-smart-case"):
                smart = option == "smart-case"
                last_case = "smart" if smart else last_case
            elif option == "ignore-case":
                ignore, last_case = True, "ignore"
            elif option in ("word-regexp", "literal"):
                setattr(out, option.split("-")[0], True)
            elif option in ("with-filename", "no-with-filename"):
                out.heading = option != "with-filename"
            elif option in ("line-number", "no-line-number"):
                out.line_number = option == "line-number"
            elif option in ("column", "nocolumn"):
                out.column = option == "column"
                out.line_number = out.line_number or out.column
            elif option in ("color", "colour", "nocolor", "nocolour"):
                out.colour = not option.startswith("no")
            elif option == "null":
                out.null = True
            elif option in ("recurse", "no-recurse"):
                out.recurse = option == "recurse"
            elif option in ("follow", "nofollow"):
                out.follow = option == "follow"
            elif "ignore-dir" in option:
                out.dirs.append((value, not option.startswith("no")))
            elif option in ("include", "exclude", "ignore"):
                out.selectors.append(("exclude" if option != "include" else "include", value))
            elif option == "ignore-file":
                out.selectors.append((option, value))
            elif option.startswith("type"):
                kind = option.partition("-")[2]
                out.selectors.append((kind or "type", value))
                if kind in ("add", "set"):
                    (types.add_type if kind == "add" else types.set_type)(value)
                elif kind == "del":
                    types.delete_type(value)
            elif option in ("jobs", "dirjobs"):
                if not value.isdigit() or int(value) < 1:
                    raise ArgumentError(f"option '--{option}' needs a number greater than 0")
                jobs.setdefault(option, int(value))
            elif option in ("help", "usage", "version"):
                out.info = out.info or option
            elif option in ("help-types", "list-file-types"):
                out.info = out.info or "types"
    out.jobs, out.dirjobs = jobs.get("jobs", 0), jobs.get("dirjobs", 4)
    out.case = ("ignore" if last_case == "ignore" or not smart else "smart") if ignore or smart else "sensitive"
    if operands:
        out.pattern, out.paths = operands[0], operands[1:] or ["."]
    elif not out.info:
        raise ArgumentError("no pattern")
    Selection.of(out.selectors, strict)
    return out


def arguments(argv: list[str], cwd: str = ".", home: str | None = None) -> list[str]:
    """Options of configuration files before those of the command line, unless that has ``--noenv`` before ``--``."""
    before = argv[:argv.index("--")] if "--" in argv else argv
    if "--noenv" in before:
        return argv
    return rc.options(cwd, home, "--test-noenv-user" not in before) + argv


#: What each option does, for the help; options that undo another are listed with it.
HELP = {
    "ignore-case": "take upper and lower case as equal", "smart-case": "take them as equal unless the pattern has an upper-case letter (default)",
    "word-regexp": "match whole words only", "literal": "take the pattern as plain text", "with-filename": "write the file name before each match",
    "no-with-filename": "write the file name on a line of its own before its matches", "line-number": "write line numbers (default)", "column": "write the column of each match",
    "color": "colour file names, line numbers and matches", "null": "write a zero byte after file names", "recurse": "search directories below the given ones (default)",
    "follow": "follow links inside directories", "known-types": "search files of known types only (default)", "ignore-dir": "leave out directories of this name",
    "include": "search files whose names match this pattern", "exclude": "leave out files whose names match this pattern", "ignore-file": "leave out files by kind:value, with the kinds ext, is, match",
    "type": "search files of this type, or none with no before its name", "type-set": "define a type as name:kind:value", "type-add": "add to a type", "type-del": "forget a type",
    "dirjobs": "accepted, as Spark plans the work", "jobs": "accepted, as Spark plans the work", "noenv": "read no configuration files", "help": "show this",
    "help-types": "list the file types", "version": "show the version",
}


def usage() -> str:
    letters = {option: letter for letter, option in reversed(SHORT.items())}
    name = lambda o: (f"-{letters[o]}, " if o in letters else "    ") + f"--{o}" + ("=VALUE" if o in VALUES else "")
    return "\n".join(["Usage: corpusgrep [OPTION...] PATTERN [FILES OR DIRECTORIES]", "", *(f"  {name(o):<32}{text}" for o, text in HELP.items())])


def version() -> str:
    return "\n".join([VERSION, f"Spark {pyspark.__version__}, Python {sys.version.split()[0]}", "Engines: jvm (built-in expressions), python (byte regexes on lines), whole (byte regexes on files)"])


def style(request: Request, terminal: bool) -> render.Output:
    """On a terminal, headings and colours unless told otherwise; elsewhere neither."""
    heading = terminal if request.heading is None else request.heading
    return render.Output(heading, request.line_number, request.column, terminal if request.colour is None else request.colour, request.null)


def diagnostics(found: Found) -> list[str]:
    """Notices of a walk as lines for stderr: what couldn't be read is an error, what was left out a warning."""
    return [f"corpusgrep: {'error' if notice.startswith('could not') else 'warning'}: {notice}" for notice in found.notices]


def run(spark: SparkSession, request: Request, out=sys.stdout, err=sys.stderr) -> int:
    """Search and print; 0 with a match, 1 without."""
    spec = SearchSpec(request.pattern, request.case, request.literal, request.word)
    spec.translated()
    selection, dirs = Selection.of(request.selectors), DirExclusion(request.dirs)
    found = walk(request.paths, request.recurse, request.follow, selection.accepts, dirs.excludes)
    for line in diagnostics(found):
        print(line, file=err)
    files = read_tree(spark, request.paths, found=found)
    here = os.getcwd().rstrip("/") + "/"
    if all(not os.path.isabs(p) for p in request.paths):
        files = files.withColumn("path", F.when(F.startswith("path", F.lit(here)), F.substring(F.col("path"), len(here) + 1, 1 << 30)).otherwise(F.col("path")))
    how = style(request, hasattr(out, "isatty") and out.isatty())
    shown = render.render(grep(files.select("path", "content"), spec), how)
    shown = shown.orderBy("path") if how.heading else shown.orderBy("path", "line_no")
    n = 0
    for row in shown.toLocalIterator():
        if how.heading and n:
            print(file=out)
        print(row["value"], file=out)
        n += 1
    return 0 if n else 1


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout, err=sys.stderr) -> int:
    try:
        request = parse(arguments(argv, os.getcwd(), os.environ.get("HOME")))
        if request.info == "version":
            print(version(), file=out)
            return 0
        if request.info in ("help", "usage"):
            print(usage(), file=out)
            return 0
        spark = spark or SparkSession.builder.appName("corpusgrep").getOrCreate()
        if request.info == "types":
            for row in render.type_listing(Selection.of(request.selectors).table(spark)).orderBy("type").collect():
                print(row["value"], file=out)
            return 0
        return run(spark, request, out, err)
    except (ArgumentError, SelectionError) as e:
        print(f"corpusgrep: {e}", file=err)
    except (BadPattern, UnsupportedPattern) as e:
        print(f"corpusgrep: Error during regex parsing: {e}", file=err)
    return 255


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
