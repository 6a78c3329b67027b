"""Which files are searched: types, globs and directory exclusions, in the order in which they are given."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.functions import glob as globs
from corpusgrep.functions import latin1
from corpusgrep.functions.regex import translate
from corpusgrep.operators.type_table import BUILTIN, EXCLUDED_DIRS


class SelectionError(ValueError):
    """A selector that can't be followed."""


def fields(text: str, delimiter: str) -> list[str]:
    """Parts between delimiters, empty ones left out."""
    return [x for x in text.split(delimiter) if x]


class Selection:
    """The state of the type algebra; definitions first, then types in or out.

    ``define`` takes the selectors that change definitions or globs (add, set, del, ignore-file,
    include, exclude), ``choose`` those that bring types in or take them out.  The first type that
    is brought in leaves only itself.  Taking a type out forbids its filters, also where other
    types share them, until a type that has them is brought in again.
    """

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.types: dict[str, list[str]] = {name: filters.split(" ") for name, filters in BUILTIN.items()}
        self.active: dict[str, list[str]] = dict(self.types)
        self.forbidden: set[str] = set()
        self.chosen = False
        #: (glob, whether it includes), in order.
        self.globs: list[tuple[str, bool]] = []
        self.vetoes: list[str] = []

    def names_like(self, name: str) -> list[str]:
        """Types that an option of this name could mean: those in order from the name on, while they contain it."""
        found = []
        for candidate in sorted(self.types):
            if candidate >= name:
                if name not in candidate:
                    break
                found.append(candidate)
        if not self.strict and name in found:
            return [name]
        return found

    def _filter(self, spec: str) -> tuple[str, list[str]]:
        parts = fields(spec, ":")
        if len(parts) != 3:
            raise SelectionError(f'Invalid filter specification "{spec}"')
        name, kind, rest = parts
        if kind == "is":
            return name, [rest]
        if kind == "ext":
            return name, ["." + e for e in fields(rest, ",")]
        if kind == "glob":
            return name, ["?" + rest]
        raise SelectionError(f'Unknown filter type "{kind}" in "{spec}"')

    def add_type(self, spec: str) -> None:
        name, filters = self._filter(spec)
        self.types.setdefault(name, []).extend(filters)
        if not self.chosen:
            self.active[name] = self.types[name]

    def set_type(self, spec: str) -> None:
        name, filters = self._filter(spec)
        self.types[name] = filters
        if not self.chosen:
            self.active[name] = filters

    def delete_type(self, name: str) -> None:
        self.types.pop(name, None)
        self.active.pop(name, None)

    def ignore_file(self, spec: str) -> None:
        """Files of a filter are left out; a glob excludes, as its name says."""
        kind, _, rest = spec.partition(":")
        if kind == "glob":
            self.exclude(rest)
            return
        name = "~ignored"
        _, filters = self._filter(f"{name}:{spec}")
        self.types.setdefault(name, []).extend(filters)
        self.take_out(name)

    def include(self, pattern: str) -> None:
        self.globs.append((pattern, True))
        name = "~included"
        self.types.setdefault(name, []).append("?" + pattern)
        self.bring_in(name)

    def exclude(self, pattern: str) -> None:
        self.globs.append((pattern, False))
        self.vetoes.append(pattern)

    def bring_in(self, name: str) -> None:
        if name not in self.types:
            raise SelectionError(f"Unknown type '{name}'")
        if not self.chosen:
            self.active, self.chosen = {}, True
        self.forbidden -= set(self.types[name])
        self.active[name] = self.types[name]

    def take_out(self, name: str) -> None:
        if name not in self.types:
            raise SelectionError(f"Unknown type '{name}'")
        self.forbidden |= set(self.types[name])
        self.active.pop(name, None)

    @classmethod
    def of(cls, selectors: Iterable[tuple[str, str]], strict: bool = False) -> "Selection":
        """From (kind, value) pairs: definitions and globs take effect before types are chosen, each in order.

        Kinds: add, set, del, ignore-file, include, exclude, type (a name, or no and a name).
        """
        self, selectors = cls(strict), list(selectors)
        define = {"add": self.add_type, "set": self.set_type, "del": self.delete_type, "ignore-file": self.ignore_file,
                  "include": self.include, "exclude": self.exclude}
        for kind, value in selectors:
            if kind in define:
                define[kind](value)
            elif kind != "type":
                raise SelectionError(f"unknown selector {kind}")
        for kind, value in selectors:
            if kind == "type":
                if value not in self.types and value.startswith("no"):
                    self.take_out(value[2:])
                else:
                    self.bring_in(value)
        return self

    def compiled(self) -> tuple[list[str], list[str]]:
        """(extensions without the dot, file names) that select."""
        filters = {f for some in self.active.values() for f in some if f not in self.forbidden}
        return sorted(f[1:] for f in filters if f[0] == "."), sorted(f for f in filters if f[0] not in "./?")

    def accepts(self, name: str) -> bool:
        """For the tree walk: whether a file of this base name is searched."""
        extensions, names = self.compiled()
        dot = name.rfind(".")
        if dot > 0 and name[dot + 1:] in set(extensions) or name in set(names):
            return not any(globs.matches(g, name) for g in self.vetoes)
        verdict = False
        for pattern, includes in self.globs:
            if globs.matches(pattern, name):
                verdict = includes
        return verdict

    def predicate(self, basename: Column) -> Column:
        """accepts() as an expression: membership tests and anchored regexes, nothing leaves the JVM."""
        extensions, names = self.compiled()
        like = lambda g: basename.rlike(globs.to_regex(g))
        has_extension = F.instr(F.substring(basename, 2, 1 << 30), ".") > 0
        extension = F.substring_index(basename, ".", -1)
        by_type = F.lit(False)
        if extensions:
            by_type = by_type | (has_extension & extension.isin(extensions))
        if names:
            by_type = by_type | basename.isin(names)
        vetoed = F.lit(False)
        for g in self.vetoes:
            vetoed = vetoed | like(g)
        by_glob = F.lit(False)
        for g, includes in self.globs:
            by_glob = F.when(like(g), F.lit(includes)).otherwise(by_glob)
        return F.when(by_type, ~vetoed).otherwise(by_glob)

    def first_line_predicate(self, content: Column) -> Column:
        """Whether the first line matches a first-line pattern of an active type.

        The search itself doesn't use these patterns; this is for those who want scripts without an
        extension as well, as an alternative to predicate().
        """
        first = F.substring_index(latin1.view(content), "\n", 1)
        found = F.lit(False)
        for pattern in sorted({f[1:-1] for some in self.active.values() for f in some if f[0] == "/" and f not in self.forbidden}):
            found = found | first.rlike(translate(pattern).java)
        return F.coalesce(found, F.lit(False))

    def table(self, spark: SparkSession) -> DataFrame:
        """(type, kind, filter) of all definitions."""
        kinds = {".": "ext", "/": "firstline", "?": "glob"}
        rows = [(t, kinds.get(f[0], "is"), f.strip("/") if f[0] == "/" else f[1:] if f[0] in ".?" else f)
                for t, some in sorted(self.types.items()) if t[0] != "~" for f in some]
        return spark.createDataFrame(rows, "type string, kind string, filter string")


class DirExclusion:
    """Directories that aren't entered; the built-in ones are always among them."""

    def __init__(self, edits: Iterable[tuple[str, bool]] = ()):
        names: set[str] = set()
        for name, ignore in edits:
            (names.add if ignore else names.discard)(name)
        self.names = names | set(EXCLUDED_DIRS)

    def excludes(self, name: str) -> bool:
        return name in self.names

    def predicate(self, path: Column) -> Column:
        """Whether no directory of the path is excluded; the last part is the file."""
        parts = F.split(path, "/")
        dirs = F.slice(parts, 1, F.size(parts) - 1)
        return ~F.arrays_overlap(dirs, F.array(*map(F.lit, sorted(self.names))))


def select_files(df: DataFrame, selection: Selection, dirs: DirExclusion | None = None) -> DataFrame:
    """Rows of (path, basename, explicit, ...) that are searched; explicit ones always are."""
    ok = selection.predicate(F.col("basename"))
    if dirs is not None:
        ok = ok & dirs.predicate(F.col("path"))
    return df.where(F.col("explicit") | ok)
