"""Corpora from directory trees: a walk on the driver, reads on the executors.

``srctree`` is a Spark data source of (path, basename, content, length,
explicit).  Its plan step walks the trees and deals the files out to
partitions of about equal bytes; its tasks read them.  Files must therefore
lie where driver and executors both see them.  Unlike Spark's binary source it
takes names that begin with a dot or an underscore and doesn't follow links.
"""

from __future__ import annotations

import json
import os
import stat
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusgrep.functions.paths import clean_up
from corpusgrep.operators.selection import DirExclusion, Selection

SCHEMA = "path string, basename string, content binary, length long, explicit boolean"
#: Bytes of a partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_COST = 32 << 20, 1 << 16


@dataclass
class Found:
    """What a walk found: files as (path, explicit, size), notices for the user, and counts."""

    files: list[tuple[str, bool, int]] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(
        ("entries", "directories", "directories_rejected", "files", "files_rejected", "links_skipped", "loops"), 0))


def walk(starts: list[str], recurse: bool = True, follow: bool = False, accepts: Callable[[str], bool] = lambda name: True,
         excludes: Callable[[str], bool] = lambda name: False) -> Found:
    """Walk the start paths; no start, the current directory.

    A start is followed if it is a link and never filtered; a file start is explicit.  Bad starts
    and directories that can't be read are noticed and skipped.  Starts aren't made distinct.
    Links in directories are skipped, or followed if asked for; then a directory link whose device
    and own inode were met before is a loop.
    """
    out, visited = Found(), set()
    for start in starts or ["."]:
        path = clean_up(start)
        try:
            info = os.stat(path)
        except OSError as e:
            out.notices.append(f"could not open {start}: {e.strerror}")
            continue
        if stat.S_ISREG(info.st_mode):
            out.files.append((path, True, info.st_size))
        elif stat.S_ISDIR(info.st_mode):
            _directory(path, recurse, follow, accepts, excludes, out, visited)
        else:
            out.notices.append(f"{start} is neither a file nor a directory")
    return out


def _directory(top: str, recurse: bool, follow: bool, accepts, excludes, out: Found, visited: set) -> None:
    waiting = [top]
    while waiting:
        directory = waiting.pop()
        try:
            entries, device = list(os.scandir(directory)), os.stat(directory).st_dev
        except OSError as e:
            out.notices.append(f"could not read {directory}: {e.strerror}")
            continue
        out.counts["directories"] += 1
        for entry in entries:
            out.counts["entries"] += 1
            path = entry.name if directory == "." else f"{directory.rstrip('/')}/{entry.name}"
            try:
                if entry.is_symlink() and not follow:
                    out.counts["links_skipped"] += 1
                elif entry.is_file():
                    if accepts(entry.name):
                        out.files.append((path, False, entry.stat().st_size))
                        out.counts["files"] += 1
                    else:
                        out.counts["files_rejected"] += 1
                elif entry.is_dir():
                    if not recurse or excludes(entry.name):
                        out.counts["directories_rejected"] += 1
                    elif follow and (device, entry.inode()) in visited:
                        out.notices.append(f"{path}: recursive directory loop")
                        out.counts["loops"] += 1
                    else:
                        visited.add((device, entry.inode()))
                        waiting.append(path)
            except OSError as e:
                out.notices.append(f"could not read {path}: {e.strerror}")


@dataclass
class _Files(InputPartition):
    files: list

    def __init__(self, files: list):
        self.files = files


def deal(files: list[tuple[str, bool, int]], partition_bytes: int = PARTITION_BYTES) -> list[list[tuple[str, bool, int]]]:
    """Files in runs of about partition_bytes; a larger file is alone."""
    out: list[list] = []
    size = 0
    for f in files:
        cost = f[2] + OPEN_COST
        if not out or size + cost > partition_bytes:
            out.append([])
            size = 0
        out[-1].append(f)
        size += cost
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.errors = options.get("errors", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        files = json.loads(self.options["found"]) if "found" in self.options else self._walk().files
        return [_Files(part) for part in deal([f for f in files if f[2] > 0])] or [_Files([])]

    def _walk(self) -> Found:
        selection = Selection.of([tuple(x) for x in json.loads(self.options.get("selectors", "[]"))])
        dirs = DirExclusion([tuple(x) for x in json.loads(self.options.get("dirs", "[]"))])
        call = lambda name, default: CloudPickleSerializer().loads(bytes.fromhex(self.options[name])) if name in self.options else default
        accepts = selection.accepts if self.options.get("select", "true") == "true" else lambda name: True
        return walk(json.loads(self.options.get("starts", "[]")), self.options.get("recurse", "true") == "true", self.options.get("follow", "false") == "true",
                    call("accepts", accepts), call("excludes", dirs.excludes))

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, explicit, _ in partition.files:
            try:
                with open(path, "rb") as f:
                    data, error = f.read(), None
            except OSError as e:  # gone or not readable since the walk
                print(f"error: could not read {path}: {e.strerror}", file=sys.stderr)
                data, error = None, e.strerror
            row = (path, path.rsplit("/", 1)[-1], data, None if data is None else len(data), explicit)
            if self.errors:
                yield *row, error
            elif error is None:
                yield row


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return SCHEMA + ", error string" * (self.options.get("errors", "false") == "true")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, starts: list[str], selectors: list[tuple[str, str]] = (), dirs: list[tuple[str, bool]] = (),
              recurse: bool = True, follow: bool = False, select: bool = True, accepts: Callable[[str], bool] | None = None,
              excludes: Callable[[str], bool] | None = None, found: Found | None = None, errors: bool = False) -> DataFrame:
    """The files of the trees that the selectors accept, with their bytes; empty files are left out.

    accepts and excludes are predicates on base names in place of the selectors and dirs.  With
    found, what a walk has found is read and nothing is walked again.  With errors, files that
    can't be read have a row with the reason in ``error``; else they are only reported on stderr.
    """
    spark.dataSource.register(TreeSource)
    absolute = [os.path.abspath(s) if not os.path.isabs(s) else s for s in (starts or ["."])]
    options = {"starts": json.dumps(absolute), "selectors": json.dumps(list(selectors)), "dirs": json.dumps(list(dirs)), "recurse": str(recurse).lower(),
               "follow": str(follow).lower(), "select": str(select).lower(), "errors": str(errors).lower()}
    options |= {name: CloudPickleSerializer().dumps(f).hex() for name, f in (("accepts", accepts), ("excludes", excludes)) if f is not None}
    if found is not None:
        options["found"] = json.dumps([(os.path.abspath(path), explicit, size) for path, explicit, size in found.files])
    return spark.read.format("srctree").options(**options).load()
