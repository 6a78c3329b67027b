"""Path and string functions, as expressions and for the driver."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_nonempty(text: Column, delimiter: str) -> Column:
    return F.filter(F.split(text, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def join_nonempty(parts: Column, separator: str) -> Column:
    """Parts joined; no separator until something is there."""
    return F.aggregate(parts, F.lit(""), lambda done, x: F.when(done == "", x).otherwise(F.concat(done, F.lit(separator), x)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; a dot without one, a slash for what lies in the root."""
    at = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(at < 0, F.lit(".")).when(at == 0, F.lit("/")).otherwise(F.substring(path, F.lit(1), at))


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def hexadecimal(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def clean_up(path: str) -> str:
    """A start path without ``./`` before it and slashes after it."""
    path = path.rstrip("/") or ("/" if path.startswith("/") else ".")
    head, tail = os.path.split(path)
    if head in (".", ""):
        return tail or "."
    return f"{head}/{tail}" if head != "/" else f"/{tail}"


def canonical(path: str, cwd: str) -> str:
    """An absolute path without dots, empty parts and links."""
    return os.path.realpath(os.path.join(cwd, path))
