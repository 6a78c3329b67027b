"""Configuration files: one option on each line."""

from __future__ import annotations

import os

RC_NAME = ".corpusgreprc"


class ArgumentError(ValueError):
    """Wrong options; exit code 255."""


def parse(text: str, name: str = RC_NAME) -> list[str]:
    """Options of a file; ``#`` begins a comment line, CR or LF ends an option."""
    out = []
    for line in text.replace("\r", "\n").split("\n"):
        line = line.lstrip(" \t\v\f")
        if not line or line.startswith("#"):
            continue
        if line == "--":
            raise ArgumentError(f'Double-dash "--" is not allowed in rc file "{name}".')
        if not line.startswith("-"):
            raise ArgumentError(f'Non-option argument "{line}" is not allowed in rc file "{name}".')
        out.append(line)
    return out


def project_file(cwd: str, home: str | None) -> str | None:
    """The file of the nearest directory from cwd upwards; the home directory and what is above it don't count."""
    here = os.path.abspath(cwd)
    while True:
        if home and os.path.isdir(home) and os.path.samefile(here, home):
            return None
        path = os.path.join(here, RC_NAME)
        if os.access(path, os.R_OK):
            return path
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def options(cwd: str, home: str | None, user: bool = True) -> list[str]:
    """The user's options, then the project's."""
    files = [os.path.join(home, RC_NAME)] if user and home and os.path.isfile(os.path.join(home, RC_NAME)) else []
    project = project_file(cwd, home)
    out = []
    for path in [*files, *([project] if project else [])]:
        with open(path, encoding="utf-8", errors="surrogateescape") as f:
            out += parse(f.read(), path)
    return out
