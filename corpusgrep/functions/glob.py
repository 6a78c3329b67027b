"""File name globs as anchored regexes and as Python predicates."""

from __future__ import annotations

import re

from corpusgrep.functions.regex import POSIX, _byte


def to_regex(glob: str) -> str:
    """A regex for a whole name: ``*`` and ``?`` match any character, a leading dot and a slash too.

    ``[...]`` with ranges, ``!`` or ``^`` and POSIX classes is one character; a backslash quotes the
    next one.  A bracket without an end is a character of its own.
    """
    out, at = [], 0
    plain = lambda c: c if c.isalnum() else "".join(_byte(ord(c)) if ord(c) < 256 else c for c in c)
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and at < len(glob):
            out.append(plain(glob[at]))
            at += 1
        elif c == "[" and (found := _bracket(glob, at)):
            out.append(found[0])
            at = found[1]
        else:
            out.append(plain(c))
    return f"(?s)^(?:{''.join(out)})\\z"


def _bracket(glob: str, at: int) -> tuple[str, int] | None:
    negated = glob[at:at + 1] in ("!", "^")
    at += negated
    members, first = [], True
    while at < len(glob) and (first or glob[at] != "]"):
        first = False
        if m := re.compile(r"\[:(\w+):\]").match(glob, at):
            if m[1] not in POSIX:
                return None
            members.append(POSIX[m[1]])
            at = m.end()
            continue
        if glob[at] == "\\" and at + 1 < len(glob):
            at += 1
        one = glob[at]
        at += 1
        quoted = lambda c: c if c.isalnum() else _byte(ord(c)) if ord(c) < 256 else c
        if glob[at:at + 1] == "-" and at + 1 < len(glob) and glob[at + 1] != "]":
            members.append(f"{quoted(one)}-{quoted(glob[at + 1])}")
            at += 2
        else:
            members.append(quoted(one))
    if at >= len(glob):
        return None
    return f"[{'^' if negated else ''}{''.join(members)}]", at + 1


def matches(glob: str, name: str) -> bool:
    return re.match(to_regex(glob).replace("\\z", "\\Z"), name) is not None


