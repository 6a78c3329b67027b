"""Translation of search patterns to the JVM's and to Python's regex dialects.

Patterns are byte-oriented and ASCII: ``.`` is one byte, classes and case
folding are ASCII, plain parentheses don't capture, ``^`` and ``$`` are line
borders, and a match never contains a line feed.  A pattern is translated
faithfully or rejected: BadPattern for what the dialect itself refuses,
UnsupportedPattern for features that the targets lack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class BadPattern(ValueError):
    """The pattern has no meaning."""


class UnsupportedPattern(ValueError):
    """The pattern has a meaning that can't be kept."""


@dataclass(frozen=True)
class Translated:
    java: str
    #: For bytes, one line at a time.
    python: str
    #: For bytes, whole files: nothing outside lookarounds consumes a line feed.
    whole: str
    #: Lookarounds or anchors could see other lines, so lines can't be matched alone.
    needs_whole: bool
    #: A test of a whole file that every file with a matching line passes; None where there is no such simple test.
    java_file: str | None
    #: A repeated group may recurse as deep as a line is long on the JVM.
    deep: bool


#: Names of POSIX classes and what they hold in the C locale, as members of a class.
POSIX = {
    "alpha": r"a-zA-Z", "digit": r"0-9", "alnum": r"a-zA-Z0-9", "upper": r"A-Z", "lower": r"a-z",
    "space": r"\x09-\x0d\x20", "blank": r"\x20\x09", "cntrl": r"\x00-\x1f\x7f", "graph": r"\x21-\x7e", "print": r"\x20-\x7e",
    "punct": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e", "xdigit": r"0-9a-fA-F", "word": r"a-zA-Z0-9_", "ascii": r"\x00-\x7f",
}
_NEGATED = {  # all other bytes
    "alpha": r"\x00-\x40\x5b-\x60\x7b-\xff", "digit": r"\x00-\x2f\x3a-\xff", "alnum": r"\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xff",
    "upper": r"\x00-\x40\x5b-\xff", "lower": r"\x00-\x60\x7b-\xff", "space": r"\x00-\x08\x0e-\x1f\x21-\xff", "blank": r"\x00-\x08\x0a-\x1f\x21-\xff",
    "cntrl": r"\x20-\x7e\x80-\xff", "graph": r"\x00-\x20\x7f-\xff", "print": r"\x00-\x1f\x7f-\xff",
    "punct": r"\x00-\x20\x30-\x39\x41-\x5a\x61-\x7a\x7f-\xff", "xdigit": r"\x00-\x2f\x3a-\x40\x47-\x60\x67-\xff",
    "word": r"\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\xff", "ascii": r"\x80-\xff",
}
_W = "[A-Za-z0-9_]"
_BORDER = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_INSIDE = f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"
#: Shorthands as class members, with and without the line feed.
_SHORT = {
    "d": POSIX["digit"], "w": POSIX["word"], "s": POSIX["space"], "D": _NEGATED["digit"], "W": _NEGATED["word"], "S": _NEGATED["space"],
    "h": r"\x09\x20\xa0", "H": r"\x00-\x08\x0a-\x1f\x21-\x9f\xa1-\xff", "v": r"\x0a-\x0d\x85", "V": r"\x00-\x09\x0e-\x84\x86-\xff",
}
_CONTROL = {"a": 7, "e": 27, "f": 12, "n": 10, "r": 13, "t": 9}


def _byte(value: int) -> str:
    if value > 255:
        raise BadPattern("character value above a byte")
    return f"\\x{value:02x}"


def quote(text: str) -> str:
    """A pattern that matches text literally."""
    return "".join(c if c.isalnum() or ord(c) > 127 else _byte(ord(c)) for c in text)


def is_literal(pattern: str) -> bool:
    """Whether the pattern has no special character."""
    return not any(c in "\\^$.|?*+()[]{}" for c in pattern)


def literal_prefix(pattern: str) -> str:
    """Characters that every match begins with; empty if none are certain.

    An optional or repeated last character doesn't count, and nor does anything in a pattern with
    alternatives or groups before its end.
    """
    if "|" in pattern or "\\Q" in pattern:
        return ""
    n = next((i for i, c in enumerate(pattern) if c in "\\^$.?*+()[]{}"), len(pattern))
    if n < len(pattern) and pattern[n] in "?*{":
        n -= 1
    return pattern[:max(n, 0)]


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.names: list[str] = []
        self.java: list[str] = []
        self.python: list[str] = []
        self.whole: list[str] = []
        self.java_whole: list[str] = []
        self.borders = False
        self.open: list[dict] = []
        self.looks, self.feeds, self.deep, self.anchored = 0, False, False, False
        self.has_look = False
        self.item: dict | None = None  # what a quantifier would apply to

    def put(self, java: str, python: str | None = None, whole: str | None = None) -> None:
        python = java if python is None else python
        self.java.append(java)
        self.python.append(python)
        self.whole.append(python if whole is None else whole)
        self.java_whole.append(java if whole is None else whole)

    def members(self, members: str, negated: bool = False) -> None:
        """A class of bytes; outside lookarounds the whole-file form never takes a line feed."""
        one = f"[{'^' if negated else ''}{members}]"
        feed = re.match(one.encode("latin-1"), b"\n")
        if feed and self.looks:
            self.feeds = True
        self.put(one, one, one if self.looks or not feed else f"(?:(?!\\x0a){one})")
        self.item = {"group": False}

    def literal(self, c: str) -> None:
        if c == "\n":
            if self.looks:
                self.feeds = True
            self.put("\\x0a", "\\x0a", "\\x0a" if self.looks else "(?!)")
        else:
            raw = c.encode("utf-8", "surrogateescape")
            text = "".join(chr(b) if chr(b).isascii() and chr(b).isalnum() else _byte(b) for b in raw)
            # A quantifier after a character of several bytes applies to its last byte.
            self.put(text)
        self.item = {"group": False}

    def number(self, digits: str, base: int) -> int:
        return int(digits, base) if digits else 0

    def take(self, pattern: str) -> str:
        m = re.compile(pattern).match(self.text, self.at)
        self.at = m.end() if m else self.at
        return m[0] if m else ""

    def run(self) -> None:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            self.at += 1
            if c == "\\":
                self.escape()
            elif c == "[":
                self.klass()
            elif c == "(":
                self.group()
            elif c == ")":
                if not self.open:
                    raise BadPattern("unmatched closing parenthesis")
                group = self.open.pop()
                self.looks -= group["look"]
                self.put(")")
                self.item = {"group": True, "varies": group["varies"], "look": group["look"]}
                if self.open:
                    self.open[-1]["varies"] |= group["varies"]
            elif c == "|":
                if self.open:
                    self.open[-1]["varies"] = True
                self.put("|")
                self.item = None
            elif c in "*+?" or (c == "{" and re.compile(r"\d+(,\d*)?\}").match(text, self.at)):
                self.quantifier(c)
            elif c == ".":
                self.put("[^\\x0a]")
                self.item = {"group": False}
            elif c == "^":
                self.borders = True
                self.put("^")
                self.item = {"group": False, "look": 1}
            elif c == "$":
                self.borders = True
                self.put("$")
                self.item = {"group": False, "look": 1}
            else:
                self.literal(c)
        if self.open:
            raise BadPattern("missing closing parenthesis")

    def quantifier(self, c: str) -> None:
        if self.item is None:
            raise BadPattern("nothing to repeat")
        if c == "{":
            body = "{" + self.take(r"\d+(,\d*)?\}")
            low, _, high = body[1:-1].partition(",")
            if int(low) > 65535 or high and (int(high) > 65535 or int(high) < int(low)):
                raise BadPattern("bad repeat count")
            unbounded = body.endswith(",}") or int(high or low) > 50
        else:
            body, unbounded = c, c in "*+"
        body += self.take(r"[?+]")
        if unbounded and self.item["group"] and self.item.get("varies"):
            self.deep = True
        if self.item.get("look"):
            # A repeated assertion is the assertion, or nothing if it may be left out.
            if body[0] in "*?" or body.startswith("{0"):
                self.put("{0,1}")
            self.item = None
            return
        self.put(body)
        if self.open:
            self.open[-1]["varies"] |= unbounded or body[0] == "?" or "," in body
        self.item = None

    def escape(self) -> None:
        if self.at >= len(self.text):
            raise BadPattern("backslash at the end")
        c = self.text[self.at]
        self.at += 1
        if c == "Q":
            end = self.text.find("\\E", self.at)
            body = self.text[self.at:end if end >= 0 else len(self.text)]
            self.at = end + 2 if end >= 0 else len(self.text)
            for x in body:
                self.literal(x)
        elif c == "E":
            pass
        elif c in "bB":
            self.borders = True
            self.put(_BORDER if c == "b" else _INSIDE)
            self.item = {"group": False, "look": 1}
        elif c in _SHORT:
            self.members(_SHORT[c])
        elif c == "N":
            self.put("[^\\x0a]")
            self.item = {"group": False}
        elif c == "R":
            feed = "(?:\\x0d\\x0a|[\\x0a-\\x0d\\x85])"
            if self.looks:
                self.feeds = True
            self.put(feed, feed, feed if self.looks else "(?:[\\x0b-\\x0d\\x85])")
            self.item = {"group": True}
        elif c in "AzZG":
            self.anchored = True
            self.put({"A": "\\A", "z": "\\z", "Z": "\\Z", "G": "\\G"}[c], {"A": "\\A", "z": "\\Z", "Z": "(?=\\n?\\Z)", "G": "\\A"}[c])
            if c == "G":
                raise UnsupportedPattern("\\G")
            self.item = {"group": False, "look": 1}
        elif c in _CONTROL:
            self.literal(chr(_CONTROL[c]))
        elif c == "c":
            if self.at >= len(self.text):
                raise BadPattern("\\c at the end")
            self.literal(chr(ord(self.text[self.at].upper()) ^ 64))
            self.at += 1
        elif c == "x":
            digits = self.take(r"\{[0-9a-fA-F]+\}").strip("{}") or self.take(r"[0-9a-fA-F]{1,2}")
            self.value(self.number(digits, 16))
        elif c == "o":
            digits = self.take(r"\{[0-7]+\}").strip("{}")
            if not digits:
                raise BadPattern("\\o without digits")
            self.value(int(digits, 8))
        elif c == "0":
            self.value(int("0" + self.take(r"[0-7]{1,2}"), 8))
        elif c.isdigit():
            self.reference(c + self.take(r"\d*"))
        elif c == "g":
            body = self.take(r"\d+|\{[^}]*\}").strip("{}")
            if not body or body.startswith(("-", "+")):
                raise UnsupportedPattern("relative reference")
            self.reference(body)
        elif c == "k":
            name = self.take(r"<\w+>|'\w+'|\{\w+\}")[1:-1]
            if not name:
                raise BadPattern("\\k without a name")
            self.reference(name)
        elif c == "C":
            raise BadPattern("\\C is not allowed")
        elif c in "KXpP":
            raise UnsupportedPattern(f"\\{c}")
        elif c.isascii() and c.isalpha():
            raise BadPattern(f"unknown escape \\{c}")
        else:
            self.literal(c)

    def value(self, n: int) -> None:
        if n == 10:
            self.literal("\n")
        else:
            self.put(_byte(n))
            self.item = {"group": False}

    def reference(self, which: str) -> None:
        if which.isdigit():
            if not 0 < int(which) <= len(self.names):
                raise BadPattern(f"no group {which}; plain parentheses don't capture")
            n = int(which) - 1
        elif which in self.names:
            n = self.names.index(which)
        else:
            raise BadPattern(f"no group {which}")
        self.put(f"\\k<n{n}>", f"(?P=n{n})")
        self.item = {"group": True, "varies": True}

    def group(self) -> None:
        self.item, look = None, 0
        text, at = self.text, self.at
        if text.startswith("*", at):
            raise UnsupportedPattern("verbs")
        if not text.startswith("?", at):
            self.put("(?:")
        elif text.startswith("?#", at):
            end = text.find(")", at)
            if end < 0:
                raise BadPattern("comment without an end")
            self.at = end + 1
            return
        elif m := re.compile(r"\?(?:P?<(\w+)>|'(\w+)')").match(text, at):
            name = m[1] or m[2]
            if name[0].isdigit() or name in self.names:
                raise BadPattern(f"bad group name {name}")
            self.names.append(name)
            n = len(self.names) - 1
            self.put(f"(?<n{n}>", f"(?P<n{n}>")
            self.at = m.end()
        elif m := re.compile(r"\?(=|!|<=|<!)").match(text, at):
            self.put("(" + m[0])
            self.at, look, self.has_look = m.end(), 1, True
        elif m := re.compile(r"\?(:|>)").match(text, at):
            self.put("(" + m[0])
            self.at = m.end()
        elif m := re.compile(r"\?P=(\w+)\)").match(text, at):
            self.at = m.end()
            self.reference(m[1])
            return
        elif m := re.compile(r"\?([ims]*)(?:-([ims]*))?(:|\))").match(text, at):
            self.flags(m)
            if m[3] == ")":
                return
        else:
            raise UnsupportedPattern("(" + text[at:at + 3])
        self.open.append({"look": look, "varies": False})
        self.looks += look

    def flags(self, m: re.Match) -> None:
        on, off = m[1], m[2] or ""
        if "m" in off or "s" in on + off:
            raise UnsupportedPattern("(?s) and (?-m)")
        self.at = m.end()
        flags = ("i" if "i" in on else "") + ("-i" if "i" in off else "")
        if m[3] == ":":
            self.put(f"(?{flags}:")
        elif flags:
            if self.open or self.java:
                # Up to the end of the group that it stands in; Python only knows the scoped form.
                raise UnsupportedPattern("option setting inside a pattern")
            self.lead = flags

    def klass(self) -> None:
        text, negated = self.text, False
        if text.startswith("^", self.at):
            negated, self.at = True, self.at + 1
        members, first = [], True
        while True:
            if self.at >= len(text):
                raise BadPattern("missing ] of a class")
            c = text[self.at]
            self.at += 1
            if c == "]" and not first:
                break
            first = False
            if c == "[" and (m := re.compile(r":(\^?)(\w+):\]").match(text, self.at)):
                if m[2] not in POSIX:
                    raise BadPattern(f"unknown class {m[2]}")
                members.append((_NEGATED if m[1] else POSIX)[m[2]])
                self.at = m.end()
            elif c == "[" and re.compile(r"([.=]).*?\1\]").match(text, self.at):
                raise BadPattern("collating elements")
            elif c == "\\":
                members.append(self.class_escape())
            else:
                members.append("-" if c == "-" else self.member(c))
        self.members(self.ranges(members), negated)

    def member(self, c: str) -> str:
        return "".join(_byte(b) for b in c.encode("utf-8", "surrogateescape"))

    def ranges(self, members: list[str]) -> str:
        """Members joined; a hyphen that makes no range is a byte of its own."""
        out: list[str] = []
        single = lambda s: re.fullmatch(r"(\\x[0-9a-f]{2})+", s)
        i = 0
        while i < len(members):
            if i + 2 < len(members) and members[i + 1] == "-" and single(members[i]) and single(members[i + 2]):
                if members[i][-4:] > members[i + 2][:4]:
                    raise BadPattern("range out of order")
                out.append(f"{members[i]}-{members[i + 2]}")
                i += 3
            else:
                out.append("\\x2d" if members[i] == "-" else members[i])
                i += 1
        return "".join(out)

    def class_escape(self) -> str:
        c = self.text[self.at:self.at + 1]
        self.at += 1
        if c == "":
            raise BadPattern("missing ] of a class")
        if c in _SHORT:
            return _SHORT[c]
        if c == "b":
            return "\\x08"
        if c in _CONTROL:
            return _byte(_CONTROL[c])
        if c == "x":
            return _byte(self.number(self.take(r"\{[0-9a-fA-F]+\}").strip("{}") or self.take(r"[0-9a-fA-F]{1,2}"), 16))
        if c.isdigit():
            return _byte(int((c + self.take(r"[0-7]{0,2}")), 8) & 255) if c in "01234567" else self.member(c)
        if c == "Q":
            end = self.text.find("\\E", self.at)
            body = self.text[self.at:end if end >= 0 else len(self.text)]
            self.at = end + 2 if end >= 0 else len(self.text)
            return "".join(map(self.member, body))
        if c == "E":
            return ""
        if c in "pPX":
            raise UnsupportedPattern(f"\\{c} in a class")
        if c.isascii() and c.isalpha():
            raise BadPattern(f"unknown escape \\{c} in a class")
        return self.member(c)


def translate(pattern: str, ignore_case: bool = False, word: bool = False) -> Translated:
    """Both dialects of a pattern; literal patterns are to be quoted first."""
    t = _Translator(pattern)
    t.run()
    flags = "i" if ignore_case or "i" in getattr(t, "lead", "").split("-")[0] else ""

    def finish(parts: list[str], head: str) -> str:
        body = "".join(parts)
        body = f"{_BORDER}(?:{body}){_BORDER}" if word else body
        return head + body

    java = finish(t.java, f"(?d{flags})")
    python = finish(t.python, f"(?{flags})" if flags else "")
    whole = finish(t.whole, f"(?m{flags})")
    needs_whole = t.anchored or (t.has_look and t.feeds)
    for form in (python, whole):
        try:
            re.compile(form.encode("latin-1"))
        except re.error as e:
            if "look-behind" in str(e):
                raise UnsupportedPattern(str(e)) from e
            raise BadPattern(str(e)) from e
    # What lies beyond a line's ends must not matter: no borders, lookarounds or empty matches.  Word borders
    # would be right, but testing for them at every byte costs more than it spares.
    simple = not (word or t.borders or t.has_look or t.anchored or re.search(python.encode("latin-1"), b""))
    return Translated(java, python, whole, needs_whole, finish(t.java_whole, f"(?d{flags})") if simple else None, t.deep)
