"""A search request, and the plan decisions that follow from it."""

from __future__ import annotations

from dataclasses import dataclass

from corpusgrep.functions.regex import Translated, is_literal, literal_prefix, quote, translate


@dataclass(frozen=True)
class SearchSpec:
    """case: ``smart`` (ignored unless the pattern has an upper-case ASCII letter), ``ignore`` or ``sensitive``.

    engine: ``jvm`` (built-in expressions), ``python`` (byte regexes on Arrow batches) or ``auto``,
    which takes the JVM unless the pattern could recurse too deeply there or see other lines.
    """

    pattern: str
    case: str = "smart"
    literal: bool = False
    word: bool = False
    engine: str = "auto"

    @property
    def ignore_case(self) -> bool:
        return self.case == "ignore" or self.case == "smart" and not any("A" <= c <= "Z" for c in self.pattern)

    @property
    def never(self) -> bool:
        """A literal with a line feed can't match inside a line."""
        return self.literal and "\n" in self.pattern

    @property
    def plain(self) -> str | None:
        """The string to look for, where no regex is needed."""
        if self.ignore_case or self.word or not self.pattern or not (self.literal or is_literal(self.pattern)):
            return None
        return self.pattern

    @property
    def needle(self) -> str:
        """A string that every matching file has, for a test before files are split into lines; may be empty."""
        if self.ignore_case:
            return ""
        found = self.pattern if self.literal else literal_prefix(self.pattern)
        return found if len(found) >= 2 and "\n" not in found else ""

    def translated(self) -> Translated:
        """Raises BadPattern or UnsupportedPattern."""
        return translate(quote(self.pattern) if self.literal else self.pattern, self.ignore_case, self.word)

    def chosen_engine(self) -> str:
        if self.engine != "auto":
            return self.engine
        t = self.translated()
        return "whole" if t.needs_whole else "python" if t.deep else "jvm"
