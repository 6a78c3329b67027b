"""Batch encoding with public tokenizer files through a bounded cache of words.

Texts of printable ASCII, line feeds and the letters of Latin-1 are cut into
words by the tokenizer's own pattern, written out for those characters; each
word is encoded once and then looked up.  All other texts, and texts with the
string of a special token, go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from corpusgrep.llm.common import keep

#: Words that each of the two generations of a cache holds, and the longest of them.
CACHED = 200_000
CACHED_CHARS = 64

#: Characters of a plain text that are cut into words at a time.
PART = 1 << 20

_NOT_PLAIN = re.compile(r"[^\x20-\x7e\nÀ-ÖØ-öø-ÿ]")
_LOWER = "a-zß-öø-ÿ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\s{_LOWER}0-9]+")
_BYTE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(more)
            more += 1
    return table


#: Stand-ins of the UTF-8 bytes of the characters that plain texts have.
_STANDINS = {c: "".join(map(byte_letters().__getitem__, chr(c).encode())) for c in [10, *range(32, 127), *range(192, 256)]}


def plain(text: str, special: tuple[str, ...]) -> bool:
    return not _NOT_PLAIN.search(text) and not any(s in text for s in special)


_CUT = re.compile(r"(?<=[^ \n]) (?=[^ \n])")


def parts(text: str) -> Iterator[str]:
    """A plain text in parts of about PART characters, cut before single spaces, where no word reaches across.

    A text without such a space stays whole.
    """
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def lower_words(text: str) -> list[str]:
    """Words of a plain text for the tokenizer that lower-cases and drops white space."""
    return _WORDS.findall(text.lower())


def byte_words(text: str) -> list[str]:
    """Words of a plain text, each with the space before it, for byte-level tokenizers."""
    return _BYTE_WORDS.findall(text)


def standins(word: str) -> str:
    return word.translate(_STANDINS)


class Cache(dict):
    """Two generations: when the younger is full it becomes the older, and what is still in use comes back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, word):
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= CACHED_CHARS:
            self.trim()
            self[word] = found
        return found

    def trim(self) -> None:
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()


class CachedEncoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the library encodes them without special tokens."""

    def __init__(self, path: str, words):
        self.tokenizer = load(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words = words
        model = self.tokenizer.model
        self.known = Cache(lambda word: np.array([t.id for t in model.tokenize(standins(word))], "<u4").tobytes())

    def __call__(self, text: str | None) -> bytes:
        """None counts as empty."""
        if not text:
            return b""
        if plain(text, self.special):
            return b"".join([b"".join(map(self.known.__getitem__, self.words(part))) for part in parts(text)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cached_encoder(path: str, words) -> CachedEncoder:
    """The encoder of this Python process, whose words the next tasks find as well."""
    return keep(f"encoder {path} {words.__name__}", lambda: CachedEncoder(path, words))
