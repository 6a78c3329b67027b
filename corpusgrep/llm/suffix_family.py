"""A logarithmic family of suffix arrays that finds equal strings of one length.

Pieces of text come in batches.  A batch gets a suffix array of its own, over
the starts of its strings and sorted to their full width.  It is merge-scanned
against the arrays that exist: equal strings are neighbours in the merged
order.  Arrays of equal rank merge into one of the next rank, so each start
is merged a logarithmic number of times.
"""

from __future__ import annotations

import numpy as np

#: Starts whose strings are laid out side by side at a time.
CHUNK = 1 << 15


class SuffixFamily:
    def __init__(self, width: int):
        self.width = width
        self.text = np.zeros(1 << 16, np.uint8)
        self.size = 0
        #: By start: whether its string also starts elsewhere.
        self.repeated = np.zeros(1 << 16, bool)
        #: (rank, starts in the order of their strings, one of each string), least rank first.
        self.levels: list[tuple[int, np.ndarray]] = []

    def _keys(self, starts: np.ndarray) -> np.ndarray:
        view = np.ndarray((max(0, len(self.text) - self.width + 1),), f"S{self.width}", self.text, 0, (1,))
        return view[starts]

    def _put(self, pieces: list[bytes]) -> list[int]:
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        if self.size + len(raw) > len(self.text):
            room = max(2 * len(self.text), self.size + len(raw))
            for name in ("text", "repeated"):
                old = getattr(self, name)
                new = np.zeros(room, old.dtype)
                new[: self.size] = old[: self.size]
                setattr(self, name, new)
        self.text[self.size:self.size + len(raw)] = raw
        ends = self.size + np.cumsum([len(p) for p in pieces])
        self.size += len(raw)
        return [int(e) - len(p) for e, p in zip(ends, pieces, strict=True)]

    def add(self, pieces: list[bytes]) -> list[int]:
        """Index one batch; returns where its pieces stand in the family's text.  Strings never run over a piece's end."""
        at = self._put(pieces)
        starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + len(p) - self.width + 1) for a, p in zip(at, pieces, strict=True) if len(p) >= self.width)])
        if not len(starts):
            return at
        keys = self._keys(starts)
        order = np.argsort(keys)
        batch = self._distinct(keys[order], starts[order])
        carry, rank, levels = batch, 0, []
        for other, level in self.levels:
            if other == rank:
                carry, rank = self._merge(carry, level, True), rank + 1
            else:
                self._merge(batch, level, False)
                levels.append((other, level))
        self.levels = sorted([*levels, (rank, carry)], key=lambda x: x[0])
        return at

    def _distinct(self, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mark the starts of equal neighbours, and keep the first of each."""
        same = keys[1:] == keys[:-1]
        self.repeated[starts[1:][same]] = True
        self.repeated[starts[:-1][same]] = True
        return starts[np.concatenate([[True], ~same])]

    def _rank_of(self, level: np.ndarray, key: bytes) -> int:
        """Strings of level that come before key."""
        low, high = 0, len(level)
        while low < high:
            middle = (low + high) >> 1
            if self.text[level[middle]:level[middle] + self.width].tobytes() < key:
                low = middle + 1
            else:
                high = middle
        return low

    def _merge(self, a: np.ndarray, b: np.ndarray, keep: bool) -> np.ndarray | None:
        """Mark the strings that both arrays have; the merged array, if it is to be kept."""
        out, at, to = [], 0, 0
        if len(a) > len(b):
            a, b = b, a
        # Both are cut at every so many strings of the longer one.
        for i in range(0, len(b), CHUNK):
            part = b[i:i + CHUNK]
            last = i + CHUNK >= len(b)
            to = len(a) if last else self._rank_of(a, self.text[b[i + CHUNK]:b[i + CHUNK] + self.width].tobytes())
            if to == at and not keep:
                continue
            starts = np.concatenate([a[at:to], part])
            keys = self._keys(starts)
            order = np.argsort(keys, kind="stable")
            found = self._distinct(keys[order], starts[order])
            if keep:
                out.append(found)
            at = to
        return np.concatenate(out) if keep else None
