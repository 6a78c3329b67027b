"""Byte-level BPE by speculation: propose greedily, verify pairs, merge only what fails.

A sequence of tokens is the BPE encoding of its word if each token encodes to
itself and each adjacent pair is compatible, that is, if encoding the two
tokens' joint string gives just these two.  Longest-match proposals are right
for most words; one vectorised check over all adjacent pairs of a batch finds
the others, and these are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import keep as keep_object
from corpusgrep.llm.common import slices, small_batches, tidy
from corpusgrep.llm.encoders import CACHED_CHARS, PART, Cache, byte_letters, byte_words, load, parts, plain

_NEVER = np.int64(1) << 62
#: Longest word, in bytes, that the vectorised steps take; others go one by one.
_WIDTH = 32


class _Table:
    """Open-addressed map from 64-bit keys to non-negative numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        keys, values = keys.astype(np.uint64), values.astype(np.int64)
        slots, self.probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.values[slots] < 0)
            taken, first = np.unique(slots[free], return_index=True)
            self.keys[taken], self.values[taken] = keys[free[first]], values[free[first]]
            rest = np.ones(len(keys), bool)
            rest[free[first]] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for unknown keys."""
        keys = keys.astype(np.uint64)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[slots] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at = (slots[open_] + 1) & ((1 << self.bits) - 1)
            slots[open_] = at
            same = self.keys[at] == keys[open_]
            out[open_[same]] = self.values[at[same]]
            open_ = open_[~same & (self.values[at] >= 0)]
        return out


_PRIME = np.uint64(0x100000001B3)


class BpeCodec:
    def __init__(self, path: str):
        library = load(path)
        self.pre_tokenizer = library.pre_tokenizer
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        #: By token: rank of the merge that makes it (-1: none) and its two parts.
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        order = np.arange(len(merges) - 1, -1, -1)  # the earliest merge of a string holds
        self.rank[made[order]], self.left[made[order]], self.right[made[order]] = order, left[order], right[order]
        if (self.rank[left] >= np.arange(len(merges))).any() or (self.rank[right] >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before those of its parts")
        self.ranks, self.made = _Table(left << 32 | right, np.arange(len(merges))), made
        self.pairs = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.own = self._own()
        #: Bytes of each token, for decoding; a special token stands for its text.
        self.letters = {c: b for b, c in byte_letters().items()}
        self.bytes = [b""] * size
        for token, i in self.vocab.items():
            self.bytes[i] = self._raw(token) if all(c in self.letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        own = {self.bytes[i]: i for token, i in self.vocab.items() if token not in self.special}
        self.by_bytes = own
        self.base = np.array([own[bytes([b])] for b in range(256)], np.int64)
        self.longest = [0] * 256
        for token in own:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        short = [t for t in own if len(t) <= _WIDTH]
        hashes = np.zeros(len(short), np.uint64)
        for k, token in enumerate(short):
            h = 0
            for b in token:
                h = (h * int(_PRIME) + b + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        self.tokens = _Table(hashes, np.array([own[t] for t in short]))
        self.known = Cache(lambda word: self.encode_words([word.encode()])[0])

    def _raw(self, standins: str) -> bytes:
        return bytes(self.letters[c] for c in standins)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair stays apart: merges are undone from the last on, and at no time may one
        across the border come before the merge that ended that time.

        Times are 3 * rank, plus 0 left of the border, 1 across it and 2 right of it, as of two equal
        merges the one further left goes first.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        limit = np.full(len(a), _NEVER) if limit is None else np.array(limit, np.int64)
        while len(at):
            rank = self.ranks.get(a << 32 | b)
            across = np.where(rank >= 0, 3 * rank + 1, _NEVER)
            apart = across >= limit
            apart |= across == _NEVER
            ok[at[~apart]] = False
            in_a, in_b = 3 * self.rank[a], 3 * self.rank[b] + 2
            on = apart & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            at, a, b, in_a, in_b = at[on], a[on], b[on], in_a[on], in_b[on]
            undo_a = in_a > in_b
            limit = np.where(undo_a, in_a, in_b)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def _own(self) -> np.ndarray:
        """By token: whether its string encodes to it alone."""
        made = np.flatnonzero(self.rank >= 0)
        fits = np.ones(len(self.rank), bool)
        # Just before its last merge, a token's two parts stand side by side; that merge itself doesn't count against them.
        fits[made] = self.compatible(self.left[made], self.right[made], 3 * self.rank[made] + 1)
        for i in made[np.argsort(self.rank[made])].tolist():
            fits[i] &= fits[self.left[i]] & fits[self.right[i]]
        return fits

    def propose(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        found, at, n, tokens = [], 0, len(word), self.by_bytes
        while at < n:
            to = min(n, at + self.longest[word[at]])
            while (token := tokens.get(word[at:to])) is None:
                to -= 1
            found.append(token)
            at = to
        return found

    def _propose_all(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, owners) of longest matches, all words at once: the longest token at every byte, then jumps."""
        left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
        token, length = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        at, hashes = np.arange(len(data)), np.zeros(len(data), np.uint64)
        limit = np.array(self.longest)[data]
        for n in range(1, _WIDTH + 1):
            on = (left[at] >= n) & (limit[at] >= n)
            at, hashes = at[on], hashes[on]
            if not len(at):
                break
            hashes = hashes * _PRIME + data[at + n - 1] + np.uint64(1)
            found = self.tokens.get(hashes)
            hit = at[found >= 0]
            token[hit], length[hit] = found[found >= 0], n
        ids, owners, now, ends = [], [], starts.copy(), starts + sizes
        on = np.flatnonzero(now < ends)
        while len(on):
            ids.append(token[now[on]])
            owners.append(on)
            now[on] += length[now[on]]
            on = on[now[on] < ends[on]]
        ids, owners = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(owners, kind="stable")
        return ids[order], owners[order]

    def _merge_all(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words, a row each: one merge of every word that still has one at a time."""
        n, width = ids.shape
        sizes, rows = sizes.copy(), np.arange(n)
        ranks = np.full((n, width), _NEVER)
        inside = np.arange(1, width)[None, :] < sizes[:, None]
        found = self.ranks.get((ids[:, :-1] << 32 | ids[:, 1:])[inside])
        ranks[:, :-1][inside] = np.where(found >= 0, found, _NEVER)
        while len(rows):
            at = ranks[rows].argmin(1)
            best = ranks[rows, at]
            on = best < _NEVER
            rows, at, best = rows[on], at[on], best[on]
            if not len(rows):
                break
            take = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            some, some_ranks = ids[rows], ranks[rows]
            pad = np.full((len(rows), 1), -1, np.int64)
            some = np.take_along_axis(np.concatenate([some, pad], 1), take, 1)
            some_ranks = np.take_along_axis(np.concatenate([some_ranks, pad + 1 + _NEVER], 1), take, 1)
            some[np.arange(len(rows)), at] = self.made[best]
            sizes[rows] -= 1
            for first in (at - 1, at):
                real = np.flatnonzero((first >= 0) & (first + 1 < sizes[rows]))
                found = self.ranks.get(some[real, first[real]] << 32 | some[real, first[real] + 1])
                some_ranks[real, first[real]] = np.where(found >= 0, found, _NEVER)
            last = np.flatnonzero(at + 1 >= sizes[rows])
            some_ranks[last, at[last]] = _NEVER
            ids[rows], ranks[rows] = some, some_ranks
        return ids, sizes

    def merge(self, word: bytes) -> list[int]:
        """Exact: the pair of least rank first, of equal ones the leftmost; n log n."""
        ids = self.base[list(word)].tolist()
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        pairs = self.pairs
        heap = [(pairs[p][0], i) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or (found := pairs.get((ids[i], ids[j]))) is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (found := pairs.get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (found[0], i))
            if before[i] >= 0 and (found := pairs.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (found[0], before[i]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for k, w in enumerate(words):
            if len(w) <= _WIDTH:
                short.append(k)
            else:
                out[k] = self._one(w)
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short], np.int64)
        data = np.frombuffer(b"".join([words[k] for k in short]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        flat, owner = self._propose_all(data, starts, sizes)
        wrong = np.zeros(len(short), bool)
        wrong[owner[~self.own[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong[owner[inside[~fits[which]]]] = True
        ends = np.searchsorted(owner, np.arange(len(short)), "right").tolist()
        raw, begin = flat.astype("<u4").tobytes(), 0
        for k, end in zip(short, ends, strict=True):
            out[k] = raw[4 * begin:4 * end]
            begin = end
        again = np.flatnonzero(wrong)
        for part in np.array_split(again, max(1, len(again) >> 14)):
            width = int(sizes[part].max(initial=0))
            cells = np.arange(width)[None, :] < sizes[part][:, None]
            ids = np.full((len(part), width), -1, np.int64)
            ids[cells] = self.base[data[(starts[part][:, None] + np.arange(width)[None, :])[cells]]]
            ids, counts = self._merge_all(ids, sizes[part])
            ids = ids.astype("<u4")
            for row, (k, count) in enumerate(zip(part.tolist(), counts.tolist(), strict=True)):
                out[short[k]] = ids[row, :count].tobytes()
        return out

    def _one(self, word: bytes) -> bytes:
        ids = np.array(self.propose(word), np.int64)
        if not (self.own[ids].all() and self.compatible(ids[:-1], ids[1:]).all()):
            ids = np.array(self.merge(word))
        return ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; None counts as empty.  A long text is taken in parts, so that its words needn't all be held."""
        out, some, special = [], [], tuple(self.special)
        for text in texts:
            if text and len(text) > PART and plain(text, special):
                out += self._encode(some, special)
                out.append(b"".join(self._encode([part], special)[0] for part in parts(text)))
                some = []
            else:
                some.append(text)
        return out + self._encode(some, special)

    def _encode(self, texts: list[str | None], special: tuple[str, ...]) -> list[bytes]:
        words = [byte_words(t) if t and plain(t, special) else None for t in texts]
        known, older = self.known, self.known.older
        missing = list({w for ws in words if ws for w in ws}.difference(known))
        again = [w for w in missing if w in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new = [w for w in missing if w not in older]
        known.update(zip(new, self.encode_words([w.encode() for w in new]), strict=True))
        out = [b"".join(map(known.__getitem__, ws)) if ws else b"" if not t else self._other(t) for t, ws in zip(texts, words, strict=True)]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        known.trim()
        return out

    def _other(self, text: str) -> bytes:
        parts = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                parts.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                parts += self.encode_words([self._raw(w) for w, _ in self.pre_tokenizer.pre_tokenize_str(part)])
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; unknown ids are nothing, broken UTF-8 becomes U+FFFD."""
        table, n = self.bytes, len(self.bytes)
        return b"".join([table[i] for i in ids.tolist() if 0 <= i < n]).decode("utf-8", "replace")


def codec_of(path: str) -> BpeCodec:
    """The codec of this Python process, whose words the next tasks find as well."""
    return keep_object(f"codec {path}", lambda: BpeCodec(path))


def roundtrip(df: DataFrame, path: str, keep: list[str], text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The kept columns, the ids of each whole text and the text that these decode to.

    Null texts count as empty.  Kept columns named like the new ones are replaced.  Repeated rows
    stay, each with its own result; an empty table gives an empty one.  No shuffle; a task holds
    about 4 MB of text, or one longer text, at a time.
    """
    small_batches(df.sparkSession)
    keep = [c for c in keep if c.lower() not in (ids.lower(), decoded.lower())]
    names = [f"__c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in slices(batches, "__text"):
            found = codec.encode(batch.column("__text").to_pylist())
            flat = np.frombuffer(b"".join(found), "<u4")
            ends = np.cumsum([0, *(len(x) >> 2 for x in found)])
            texts = [codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))), pa.array(texts, pa.string())],
                [*names, "__ids", "__decoded"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    done = rows.mapInArrow(tidy(run, True), ", ".join([*kinds, "__ids array<int>, __decoded string"]))
    return done.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("__ids").alias(ids), F.col("__decoded").alias(decoded))


def op6_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document; see roundtrip for all special cases."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = roundtrip(documents, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_bpe_speculate_verify": op6_bpe_speculate_verify}
ORACLES: dict[str, str] = {}
