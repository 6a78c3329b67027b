"""A bidirectional gated recurrent network with attention pooling, in numpy.

A text is read in both directions; in each window of words an attention layer
weighs the states, and their weighted sum gives one logit.  A word's input
joins an embedding of the word and the mean embedding of its character
trigrams, both looked up by hash, each with one more component that starts as
the log odds of a toxic document given the word or trigram and is trained on
like the others.  A document's logit is that of its highest window.

So that every window can be scored at the cost of reading a text a few times,
windows share the states of their words: the text is read in pieces of WINDOW
words, in READINGS ways that differ in where the pieces begin, and a window is
pooled from the states of each reading in turn.  A window that is a piece of a
reading is scored just as in training.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np

WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 6, 8, 8
INPUT = WORD_DIM + CHAR_DIM
#: Words whose inputs a task remembers.
CACHED = 150_000
#: Words of a window, readings of a text, and words from the beginning of one reading's pieces to that of the next one's.
WINDOW, READINGS = 32, 4
STEP = WINDOW // READINGS
#: Documents that a word or trigram needs in training before its log odds count.
LEAST_SEEN = 4
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Steps of training at least; small samples get more rounds for it.
LEAST_STEPS = 600
#: Characters above which a text's words are scored part by part.
LONG = 1 << 18
#: Words of texts that are read together in training.
TOGETHER = 1 << 17

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def split(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD_BUCKETS


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of ^word$, of all words on end, and how many each word has."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mixed = codes[:-2] * _MIX[0] + codes[1:-1] * _MIX[1] + codes[2:] * _MIX[2]
    mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX[0]
    return (mixed >> np.uint64(40)).astype(np.int32)[_ranges(np.cumsum(sizes + 2) - sizes - 2, sizes)] % CHAR_BUCKETS, sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_parameters(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "char": np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32)}
    for side in "fb":
        p |= {f"W{side}": draw(INPUT, 3 * HIDDEN), f"U{side}": draw(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": draw(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, 1)[:, 0],
                "w": draw(2 * HIDDEN, 1)[:, 0], "c": np.full(1, -1.0, np.float32)}


def _states(gates: np.ndarray, u: np.ndarray, real: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """Hidden states by step of one direction; gates are the inputs' parts, steps first.  Padding keeps the state."""
    steps, n, _ = gates.shape
    h, kept = np.zeros((n, HIDDEN), gates.dtype), []
    out = np.zeros((steps, n, HIDDEN), gates.dtype)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        mine = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + mine[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        m = mine[:, 2 * HIDDEN:]
        new = np.tanh(gates[t, :, 2 * HIDDEN:] + r * m)
        z = np.where(real[t][:, None], z, 1).astype(gates.dtype)
        kept.append((t, h, z, r, m, new))
        h = (1 - z) * new + z * h
        out[t] = h
    return out, kept


def forward(p: dict, gates_f: np.ndarray, gates_b: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows, steps first; an empty window's logit is that of the zero state."""
    sf, kf = _states(gates_f, p["Uf"], real, False)
    sb, kb = _states(gates_b, p["Ub"], real, True)
    s = np.concatenate([sf, sb], 2)
    u = np.tanh(s @ p["A"] + p["a"])
    e = np.where(real, u @ p["v"], -1e9)
    e = np.exp(e - e.max(0))
    share = np.where(real, e, 0)
    share = share / np.maximum(share.sum(0), 1e-9)
    pooled = (share[:, :, None] * s).sum(0)
    return pooled @ p["w"] + p["c"][0], (s, kf, kb, u, share, pooled)


def backward(p: dict, real: np.ndarray, cache: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the parameters but the embeddings, and of both directions' gates."""
    s, kf, kb, u, share, pooled = cache
    g = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
    d_pool = d_logit[:, None] * p["w"]
    ds = share[:, :, None] * d_pool
    d_share = (s * d_pool).sum(2)
    d_e = share * (d_share - (share * d_share).sum(0))
    g["v"] = np.einsum("tn,tna->a", d_e, u)
    d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["a"] = np.einsum("tns,tna->sa", s, d_u), d_u.sum((0, 1))
    ds = ds + d_u @ p["A"].T
    out = []
    for side, kept, d_side in (("f", kf, ds[:, :, :HIDDEN]), ("b", kb, ds[:, :, HIDDEN:])):
        d_gates = np.zeros((*d_side.shape[:2], 3 * HIDDEN), d_side.dtype)
        d_u_side, dh = np.zeros_like(p[f"U{side}"]), np.zeros_like(d_side[0])
        for t, h, z, r, m, new in reversed(kept):
            dh = dh + d_side[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z) * real[t][:, None]
            d_r = d_new * m * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], 1)
            d_mine = np.concatenate([d_z, d_r, d_new * r], 1)
            d_u_side += h.T @ d_mine
            dh = dh * z + d_mine @ p[f"U{side}"].T
        g[f"U{side}"], g[f"b{side}"] = d_u_side, d_gates.sum((0, 1))
        out.append(d_gates)
    return g, out[0], out[1]


def states(p: dict, forth: np.ndarray, back: np.ndarray, flat: np.ndarray, sizes: np.ndarray, reading: int) -> np.ndarray:
    """Both states of every word of texts of these sizes: flat has their words, rows of the tables of gates of each direction."""
    first = np.cumsum(sizes) - sizes
    ahead = -reading * STEP % WINDOW  # words that the first piece lacks
    pieces = np.where(sizes > 0, -(-(sizes + ahead) // WINDOW), 0)
    begin = _ranges(np.zeros_like(pieces), pieces) * WINDOW - ahead + np.repeat(first, pieces)
    end = np.minimum(begin + WINDOW, np.repeat(first + sizes, pieces))
    begin = np.maximum(begin, np.repeat(first, pieces))
    order = np.argsort(begin - end, kind="stable")  # longest first: those that a step doesn't reach come last
    begin, end = begin[order], end[order]
    reach = np.searchsorted(begin - end, -np.arange(WINDOW))  # pieces of more than so many words
    half = np.ones(3 * HIDDEN, np.float32)
    half[: 2 * HIDDEN] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
    u = np.stack([p["Uf"], p["Ub"]]) * half
    out, h = np.empty((len(flat), 2 * HIDDEN), np.float32), np.zeros((2, len(begin), HIDDEN), np.float32)
    for t in range(int((end - begin).max(initial=0))):
        n = int(reach[t])
        f, b = begin[:n] + t, end[:n] - 1 - t
        x = np.stack([forth[flat[f]], back[flat[b]]])
        h = h[:, :n]
        mine = h @ u
        zr = np.tanh(x[..., : 2 * HIDDEN] * np.float32(0.5) + mine[..., : 2 * HIDDEN])
        zr += 1
        zr *= np.float32(0.5)
        new = np.tanh(x[..., 2 * HIDDEN:] + zr[..., HIDDEN:] * mine[..., 2 * HIDDEN:])
        h = new + zr[..., :HIDDEN] * (h - new)
        out[f, :HIDDEN], out[b, HIDDEN:] = h[0], h[1]
    return out


def window_logits(p: dict, forth: np.ndarray, back: np.ndarray, flat: np.ndarray, sizes: np.ndarray, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of each text in one reading, and how many windows it has; an empty text has an empty one.

    A window's pooled sums are differences of running sums over the words.
    """
    s = states(p, forth, back, flat, sizes, reading)
    e = np.exp(np.clip((np.tanh(s @ p["A"] + p["a"]) @ p["v"]).astype(np.float64), -20, 20))
    sums = np.zeros((2, len(flat) + 1))
    np.cumsum(e, out=sums[0, 1:])
    np.cumsum(e * (s @ p["w"]), out=sums[1, 1:])
    counts = np.maximum(sizes - WINDOW, 0) + 1
    begins = _ranges(np.cumsum(sizes) - sizes, counts)
    ends = begins + np.repeat(np.minimum(sizes, WINDOW), counts)
    share = sums[0, ends] - sums[0, begins]
    return (sums[1, ends] - sums[1, begins]) / np.where(share > 0, share, 1) + p["c"][0], counts


def highest(p: dict, forth: np.ndarray, back: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The highest logit of all windows of each text in all readings."""
    found = []
    for reading in range(READINGS):
        z, counts = window_logits(p, forth, back, flat, sizes, reading)
        found.append(np.maximum.reduceat(z, np.cumsum(counts) - counts))
    return np.max(found, 0)


def best_pieces(p: dict, forth: np.ndarray, back: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the highest of the windows begins that are a piece of every other reading, or end with the text."""
    best, at = np.full(len(sizes), -np.inf), np.zeros(len(sizes), np.int64)
    for reading in range(0, READINGS, 2):
        z, counts = window_logits(p, forth, back, flat, sizes, reading)
        first = np.cumsum(counts) - counts
        nth = np.arange(len(z)) - np.repeat(first, counts)
        z = np.where((nth % WINDOW == reading * STEP) | (nth == np.repeat(counts, counts) - 1), z, -np.inf)
        top = np.maximum.reduceat(z, first)
        hits = np.flatnonzero(z == np.repeat(top, counts))
        here = hits[np.searchsorted(hits, first)] - first
        best, at = np.maximum(best, top), np.where(top > best, here, at)
    return at


class Scorer:
    """A trained model; words' gate inputs are computed once and looked up."""

    def __init__(self, p: dict):
        self.p = p
        self.w, self.b = np.concatenate([p["Wf"], p["Wb"]], 1), np.concatenate([p["bf"], p["bb"]])
        self.rows: dict[str, int] = {}
        self.table = np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[str]) -> None:
        grams, sizes = char_buckets(words)
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][np.array([word_bucket(w) for w in words])], chars], 1)
        first = len(self.rows)
        if first + len(words) > self.table.shape[1]:
            self.table = np.concatenate([self.table[:, :first], np.zeros((2, first + 2 * len(words), 3 * HIDDEN), np.float32)], 1)
        self.table[:, first:first + len(words)] = (x @ self.w + self.b).reshape(-1, 2, 3 * HIDDEN).transpose(1, 0, 2)
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's logit of each whole text, all windows scored."""
        out = np.empty(len(texts))
        short = [i for i, t in enumerate(texts) if len(t or "") <= LONG]
        if short:
            out[short] = self._windows([split(texts[i]) for i in short])
        for i, t in enumerate(texts):
            if len(t or "") > LONG:  # part by part, each with the last words of the one before, so that all windows are seen
                out[i] = max(self._windows([part])[0] for part in _parts(t))
        return out

    def _windows(self, words: list[list[str]]) -> np.ndarray:
        """The highest window's logit of each list of words."""
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self.rows))
        if len(self.rows) + len(new) > CACHED:  # start over, so that the table stays small
            self.rows, self.table = {}, np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)
            new = list(dict.fromkeys(w for ws in words for w in ws))
        if new:
            self._learn(new)
        flat = np.fromiter((r for ws in words for r in map(self.rows.__getitem__, ws)), np.int64)
        sizes = np.array([len(ws) for ws in words], np.int64)
        return highest(self.p, *self.table, flat, sizes)


def _parts(text: str) -> Iterator[list[str]]:
    """Words of a long text, part by part.

    A part begins with the last pieces of the one before, so that all windows are in one.
    """
    part, new = [], 0
    for m in _WORD.finditer(text.lower()):
        part.append(m[0])
        new += 1
        if len(part) == LONG // 4:
            yield part
            part, new = part[-2 * WINDOW:], 0
    if new or not part:
        yield part


def _log_odds(seen: np.ndarray, totals: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Log odds by bucket, (buckets, 2) counts of clean and toxic documents; less: one document of this class left out."""
    n, all_ = np.maximum(seen - less, 0), np.maximum(totals - less, 1)
    odds = np.log((n[:, 1] + 0.5) / (all_[1] + 1)) - np.log((n[:, 0] + 0.5) / (all_[0] + 1))
    return np.where(n.sum(1) >= LEAST_SEEN, np.clip(odds / 2, -2, 2), 0).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters fitted to documents' labels.  The log odds that a document trains with leave it out itself.

    In every round the highest piece of each document, and of clean ones also a random window, is
    learnt from.  With one class only, or no documents, the odds stay 0 and the bias
    tells the class.
    """
    p, y = new_parameters(seed), np.array(labels, np.int64)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in split(t)], np.int32) for t in texts]
    buckets = np.fromiter(map(word_bucket, vocabulary), np.int32, len(vocabulary))
    gram_flat, gram_sizes = char_buckets(list(vocabulary))
    gram_first = np.cumsum(gram_sizes) - gram_sizes
    del vocabulary
    totals = np.array([(y == 0).sum(), (y == 1).sum()])
    word_seen, char_seen = np.zeros((WORD_BUCKETS, 2)), np.zeros((CHAR_BUCKETS, 2))
    for d, c in zip(ids, y.tolist(), strict=True):
        own = np.unique(d)
        word_seen[np.unique(buckets[own]), c] += 1
        char_seen[np.unique(gram_flat[_ranges(gram_first[own], gram_sizes[own])]), c] += 1
    full = {"word": _log_odds(word_seen, totals, np.zeros(2)), "char": _log_odds(char_seen, totals, np.zeros(2))}
    left_out = [{"word": _log_odds(word_seen, totals, less), "char": _log_odds(char_seen, totals, less)} for less in np.eye(2)]
    if totals.min() == 0:
        p["c"][0] = 6.0 if totals[1] else -6.0
        p["w"][:] = 0
        return p
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    span = lambda d, a: (d, a, min(len(ids[d]), a + WINDOW))

    def gates_of(c: int) -> np.ndarray:
        """Gates of all words for documents of class c, without their own counts."""
        out = np.zeros((2, max(1, len(buckets)), 3 * HIDDEN), np.float32)
        for k in range(0, len(buckets), 8192):
            x = _inputs(p, left_out[c], np.arange(k, min(len(buckets), k + 8192)), buckets, gram_flat, gram_first, gram_sizes)
            out[0, k:k + len(x)], out[1, k:k + len(x)] = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
        return out

    def layout(chosen: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        place, real = np.zeros((WINDOW, len(chosen)), np.int64), np.zeros((WINDOW, len(chosen)), bool)
        for k, (d, a, b) in enumerate(chosen):
            place[: b - a, k], real[: b - a, k] = ids[d][a:b], True
        return place, real

    lengths = np.array([len(d) for d in ids], np.int64)
    step, rounds = 0, max(EPOCHS, -(-LEAST_STEPS * BATCH // (len(ids) + int(totals[0]))))
    for epoch in range(rounds):
        best = np.zeros(len(ids), np.int64)
        for c in (0, 1):
            forth, back = gates_of(c)
            own = np.flatnonzero(y == c)
            for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(lengths[own]) // TOGETHER)) + 1):
                best[part] = best_pieces(p, forth, back, np.concatenate([ids[d] for d in part.tolist()]), lengths[part])
        chosen = [span(d, int(best[d])) for d in range(len(ids))]
        chosen += [span(d, int(rng.integers(max(1, lengths[d] - WINDOW + 1)))) for d in np.flatnonzero(y == 0).tolist()]
        order = rng.permutation(len(chosen))
        weight = np.where(y == 1, min(3.0, totals[0] / totals[1]), 1.0)
        for k in range(0, len(order), BATCH):
            some = [chosen[i] for i in order[k:k + BATCH]]
            owner = np.array([d for d, _, _ in some])
            place, real = layout(some)
            toxic = y[owner] == 1
            x = word_inputs(p, left_out, place, toxic, buckets, gram_flat, gram_first, gram_sizes)
            z, cache = forward(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], real)
            d_logit = ((_sigmoid(z) - y[owner]) * weight[owner] / len(some)).astype(np.float32)
            g, d_f, d_b = backward(p, real, cache, d_logit)
            g["Wf"], g["Wb"] = np.einsum("tni,tng->ig", x, d_f), np.einsum("tni,tng->ig", x, d_b)
            d_x = ((d_f @ p["Wf"].T + d_b @ p["Wb"].T) * real[:, :, None])[real]
            words = place[real]
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], buckets[words], d_x[:, :WORD_DIM])
            sizes = gram_sizes[words]
            np.add.at(g["char"], gram_flat[_ranges(gram_first[words], sizes)], np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, 0))
            step += 1
            for name, value in g.items():
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.01 * (value * value - v)
                p[name] -= (RATE * (1 - epoch / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    p["word"][:, 0] += full["word"]
    p["char"][:, 0] += full["char"]
    return p


def word_inputs(p: dict, left_out: list[dict], place: np.ndarray, toxic: np.ndarray, buckets, gram_flat, gram_first, gram_sizes) -> np.ndarray:
    """Inputs of a layout's words, steps first, each document's log odds without itself."""
    words, which = np.unique(place, return_inverse=True)
    which = which.reshape(place.shape)
    clean, bad = (_inputs(p, left_out[c], words, buckets, gram_flat, gram_first, gram_sizes) for c in (0, 1))
    return np.where(toxic[None, :, None], bad[which], clean[which])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at first and have these sizes."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _inputs(p: dict, odds: dict, words: np.ndarray, buckets, gram_flat, gram_first, gram_sizes) -> np.ndarray:
    """Inputs of words, with these log odds added."""
    sizes = gram_sizes[words]
    word, gram = p["word"][buckets[words]], gram_flat[_ranges(gram_first[words], sizes)]
    word[:, 0] += odds["word"][buckets[words]]
    char = p["char"][gram]
    char[:, 0] += odds["char"][gram]
    return np.concatenate([word, np.add.reduceat(char, np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)], 1)
