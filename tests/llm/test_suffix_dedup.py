import hashlib
from collections import Counter

import numpy as np
import pytest

from corpusgrep.llm import suffix_dedup, suffix_family
from corpusgrep.llm.suffix_dedup import op2_suffix_array_family
from corpusgrep.llm.suffix_family import SuffixFamily


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((k, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdé fghij\n"), n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 500)]
    texts = [text(rng.integers(0, 700)) for _ in range(20)]
    for _ in range(60):
        s = shared[rng.integers(len(shared))]
        a, b = sorted(rng.integers(0, len(s) + 1, 2)) if rng.random() < 0.5 else (0, len(s))
        texts.append(text(rng.integers(0, 300)) + s[a:b] + text(rng.integers(0, 200)))
    base = text(900)
    for _ in range(25):
        at = rng.integers(0, 900)
        texts.append(base[:at] + "#" + base[at + 1:])
    return texts + ["a" * 1000, "ab" * 150, "x" * 199, "y" * 200, "z" * 201, "z" * 250, "", None, ("q" * 90 + "w" * 77) * 5, text(169) * 3, text(230) * 2] + [base] * 20


@pytest.mark.parametrize("seed,many", [(0, 1 << 20), (1, 1000), (2, 4000)])
def test_query(spark, tmp_path, monkeypatch, seed, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "PIECES", 40)
    texts = make(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "n" * 210), (3, texts[3]), (4, texts[5]), (None, None)]
    spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, start string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op2_suffix_array_family(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op2_suffix_array_family(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_family(monkeypatch, chunk):
    monkeypatch.setattr(suffix_family, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    family, pieces, places = SuffixFamily(6), [], []
    for _ in range(13):
        batch = [bytes(rng.choice(list(b"ab\x00"), rng.integers(0, 30)).tolist()) for _ in range(5)]
        places += family.add(batch)
        pieces += batch
    seen = Counter(p[i:i + 6] for p in pieces for i in range(len(p) - 5))
    for p, at in zip(pieces, places, strict=True):
        for i in range(len(p) - 5):
            assert family.repeated[at + i] == (seen[p[i:i + 6]] > 1)
    assert [r for r, _ in family.levels] == [0, 2, 3]
    for _, level in family.levels:
        keys = family._keys(level)
        assert (keys[1:] > keys[:-1]).all()


def test_blocks_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 6000).astype(np.uint8)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "LONGEST", 50)
    text, start, n, value, _, _ = suffix_dedup.runs(data, np.array([0, 2500, 2600, 6000]))
    covered = sorted((t, s + i) for t, s, m in zip(text, start, n, strict=True) for i in range(m))
    assert covered == [(0, i) for i in range(2301)] + [(2, i) for i in range(3201)]
