import re

import numpy as np
import pytest

from corpusgrep.llm import minhash
from corpusgrep.llm.common import Stages
from corpusgrep.llm.components import components
from corpusgrep.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, len(s), c, k == c) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)) for c in [least.get(top(i)) if s else k]]


def make(seed, bases=12, copies=9):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(bases):
        base = rng.choice(words, rng.integers(3, 200)).tolist()
        for _ in range(copies):
            new = base.copy()
            for _ in range(rng.integers(0, max(1, len(base) // 14) + 1)):
                new[rng.integers(len(new))] = str(rng.choice(words))
            texts.append(" ".join(new))
    return texts + ["", None, " \n", "One two", "one  TWO", "one two three four five", "one two three four", "é É é É é É", "é é é é é é"] + ["hot copy of a text here"] * 60


@pytest.mark.parametrize("seed,wide,tile", [(0, 4096, 4 << 20), (1, 6, 300), (2, 4096, 500)])
def test_against_all_pairs(spark, monkeypatch, seed, wide, tile):
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(minhash, "TILE_BYTES", tile)
    monkeypatch.setattr(minhash, "SETS_BYTES", 4000)
    texts = make(seed)
    rows = [(int(k), t) for k, t in zip(np.random.default_rng(seed).permutation(len(texts)), texts, strict=True)] + [(None, "alone in here"), (None, texts[0]), (7, "dup row"), (7, "dup row")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(spark, df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_long_texts_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    words = rng.choice([f"w{i}" for i in range(5000)], 200_000).tolist()
    rows = [(1, " ".join(words), "a"), (2, " ".join(words[:190_000]), "b"), (3, "x" * 2_000_000, "c"), (4, "x" * 2_000_000, "d"), (4, "x" * 2_000_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h string").withColumnsRenamed({"__h": "__d"}).selectExpr("*", "1 as __g", "2 as __h")
    assert {r.doc_id: r.component_id for r in near_duplicates(spark, df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert sorted(r.doc_id for r in minhash.keep_one(spark, df).collect()) == [1, 3] and minhash.keep_one(spark, df).columns == df.columns


def test_large_bucket_of_strangers(spark):
    """Rows follow the members, not their square: a row for each wide block, and none with a text."""
    n, rng = 16_000, np.random.default_rng(9)
    work = minhash.NearDuplicates(spark, spark.createDataFrame([], "doc_id long, text string"))
    nodes = [i.to_bytes(16, "big") for i in range(n)]
    marks = rng.integers(0, 1 << 32, (n, minhash.PERMUTATIONS), dtype=np.uint64).astype(np.uint32)
    classes = work.stages.write(spark.createDataFrame([(k, 50, m.tobytes()) for k, m in zip(nodes, marks, strict=True)], "node binary, n long, s binary"), "classes")
    members = work.stages.write(spark.createDataFrame([(0, 7, k, n) for k in nodes], "band int, bucket long, node binary, size long"), "members")
    work.texts = spark.createDataFrame([], "node binary, z binary")
    links = work._between(members, spark.createDataFrame([], "a binary, b binary"), classes)
    assert links.count() == 0 and spark.read.parquet(work.stages.path("active")).count() == 0
    assert work.tiles.count() == n * -(-n // minhash.WIDE) and "z" not in work.tiles.columns


def test_empty(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = dict(map(tuple, components(Stages(spark, "t"), spark.createDataFrame(path, "a long, b long"), "c").collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
