import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrep.llm import quality, words

TEXTS = ["", None, " ", "a", "one two three one two three one", "a b c d\na b c d\n\n \nx ## é |", "é ñ ü \x0bzz\tq", "the " * 200, "Ab! Cd! Ef!\r\nAb! Cd! Ef!\r\n",
         "Some plain words make a line here.\n" * 3 + "Another one of these lines ends here."]


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i:i + 3]) for i in range(len(found) - 2))
    covered = {j for i in range(len(found) - 2) if windows[tuple(found[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_query(spark, tmp_path):
    rng = np.random.default_rng(0)
    texts = TEXTS + [" ".join(rng.choice(["ab", "é", "c.", "D#", "e\n"], 70)) for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "n", 1), (3, "dup", 1), (3, "dup", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op9_weak_supervision(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[:7]) for r in got), key=str) == sorted(((k, *brute(t)) for k, t, _ in rows), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert quality.op9_weak_supervision(spark, str(tmp_path)).count() == 0


def test_long_words_in_small_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(words, "BLOCK", 16)
    data, offsets = words.text_bytes(pa.array(["x" * 50 + " ab ab " + "x" * 50, None, "ab"]))
    starts, ends, first = words.find_words(data, offsets)
    h = words.hash_ranges(data, starts, ends)
    assert first.tolist() == [0, 4, 4, 5] and h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]


def test_estimates_recover_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy, cover = np.array([0.95, 0.9, 0.8, 0.75, 0.85]), np.array([0.9, 0.5, 0.8, 0.9, 0.3])
    right = rng.random((20000, 5)) < accuracy
    vote = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 5)) < cover)
    rows, counts = np.unique(vote, axis=0, return_counts=True)
    start, ratios = quality.estimate(rows, counts)
    assert abs(1 / (1 + np.exp(-start)) - 0.7) < 0.05
    assert np.allclose(-ratios[:, 0], np.log(accuracy / (1 - accuracy)), atol=0.3)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_agrees_with_labels(spark):
    got = quality.op9_weak_supervision(spark, "/root/testdata/sf0.1").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    table = {(r.quality, r.kept): r["count"] for r in got.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    kept = table.get((1, True), 0) / max(1, table.get((1, True), 0) + table.get((1, False), 0))
    caught = table.get((0, False), 0) / max(1, table.get((0, False), 0) + table.get((0, True), 0))
    print(table)
    assert kept > 0.99 and caught > 0.9


def one_by_one(votes):
    """Posteriors by expectation-maximisation over single documents, in plain loops."""
    prior, tables = 0.85, [[0.22] * len(votes[0]), [0.004] * len(votes[0])]
    odds = lambda v: math.log(prior / (1 - prior)) + sum(
        min(0, math.log(g / b)) if x < 0 else max(0, math.log((1 - g) / (1 - b))) if x > 0 else 0 for x, b, g in zip(v, *tables, strict=True))
    for _ in range(100):
        p = [1 / (1 + math.exp(-odds(v))) for v in votes]
        tables = [[(sum(q for q, v in zip(share, votes, strict=True) if v[r] < 0) + 50 * start) / (sum(q for q, v in zip(share, votes, strict=True) if v[r]) + 50)
                   for r in range(len(votes[0]))] for share, start in (([1 - q for q in p], 0.22), (p, 0.004))]
        prior = min(0.97, max(0.05, (sum(p) + 0.85 * 50) / (len(p) + 50)))
    return [1 / (1 + math.exp(-odds(v))) for v in votes]


def test_posterior_by_definition(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(60)] + ["#$ && ## a !! " * 20 for _ in range(9)] + ["SHOUT NOW! " * 30, "", "1 2 3 4 5 6"] + ["same line\n" * 40] * 6
    measured = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rules = quality.votes()
    got = quality.posterior(measured).select("doc_id", "quality_probability", *(v.alias(f"vote_{n}") for n, v in rules.items())).orderBy("doc_id").collect()
    want = one_by_one([[r[f"vote_{n}"] for n in rules] for r in got])
    assert np.allclose([r.quality_probability for r in got], want, atol=1e-9) and min(want) < 0.5 < max(want)
