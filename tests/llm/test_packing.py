import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgrep.llm.packing import op5_pattern_packing, plan, slots

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 64 if seed < 3 else 1024
    counts = np.zeros(capacity + 1, np.int64)
    lengths = np.minimum(rng.lognormal(5 if capacity > 64 else 2.5, 1, 5000).astype(int) + 1, capacity)
    np.add.at(counts, lengths, 1)
    planned = plan(counts, capacity)
    used = np.zeros(capacity + 1, np.int64)
    for row, k in planned:
        assert sum(row) <= capacity and k > 0
        np.add.at(used, np.array(row), k)
    assert (used == counts).all()
    total, least = sum(k for _, k in planned), -(-int(lengths.sum()) // capacity)
    assert total <= least * 1.005 + 2
    ranks = {}
    for length, first, last, _, _ in slots(planned):
        ranks.setdefault(length, []).extend(range(first, last + 1))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())


def test_plan_edges():
    assert plan(np.zeros(11, np.int64), 10) == []
    only = np.zeros(11, np.int64)
    only[7] = 5
    assert plan(only, 10) == [((7,), 5)]


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["thon", "ering", "the", "Éa", "of", "x1"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 900, 120)] + ["", None, "y" * 9, "word " * 5000, "the" * 1023] + ["same"] * 40
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1), (4, "dup", 1), (4, "dup", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, length int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_pattern_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(PATH)
    want, total = [], 0
    for k, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-total // 1024) + 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_pattern_packing(spark, str(tmp_path)).count() == 0
