import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from corpusgrep.llm.sharding import rendezvous, shard, shard_slots

SCHEMA = "doc_id long, text string, shard string"


def test_slots_and_growth(spark):
    rows = [(i, "x" * (i % 7) + "é", "a") for i in range(3000)] + [(None, None, None)] * 3 + [(5, "", "b")] * 2
    got = shard_slots(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(16))
    assert 100 < sum(r.grown_shard == 16 for r in got) < 260


def by_definition(key, weights):
    """The shard by another implementation of the hash, one score at a time."""
    scores = []
    for i, weight in enumerate(weights):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
        scores.append((-weight / math.log(((h >> 11) + 0.5) / 2**53), i))
    return max(scores)[1]


def test_shards_by_definition(spark):
    keys = [None, 0, -1, 2**62, *range(1, 400)]
    df = spark.createDataFrame([(k, "t", "") for k in keys], SCHEMA)
    for r in shard_slots(spark, df).collect():
        assert (r.shard, r.grown_shard) == (by_definition(r.doc_id, [1.0] * 16), by_definition(r.doc_id, [1.0] * 17))
    weights = [1.0, 2.5, 0.5]
    assert all(r.shard == by_definition(r.doc_id, weights) for r in shard(df, "doc_id", weights).collect())


def test_weights(spark):
    n = Counter(r.s for r in spark.range(8000).select(rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).collect())
    assert 0.22 < n[0] / 8000 < 0.28
    fewer = spark.range(2000).select(rendezvous(F.col("id"), [1.0] * 4).alias("a"), rendezvous(F.col("id"), [1.0] * 3).alias("b"))
    assert fewer.where("a < 3 and a != b").count() == 0


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_slots(spark, empty).count() == 0
    assert shard(empty, "doc_id", [1.0]).columns == ["doc_id", "text", "shard"]
