"""Sharding by rendezvous (highest random weight) hashing.

Each record key is hashed with every shard; the shard with the greatest score
``-weight / ln(u)`` takes the record.  The scores of a key do not depend on
the other shards, so a new shard takes only its own fair part, a removed one
gives away only what it held, and a weight change moves rows only to or from
that shard.  Everything is a column expression: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, gapless_rank, text_bytes


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Index of the shard that takes key.  A null key is a key like any other.

    Weights must be positive; equal scores (chance about 2**-53) go to the greater index.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    scored = []
    for i, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        scored.append(F.struct((F.lit(-float(weight)) / F.ln(unit)).alias("score"), F.lit(i).alias("shard")))
    return F.array_max(F.array(*scored)).getField("shard") if len(scored) > 1 else F.lit(0)


def shard(df: DataFrame, key: str, weights: list[float], shard_col: str = "shard") -> DataFrame:
    """df with the shard of each row; an existing column of that name is replaced.

    No shuffle.  Empty tables give empty results; repeated rows go to the same shard.
    """
    return df.withColumn(shard_col, rendezvous(F.col(key), weights))


def shard_slots(spark: SparkSession, documents: DataFrame, shards: int = 16) -> DataFrame:
    """Digest of a sharding of documents by doc_id, with gapless slots in each shard.

    Null texts have no bytes (size 1); null ids are one key.  Rows equal in all
    digest columns get slots of their own.  Slots follow a hash of id, checksum and size, then
    these.  An empty table gives an empty result, and other
    columns are ignored.  Only ids, sizes and checksums are shuffled.
    """
    digest = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_bytes("text")) + 1).cast("long").alias("size"),
        F.crc32(text_bytes("text")).alias("text_crc32"))
    digest = shard(digest, "doc_id", [1.0] * shards)
    digest = shard(digest, "doc_id", [1.0] * (shards + 1), "grown_shard")
    stages = Stages(spark, "shard")
    digest = stages.write(digest, "digest")
    ranked = gapless_rank(digest, ["shard"], ["doc_id", "text_crc32", "size"], "slot", digest.count())
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; see shard_slots for all special cases."""
    return shard_slots(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_rendezvous_sharding": op10_rendezvous_sharding}
ORACLES: dict[str, str] = {}
