"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its lesser neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(stages: Stages, edges: DataFrame, label: str) -> DataFrame:
    """(a, b): every node that has an edge, but for the least of its component, and that least node.

    Edges are (a, b) of any orderable, non-null type, either way round and repeated as they come;
    loops are ignored.  Each round is written to the shared folder, so lineage stays short and a
    lost executor costs one round; a node with very many neighbours is aggregated before the
    shuffle and split by adaptive execution in the join.  No edges give no rows.
    """
    now = stages.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    sign = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    before, step = sign(now), 0
    while before[0]:
        step += 1
        now = stages.write(_small_star(_large_star(now)), f"{label}-{step}")
        after = sign(now)
        stages.drop(f"{label}-{step - 1}")
        if after == before:
            break
        before = after
    return now
