"""Toxicity scores of whole documents by a recurrent network trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm import gru
from corpusgrep.llm.common import Stages, slices, small_batches, tidy

#: Labelled documents of each class that the network is fitted to, at most: those of least hash.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 2000
THRESHOLD = 0.5
#: Bytes of text that all samples together have at most, half for each class, and those that are scored together.
SAMPLE_BYTES = 32 << 20
SLICE = 1 << 18


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is divisible by 5.  Null ids are held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict[str, np.ndarray]:
    """Train on a bounded sample of the labelled rows that aren't held out.

    The sample has TOXIC_SAMPLE and CLEAN_SAMPLE documents at most, those of least hash of the id,
    as far as their texts come to half of SAMPLE_BYTES for each class (a text that would go beyond
    it is left out), so it is the same in every run; only these texts come to the driver.  Null
    labels, ids and texts are ignored; of several labels of one id the greatest counts, and of
    several texts the least.  The labels are the smaller side of the join, and adaptive execution
    chooses how it is done.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__label"))
    hashed = known.withColumn("__hash", F.xxhash64("__key"))
    toxic = hashed.where(F.col("__label") == 1).orderBy("__hash", "__key").limit(TOXIC_SAMPLE)
    clean = hashed.where(F.col("__label") == 0).orderBy("__hash", "__key").limit(CLEAN_SAMPLE)
    chosen = {r["__key"]: (int(r["__label"]), r["__hash"]) for r in toxic.unionByName(clean).collect()}
    if not chosen:
        return gru.train([], [])
    rows = documents.where(F.col(key).isin(list(chosen)) & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = Stages(documents.sparkSession, "toxicity").write(rows.groupBy("__key").agg(F.min("__text").alias("__text")), "sample")
    sizes = {r["__key"]: r["n"] for r in rows.select("__key", F.octet_length("__text").alias("n")).collect()}  # at most the sample
    taken, spent = [], [0, 0]
    for k in sorted(sizes, key=lambda k: (chosen[k][1], k)):
        if spent[chosen[k][0]] + sizes[k] <= SAMPLE_BYTES // 2:
            spent[chosen[k][0]] += sizes[k]
            taken.append(k)
    if not taken:
        return gru.train([], [])
    texts = sorted((r["__key"], r["__text"]) for r in rows.where(F.col("__key").isin(taken)).collect())
    return gru.train([t for _, t in texts], [chosen[k][0] for k, _ in texts])


def score(df: DataFrame, parameters: dict[str, np.ndarray], text: str = "text", into: str = "score") -> DataFrame:
    """df with the score, 0 to 1, of every whole text; a column named like the score is replaced.

    A text's score is that of its highest window, and all overlapping windows are scored.  A null
    or empty text gets the score of an empty window.  Repeated rows get one score each, the same
    one; an empty table gives an empty result.  No shuffle, and only texts go to Python, in batches
    of bounded size; a longer text is a batch of its own, and its words are taken part by part.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(parameters)  # about 1 MB, whatever the corpus

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = gru.Scorer(sent.value)
        for whole in texts:
            for batch in slices([pa.RecordBatch.from_arrays([whole], ["t"])], "t", SLICE):
                yield pa.array(1 / (1 + np.exp(-scorer.logits(batch.column("t").to_pylist()))), pa.float64())

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(run)(texts)

    # Not deterministic in name only: so that no plan computes it twice.
    return df.withColumn(into, scores.asNondeterministic()(F.col(text)))


def op7_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; see fit and score for all special cases."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parameters = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, parameters).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_gru_toxicity": op7_gru_toxicity}
ORACLES: dict[str, str] = {}
