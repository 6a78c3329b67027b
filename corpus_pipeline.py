"""Five stages from raw documents to packed sequences, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm import minhash, packing, pii, suffix_dedup, toxicity
from corpusgrep.llm.common import Stages, fresh

#: Trained scores, similarities and token counts are not for SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, scores below the threshold.

    Null and empty texts get the score of an empty window and stay; repeated rows go or stay
    together; a score of just the threshold goes.  Without labels nothing is toxic.
    """
    (score,) = fresh(docs, "__toxicity")
    parameters = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, parameters, into=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates.

    Null texts and texts without words are linked with nothing and stay; of rows that share id and
    text one stays, and a null id counts as greater than all others.
    """
    return minhash.keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that are repeated; characters that a cut splits go as well.

    Null texts stay null, and a text of which nothing is left is empty.  Repeated rows are copies
    of one another, so both lose what they share.
    """
    (null,) = fresh(docs, "__null")
    cut = suffix_dedup.without_repeats(spark, docs.withColumn(null, F.col("text").isNull()))
    return _with_text(docs, cut, F.when(~F.col(null), suffix_dedup.whole_characters(F.col("__kept"))))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.  Null texts stay null; repeated rows are masked alike."""
    masked = pii.mask(spark, docs)
    return _with_text(docs, masked, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is a piece of the end id alone."""
    return packing.pack_documents(spark, docs)


def _with_text(docs: DataFrame, df: DataFrame, text) -> DataFrame:
    """The columns of docs with a new text, and n_chars to match."""
    new = df.withColumn("text", text)
    return new.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage keeps is written and read again as the next one's input."""
    stages, docs = Stages(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stages.write(docs, name)
    return docs
