"""Quality by weak supervision: rules vote good, bad or not at all, and their accuracies are estimated without labels.

The votes of all documents are counted by combination; there are at most
3**rules of these however many documents there are.  Expectation-maximisation
on the counts estimates how often good and bad documents exist and how each
rule votes on either; a document is kept if the posterior probability that it
is good, given its votes, is at least a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, slices, small_batches, tidy
from corpusgrep.llm.words import find_words, hash_ranges, hash_windows, mix, text_bytes

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts", "n_lines", "n_closed_lines", "n_letterless", "n_marked_words"]
ITERATIONS = 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
_SPEAKS = _LETTER.copy()
_SPEAKS[0x80:] = True
_LATER = np.zeros(256, bool)
_LATER[0x80:0xC0] = True
_BLANKS = " \t\n\x0b\x0c\r"
_CLOSERS = (".", "!", "?", ":", ";", '"', "'", ")", "”", "»", "…")


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(marks)
    return np.diff(np.searchsorted(at, offsets))


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each whole text, FEATURES by name."""
    data, offsets = text_bytes(column)
    starts, ends, first = find_words(data, offsets)
    n_words = np.diff(first)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = lengths[first[1:]] - lengths[first[:-1]]
    hashes = hash_ranges(data, starts, ends)
    windows, at = hash_windows(hashes, first, 3)
    text = np.searchsorted(first, at, "right") - 1 if len(at) else at
    keyed = mix(windows + mix(text.astype(np.uint64) + np.uint64(1)))
    _, which, counts = np.unique(keyed, return_inverse=True, return_counts=True)
    again = at[counts[which] >= 2]
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[again + k] = True
    speaks = np.concatenate([[0], np.cumsum(_SPEAKS[data])])
    letterless = speaks[ends] == speaks[starts]
    marked = np.zeros(len(starts), bool)
    marked[:] = _SYMBOL[data[ends - 1]] | _SHOUT[data[ends - 1]] if len(starts) else False
    out = {
        "n_letterless": _sums(letterless, first), "n_marked_words": _sums(marked, first), "n_words": n_words, "word_chars": solid - _sums(_LATER[data], offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_repeat_words": _sums(covered, first), "n_upper": _sums(_UPPER[data], offsets), "n_letters": _sums(_LETTER[data], offsets),
        "n_shouts": _sums(_SHOUT[data], offsets),
    }
    lines = np.zeros((len(column), 3), np.int64)
    for i, t in enumerate(column.to_pylist()):
        if t:
            some = [x for x in t.split("\n") if x.strip(_BLANKS)]
            lines[i] = len(some) - len(set(some)), len(some), sum(x.rstrip(_BLANKS).endswith(_CLOSERS) for x in some)
    return out | {"n_dup_lines": lines[:, 0], "n_lines": lines[:, 1], "n_closed_lines": lines[:, 2]}


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with FEATURES of the whole text in place of the text; columns of these names are replaced.

    A null text counts as empty; repeated rows are measured each; an empty table gives an empty
    result.  No shuffle; a task holds about 4 MB of text, or one longer text.
    """
    keep = [c for c in df.columns if c != text and c not in FEATURES]
    small_batches(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = features(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[f], pa.int64()) for f in FEATURES)], [*keep, *FEATURES])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(tidy(run), ", ".join([*kinds, *(f"{f} long" for f in FEATURES)]))


def _rule(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """Rules by name: 1 for good, -1 for bad, 0 to abstain.  Every rule abstains on a text without words."""
    n, words = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))
    lines, letters = F.greatest(F.col("n_lines"), F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))
    some = n > 0
    rules = {
        "symbols": _rule(F.col("n_symbols") * 100 <= words, F.col("n_symbols") * 10 > words),
        "marked_words": _rule(F.col("n_marked_words") * 50 <= words, F.col("n_marked_words") * 8 > words),
        "letterless": _rule(F.col("n_letterless") * 25 <= words, F.col("n_letterless") * 5 > words),
        "repetition": _rule(F.col("n_repeat_words") * 10 <= words, F.col("n_repeat_words") * 10 > words * 4),
        "lines": _rule(F.col("n_dup_lines") * 5 <= lines, F.col("n_dup_lines") * 2 > lines),
        "case": _rule((F.col("n_upper") * 5 <= letters) & (n >= 5), (F.col("n_upper") * 2 > letters) & (n >= 5)),
        "shouting": _rule(F.col("n_shouts") * 20 <= words, F.col("n_shouts") * 3 > words),
        "closing": _rule(F.col("n_closed_lines") * 2 >= lines, (F.col("n_closed_lines") * 5 < lines) & (lines >= 5)),
        "word_length": _rule((F.col("word_chars") >= words * 3) & (F.col("word_chars") <= words * 8),
                             (F.col("word_chars") < words * 2) | (F.col("word_chars") > words * 15)),
    }
    return {name: F.when(some, rule).otherwise(F.lit(0)) for name, rule in rules.items()}


#: Chances that a rule that votes says bad, on a bad and on a good document, to start from and as prior.
#: A defect is one of many and seldom seen by a second rule, but good documents hardly ever have it.
START = np.array([0.22, 0.004])
PRIOR_WEIGHT = 50


def estimate(combinations: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote combinations (rows of -1, 0, 1) with their document counts.

    Returns the log odds of a good document and, by rule and vote (-1, 0, 1), the log likelihood
    ratio that the vote adds.  A rule's accuracies on either class are its own, for a rule that sees
    one kind of defect says much by its vote against a document and little by one for it.
    Abstentions add nothing, and rules are taken to be independent given the class.  A vote never
    counts for the class that it is against, so the classes can't change places.  With no documents
    the start is returned.
    """
    n_rules = combinations.shape[1]
    bad, good = (combinations == -1).astype(float), (combinations == 1).astype(float)
    weight, prior = counts.astype(float), 0.85
    says_bad = np.repeat(START[:, None], n_rules, 1)  # class, rule

    def ratios() -> np.ndarray:
        against = np.log(says_bad[1]) - np.log(says_bad[0])
        for_it = np.log1p(-says_bad[1]) - np.log1p(-says_bad[0])
        return np.stack([np.minimum(against, 0), np.zeros(n_rules), np.maximum(for_it, 0)], 1)

    for _ in range(ITERATIONS if len(counts) else 0):
        r = ratios()
        odds = np.log(prior / (1 - prior)) + bad @ r[:, 0] + good @ r[:, 2]
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for c, q in enumerate((1 - p, p)):
            against, for_it = (weight * q) @ bad, (weight * q) @ good
            says_bad[c] = (against + PRIOR_WEIGHT * START[c]) / (against + for_it + PRIOR_WEIGHT)
        prior = float(np.clip(((weight * p).sum() + 0.85 * PRIOR_WEIGHT) / (weight.sum() + PRIOR_WEIGHT), 0.05, 0.97))
    return float(np.log(prior / (1 - prior))), ratios()


def posterior(df: DataFrame, probability: str = "quality_probability") -> DataFrame:
    """Measured rows with the posterior probability that each is good; votes are estimated on all rows.

    One aggregation to at most 3**rules rows, which the driver reads.  The rows should be a written
    table, as they are read twice.  An empty table gives an empty result.
    """
    rules = votes()
    found = df.select(*(v.alias(name) for name, v in rules.items())).groupBy(*rules).agg(F.count("*").alias("n")).collect()
    combinations = np.array([[r[name] for name in rules] for r in found], np.int64).reshape(len(found), len(rules))
    counts = np.array([r["n"] for r in found], np.int64)
    order = np.lexsort(combinations.T) if len(found) else np.zeros(0, int)
    start, ratios = estimate(combinations[order], counts[order])
    odds = reduce(lambda total, x: total + x, [
        F.when(v == 1, F.lit(float(w[2]))).when(v == -1, F.lit(float(w[0]))).otherwise(F.lit(float(w[1])))
        for v, w in zip(rules.values(), ratios, strict=True)], F.lit(start))
    return df.withColumn(probability, 1 / (1 + F.exp(-odds)))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; see measure, votes and posterior for all special cases."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    measured = Stages(spark, "quality").write(measure(documents), "features")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return posterior(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability")


QUERIES = {"op9_weak_supervision": op9_weak_supervision}
ORACLES: dict[str, str] = {}
