"""Packing pieces into sequences by length patterns and non-negative least squares.

Which documents share a sequence depends on their lengths only, and there are
at most ``capacity`` different ones.  So the plan is made on the driver from
the histogram of lengths, whose size doesn't depend on the corpus: patterns of
a few lengths that fill a sequence are listed, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is
packed by best fit, again many equal sequences at a time.  The pieces of each
length are then numbered, and their number tells sequence and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, gapless_rank, slices, small_batches, tidy
from corpusgrep.llm.encoders import cached_encoder, byte_words

#: Partners tried for the second and third place of a pattern, the commonest lengths first.
PARTNERS = 40
ROUNDS = 300


def patterns(present: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of one to four present lengths, descending and padded by 0, that fill a sequence exactly."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    common = present[np.argsort(-counts[present], kind="stable")]
    found = [np.array([[capacity, 0, 0, 0]])[: int(has[capacity])]]
    small = common[common < capacity]
    a = small[capacity - small >= 1]
    if len(a):
        b = capacity - a
        on = has[b]
        found.append(np.stack([a[on], b[on], 0 * a[on], 0 * a[on]], 1))
        second = small[:PARTNERS]
        x, y = (m.ravel() for m in np.meshgrid(small, second, indexing="ij"))
        z = capacity - x - y
        on = (z > 0) & has[np.maximum(z, 0)]
        found.append(np.stack([x[on], y[on], z[on], 0 * x[on]], 1))
        few = small[: PARTNERS // 4]
        x, y, w = (m.ravel() for m in np.meshgrid(small, few, few, indexing="ij"))
        z = capacity - x - y - w
        on = (z > 0) & has[np.maximum(z, 0)]
        found.append(np.stack([x[on], y[on], w[on], z[on]], 1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), int)
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error of the lengths that they use, by multiplicative updates."""
    weight = (rows > 0).astype(float)
    share = lambda y: (y[rows] * weight).sum(1)
    used = lambda x: np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), len(counts))
    target = np.maximum(share(counts.astype(float)), 1e-12)
    x = (np.where(rows > 0, counts[rows] / np.maximum(used(np.ones(len(rows)))[rows], 1e-12), np.inf)).min(1)
    for _ in range(ROUNDS):
        x = x * target / np.maximum(share(used(x)), 1e-12)
    return x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up counts[length] exactly.

    PARTNERS bounds the patterns that are tried, not the pieces: best fit packs all that they leave.
    Ties between patterns go to the one that comes first, longest pieces first.
    """
    left, out = counts.astype(np.int64).copy(), []

    def take(row: tuple[int, ...], most: int) -> None:
        need = np.bincount(row, minlength=len(left))
        some = np.flatnonzero(need)
        k = min(most, int((left[some] // need[some]).min()))
        if k > 0:
            left[some] -= k * need[some]
            out.append((row, k))

    present = np.flatnonzero(left)
    if len(present):
        rows = patterns(present, left, capacity)
        if len(rows):
            x = fit(rows, left)
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 1:
                    break
                take(tuple(int(v) for v in rows[i] if v), int(x[i]))
    # Best fit of the rest: the longest piece, then always the longest that still fits; then as many equal sequences as there are pieces for.
    while left.any():
        row, room, free = [], capacity, left.copy()
        while room > 0 and len(fits := np.flatnonzero(free[: room + 1])):
            longest = int(fits[-1])
            n = min(int(free[longest]), room // longest)
            row += [longest] * n
            free[longest] -= n
            room -= n * longest
        take(tuple(row), int(left.max()))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) rows: piece r of a length lies in the row with r."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for row, k in planned:
        offset = 0
        for length in row:
            first = used.get(length, 0)
            out.append((length, first, first + k - 1, sequence, offset))
            used[length] = first + k
            offset += length
        sequence += k
    return out


def pieces(df: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids) of every text, with the end id; ids little-endian, 32 bits.

    A null text is empty, repeated rows are cut each.  Only texts of over capacity ids are cut: all pieces but the first have
    capacity ids, the first what is left over.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoder(path, byte_words)
        for batch in slices(batches, "t"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                ids = encode(t.as_py()) + end
                n = len(ids) >> 2
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, value in zip(out, (k, piece, a, b - a, ids[4 * a:4 * b]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(tidy(run, True), "doc_id long, piece int, start long, length long, ids binary")


def pack(spark: SparkSession, df: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """Written rows with a ``length`` of 1 to capacity, with sequence_id and offset.

    The numbering of equal lengths is spread over buckets, so that no length's rows need to fit one
    task; rows equal in all columns are folded before they are shuffled.  The slot table is joined
    by broadcast: it has a few rows for each pattern, and there are at most as many patterns as the
    fitted ones (bounded by capacity and PARTNERS) and one for each step of best fit, each of which
    uses up a length; with 1024 lengths these are some thousand rows.  Which of equally long pieces
    gets which place follows a hash of their order columns, then these; rows equal in all columns get places of their own.  An empty table gives an empty result.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in df.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[length] = n
    rows = slots(plan(counts, capacity))
    table = spark.createDataFrame(rows, "length long, first long, last long, base long, offset long")
    ranked = gapless_rank(df, ["length"], order, "__rank", int(counts.sum()))
    return ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("__rank").between(F.col("first"), F.col("last"))).select(
        *(ranked[c] for c in df.columns), (F.col("base") + F.col("__rank") - F.col("first")).alias("sequence_id"), "offset")


def pack_documents(spark: SparkSession, documents: DataFrame, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Digest of the packing of all documents; see pieces and pack."""
    cut = pieces(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id, capacity)
    written = Stages(spark, "packing").write(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(spark, written, ["doc_id", "piece", "ids_crc32"], capacity)


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; see pieces and pack for all special cases."""
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_pattern_packing": op5_pattern_packing}
ORACLES: dict[str, str] = {}
