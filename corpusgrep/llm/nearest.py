"""Nearest neighbours by randomly rotated one-bit codes with error bounds, in cells.

Vectors lie in the cells of a few centres.  A vector is taken relative to its
cell's centre, scaled to unit length and rotated at random; its code keeps the
sign of each coordinate, packed, and two scalars: the distance to the centre
and the inner product of the unit vector with its own code, which corrects the
estimate.  The estimate of an inner product with a query then has an error of
at most about EPSILON standard deviations; candidates whose lower bound of the
distance is above the K-th upper bound are skipped, and the rest are ranked
again by the original vectors in double precision.

Queries are rows that go to the cells that they visit: first to the nearest
ones, which gives each a K-th distance, then to every other cell whose ball can
hold something as near.  A cell's vectors and its queries are dealt out in
blocks of bounded size, so no cell needs to fit one task, however many rows or
queries it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, tidy

#: Cells at most, and vectors of the sample for each; vectors, and bytes of them, that the centres are fitted to (a documented sample: least hashes of the ids).
CELLS, FOR_EACH = 256, 32
CENTRE_SAMPLE, CENTRE_BYTES = 20_000, 32 << 20
#: Cells that a query visits to begin with.
FIRST = 2
#: Bytes of a block's vectors and of a block's queries, in double precision, and queries that are compared together.
VECTOR_BYTES, QUERY_BYTES, TOGETHER = 8 << 20, 16 << 20, 256
#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 4.0
SEED = 20240517


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every call."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, distance to the centre, inner product of the unit vector with its code) of each row.

    The centre is one for all rows, or one for each.  A vector at it has distance 0 and a correction of 1.
    """
    rest = vectors - centre
    norm = np.sqrt((rest * rest).sum(1))
    rest = rest @ turn.T
    bits = rest >= 0
    unit = rest / np.maximum(norm, 1e-300)[:, None]
    own = np.where(norm > 0, np.abs(unit).sum(1) / np.sqrt(vectors.shape[1]), 1.0)
    return np.packbits(bits, axis=1), norm, own.astype(np.float32)


def unpacked(codes: np.ndarray, dim: int) -> np.ndarray:
    """Codes as 1 and -1, for products with many queries: a matrix product of floats is the fastest that numpy has for them."""
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def bounds(signs: np.ndarray, norm: np.ndarray, own: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, vectors) of the squared distances; infinite where they can't be computed."""
    dim = queries.shape[1]
    q = (queries - centre) @ turn.T
    q_norm = np.sqrt((q * q).sum(1))
    unit = (q / np.maximum(q_norm, 1e-300)[:, None]).astype(np.float32)
    raw = unit @ signs.T / np.float32(np.sqrt(dim))
    own = np.maximum(own, np.float32(1e-6))
    near = raw / own
    error = np.float32(EPSILON / np.sqrt(max(1, dim - 1))) * np.sqrt(np.maximum(1 - own * own, 0)) / own + np.float32(1e-4)
    far, norm = q_norm[:, None], norm.astype(np.float64)[None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        scale, base = 2 * far * norm, far * far + norm * norm
        slack = 1e-5 * base
        low, high = base - scale * np.minimum(near + error, 1) - slack, base - scale * np.maximum(near - error, -1) + slack
    known = np.isfinite(low) & np.isfinite(high)
    return np.where(known, low, -np.inf), np.where(known, high, np.inf)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and one of them not zero."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(doubles) > 0) & finite & F.exists(doubles, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances (vectors, centres), exactly summed for each pair."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((vectors - c) ** 2).sum(1)) for c in centres], 1)


def _closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector.  Any cell would be right, so it needn't be exact; where products overflow, it is the first."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((centres * centres).sum(1) - 2 * (vectors @ centres.T), nan=np.inf, posinf=np.inf).argmin(1)


def centres_of(sample: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Centres by k-means, as many as the sample has enough vectors for."""
    n = min(CELLS, max(1, len(sample) // FOR_EACH))
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:n]]
    for _ in range(rounds if n > 1 else 1):
        which = _closest(sample, centres) if n > 1 else np.zeros(len(sample), int)
        for c in range(n):
            if (which == c).any():
                centres[c] = sample[which == c].mean(0)
    return centres


def index(df: DataFrame, dim: int, centres: np.ndarray) -> DataFrame:
    """(cell, id, v, code, norm, own) of every row (id, v)."""
    sent = df.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = rotation(dim), sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                vectors = _matrix(batch.column("v"), dim)
                cell = _closest(vectors, centres)
                with np.errstate(over="ignore", invalid="ignore"):
                    codes, norm, own = encode(vectors, centres[cell], turn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), batch.column("id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(own)],
                    ["cell", "id", "v", "code", "norm", "own"])

    return df.mapInArrow(tidy(run), f"cell int, id long, v {df.schema['v'].dataType.simpleString()}, code binary, norm double, own float")


def _visits(asked: DataFrame, dim: int, centres: np.ndarray, radius: np.ndarray, first: bool) -> DataFrame:
    """(cell, id, v, cut): the cells that each query (id, v, cut) visits, the FIRST nearest ones that have vectors, or all others within its cut."""
    sent = asked.sparkSession.sparkContext.broadcast((centres, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                far = np.where(radius >= 0, np.nan_to_num(_distances(_matrix(batch.column("v"), dim), centres), nan=np.inf, posinf=np.inf), np.inf)
                near = np.zeros(far.shape, bool)
                np.put_along_axis(near, np.argsort(far, 1, kind="stable")[:, :FIRST], True, 1)
                if not first:
                    cut = batch.column("cut").to_numpy()[:, None]
                    with np.errstate(invalid="ignore"):
                        near = ~near & ~(far - radius > cut * (1 + 1e-9))
                row, cell = np.nonzero(near & (radius >= 0))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(batch.column(c).take(take) for c in ("id", "v", "cut"))], ["cell", "id", "v", "cut"])

    return asked.mapInArrow(tidy(run), f"cell int, id long, v {asked.schema['v'].dataType.simpleString()}, cut double")


def _compare(k: int, dim: int, centres: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, cuts: np.ndarray, ids: np.ndarray, rows: np.ndarray,
             codes: np.ndarray, norm: np.ndarray, own: np.ndarray, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vec_id, score) arrays: the k nearest of a block for each query, less what is beyond its cut."""
    turn, signs = rotation(dim), unpacked(codes, dim)
    for a in range(0, len(q_ids), TOGETHER):
        part = slice(a, a + TOGETHER)
        low, high = bounds(signs, norm, own, queries[part], centres[cell], turn)
        self_ = ids[None, :] == q_ids[part, None]
        low[self_], high[self_] = np.inf, np.inf
        limit = cuts[part] ** 2 * (1 + 1e-6)
        if len(ids) >= k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        for i, cut in enumerate(limit):
            at = np.flatnonzero((low[i] <= cut) & ~self_[i])
            if len(at):
                rest = rows[at] - queries[a + i]
                with np.errstate(over="ignore"):
                    scores = np.sqrt((rest * rest).sum(1))
                top = np.lexsort((ids[at], scores))[:k]
                top = top[np.isfinite(scores[top]) & (scores[top] <= cuts[a + i])]
                yield np.full(len(top), q_ids[a + i]), ids[at][top], scores[top]


def search(indexed: DataFrame, visits: DataFrame, dim: int, centres: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest, in each block that they visit, of every query."""
    spark = indexed.sparkSession
    held, asked = (dict(df.groupBy("cell").count().collect()) for df in (indexed, visits))  # CELLS rows each at most
    blocks = lambda n, size: -(-n // max(TOGETHER, size // (8 * dim)))
    table = spark.createDataFrame([(c, blocks(held.get(c, 0), VECTOR_BYTES), blocks(n, QUERY_BYTES)) for c, n in sorted(asked.items()) if c in held], "cell int, blocks int, parts int")
    some = F.broadcast(table)  # as many rows as cells
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nth = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    vectors = indexed.join(some, "cell").withColumn("block", nth("blocks")).withColumn("part", spread("parts")).select(
        "cell", "block", "part", F.lit(False).alias("asked"), "id", "v", "code", "norm", "own", F.lit(None).cast("double").alias("cut"))
    questions = visits.join(some, "cell").withColumn("part", nth("parts")).withColumn("block", spread("blocks")).select(
        "cell", "block", "part", F.lit(True).alias("asked"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("norm"),
        F.lit(None).cast("float").alias("own"), "cut")
    sent = spark.sparkContext.broadcast(centres)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        on = rows["asked"].to_numpy()
        out: list[tuple] = []
        if on.any() and not on.all():
            q, d = (rows.filter(pa.array(x)).combine_chunks() for x in (on, ~on))
            matrix = lambda t: _matrix(t["v"].combine_chunks(), dim)
            codes = np.frombuffer(b"".join(d["code"].to_pylist()), np.uint8).reshape(d.num_rows, -1)
            out = list(_compare(k, dim, sent.value, q["id"].to_numpy(), matrix(q), q["cut"].to_numpy(), d["id"].to_numpy(), matrix(d), codes, d["norm"].to_numpy(), d["own"].to_numpy(), key[0].as_py()))
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    return vectors.unionByName(questions).groupBy("cell", "block", "part").applyInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every query row by Euclidean distance.

    Ties go to the smaller id; scores are sqrt of the sum of squared differences of the original
    components in double precision.  Rows with a null id, or a vector that is null, empty, zero or
    has null or non-finite components, take no part; vectors of unequal length are in separate
    indexes.  A query's own id is no candidate, nor is any other row with it.  Rows repeated with
    one id and vector are one, however often; rows with one id and other vectors are candidates
    each.  Other columns are ignored; an empty table gives an empty result.  The centres are fitted
    to a bounded sample; every row is indexed.  The driver holds the centres and a row for each
    cell; a query's merged candidates are at most k for each block that it visits.
    """
    stages = Stages(spark, "nearest")
    usable_rows = lambda t: t.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).dropDuplicates(["id", "v"])
    good, asked = stages.write(usable_rows(df), "rows"), stages.write(usable_rows(queries), "queries")
    parts = []
    for dim in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):
        rows = good.where(F.size("v") == dim)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CENTRE_SAMPLE, CENTRE_BYTES // (8 * dim)))).select(F.col("v").cast("array<double>")).collect()
        if not sample:
            continue
        centres = centres_of(np.array([r[0] for r in sample]))
        indexed = stages.write(index(rows, dim, centres), f"index-{dim}")
        radius = np.full(len(centres), -1.0)  # of a cell without vectors
        for cell, most in indexed.groupBy("cell").agg(F.max("norm")).collect():
            radius[cell] = np.inf if np.isnan(most) else most * (1 + 1e-9)
        own = asked.where(F.size("v") == dim).withColumn("cut", F.lit(float("inf")))
        begun = stages.write(_ranked(search(indexed, _visits(own, dim, centres, radius, True), dim, centres, k), k).drop("rank"), f"begun-{dim}")
        cuts = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("last")).where(F.col("n") >= k)
        cut = own.drop("cut").join(cuts, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("last", F.lit(float("inf"))).alias("cut"))
        rest = stages.write(_visits(cut, dim, centres, radius, False), f"visits-{dim}")
        parts += [begun, search(indexed, rest, dim, centres, k)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _ranked(reduce(DataFrame.unionByName, parts), k).select("query_id", "rank", "vec_id", "score")


def op8_one_bit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 100; see nearest for all special cases."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(spark, vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op8_one_bit_nearest": op8_one_bit_nearest}
ORACLES = {"op8_one_bit_nearest": """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10"""}
