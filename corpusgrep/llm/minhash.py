"""Near-duplicates by MinHash: universal hash minima, banding, verification, components.

A document is the set of its distinct 5-word shingles.  Equal sets form a
class and take part once.  Classes that share a band are candidates; they are
compared by signature and then on their full sets, and links at a similarity
of 0.75 or more are joined to components.

Buckets can be large, so their pairs are never listed.  First every member is
compared with one pivot of its bucket, which links nearly all of a group of
near copies at once.  Where a bucket still has several components, any pair of
members from different ones could be the one link between them, so all such
pairs are compared: the bucket is cut into blocks of bounded size, and a task
gets two of them.  At first these are wide blocks of signatures alone; only
members that have a partner of similar signature go on, with their texts, in
blocks of bounded bytes, where a task compares sets and returns no more links
than join its members.  Pairs inside a component can't change it and aren't needed.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, fresh, slices, tidy
from corpusgrep.llm.components import components
from corpusgrep.llm.words import LOWER, find_words, hash_ranges, hash_windows, mix, text_bytes

SHINGLE = 5
#: Bands of rows; a pair at similarity 0.75 misses all of them with a chance of 5e-6.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Equal minima that a pair needs to be confirmed: 96 are expected at 0.75, fewer than 70 have a chance of 1e-7.
LEAST_EQUAL = 70
PERCENT = 75
_CHUNK = 2048
#: Members of a block of signatures, of which a task compares two, and bytes of compressed texts that a task compares at most, or twice that.
WIDE, TILE_BYTES = 4096, 4 << 20
#: Bytes of shingle sets that a task keeps.
SETS_BYTES = 64 << 20

_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a null text has none."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = find_words(data, offsets)
    words = hash_ranges(data, starts, ends)
    hashes, at = hash_windows(words, first, SHINGLE)
    cuts = np.searchsorted(at, first)
    out = []
    for i, (a, b, lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if hi > lo:
            out.append(np.unique(hashes[lo:hi]))
        elif b > a:
            total = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    total = mix(np.array([total * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            out.append(np.array([total], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of PERMUTATIONS universal hashes a * x + b modulo 2**32 over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _CHUNK):
        np.minimum(least, (_A * x[None, i:i + _CHUNK] + _B).min(1), out=least)
    return least


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, hash of the text, n_shingles, node, signature) of every row.

    node is a 128-bit fingerprint of the set, null if it is empty.  No shuffle; a task holds about
    4 MB of text, or one longer text.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = shingle_sets(batch.column("t"))
            nodes = [np.array([mix(s).sum(), mix(s ^ np.uint64(0x5BD1E995)).sum()], ">u8").tobytes() if len(s) else None for s in sets]
            marks = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "h", "n_shingles", "node", "signature"])

    return rows.mapInArrow(tidy(run), "doc_id long, h long, n_shingles long, node binary, signature binary")


def _similar_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in ("sa", "sb"))
            on = pa.array((x == y).sum(1) >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(on) for c in ("a", "b")], ["a", "b"])


def _similar_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, kept = zstandard.ZstdDecompressor(), OrderedDict()

    def shingles(node: bytes, packed: bytes) -> np.ndarray:
        if node not in kept:
            kept[node] = shingle_sets(pa.array([unpack.decompress(packed)], pa.binary()))[0]
            if len(kept) > 64:
                kept.popitem(last=False)
        kept.move_to_end(node)
        return kept[node]

    for batch in batches:
        on = []
        for a, b, za, zb in zip(*(batch.column(c) for c in ("a", "b", "za", "zb")), strict=True):
            x, y = shingles(a.as_py(), za.as_py()), shingles(b.as_py(), zb.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            on.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(on, pa.bool_())) for c in ("a", "b")], ["a", "b"])


class _Sets:
    """Shingle sets of a tile's texts, made when they are asked for; the ones not used for longest go when they become too many."""

    def __init__(self, packed: pa.ChunkedArray):
        self.packed, self.unpack = packed, zstandard.ZstdDecompressor()
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.size = 0

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.kept:
            self.kept[i] = shingle_sets(pa.array([self.unpack.decompress(self.packed[i].as_py())], pa.binary()))[0]
            self.size += self.kept[i].nbytes
            while self.size > SETS_BYTES and len(self.kept) > 1:
                self.size -= self.kept.popitem(last=False)[1].nbytes
        self.kept.move_to_end(i)
        return self.kept[i]


class _Tile:
    """Members of two blocks of a bucket, or of one, and which of them could be linked by their signatures."""

    def __init__(self, tile: pa.Table, *blocks: str):
        self.nodes, roots = tile["node"].to_pylist(), tile["root"].to_pylist()
        self.marks = np.frombuffer(b"".join(tile["s"].to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
        self.low = np.ascontiguousarray(self.marks.astype(np.uint8))
        band = tile["band"][0].as_py()
        self.bands = np.ascontiguousarray(self.marks[:, : ROWS * band]).reshape(len(self.nodes), band, ROWS)
        self.counts = tile["n"].to_numpy()
        #: Pairs inside a block are compared where the block meets itself.
        self.blocks = [b for b in (tile[name].to_numpy() for name in blocks) if len(np.unique(b)) > 1]
        ids = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        self.group = np.array([ids[r] for r in roots])

    def partners(self, i: int) -> np.ndarray:
        """Members of other components, and of other blocks, of similar size and signature.  Pairs that share an earlier band are left to that bucket."""
        others = self.group != self.group[i]
        for block in self.blocks:
            others &= block != block[i]
        others &= np.minimum(self.counts, self.counts[i]) * 100 >= PERCENT * np.maximum(self.counts, self.counts[i])
        at = np.flatnonzero(others)
        at = at[(self.low[at] == self.low[i]).sum(1) >= LEAST_EQUAL]  # at least as many bytes are equal as minima
        at = at[(self.marks[at] == self.marks[i]).sum(1) >= LEAST_EQUAL]
        return at[~(self.bands[at] == self.bands[i]).all(2).any(1)] if self.bands.shape[1] and len(at) else at


def _active_of_tile(key: tuple, rows: pa.Table) -> pa.Table:
    """(band, bucket, i, j, wide, node): the members of a tile of signatures that have a partner."""
    tile = _Tile(rows, "wide")
    on = pa.array([i for i in range(len(tile.nodes)) if len(tile.partners(i))], pa.int64())
    same = [pa.array([k.as_py()] * len(on), t) for k, t in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
    return pa.table([*same, rows["wide"].take(on), rows["node"].take(on)], ["band", "bucket", "i", "j", "wide", "node"])


def _links_of_tile(rows: pa.Table) -> pa.Table:
    """Links on full sets between members of different components, as few as join them."""
    tile, sets = _Tile(rows, "wide", "part"), _Sets(rows["z"])
    group, out = tile.group, ([], [])
    for i in np.argsort(np.bincount(group)[group], kind="stable").tolist():  # members of small components first
        for j in tile.partners(i).tolist():
            if group[j] != group[i]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= PERCENT * (tile.counts[i] + tile.counts[j] - both):
                    out[0].append(tile.nodes[i])
                    out[1].append(tile.nodes[j])
                    group[group == group[j]] = group[i]
    return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})


class NearDuplicates:
    """The steps, each on written tables."""

    def __init__(self, spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text"):
        self.stages = Stages(spark, "minhash")
        self.documents = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
        self.rows = self.stages.write(signatures(documents, key, text), "rows")

    def find(self) -> DataFrame:
        """(node, root): the class of least fingerprint of each linked class's component."""
        stages = self.stages
        classes = self.rows.where("node is not null").groupBy("node").agg(
            F.min(F.struct("doc_id", "h")).alias("one"), F.first("n_shingles").alias("n"), F.first("signature").alias("s"))
        classes = stages.write(classes, "classes")
        bands = F.array(*(F.xxhash64(F.lit(i), F.substring("s", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
        members = classes.select("node", F.posexplode(bands).alias("band", "bucket"))
        shared = members.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
        members = stages.write(members.join(shared, ["band", "bucket"]), "members")
        self._gather_texts(members.select("node").distinct(), classes)
        links = self._confirm(members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), classes)
        roots = components(stages, links, "first")
        rest = self._between(members, roots, classes)
        return components(stages, roots.unionByName(rest), "all").select(F.col("a").alias("node"), F.col("b").alias("root"))

    def _gather_texts(self, nodes: DataFrame, classes: DataFrame) -> None:
        """Write one text, compressed, of each class that shares a band."""
        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(3)
            for batch in slices(batches, "t"):
                packed = [pack.compress(x.as_buffer()) if x.is_valid else None for x in batch.column("t").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(packed, pa.binary())], ["doc_id", "h", "z"])

        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("one.doc_id").alias("k"), F.col("one.h").alias("g"))
        packed = self.documents.withColumn("h", F.xxhash64("t")).mapInArrow(tidy(squeeze), "doc_id long, h long, z binary")
        found = packed.join(wanted, packed["doc_id"].eqNullSafe(wanted["k"]) & (packed["h"] == wanted["g"]))
        self.texts = self.stages.write(found.dropDuplicates(["node"]).select("node", "z"), "texts")

    def _between(self, members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
        """Links between the components that still share a bucket."""
        placed = members.join(roots.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").select(
            "band", "bucket", "node", "size", F.coalesce("root", "node").alias("root"))
        split = placed.groupBy("band", "bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("band", "bucket")
        open_ = self.stages.write(placed.join(split, ["band", "bucket"]), "open")
        marks = classes.select("node", "n", "s")
        wide, key = F.ceil(F.col("size") / WIDE).cast("int"), ["band", "bucket", "i", "j"]
        # A block meets every other block, and itself: tile (i, i) compares inside the block.
        self.tiles = open_.withColumn("wide", F.pmod(F.xxhash64("node"), wide).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), wide - 1))).select(
            "band", "bucket", F.least("wide", "other").alias("i"), F.greatest("wide", "other").alias("j"), "wide", "node", "root")
        active = self.tiles.join(marks, "node").groupBy(*key).applyInArrow(_active_of_tile, "band int, bucket long, i int, j int, wide int, node binary")
        active = self.stages.write(active.join(self.texts.select("node", F.octet_length("z").alias("bytes")), "node"), "active")
        # The same by bytes, for the members that are left.
        parts = active.groupBy(*key).agg(F.ceil(F.sum("bytes") / TILE_BYTES).cast("int").alias("parts"))
        placed = active.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            *key, F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "wide", "part", "node")
        full = placed.join(open_.select("node", "root").distinct(), "node").join(marks, "node").join(self.texts, "node")
        return full.groupBy(*key, "a", "b").applyInArrow(_links_of_tile, "a binary, b binary")

    def _confirm(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        marks = classes.select("node", "n", "s")
        joined = pairs.join(marks.withColumnsRenamed({"node": "a", "n": "na", "s": "sa"}), "a").join(
            marks.withColumnsRenamed({"node": "b", "n": "nb", "s": "sb"}), "b")
        near = joined.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b", "sa", "sb").mapInArrow(
            tidy(_similar_signatures), "a binary, b binary")
        texts = near.join(self.texts.withColumnsRenamed({"node": "a", "z": "za"}), "a").join(
            self.texts.withColumnsRenamed({"node": "b", "z": "zb"}), "b").select("a", "b", "za", "zb")
        return texts.mapInArrow(tidy(_similar_sets), "a binary, b binary")


def _decide(work: NearDuplicates) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, kept) of every row."""
    roots = work.find()
    least = work.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    placed = work.stages.write(least.select("node", "least", F.coalesce("root", "node").alias("root")), "placed")
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(of_root, "root").select("node", "component_id")
    out = work.rows.select("doc_id", "h", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    component_id is the least id of the component; one document of it, the one with that id, is
    kept.  A text without words, or null, is linked with nothing.  A null id counts as greater
    than all others: such a row is kept if its component has no id.  Rows with one id and one text
    are one document; an empty table gives an empty result.
    """
    return _decide(NearDuplicates(spark, documents, key, text)).drop("h")


def keep_one(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without the rows that near_duplicates doesn't keep, and one of the rows that share id and text."""
    d, g, h = fresh(documents, "__d", "__g", "__h")
    work = NearDuplicates(spark, documents, key, text)
    decided = work.stages.write(_decide(work).select("doc_id", "h", "kept"), "decided")
    gone = decided.where("not kept").select(F.col("doc_id").alias(d), F.col("h").alias(g)).distinct()
    same = lambda other: F.col(key).cast("long").eqNullSafe(other[d]) & (F.col(h) == other[g])
    kept = documents.withColumn(h, F.xxhash64(text)).join(gone, same(gone), "left_anti")
    again = decided.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(d), F.col("h").alias(g))
    if again.isEmpty():
        return kept.drop(h)
    one = kept.join(again, same(again), "left_semi").dropDuplicates([key, h])
    return kept.join(again, same(again), "left_anti").unionByName(one).drop(h)


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document; see near_duplicates for all special cases."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_minhash_near_duplicates": op3_minhash_near_duplicates}
ORACLES = {"op3_minhash_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(l[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n, bit_xor(g) AS x, sum(hash(g) % 1000000007) AS y FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, x, y) AS c FROM f),
r AS (SELECT s.doc_id, g FROM s JOIN c ON c.doc_id = s.doc_id AND c.c = c.doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_of FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_of >= 75 * (na.n + nb.n - both_of)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
t AS (SELECT c AS a, c AS b FROM c WHERE c = doc_id UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b),
m AS (SELECT a, min(b) AS m FROM t GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.a = c.c"""}
