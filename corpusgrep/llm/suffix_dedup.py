"""Removal of long repeated strings, with suffix arrays dealt out by minimizer.

Equal strings of WIDTH bytes have equal minimizers (the least hash of their
GRAM-byte substrings), so the suffixes that could match are those of runs of
string starts with one minimizer.  Runs whose minimizer occurs once in the
corpus are dropped by their hashes alone; runs with equal content are counted
and only one of them goes on; what is left, pieces of a few hundred bytes, is
dealt out by minimizer, and each task indexes its pieces in a logarithmic
family of suffix arrays.  Pieces of a minimizer that has too many for one task
are dealt out in blocks of bounded size, each with a family of its own; the
distinct strings of the blocks' arrays are merged by their hashes, and those
that several blocks have are marked in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, slices, tidy
from corpusgrep.llm.suffix_family import SuffixFamily
from corpusgrep.llm.words import BASES, INVERSES, hash_ranges, mix, powers, text_bytes

WIDTH = 200
GRAM = 32
#: GRAM-byte substrings in a string.
SPAN = WIDTH - GRAM + 1
#: Starts of the longest run; longer ones are cut, which costs nothing but a comparison.
LONGEST = 1 << 14
#: Starts that are looked at together; a longer text is looked at in blocks.
BLOCK = 2 << 20
#: Pieces that a task indexes, starts of a batch, and bytes of one minimizer's pieces that a task may get, or a block beyond that.
PIECES = 8_000
BATCH = 1 << 17
MANY = 1 << 20


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    out, step = np.empty(max(0, len(data) - GRAM + 1), np.uint64), 1 << 20
    for i in range(0, len(out), step):
        n = min(step, len(out) - i)
        part = data[i:i + n + GRAM - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(BASES[0], len(part))[: len(part)], out=sums[1:])
        out[i:i + n] = mix((sums[GRAM:] - sums[:-GRAM]) * powers(INVERSES[0], n)[:n])
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of width values."""
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, x[-1])]).reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: len(x) - width + 1], ahead[width - 1:len(x)])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, starts, minimizer, content hash, own) of each run of string starts with one minimizer.

    Strings don't run over the texts' ends.  own says that the minimizer may occur twice in the
    run, so that the run may repeat itself.
    """
    found = []
    step = BLOCK if len(data) > 2 * BLOCK else max(1, len(data))
    for low in range(0, max(1, len(data) - WIDTH + 1), step):
        part = data[low:min(len(data), low + step + WIDTH - 1)]
        if len(part) < WIDTH:
            break
        hashes = _gram_hashes(part)
        least = _sliding(hashes, SPAN, np.minimum)
        at = np.arange(len(least)) + low
        text = np.searchsorted(offsets, at, "right") - 1
        real = at + WIDTH <= offsets[text + 1]
        begins = np.ones(len(least), bool)
        begins[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~real[:-1]
        starts = np.flatnonzero(begins & real)
        if not len(starts):
            continue
        stops = np.flatnonzero(real & np.append(begins[1:] | ~real[1:], True)) + 1
        counts = -(-(stops - starts) // LONGEST)
        long = stops - starts > SPAN
        value, which = least[starts], np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts[which] + nth * LONGEST
        end = np.minimum(begin + LONGEST, stops[which])
        # Places that are the least of some string, and values that are so twice within a string's reach.
        edge = np.full(SPAN - 1, 0, np.uint64)
        top = _sliding(np.concatenate([edge, np.where(real, least, np.uint64(0)), edge]), SPAN, np.maximum)
        places = np.flatnonzero(hashes == top)
        order = np.lexsort((places, hashes[places]))
        places = places[order]
        near = (hashes[places[1:]] == hashes[places[:-1]]) & (places[1:] - places[:-1] < SPAN)
        own = long | np.isin(value, hashes[places[1:][near]])
        found.append((text[begin], begin + low - offsets[text[begin]], end - begin, value[which],
                      hash_ranges(part, begin, end + WIDTH - 1, 1), own[which]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "t", BLOCK):
        data, offsets = text_bytes(batch.column("t"))
        text, start, count, value, content, own = runs(data, offsets)
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("k").take(take), pa.array(value.view(np.int64)), pa.array(content.view(np.int64)),
             pa.array(start, pa.int64()), pa.array(count, pa.int32()), pa.array(own)],
            ["doc_id", "k", "v", "h", "start", "n", "own"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for z, parts in zip(batch.column("z"), batch.column("parts").to_pylist(), strict=True):
            text = unpack.decompress(z.as_buffer())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[c] for p in parts], pa.int64()) for c in ("v", "h")]
                + [pa.array([text[p["start"]:p["start"] + p["n"] + WIDTH - 1] for p in parts], pa.binary())], ["v", "h", "piece"])


def _spans(marks: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0)).tolist()


def _indexed(pieces: Iterator[bytes]) -> tuple[SuffixFamily, list[int]]:
    """A family of all pieces, and where each stands in its text."""
    family, places, waiting, size = SuffixFamily(WIDTH), [], [], 0
    for piece in pieces:
        waiting.append(piece)
        size += len(piece) - WIDTH + 1
        if size >= BATCH:
            places += family.add(waiting)
            waiting, size = [], 0
    return family, places + family.add(waiting)


def _marked(found: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int32()))], ["v", "h", "spans"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []

    def pieces() -> Iterator[bytes]:
        for batch in batches:
            for v, h, piece in zip(*(batch.column(c).to_pylist() for c in ("v", "h", "piece")), strict=True):
                rows.append((v, h, len(piece) - WIDTH + 1))
                yield piece

    family, places = _indexed(pieces())
    found = [(v, h, spans) for (v, h, n), at in zip(rows, places, strict=True) if (spans := _spans(family.repeated[at:at + n]))]
    for i in range(0, len(found), 10_000):
        yield _marked(found[i:i + 10_000])


def _hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the strings at ascending starts."""
    x, y = (hash_ranges(data, starts, starts + WIDTH, base).view(np.int64) for base in (0, 1))
    return x, y


def _strings_of_block(key: tuple, rows: pa.Table) -> pa.Table:
    """(v, block, x, y, twice): the strings in the arrays of a block's family, by hash, and whether the block has them twice."""
    family, _ = _indexed(rows["piece"].to_pylist())
    starts = np.sort(np.concatenate([np.zeros(0, np.int64), *(level for _, level in family.levels)]))
    x, y = _hashes(family.text, starts)
    same = [pa.array([k.as_py()] * len(starts), t) for k, t in zip(key, (pa.int64(), pa.int32()), strict=True)]
    return pa.table([*same, pa.array(x), pa.array(y), pa.array(family.repeated[starts])], ["v", "block", "x", "y", "twice"])


def _mark_block(pieces: pa.Table, strings: pa.Table) -> pa.Table:
    """Starts in a block's pieces of the strings with these hashes."""
    x, y = strings["x"].to_numpy(), strings["y"].to_numpy()
    order = np.argsort(x, kind="stable")
    x, y, found = x[order], y[order], []
    for v, h, piece in zip(*(pieces[c].to_pylist() for c in ("v", "h", "piece")), strict=True) if len(x) else ():
        a, b = _hashes(np.frombuffer(piece, np.uint8), np.arange(len(piece) - WIDTH + 1))
        at = np.minimum(np.searchsorted(x, a), len(x) - 1)
        if spans := _spans((x[at] == a) & (y[at] == b)):
            found.append((v, h, spans))
    return pa.Table.from_batches([_marked(found)])


def _squeeze(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in slices(batches, text):
            packed = [pack.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(packed, pa.binary())], [*keep, "z"])
    return run


class RepeatedStrings:
    """The steps, each on written tables; a row's key is its doc_id and a hash of doc_id and text."""

    def __init__(self, spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text"):
        self.stages = Stages(spark, "suffix")
        self.rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(key, text).alias("k"), F.col(text).alias("t"))

    def find(self) -> DataFrame:
        """(doc_id, k, starts): starts are (start, ends and starts of repeated strings from there), a list for each row."""
        stages = self.stages
        all_runs = stages.write(self.rows.mapInArrow(tidy(_find_runs), "doc_id long, k long, v long, h long, start long, n int, own boolean"), "runs")
        again = all_runs.groupBy("v").agg(F.count("*").alias("c"), F.min("h").alias("x"), F.max("h").alias("y"), F.max("own").alias("o")).where(
            "c > 1 or o").select("v", (F.col("x") != F.col("y")).alias("mixed"))
        some = stages.write(all_runs.join(again, "v"), "some")
        stages.drop("runs")
        contents = some.groupBy("v", "h").agg(
            F.count("*").alias("c"), F.min(F.struct("doc_id", "k", "start")).alias("one"), F.first("n").alias("n"), F.max("own").alias("own"), F.first("mixed").alias("mixed"))
        contents = stages.write(contents, "contents")
        pieces = self._pieces(contents.where("mixed or (own and c = 1)"))
        matched = self._matched(pieces)
        whole = contents.where("c > 1").select("v", "h", F.array(F.lit(0), F.col("n")).alias("spans"))
        once = matched.join(contents.where("c = 1").select("v", "h"), ["v", "h"], "left_semi")
        placed = some.select("doc_id", "k", "v", "h", "start").join(whole.unionByName(once), ["v", "h"])
        spans = placed.select("doc_id", "k", "start", "spans").distinct()
        return spans.groupBy("doc_id", "k").agg(F.collect_list(F.struct("start", "spans")).alias("starts"))

    def _pieces(self, wanted: DataFrame) -> DataFrame:
        """The bytes of one run of each content."""
        parts = wanted.groupBy(F.col("one.doc_id").alias("d"), F.col("one.k").alias("k2")).agg(
            F.collect_list(F.struct("v", "h", F.col("one.start").alias("start"), "n")).alias("parts"))
        packed = self.rows.mapInArrow(tidy(_squeeze("t", ["doc_id", "k"])), "doc_id long, k long, z binary")
        cut = packed.join(parts, packed["doc_id"].eqNullSafe(parts["d"]) & (packed["k"] == parts["k2"])).select("z", "parts")
        return self.stages.write(cut.mapInArrow(tidy(_cut), "v long, h long, piece binary").dropDuplicates(["v", "h"]), "pieces")

    def _matched(self, pieces: DataFrame) -> DataFrame:
        """(v, h, spans): starts in each piece, one of a content, whose strings are found again in a piece."""
        size = F.sum(F.octet_length("piece"))
        many = self.stages.write(pieces.groupBy("v").agg(size.alias("size")).where(F.col("size") > MANY), "many")
        tasks = max(1, -(-pieces.count() // PIECES))
        if many.isEmpty():  # what is returned is read once, so it isn't written
            return pieces.repartition(tasks, "v").mapInArrow(tidy(_match), "v long, h long, spans array<int>")
        few = pieces.join(many, "v", "left_anti").repartition(tasks, "v").mapInArrow(tidy(_match), "v long, h long, spans array<int>")
        hot = pieces.join(many, "v").withColumn("block", F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / MANY)).cast("int")).select("v", "block", "h", "piece")
        strings = self.stages.write(hot.groupBy("v", "block").applyInArrow(_strings_of_block, "v long, block int, x long, y long, twice boolean"), "strings")
        again = strings.groupBy("v", "x", "y").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 or t").select("v", "x", "y")
        marks = strings.select("v", "block", "x", "y").join(again, ["v", "x", "y"], "left_semi")
        return few.unionByName(hot.groupBy("v", "block").cogroup(marks.groupBy("v", "block")).applyInArrow(_mark_block, "v long, h long, spans array<int>"))


def without_repeats(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the text, with ``__kept`` (binary), ``__n_bytes``, ``__n_removed`` and ``__n_spans`` (longs).

    Every byte of the UTF-8 text that a WIDTH-byte string covers which also starts elsewhere in the
    table is removed, its first place included; strings don't cross texts, and all are judged on
    the input.  A null text has no bytes.  Rows are copies of one another even if id and text are
    both the same.  Cutting can split a character; what is kept is therefore binary.  Two shuffles
    of the compressed texts; all else that is shuffled is hashes and the pieces with candidates.
    """
    keep = [c for c in df.columns if c != text]
    spans = RepeatedStrings(spark, df, key, text).find()
    names = [f"__c{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(key).cast("long").alias("__d"),
                     F.xxhash64(key, text).alias("__k"), F.col(text).alias("__t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    packed = rows.mapInArrow(tidy(_squeeze("__t", [*names, "__d", "__k"])), f"{kinds}, z binary")
    joined = packed.join(spans, packed["__d"].eqNullSafe(spans["doc_id"]) & (packed["__k"] == spans["k"]), "left").select(*names, "z", "starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, "z", 1 << 20):
            out: tuple[list, ...] = ([], [], [], [])
            for z, starts in zip(batch.column("z"), batch.column("starts").to_pylist(), strict=True):
                data = np.frombuffer(unpack.decompress(z.as_buffer()), np.uint8)
                edges = np.zeros(len(data) + 1, np.int32)
                for one in starts or ():
                    bounds = np.array(one["spans"]) + one["start"]
                    np.add.at(edges, bounds[::2], 1)
                    np.add.at(edges, bounds[1::2] + WIDTH - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                for column, value in zip(out, (data[~gone].tobytes(), len(data), int(gone.sum()), len(_spans(gone)) // 2), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])],
                [*names, "__kept", "__n_bytes", "__n_removed", "__n_spans"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    done = joined.mapInArrow(tidy(remove), ", ".join(filter(None, [kinds, "__kept binary, __n_bytes long, __n_removed long, __n_spans long"])))
    return done.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "__kept", "__n_bytes", "__n_removed", "__n_spans")


def whole_characters(kept: Column) -> Column:
    """Text of UTF-8 bytes from which strings were cut: bytes that are no whole character any more are left out.

    The bytes are read as Latin-1, where whole characters are runs that a pattern finds.
    """
    view = F.decode(kept, "ISO-8859-1")
    whole = ("([\\x00-\\x7F]+|[\\xC2-\\xDF][\\x80-\\xBF]|\\xE0[\\xA0-\\xBF][\\x80-\\xBF]|\\xED[\\x80-\\x9F][\\x80-\\xBF]"
             "|[\\xE1-\\xEC\\xEE\\xEF][\\x80-\\xBF]{2}|\\xF0[\\x90-\\xBF][\\x80-\\xBF]{2}|[\\xF1-\\xF3][\\x80-\\xBF]{3}|\\xF4[\\x80-\\x8F][\\x80-\\xBF]{2})|[\\x80-\\xFF]")
    cleaned = F.encode(F.regexp_replace(view, whole, "$1"), "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(kept.cast("string")), kept.cast("string")).otherwise(cleaned)


def op2_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document; see without_repeats for all special cases."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(spark, documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_array_family": op2_suffix_array_family}
ORACLES = {"op2_suffix_array_family": """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM p),
t AS (SELECT r, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS first FROM t),
m AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS span FROM n),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY r, span),
g AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT g.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM g JOIN d ON d.r = g.r GROUP BY g.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r"""}
