"""Binary token files: one id array with Elias-Fano document boundaries.

A file holds segments; a segment is

    magic "EFT1", id width (2 or 4), null ids, documents, tokens, smallest id,
    sizes of the two Elias-Fano parts and of the id array   (header, little-endian)
    Elias-Fano of the document ids (less the smallest), of the boundaries (documents + 1 values)
    ids, little-endian
    one line feed (the writer's record end)

Files are named by their place in ascending id order; ids that are null come
first.  Files are written and read by Spark's own sources, so they lie in any
store that Spark reaches and a task that is lost is run again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgrep.llm.common import Stages, partitions_for, settings, small_batches, tidy
from corpusgrep.llm.elias_fano import EliasFano
from corpusgrep.llm.encoders import cached_encoder, lower_words

_HEAD = struct.Struct("<4sBQQQqQQQ")
MAGIC = b"EFT1"
#: Tokens after which a segment ends, so that memory doesn't follow the file's size.
SEGMENT_TOKENS = 1 << 20
#: MB of stored text, by the optimizer's estimate, for a task, as far as there can be that many tasks.
TASK_MB = 6
#: Segments of a file; a reader holds a file's ids at once.
FILE_SEGMENTS = 8


def pack_segment(doc_ids: list, lengths: list[int], ids: bytes, width: int) -> bytes:
    """doc_ids ascending, nulls first; ids as little-endian unsigned 32-bit integers."""
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    keys = EliasFano.of([x - least for x in known]).tobytes()
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])).tobytes()
    body = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
    return _HEAD.pack(MAGIC, width, len(doc_ids) - len(known), len(doc_ids), sum(lengths), least,
                      len(keys), len(ends), len(body)) + keys + ends + body


class Segment:
    """A segment read in place: select finds a document's ids without a table of offsets."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.width, self.nulls, self.docs, self.tokens, self.least, a, b, c = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += _HEAD.size
        self._keys, self._ends, self._ids = data[at:at + a], data[at + a:at + a + b], data[at + a + b:at + a + b + c]
        self.ends = EliasFano.frombytes(self._ends)
        self.end = at + a + b + c + 1

    def doc_ids(self) -> list:
        return [None] * self.nulls + (EliasFano.frombytes(self._keys).decode() + self.least).tolist()

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        a, b = self.ends.select(i), self.ends.select(i + 1)
        return np.frombuffer(self._ids, f"<u{self.width}", b - a, a * self.width)


def segments(content: bytes) -> Iterator[Segment]:
    data, at = memoryview(content), 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at = segment.end


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text and write the files in ascending key order.

    A null text is empty and gets the end id alone; null keys come first; equal keys are ordered by
    a hash of the text.  The rows are range-partitioned by key and that hash, so no key's rows need
    to fit one task, and a segment is the most that a task holds.  An empty table writes no segment.
    """
    small_batches(df.sparkSession)
    width = 2 if max(end_id, _largest_id(tokenizer)) < 1 << 16 else 4
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(partitions_for(rows, TASK_MB), "k", "h").sortWithinPartitions("k", "h")
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoder(tokenizer, lower_words)
        keys, lengths, parts, tokens = [], [], [], 0

        def segment():
            return pa.RecordBatch.from_arrays([pa.array([pack_segment(keys, lengths, b"".join(parts), width)], pa.binary())], ["b"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py()) + end
                keys.append(k)
                lengths.append(len(ids) >> 2)
                parts.append(ids)
                tokens += len(ids) >> 2
                if tokens >= SEGMENT_TOKENS:
                    yield segment()
                    keys, lengths, parts, tokens = [], [], [], 0
        if keys:
            yield segment()

    with settings(df.sparkSession):
        rows.select("k", "t").mapInArrow(tidy(pack, True), "b binary").select(F.col("b").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _largest_id(tokenizer: str) -> int:
    from corpusgrep.llm.encoders import load

    return load(tokenizer).get_vocab_size() - 1


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: file, segment, place in the segment, doc_id, start in the segment, ids.

    ids are little-endian unsigned 32-bit integers.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(path).select(
        F.substring_index("path", "/", -1).alias("file"), "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for s, segment in enumerate(segments(content.as_buffer())):
                    doc_ids, starts = segment.doc_ids(), [segment.ends.select(i) for i in range(segment.docs + 1)]
                    for a in range(0, segment.docs, 2000):
                        b = min(segment.docs, a + 2000)
                        ids = [segment.ids(i).astype("<u4").tobytes() for i in range(a, b)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([file] * (b - a)), pa.array([s] * (b - a), pa.int32()), pa.array(range(a, b), pa.int64()),
                            pa.array(doc_ids[a:b], pa.int64()), pa.array(starts[a:b], pa.int64()), pa.array(ids, pa.binary()),
                        ], ["file", "segment", "place", "doc_id", "local_start", "ids"])

    return files.mapInArrow(tidy(unpack), "file string, segment int, place long, doc_id long, local_start long, ids binary")


def with_starts(documents: DataFrame) -> DataFrame:
    """Documents of read_tokens, a written table, with ``start``: the ids of all documents before each.

    The files aren't read again for it: a segment's size is told by its last document.  Segments are
    numbered in two steps, inside a file and over files, so the only single task sees one row for each file.
    """
    segments = documents.groupBy("file", "segment").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("tokens"))
    before = lambda *by: F.coalesce(F.sum("tokens").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order: list = ["segment"]
    inside = segments.withColumn("inside", before("file"))
    # Names tell the task and the file's number in it.
    order = [F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"c(\d+)\.[^-]*$", 1).cast("long"), F.col("file")]
    files = segments.groupBy("file").agg(F.sum("tokens").alias("tokens")).select("file", before().alias("outside"))
    bases = inside.join(files, "file").select("file", "segment", (F.col("inside") + F.col("outside")).alias("base"))
    return documents.join(bases, ["file", "segment"]).withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def op1_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and describe each from what is read back; see write_tokens for all special cases."""
    stages = Stages(spark, "tokens")
    path = stages.path("files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = stages.write(read_tokens(spark, path).select(
        "file", "segment", "doc_id", "local_start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "documents")
    return with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_elias_fano_tokens": op1_elias_fano_tokens}
ORACLES: dict[str, str] = {}
