"""The same search over a stream of files: stateless, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from corpusgrep.operators.match import grep
from corpusgrep.plans.spec import SearchSpec


def grep_stream(files: DataFrame, spec: SearchSpec, content: str = "content") -> DataFrame:
    """Matches of a streaming table of files, as grep() gives them for a batch."""
    if not files.isStreaming:
        raise ValueError("not a stream")
    return grep(files, spec, content)


def write_matches(matches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append matches as Parquet, each input row's exactly once, and stop when all there is has been read."""
    return matches.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
