"""Incremental embedding: a stream of files into the vector cache.

Every micro-batch is chunked and embedded where the cache has no vector yet.
The cache is keyed by content, so that a batch that runs twice, after a failure,
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions import text
from kindred.operators.embed import Embedder, VectorCache, embed_cached
from kindred.sources.chunkers import chunk_files


def file_stream(spark: SparkSession, folder: str, schema: str = "file_path string, language string, content string") -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def embed_stream(files: DataFrame, cache: VectorCache, checkpoint: str, min_lines: int = 5, max_lines: int = 100, backend: Embedder | None = None, once: bool = True) -> StreamingQuery:
    """Starts a query that keeps ``cache`` up to date with ``files`` (file_path, language, content)."""

    def batch(rows: DataFrame, _: int) -> None:
        chunks = chunk_files(rows, min_lines, max_lines, None)
        texts = chunks.select("file_path", text.embedding_text(F.col("language"), F.col("chunk_type"), F.col("name"), F.col("content")).alias("embed_text"))
        embed_cached(texts, cache, "embed_text", backend)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
