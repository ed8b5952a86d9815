"""Streaming ingest: files that arrive become documents, blocks and chunks; repeated documents are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS
from ..operators.chunks import chunk_texts
from ..sources.converters import Context
from ..sources.registry import convert_files, file_info

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Files as they arrive: path, modificationTime, length, content and info."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.withColumn("info", file_info(F.col("path")))


def stream_documents(files: DataFrame, context: Context = Context(), keep: str = "1 day") -> DataFrame:
    """doc_id (by content), path, markdown, title, error and modificationTime; a content seen within `keep` is dropped before it is converted."""
    known = files.withColumn("doc_id", F.sha2("content", 256)).withWatermark("modificationTime", keep).dropDuplicatesWithinWatermark(["doc_id"])
    return convert_files(known, context).select("doc_id", "path", "modificationTime", "markdown", "title", "error")


def stream_chunks(documents: DataFrame, size: int = DEFAULTS.chunk_size_tokens, overlap: int = DEFAULTS.chunk_overlap_tokens) -> DataFrame:
    """Chunks of streamed documents; row by row, so there is no state."""
    return chunk_texts(documents.filter(F.col("error").isNull()).select("doc_id", F.col("markdown").alias("text")), size, overlap)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to Parquet; available_now takes what is there and ends."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_windows(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window start and end, event_type, n and value: counts and sums by event time; events later than `late` don't count."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return windowed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")
