"""Incremental ingest as a stream: new source files of a folder are parsed and put into the store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.text import skipped_path
from siltstone.session import CodeEngine
from siltstone.sources.files import decoded, supported

_FILES = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """path, text of the source files that appear below root."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return raw.where(supported(path) & ~skipped_path(path, root)).select(path.alias("path"), decoded(F.col("content")).alias("text"))


def start(engine: CodeEngine, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts are keyed, so a batch that is repeated after a failure changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        engine.resolve_changed(engine.add_chunks(engine.parsed(batch)))

    writer = source_stream(engine.spark, root).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def error_rates(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by kind in tumbling windows, with late rows accepted for a while (a streaming or a plain DataFrame with ts)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n")
