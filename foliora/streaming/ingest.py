"""Ingestion of files as they arrive in a folder, with exactly-once bookkeeping by the stream's checkpoint.

An extension: files are picked up in small batches, each ingested by the same plan as a single file. No
event time is involved, hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliora.engine import Engine
from foliora.errors import FolioraError


def arrivals(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of the paths, lengths and times of files in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    return s.select("path", "modificationTime", "length")


def ingest_stream(engine: Engine, folder: str, collection_id: str, checkpoint: str) -> StreamingQuery:
    """Import and ingest every file that has arrived, then stop; call again, or on a schedule, for later ones."""

    def batch(df: DataFrame, _: int) -> None:
        # a batch has at most maxFilesPerTrigger rows, and only their paths come here
        for r in df.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).collect():
            file = engine.import_file(r["path"])
            try:
                engine.ingest(file["file_id"], collection_id)
            except FolioraError:
                continue  # indexed before, or recorded as failed

    return arrivals(engine.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
