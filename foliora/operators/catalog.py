"""The catalog of files, collections, registry entries and jobs, as tables of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions.lineage import cut

ACTIVE, DELETED = "active", "deleted"
INDEXING, INDEXED, FAILED, DE_INGESTED = "indexing", "indexed", "failed", "de_ingested"
QUEUED, RUNNING, SUCCEEDED = "queued", "running", "succeeded"
INTERRUPTED = "Interrupted by a restart before it ended."


def latest(df: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The latest row of each key; rows alike but for other columns are settled by ``ties``.

    An aggregate rather than a sort of each key, so that a key with very many rows is reduced before the exchange."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(at), *(F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ties)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(df.columns)


def file_states(files: DataFrame) -> DataFrame:
    """The current row of each file."""
    return latest(files, ["file_id"], "created_at", "status", "original_name")


def registry_states(log: DataFrame) -> DataFrame:
    """The current state of each file in each collection, from a log that may be late, out of order and repeated."""
    return latest(log, ["file_id", "collection_id"], "recorded_at", "index_status", "indexed_chunk_count", "last_error")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``stored`` with other keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(stored.columns))


def transition(status: Column, action: str) -> Column:
    """State after an action, null where it isn't allowed."""
    if action == "ingest":
        return F.when(F.coalesce(status, F.lit("")) != INDEXED, F.lit(INDEXING))
    if action == "complete":
        return F.when(status == INDEXING, F.lit(INDEXED))
    if action == "fail":
        return F.when(status == INDEXING, F.lit(FAILED))
    if action == "de_ingest":
        return F.when(status == INDEXED, F.lit(DE_INGESTED))
    raise ValueError(action)


def deletable(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Active files that no collection has indexed."""
    return file_states(files).where(F.col("status") == ACTIVE).join(registry_states(registry).where(F.col("index_status") == INDEXED).select("file_id").distinct(), "file_id", "left_anti")


def without_files(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """Chunks left when files are taken from collections; ``removed`` has file_id and collection_id. Chunks without file stay."""
    return chunks.join(removed.select("file_id", "collection_id").distinct(), ["file_id", "collection_id"], "left_anti")


def content_id(text: Column) -> Column:
    """Id of a file by its content."""
    return F.concat(F.lit("sha256_"), F.sha2(F.encode(text, "UTF-8"), 256))


def import_files(documents: DataFrame, text: str = "text", name: str = "file_name", at: str = "loaded_at") -> DataFrame:
    """One row for each distinct content: id, name and time of its first import, size, and how often it came.

    Contents are hashed where they are read; only the narrow columns are exchanged."""
    d = documents.where(F.col(text).isNotNull()).select(content_id(F.col(text)).alias("file_id"), F.col(name).alias("original_name"), F.col(at).alias("created_at"), F.octet_length(F.encode(F.col(text), "UTF-8")).cast("bigint").alias("size_bytes"))
    first = F.struct("created_at", "original_name")
    return d.groupBy("file_id").agg(F.min(first).alias("f"), F.max("size_bytes").alias("size_bytes"), F.count("*").alias("imports")).select("file_id", "f.original_name", "size_bytes", "imports", "f.created_at")


def job_of(log: DataFrame) -> DataFrame:
    """A job for each ingestion in the registry's log: its state follows from that of the entry."""
    s = registry_states(log)
    status = F.when(F.col("index_status") == INDEXING, RUNNING).when(F.col("index_status") == FAILED, FAILED).otherwise(SUCCEEDED)
    return s.select(F.concat(F.lit("job_"), F.substring(F.sha2(F.concat_ws("|", "file_id", "collection_id"), 256), 1, 12)).alias("job_id"), "file_id", "collection_id", status.alias("status"), "last_error", "recorded_at")


def interrupt(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those queued or running have failed."""
    open_ = F.col("status").isin(QUEUED, RUNNING)
    return jobs.withColumn("last_error", F.when(open_, F.lit(INTERRUPTED)).otherwise(F.col("last_error"))).withColumn("status", F.when(open_, F.lit(FAILED)).otherwise(F.col("status")))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their place in a listing: ranges of the order are numbered apart and shifted by the sizes of those before."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    # a row for each range
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_m", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order))).join(before, "_p")
    return placed.withColumn("place", (F.col("_r") + F.col("_m")).cast("int")).drop("_p", "_r", "_m")
