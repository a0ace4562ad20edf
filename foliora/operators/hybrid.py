"""Hybrid search: fusion of vector and keyword candidates, and consistency of the two indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.errors import IndexConsistencyError

VECTOR_WEIGHT, MULTIPLIER = 0.65, 4


def candidate_k(top_k: int) -> int:
    """Candidates each branch fetches."""
    return max(top_k, top_k * MULTIPLIER)


def hybrid_score(vector: Column, keyword: Column, weight: float = VECTOR_WEIGHT) -> Column:
    """Weighted sum; a side that missed an item gives it 0."""
    return weight * F.coalesce(vector, F.lit(0.0)) + (1.0 - weight) * F.coalesce(keyword, F.lit(0.0))


def fuse(vector: DataFrame, keyword: DataFrame, weight: float = VECTOR_WEIGHT) -> DataFrame:
    """Candidates of both branches by (query_id, id), with ranks and the fused score and place.

    ``vector`` has query_id, id, vector_score, raw_distance and vector_rank; ``keyword`` query_id, id,
    keyword_score, raw_bm25 and keyword_rank. Equal scores keep the order of the vector branch, then of
    the keyword branch, then of the id."""
    both = vector.join(keyword, ["query_id", "id"], "full_outer").withColumn("hybrid_score", hybrid_score(F.col("vector_score"), F.col("keyword_score"), weight))
    order = W.partitionBy("query_id").orderBy(F.round("hybrid_score", 9).desc(), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last(), "id")
    return both.withColumn("hybrid_rank", F.row_number().over(order))


def branches(results: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The vector and the keyword candidates in a table of logged results, each ranked within its query."""
    one = results.select("query_id", "id", "raw_distance", "vector_score", "raw_bm25", "keyword_score").dropDuplicates(["query_id", "id"])
    v = one.where("raw_distance is not null").withColumn("vector_rank", F.row_number().over(W.partitionBy("query_id").orderBy("raw_distance", "id")))
    k = one.where("raw_bm25 is not null").withColumn("keyword_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("keyword_score").desc_nulls_last(), "raw_bm25", "id")))
    if limit is not None:
        v, k = v.where(F.col("vector_rank") <= limit), k.where(F.col("keyword_rank") <= limit)
    return v.select("query_id", "id", "vector_score", "raw_distance", "vector_rank"), k.select("query_id", "id", "keyword_score", "raw_bm25", "keyword_rank")


def compare_indexes(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """For each collection the chunks in each index, the sources only one of them has, and whether they agree.

    Both need collection_id, source and chunk_id; each side is reduced to sources and counts before they meet."""

    def per_source(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("collection_id", "source").agg(F.countDistinct("chunk_id").alias(name))

    both = per_source(keyword, "k").join(per_source(vector, "v"), ["collection_id", "source"], "full_outer")
    out = both.groupBy("collection_id").agg(
        F.sum(F.coalesce("k", F.lit(0))).alias("keyword_chunks"), F.sum(F.coalesce("v", F.lit(0))).alias("vector_chunks"),
        F.sum(F.col("v").isNull().cast("bigint")).alias("missing_in_vector"), F.sum(F.col("k").isNull().cast("bigint")).alias("missing_in_keyword"),
    )
    return out.withColumn("consistent", (F.col("missing_in_vector") == 0) & (F.col("missing_in_keyword") == 0) & (F.col("keyword_chunks") == F.col("vector_chunks")))


def check_indexes(keyword: DataFrame, vector: DataFrame) -> None:
    """Raise ``IndexConsistencyError`` for the first collection whose indexes differ."""
    bad = compare_indexes(keyword, vector).where("not consistent").orderBy("collection_id").first()
    if bad is not None:
        raise IndexConsistencyError(f"The indexes of {bad['collection_id']} differ: de-ingest and ingest its files again.")
