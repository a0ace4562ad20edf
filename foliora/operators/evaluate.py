"""Evaluation of retrieval: cases, hits and ranks, and the report over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_errors(cases: DataFrame) -> DataFrame:
    """Cases that can't be used, with the first reason."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = F.when(empty("id"), "missing id").when(empty("query"), "missing query").when(empty("collection_id"), "missing collection_id").when(F.col("top_k") <= 0, "top_k must be above 0")
    return cases.select("id", reason.alias("error")).where("error is not null").distinct()


def source_matches(source: Column, expected: Column) -> Column:
    """Whether one of two names holds the other, whatever the case; an empty source matches nothing."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return (s != "") & F.coalesce(F.exists(expected, lambda e: F.contains(s, F.lower(e)) | F.contains(F.lower(e), s)), F.lit(False))


def keywords_match(content: Column, tokens: Column, expected: Column) -> Column:
    """Whether all expected keywords are in the content or among the matched tokens."""
    c, t = F.lower(F.coalesce(content, F.lit(""))), F.coalesce(F.transform(tokens, F.lower), F.array().cast("array<string>"))
    return F.coalesce(F.forall(expected, lambda k: F.contains(c, F.lower(k)) | F.array_contains(t, F.lower(k))), F.lit(False))


def _asked(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Hits and ranks of each case.

    ``cases`` has id and the expected arrays; ``results`` case_id, rank, source, file_id, content and
    matched_tokens. Hits are null where nothing is expected. Cases without results have no hit. The
    results are reduced to the least matching rank of each kind, with no case gathered."""
    one = cases.select("id", "expected_sources", "expected_file_ids", "expected_keywords").dropDuplicates(["id"])
    rows = one.join(results, one["id"] == results["case_id"], "left")
    r = F.col("rank")
    ranks = rows.groupBy("id").agg(
        F.min(F.when(_asked("expected_sources") & source_matches(F.col("source"), F.col("expected_sources")), r)).alias("source_rank"),
        F.min(F.when(_asked("expected_file_ids") & F.array_contains("expected_file_ids", F.col("file_id")), r)).alias("file_rank"),
        F.min(F.when(_asked("expected_keywords") & keywords_match(F.col("content"), F.col("matched_tokens"), F.col("expected_keywords")), r)).alias("keyword_rank"),
        F.max(F.coalesce(F.size("matched_tokens") > 0, F.lit(False))).alias("retrieval_evidence_present"),
    )
    out = one.join(ranks, "id").withColumn("first_hit_rank", F.least("source_rank", "file_rank", "keyword_rank"))
    return out.select(
        "id",
        F.when(_asked("expected_sources"), F.col("source_rank").isNotNull()).alias("source_hit"),
        F.when(_asked("expected_file_ids"), F.col("file_rank").isNotNull()).alias("file_hit"),
        F.when(_asked("expected_keywords"), F.col("keyword_rank").isNotNull()).alias("keyword_hit"),
        "first_hit_rank",
        F.col("first_hit_rank").isNotNull().cast("double").alias("hit_at_k"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("first_hit_rank")), F.lit(0.0)).alias("mrr"),
        "retrieval_evidence_present",
    )


def report(scored: DataFrame) -> DataFrame:
    """Means over all cases without error, nulls left out; null where no case counts. ``error`` and ``latency_ms`` may be absent."""
    df = scored if "error" in scored.columns else scored.withColumn("error", F.lit(None).cast("string"))
    df = df if "latency_ms" in df.columns else df.withColumn("latency_ms", F.lit(None).cast("double"))
    sound = F.col("error").isNull()
    rate = lambda c: F.avg(F.when(sound, F.col(c).cast("double")))
    return df.agg(
        F.count("*").alias("case_count"), F.sum((~sound).cast("bigint")).alias("error_count"), rate("hit_at_k").alias("recall_at_k"), rate("mrr").alias("mrr"), rate("source_hit").alias("source_hit_rate"),
        rate("file_hit").alias("file_hit_rate"), rate("keyword_hit").alias("keyword_hit_rate"), rate("retrieval_evidence_present").alias("retrieval_evidence_coverage"), rate("latency_ms").alias("avg_latency_ms"),
    )


def spread(rows: DataFrame, group: str, order: list[str], count: int) -> DataFrame:
    """Up to ``count`` evenly spaced rows of each group; all rows of a smaller group, the first one for a count of 1.

    Halves between two places go to the even one."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if count <= 0:
        return numbered.where("false").drop("_i", "_n")
    if count == 1:
        return numbered.where("_i = 0").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(count - 1)), 0).cast("int"))
    return numbered.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def select(rows: DataFrame, key: str, group: str, order: list[str], count: int, each: int = 6) -> DataFrame:
    """``count`` rows: evenly spread ones of every group, filled up with evenly spread ones of the rest.

    Groups come in order, and the rest only where they don't give enough; each row of ``rows`` has its own key."""
    from foliora.operators.catalog import numbered

    chosen = spread(rows, group, order, each)
    missing = max(0, count - chosen.count())
    rest = rows.join(chosen.select(key), key, "left_anti") if missing else rows.where("false")
    fill = numbered(rest, group, *order)
    n = fill.count()
    if missing and missing < n:
        # row i of n is the j-th of m evenly spread ones if some j has round(j * (n - 1) / (m - 1)) = i
        i, m = F.col("place") - 1, F.lit(missing)
        if missing == 1:
            fill = fill.where(i == 0)
        else:
            step = (n - 1) / (missing - 1)
            near = F.floor(i / F.lit(step))
            fill = fill.where((F.bround(near * F.lit(step), 0) == i) | (F.bround((near + 1) * F.lit(step), 0) == i) & (near + 1 < m))
    both = chosen.withColumn("_late", F.lit(0)).unionByName(fill.drop("place").withColumn("_late", F.lit(1)))
    return both.orderBy("_late", group, *order).limit(count).drop("_late")
