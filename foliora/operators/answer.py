"""From results to answers: labels, context packing, sufficiency, confidence and several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions.text import fixed, has_content, rstrip, strip

HIGH, MEDIUM = 0.75, 0.45
MIN_SCORE, MIN_CHARS, MAX_CHARS, GAP = 0.45, 80, 4000, 2

# Phrases by which a model says that it has no answer, and the answer given then.
UNSUPPORTED = ["无法从当前知识库中确定", "无法确定", "无法回答", "不能确定", "不能回答", "无法判断", "cannot determine", "cannot answer", "not enough information", "insufficient information"]
FALLBACK = "无法从当前知识库中确定。"


def score_label(score: Column) -> Column:
    return F.coalesce(fixed(score), F.lit("n/a"))


def source_label(source: Column, missing: str = "unknown") -> Column:
    return F.when(source.isNull() | (source == ""), F.lit(missing)).otherwise(source)


def page_label(start: Column, end: Column, number: Column | None = None, page: Column | None = None, index: Column | None = None, count: Column | None = None) -> Column:
    """Pages of a chunk: one, a range, or by the first other column that tells; else ``n/a``."""
    c = F.when(start.isNotNull() & end.isNotNull(), F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end)))
    for other in (number, page):
        if other is not None:
            c = F.coalesce(c, other.cast("string"))
    if index is not None:
        c = F.coalesce(c, (index + 1).cast("string"))
    if count is not None:
        c = F.coalesce(c, F.when(count == 1, F.lit("1")))
    return F.coalesce(c, F.lit("n/a"))


def confidence_of(best: Column) -> Column:
    return F.when(best >= HIGH, "high").when(best >= MEDIUM, "medium").otherwise("low")


def confidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Confidence of each query by its best result; low without results. Null scores count as 0."""
    best = results.groupBy("query_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best_score"))
    return queries.select("query_id").distinct().join(best, "query_id", "left").withColumn("confidence", confidence_of(F.col("best_score")))


def judge(queries: DataFrame, results: DataFrame, min_score: float = MIN_SCORE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Whether each query's results suffice for an answer, and if not, why (the first of three reasons)."""
    kept = results.where(has_content(F.col("content")))
    seen = kept.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce("score", F.lit(0.0))).alias("best"), F.sum(F.length(strip(F.col("content")))).alias("chars"))
    reason = F.when(F.col("n").isNull(), "no_results").when(F.col("best") < min_score, "best_score_below_min_score").when(F.col("chars") < min_chars, "content_chars_below_min_chars")
    return queries.select("query_id").distinct().join(seen, "query_id", "left").select("query_id", reason.isNull().alias("context_sufficient"), reason.alias("fallback_reason"))


def pack(results: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """The context of each query: its results by score under headers, cut to ``max_chars`` characters.

    ``results`` needs query_id, id, score, source, page_label and content. The section that no longer
    fits is cut, one whose header doesn't fit ends the context; blank contents take no part. Equal
    scores are ordered by id. Lengths are summed over the sections of a query; only those that fit
    are put together, so a group's text is bounded by the budget."""
    kept = results.where(has_content(F.col("content")))
    order = W.partitionBy("query_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id")
    rows = kept.withColumn("i", F.row_number().over(order)).where(F.col("i") <= max_chars)
    header = F.concat(F.lit("["), F.col("i"), F.lit("] [source: "), source_label(F.col("source")), F.lit(" | page: "), F.col("page_label"), F.lit(" | score: "), score_label(F.col("score")), F.lit("]"))
    rows = rows.withColumn("header", header).withColumn("body", strip(F.col("content")))
    full = F.length("header") + 1 + F.length("body")
    before = F.coalesce(F.sum(full + GAP).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.lit(max_chars) - before).withColumn("budget", F.col("room") - F.length("header") - 1)
    rows = rows.where((F.col("room") > 0) & ((F.length("body") <= F.col("budget")) | (F.col("budget") > 0)))
    text = F.concat("header", F.lit("\n"), F.when(F.length("body") <= F.col("budget"), F.col("body")).otherwise(rstrip(F.substring(F.col("body"), F.lit(1), F.greatest(F.col("budget"), F.lit(0)).cast("int")))))
    packed = rows.select("query_id", "i", text.alias("section")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "section"))).alias("s"))
    return packed.select("query_id", F.size("s").alias("sections"), F.array_join(F.transform("s", lambda x: x["section"]), "\n\n").alias("context"))


def clean_query(q: Column) -> Column:
    """A generated query without list mark, quotes and space around it."""
    c = F.regexp_replace(strip(q), r"\A(?:[-*]|\p{Nd}+[.)、])[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]*", "")
    return F.regexp_replace(c, "\\A[\"'“”‘’` ]+|[\"'“”‘’` ]+\\z", "")


def dedupe_queries(queries: DataFrame, group: str, place: str, query: str = "query") -> DataFrame:
    """Cleaned queries of each group in order, without empty ones and without those equal but for case; first ones stay."""
    c = queries.select(group, place, clean_query(F.col(query)).alias("query")).where("query <> ''").withColumn("_k", F.lower("query"))
    firsts = c.groupBy(group, "_k").agg(F.min_by("query", place).alias("query"), F.min(place).alias("_p"))
    order = W.partitionBy(group).orderBy("_p")
    return firsts.withColumn("query_no", F.row_number().over(order)).select(group, "query_no", "query")


def merge_queries(results: DataFrame, group: str, top_k: int) -> DataFrame:
    """Results of several queries of one question as one list: the best hit of each item, best items first.

    ``results`` needs the group, query_no, rank, id and score; a null score is below all others when
    hits are compared and 0 when items are ordered; of equal hits the one of the earlier query stays."""
    best = results.groupBy(group, "id").agg(
        F.max_by(F.struct("query_no", "rank", "score"), F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("query_no"), -F.col("rank"))).alias("b"), F.min(F.struct("query_no", "rank")).alias("seen")
    )
    order = W.partitionBy(group).orderBy(F.coalesce(F.col("b.score"), F.lit(0.0)).desc(), "seen", "id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).select(group, "place", "id", "b.score", "b.query_no")


def is_unsupported(answer: Column) -> Column:
    """Whether an answer says that there is none."""
    c, out = F.lower(strip(answer)), F.lit(False)
    for phrase in UNSUPPORTED:
        out = out | F.contains(c, F.lit(phrase))
    return F.coalesce(out, F.lit(False))


def conclude(sufficient: Column, reason: Column, answer: Column, failed: Column) -> Column:
    """Answer, its fallback reason and whether sources are shown, from the steps before."""
    why = F.when(~sufficient, reason).when(failed, "generation_failed").when(is_unsupported(answer), "answer_not_supported")
    text = F.when(~sufficient | failed | ~has_content(answer), F.lit(FALLBACK)).otherwise(answer)
    return F.struct(text.alias("answer"), why.alias("fallback_reason"), why.isNull().alias("show_sources"))
