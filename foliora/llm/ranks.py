"""One ranking from several differently scaled scores, by weighted median rank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Groups with more rows than this are ranked over several tasks.
LARGE_GROUP = 200_000
#: Slices into which each score of a large group is cut.
SLICES = 256

SEARCH_SCORES = {"raw_distance": "asc", "raw_bm25": "asc", "keyword_score": "desc", "rerank_score": "desc", "click_count": "desc"}


def _loss(name: str, order: str) -> Column:
    """A score as a number of which less is better; null and NaN are null."""
    c = F.col(f"`{name}`").cast("double")
    c = F.when(F.isnan(c), None).otherwise(c)
    return c if order == "asc" else -c


def _small(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean rank of each loss within its group: ties share the mean of their places, nulls are last."""
    for k in names:
        order = W.partitionBy("_g").orderBy(F.col(k).asc_nulls_last())
        # rows equal to this one, counted in the same order, so that each score is sorted once
        equal = order.rangeBetween(W.currentRow, W.currentRow)
        df = df.withColumn(f"{k}_r", F.rank().over(order) + (F.count("*").over(equal) - 1) / F.lit(2.0))
    return df


def _large(df: DataFrame, names: list[str]) -> DataFrame:
    """The same ranks for groups too large for one task: counts of distinct values, then of slices of values.

    Rows are counted by value before the exchange; a running sum within each slice plus the sum of the
    slices before it gives every value's rank, which is joined back to the rows by value."""
    out = df
    for k in names:
        values = df.groupBy("_g", k).agg(F.count("*").alias("n"))
        bounds = df.groupBy("_g").agg(F.percentile_approx(k, [i / SLICES for i in range(1, SLICES)], 10_000).alias("b"))
        sliced = values.join(bounds, "_g").withColumn("s", F.when(F.col(k).isNull(), SLICES + 1).otherwise(F.coalesce(F.size(F.filter("b", lambda x: x < F.col(k))), F.lit(0)))).drop("b")
        before = sliced.groupBy("_g", "s").agg(F.sum("n").alias("m")).withColumn("m", F.sum("m").over(W.partitionBy("_g").orderBy("s").rowsBetween(W.unboundedPreceding, -1)))
        ranked = sliced.join(before, ["_g", "s"]).withColumn(
            f"{k}_r", F.coalesce("m", F.lit(0)) + F.sum("n").over(W.partitionBy("_g", "s").orderBy(F.col(k).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)) - (F.col("n") - 1) / F.lit(2.0)
        )
        a, b = out.alias("a"), ranked.select("_g", k, f"{k}_r").alias("b")
        out = a.join(b, (F.col("a._g") == F.col("b._g")) & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))).select("a.*", f"b.{k}_r")
    return out


def _large_groups(rows: DataFrame) -> list:
    """Groups (``_g``) of more than ``LARGE_GROUP`` items (``_i``), at most one in so many rows.

    Found before the plan is made: rows are counted by group, within each task first; only where a group has
    so many rows are its distinct items counted."""
    over = lambda df: [r["_g"] for r in df.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_GROUP).select("_g").collect()]
    rows = rows.select("_g", "_i").where("_i is not null")
    return over(rows.where(_among(F.col("_g"), full)).distinct()) if (full := over(rows)) else []


def _among(group: Column, some: list) -> Column:
    """Whether a group is one of ``some``; null is a group too."""
    return F.coalesce(group.isin([g for g in some if g is not None]), F.lit(False)) | (group.isNull() & F.lit(None in some))


def weighted_median(values: list[Column], weights: list[float]) -> Column:
    """The least value at which the weights of all values up to it reach half of the total."""
    half = sum(weights) / 2
    pairs = F.array_sort(F.array(*(F.struct(v.alias("v"), F.lit(float(w)).alias("w")) for v, w in zip(values, weights))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda acc, p: F.struct((acc["sum"] + p["w"]).alias("sum"), F.when(acc["at"].isNull() & (acc["sum"] + p["w"] >= half), p["v"]).otherwise(acc["at"]).alias("at"))
    return F.aggregate(pairs, start, step, lambda acc: acc["at"])


def fuse(df: DataFrame, group: str, item: str, scores: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Group, item, median rank and mean rank of each distinct item.

    A null or NaN score is worst; equal scores share their mean rank; repeated rows of an item count
    once, each score at its best; a null group is a group of its own and rows without item are left
    out. Only the named columns are read. An empty table gives an empty table."""
    names = [f"_l{i}" for i in range(len(scores))]
    losses = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i"), *(_loss(n, o).alias(k) for k, (n, o) in zip(names, scores.items()))).where("_i is not null")
    items = losses.groupBy("_g", "_i").agg(*(F.min(k).alias(k) for k in names))
    large = _large_groups(losses)
    if not large:
        ranked = _small(items, names)
    else:
        hot = _among(F.col("_g"), large)
        apart = lambda d: d.withColumn("_g", F.struct("_g"))  # a null group is equal to itself
        ranked = _small(apart(items.where(~hot)), names).unionByName(_large(apart(items.where(hot)), names)).withColumn("_g", F.col("_g")["_g"])
    w = [float((weights or {}).get(n, 1.0)) for n in scores]
    columns = [F.col(f"{k}_r") for k in names]
    mean = sum((c * x for c, x in zip(columns, w)), F.lit(0.0)) / sum(w)
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), weighted_median(columns, w).alias("median_rank"), mean.alias("mean_rank"))


def ranking(df: DataFrame, group: str, item: str, scores: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """``fuse`` with the place of each item in its group: by median rank, mean rank, identifier."""
    fused = fuse(df, group, item, scores, weights)
    names = [group, item, "median_rank", "mean_rank"]
    large = _large_groups(df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i")))
    order = W.partitionBy(group).orderBy("median_rank", "mean_rank", item)
    if not large:
        return fused.withColumn("place", F.row_number().over(order))
    # places in a large group: within slices of its median ranks, shifted by the sizes of the slices before
    hot = _among(F.col(f"`{group}`"), large)
    small, rows = fused.where(~hot).withColumn("place", F.row_number().over(order)), fused.where(hot).withColumn("_g", F.struct(F.col(f"`{group}`").alias("_g")))
    counts = rows.groupBy("_g", "median_rank").agg(F.count("*").alias("n"))
    bounds = rows.groupBy("_g").agg(F.percentile_approx("median_rank", [i / SLICES for i in range(1, SLICES)], 10_000).alias("b"))
    sliced = lambda d: d.join(bounds, "_g").withColumn("_s", F.size(F.filter("b", lambda x: x < F.col("median_rank")))).drop("b")
    before = sliced(counts).groupBy("_g", "_s").agg(F.sum("n").alias("m")).withColumn("_m", F.coalesce(F.sum("m").over(W.partitionBy("_g").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("m")
    within = W.partitionBy("_g", "_s").orderBy("median_rank", "mean_rank", item)
    placed = sliced(rows).withColumn("_r", F.row_number().over(within)).join(before, ["_g", "_s"]).withColumn("place", F.col("_r") + F.col("_m"))
    return small.unionByName(placed.select(*names, "place"))


def first(df: DataFrame, group: str, item: str, scores: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """The first item of each group; a running minimum, so that no group is gathered or sorted for it."""
    best = fuse(df, group, item, scores, weights).groupBy(group).agg(F.min(F.struct("median_rank", "mean_rank", item)).alias("best"))
    return best.select(group, F.col("best")[item].alias(item))
