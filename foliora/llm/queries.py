"""The queries of this subpackage, by name; each takes a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliora.functions.rows import table
from foliora.llm import abuse, lookalikes, markup, mix, pairs, ranks, scans, sentences, split, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn, *names: str) -> Query:
    """A query that applies ``fn`` to whole tables."""
    return lambda spark, sf: fn(*(table(spark, sf, n) for n in names))


def _units(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentence units of every document and chunk."""
    d = sentences.sentences(documents.select("doc_id", "text"), "doc_id", "text")
    c = sentences.sentences(chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"]), "chunk_id", "content")
    return d.select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_key"), *d.columns[1:]).unionByName(
        c.select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_key"), *c.columns[1:])
    )


def _forms(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every query and chunk in its consistent form."""
    a = lookalikes.normalize(cases.select("id", "query").distinct(), "id", "query")
    b = lookalikes.normalize(chunks.select("chunk_id", "content").distinct(), "chunk_id", "content")
    return a.select(F.lit("eval_case").alias("kind"), F.col("id").alias("item"), "canonical", "changed", "compared").unionByName(b.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item"), "canonical", "changed", "compared"))


def _ranked(results: DataFrame) -> DataFrame:
    return ranks.ranking(results, "query_id", "id", ranks.SEARCH_SCORES).select("query_id", "id", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), F.col("place").cast("int").alias("place"))


QUERIES: dict[str, Query] = {
    "p1_found": _on(markup.found, "documents"),
    "p1_clean": _on(markup.strip_markup, "documents"),
    "p2_found": _on(scans.found, "pdf_pages"),
    "p2_text": _on(scans.continuous, "pdf_pages"),
    "p3_found": _on(sentences.found, "documents", "sentence_sample"),
    "p3_units": _on(_units, "documents", "chunks"),
    "p4_found": _on(pairs.found, "answers"),
    "p4_report": _on(pairs.report, "answers"),
    "p5_found": _on(lambda r: ranks.first(r, "query_id", "id", ranks.SEARCH_SCORES), "search_results"),
    "p5_ranking": _on(_ranked, "search_results"),
    "p6_found": _on(lookalikes.found, "eval_cases", "chunks"),
    "p6_classes": _on(lambda q, c: lookalikes.grouped(lookalikes.classes(q, "eval_case", "id", "query"), lookalikes.classes(c, "chunk", "chunk_id", "content")), "eval_cases", "chunks"),
    "p6_forms": _on(_forms, "eval_cases", "chunks"),
    "p7_found": _on(split.found, "documents", "chunks", "chunk_limits"),
    "p7_pieces": _on(split.all_pieces, "documents", "chunks", "chunk_limits"),
    "p8_ids": _on(tokens.encode_column, "documents"),
    "p9_found": _on(mix.found, "documents", "mix_targets"),
    "p9_shares": _on(mix.shares, "documents", "mix_targets"),
    "p9_mix": _on(mix.mixed, "documents", "mix_targets"),
    "p10_found": _on(abuse.found, "documents", "doc_labels"),
    "p10_scores": _on(abuse.score, "documents", "doc_labels"),
    "p10_rates": _on(abuse.rates, "documents", "doc_labels"),
}
