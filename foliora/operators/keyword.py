"""Keyword search: positional postings, BM25 with phrases, and rescoring of the candidates."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions.lineage import cut
from foliora.functions.rows import schema_of, spread, unnest
from foliora.functions.text import let
from foliora.operators import tokens as T

K1, B = 1.2, 0.75  # fixed values of the ranking function
LEAST_IDF = 1e-6
CANDIDATES, LEAST_CANDIDATES = 8, 50
DEFAULT_TOP_K = 5


#: Terms of the queries up to which a text's terms are looked up among them as they are made; more are joined.
TERMS = 5_000


def _distinct(chunks: DataFrame) -> DataFrame:
    return chunks.select("collection_id", "chunk_id", "content").dropDuplicates(["chunk_id"])


def postings(chunks: DataFrame, distinct: bool = False) -> DataFrame:
    """The inverted index: for each term of a chunk its positions (from 0), their number and the chunk's length.

    A chunk is one row, so its terms are gathered within it and nothing is shuffled but repeated chunks, unless
    the caller knows them to be ``distinct``. A null or blank content has no terms."""
    rows = (chunks if distinct else _distinct(chunks)).select("collection_id", "chunk_id", T.index_terms(F.col("content")).alias("terms"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = schema_of(f"collection_id {kinds['collection_id']}, token string, chunk_id {kinds['chunk_id']}, doc_len int, positions array<int>, tf int")

    def gather(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            terms = b.column(2)
            of, flat = pc.list_parent_indices(terms).to_numpy(), pc.list_flatten(terms)
            if not len(flat):
                continue
            size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
            codes = (d := flat.dictionary_encode()).indices.to_numpy()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            key = of.astype(np.int64) * len(d.dictionary) + codes
            order = np.argsort(key, kind="stable")  # positions of a term stay in order
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            tf = np.diff(first, append=len(order))
            row, code = of[order[first]], codes[order[first]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
            parts = [b.column(0).take(pa.array(row)), d.dictionary.take(pa.array(code)), b.column(1).take(pa.array(row)), pa.array(size[row].astype(np.int32)), lists, pa.array(tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(parts, arrow)], schema=arrow)

    return rows.mapInArrow(gather, schema)


def write_postings(chunks: DataFrame, path: str) -> None:
    """Store the index of distinct chunks in the folder ``path``, by term, so that a search reads few parts of it."""
    postings(chunks, distinct=True).sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def stats(chunks: DataFrame) -> DataFrame:
    """Number and mean length in terms of the chunks of each collection; lengths are made before repeated chunks are dropped."""
    sized = chunks.select("collection_id", "chunk_id", T.term_count(F.col("content")).alias("doc_len")).dropDuplicates(["chunk_id"])
    return _lengths(sized)


def _lengths(sized: DataFrame) -> DataFrame:
    return sized.groupBy("collection_id").agg(F.count("*").alias("n_chunks"), (F.sum("doc_len") / F.count("*")).alias("avg_len"))


@dataclasses.dataclass(frozen=True)
class Index:
    """What a search reads: places of terms (collection_id, chunk_id, doc_len, term, pos), and chunks and their mean length by collection."""

    places: DataFrame
    stats: DataFrame


def analysed(queries: DataFrame) -> DataFrame:
    """Queries with their tokens and ``top_k``, made once; those that have tokens already come back as they are."""
    if {"required", "optional"} <= set(queries.columns):
        return queries
    top_k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K)) if "top_k" in queries.columns else F.lit(DEFAULT_TOP_K)
    return cut(T.analyze(queries.select("query_id", "query", "collection_id", top_k.alias("top_k"))))


def stored_index(postings: DataFrame, lengths: DataFrame, queries: DataFrame) -> Index:
    """The index of stored ``postings`` and ``lengths`` (collection_id, chunk_id, doc_len), read at the terms of the queries only."""
    terms = _terms(_phrases(analysed(queries)))
    some = postings if terms is None else postings.where(F.col("token").isin(terms))
    places = some.select("collection_id", "chunk_id", "doc_len", F.col("token").alias("term"), F.explode("positions").alias("pos"))
    return Index(places, _lengths(lengths))


def text_index(chunks: DataFrame, queries: DataFrame) -> Index:
    """The same from the chunks themselves, in one pass: of each text only its length and the places of the queries' terms are kept."""
    terms = _terms(_phrases(analysed(queries)))

    def of(ts: Column) -> Column:
        place = lambda t, i: F.when(t.isin(terms) if terms is not None else t.isNotNull(), F.struct(t.alias("term"), i.alias("pos")))
        return F.struct(F.size(ts).alias("doc_len"), F.filter(F.transform(ts, place), lambda x: x.isNotNull()).alias("places"))

    rows = spread(chunks.select("collection_id", "chunk_id", "content")).select("collection_id", "chunk_id", let(T.index_terms(F.col("content")), of).alias("r"))
    narrow = cut(rows.select("collection_id", "chunk_id", "r.doc_len", "r.places").dropDuplicates(["chunk_id"]))
    return Index(narrow.select("collection_id", "chunk_id", "doc_len", F.explode("places").alias("p")).select("collection_id", "chunk_id", "doc_len", "p.term", "p.pos"), _lengths(narrow))


def _terms(phrases: DataFrame) -> list[str] | None:
    """The terms of a set of queries, or None for more than ``TERMS``."""
    rows = phrases.select(F.explode("parts").alias("term")).distinct().limit(TERMS + 1).collect()
    return [r["term"] for r in rows] if len(rows) <= TERMS else None


def _phrases(queries: DataFrame) -> DataFrame:
    """The phrases of analysed queries: a token with underscores is a phrase of several terms."""
    both = F.concat(F.transform("required", lambda t: F.struct(t.alias("token"), F.lit(True).alias("required"))), F.transform("optional", lambda t: F.struct(t.alias("token"), F.lit(False).alias("required"))))
    rows = unnest(queries.withColumn("n_required", F.size("required")), ["query_id", "collection_id", "n_required"], both, "_i", "p")
    return rows.select("query_id", "collection_id", "n_required", "p.token", F.col("p.required").alias("is_required")).withColumn("parts", F.filter(F.split("token", "_"), lambda x: x != ""))


def _occurrences(phrases: DataFrame, places: DataFrame) -> DataFrame:
    """How often each phrase stands in each chunk of its collection.

    Counted before the exchange for single terms, and lined up by their position for phrases."""
    wanted = phrases.select("collection_id", "token", "parts").distinct()
    parts = wanted.select("collection_id", "token", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "term"))
    hits = places.join(parts, ["collection_id", "term"])
    start = F.when(F.col("n_parts") > 1, F.col("pos") - F.col("part"))  # null for single terms, whose count is all that matters
    lined = hits.groupBy("collection_id", "token", "n_parts", "chunk_id", start.alias("start")).agg(F.count("*").alias("k"), F.first("doc_len").alias("doc_len"))
    times = F.when(F.col("n_parts") == 1, F.col("k")).otherwise((F.col("k") == F.col("n_parts")).cast("bigint"))
    return lined.groupBy("collection_id", "token", "chunk_id").agg(F.sum(times).alias("f"), F.first("doc_len").alias("doc_len")).where("f > 0")


def _idf() -> Column:
    idf = F.ln((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))


def weights(queries: DataFrame, chunks: DataFrame, index: Index | None = None) -> DataFrame:
    """Number of chunks with each token of the queries, and its inverse document frequency, by collection."""
    queries = analysed(queries)
    index = index or text_index(chunks, queries)
    found = _occurrences(_phrases(queries), index.places)
    return found.groupBy("collection_id", "token").agg(F.count("*").alias("df")).join(index.stats.drop("avg_len"), "collection_id").withColumn("idf", _idf())


def _weight() -> Column:
    """The share of one phrase in the (negative) score of a chunk."""
    f = F.col("f").cast("double")
    return -_idf() * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))


def candidates(queries: DataFrame, chunks: DataFrame, index: Index | None = None) -> DataFrame:
    """Best chunks of each query by BM25: those with all required tokens, or where there are none, with any token.

    ``queries`` needs query_id, query, collection_id and top_k (null for the default). Returns query_id,
    chunk_id, raw_bm25 (less is better) and bm25_rank. Ties are ordered by chunk_id. Queries without
    usable tokens have no rows. Without an ``index`` the chunks' texts are read."""
    queries = analysed(queries)
    index = index or text_index(chunks, queries)
    phrases = _phrases(queries)
    found = cut(_occurrences(phrases, index.places))
    df = found.groupBy("collection_id", "token").agg(F.count("*").alias("df"))
    weighted = found.join(df, ["collection_id", "token"]).join(index.stats, "collection_id").select("collection_id", "token", "chunk_id", _weight().alias("w"))
    per_chunk = (
        phrases.join(weighted, ["collection_id", "token"])
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(F.col("is_required").cast("int")).alias("n"), F.first("n_required").alias("n_required"), F.sum(F.when(F.col("is_required"), F.col("w"))).alias("strict"), F.sum("w").alias("relaxed"))
        .withColumn("is_strict", (F.col("n") == F.col("n_required")) & (F.col("n_required") > 0))
    )
    any_strict = F.max("is_strict").over(W.partitionBy("query_id"))
    scored = per_chunk.withColumn("any_strict", any_strict).where("is_strict or not any_strict").select("query_id", "chunk_id", F.when(F.col("any_strict"), F.col("strict")).otherwise(F.col("relaxed")).alias("raw_bm25"))
    limit = queries.select("query_id", F.greatest(F.col("top_k") * CANDIDATES, F.lit(LEAST_CANDIDATES)).alias("limit"))
    order = W.partitionBy("query_id").orderBy(F.round("raw_bm25", 9), "chunk_id")
    return scored.withColumn("bm25_rank", F.row_number().over(order)).join(limit, "query_id").where("bm25_rank <= limit").drop("limit")


def structure_bonus(content: Column, required: Column, optional: Column) -> Column:
    """Bonus for chunks that open with a description or prototype of what the query requires."""

    def of(text: Column) -> Column:
        places = F.filter(F.transform(required, lambda t: F.instr(text, t) - 1), lambda p: p >= 0)
        first = F.array_min(places)
        asks = F.arrays_overlap(optional, F.array(F.lit("功能"), F.lit("作用")))
        described = asks & F.contains(F.substring(text, 1, 80), F.lit("功能说明")) & (first <= 160)
        prototype = F.contains(F.substring(text, 1, 160), F.lit("函数原型")) & (first <= 160)
        return F.when(first.isNull(), 0.0).when(described, 1.0).when(prototype, 0.6).otherwise(0.0)

    return let(F.lower(content), of)


def _coverage(hits: Column, of: Column) -> Column:
    return F.when(F.size(of) == 0, 0.0).otherwise(F.try_divide(F.size(hits).cast("double"), F.size(of)))


def evidence(required: Column, optional: Column, content: Column, tokens: Column | None = None) -> Column:
    """What of a query a content (with ``tokens``, if they are made already) matches: tokens, coverage of both kinds, and bonuses."""

    def of(toks: Column) -> Column:
        return F.struct(T.matched(required, toks).alias("required"), T.matched(optional, toks).alias("optional"))

    m = let(T.tokenize(content) if tokens is None else tokens, of)
    lettered = F.exists(m["required"], lambda t: t.rlike(r"\A[\x{0}-\x{7f}]+\z") & t.rlike("[A-Za-z]"))
    return F.struct(
        F.array_distinct(F.concat(m["required"], m["optional"])).alias("matched_tokens"),
        _coverage(m["required"], required).alias("required_coverage"),
        _coverage(m["optional"], optional).alias("optional_coverage"),
        F.when(F.size(m["required"]) == 0, 0.0).when(lettered, 1.0).otherwise(0.5).alias("exact_bonus"),
        structure_bonus(content, required, optional).alias("structure_bonus"),
    )


def search(queries: DataFrame, chunks: DataFrame, every: bool = False, index: Index | None = None) -> DataFrame:
    """Keyword search of every query: candidates by BM25, rescored by coverage, exactness and structure.

    Returns the best ``top_k`` chunks of each query (all candidates if ``every``) with their evidence.
    Contents are joined to the candidates only, after the limit, and made to tokens once for all queries."""
    queries = analysed(queries)
    best = cut(candidates(queries, chunks, index))
    content = chunks.select("chunk_id", "content", "source", "file_id").join(best.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    content = content.withColumn("_tokens", T.tokenize(F.col("content")))
    rows = best.join(queries.select("query_id", "required", "optional", "top_k"), "query_id").join(content, "chunk_id").withColumn("e", evidence(F.col("required"), F.col("optional"), F.col("content"), F.col("_tokens")))
    per_query = W.partitionBy("query_id")
    low, high = F.min("raw_bm25").over(per_query), F.max("raw_bm25").over(per_query)
    rows = rows.withColumn("bm25_signal", F.when(low == high, 1.0).otherwise(F.try_divide(high - F.col("raw_bm25"), high - low)))
    score = 0.55 * F.col("e.required_coverage") + 0.20 * F.col("e.optional_coverage") + 0.15 * F.col("e.exact_bonus") + 0.05 * F.col("bm25_signal") + 0.05 * F.col("e.structure_bonus")
    capped = F.when((F.size("required") > 0) & (F.col("e.required_coverage") == 0), F.least(score, F.lit(0.2))).otherwise(score)
    rows = rows.withColumn("keyword_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)))
    order = W.partitionBy("query_id").orderBy(F.round("keyword_score", 9).desc(), F.round("raw_bm25", 9), "chunk_id")
    rows = rows.withColumn("keyword_rank", F.row_number().over(order))
    if not every:
        rows = rows.where("keyword_rank <= top_k")
    return rows.select("query_id", "chunk_id", "keyword_score", "raw_bm25", "bm25_rank", "keyword_rank", "bm25_signal", "e.*", "content", "source", "file_id")
