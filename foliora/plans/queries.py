"""The engine's queries by name; each takes a session and a data folder and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions import text as X
from foliora.functions import vectors as V
from foliora.functions.rows import table, unnest
from foliora.operators import answer, cases, catalog, chunking, clean, evaluate, hybrid, keyword, sections, tokens, vector
from foliora.providers import HashingEmbedder
from foliora.sources import loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP_K = 10


def query(*names: str):
    """Register a function of whole tables under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf: fn(*(table(spark, sf, n) for n in names))
        return fn

    return add


def _pages(pages: DataFrame) -> DataFrame:
    return pages.dropDuplicates(["page_doc_id"])


def _chunks(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["chunk_id"])


def _cases(cases: DataFrame) -> DataFrame:
    return cases.dropDuplicates(["id"])


def _searches(cases: DataFrame) -> DataFrame:
    """The searches: every case whose number is divisible by 100."""
    return _cases(cases).where(F.right("id", F.lit(6)).cast("int") % 100 == 0).select(F.col("id").alias("query_id"), "query", "collection_id", "top_k")


def _r(c, n: int = 6):
    return F.round(c, n)


# --- scans, sources, sinks ---------------------------------------------------------------------


@query("documents")
def load_text(d):
    text = d.where(F.col("file_type").isin(*loaders.TEXT))
    return loaders.loaded(text, "text").select("doc_id", "source", F.length(X.strip(F.col("text"))).alias("chars"))


@query("pdf_pages")
def load_pages(p):
    """Pages with content, with the number of pages of their source, empty ones included."""
    one = _pages(p)
    n = one.groupBy("source").agg(F.count("*").cast("int").alias("pages"))
    return loaders.loaded(one, "content").join(n, "source").select("page_doc_id", "source", "page_number", "pages", F.length("content").alias("chars"))


QUERIES["scan_dir"] = lambda spark, sf: loaders.scan(spark, sf).groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query("documents")
def load_skipped(d):
    return loaders.skipped(d, F.col("file_name"), "text").select("doc_id", "message")


@query("pdf_pages")
def vision_route(p):
    c = F.col("content")
    return _pages(p).select("page_doc_id", loaders.needs_vision(c, "auto").alias("auto"), loaders.needs_vision(c, "visual").alias("visual"), loaders.needs_vision(c, "text").alias("text"))


@query("files")
def mime_type(f):
    return f.select("file_id", loaders.mime_type(F.col("original_name")).alias("mime_type")).distinct()


@query("documents")
def loader_meta(d):
    return d.select("doc_id", F.concat_ws("/", "file_id", "file_name").alias("source"), "file_name", loaders.suffix(F.col("file_name")).alias("file_type"))


@query("chunks")
def postings(c):
    """The inverted index: terms, chunks, frequency, length and first position."""
    return keyword.postings(c).select("collection_id", "token", "chunk_id", "tf", "doc_len", F.get("positions", F.lit(0)).alias("first_pos"))


@query("embeddings")
def vector_upsert(e):
    """Vectors of the upper labels come again, turned round."""
    new = e.where("label >= 5").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return vector.upsert(e, new).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("eval_cases")
def eval_cases(c):
    bad = evaluate.case_errors(c)
    one = _cases(c).select("id", "collection_id", F.coalesce(F.size("expected_sources"), F.lit(0)).alias("sources"), F.coalesce(F.size("expected_keywords"), F.lit(0)).alias("keywords"), "top_k")
    return one.join(bad, "id", "left").withColumn("sources", F.greatest("sources", F.lit(0))).withColumn("keywords", F.greatest("keywords", F.lit(0)))


@query("chunks")
def case_rows(c):
    """Chunks long enough to make a case of, with their space as single blanks."""
    one = _chunks(c).where(F.length(F.trim("content")) >= 80)
    return one.select("chunk_id", "source", "chunk_index", X.strip(F.regexp_replace("content", f"[{X.SPACE}]+", " ")).alias("content"))


@query("chunks")
def case_topic(c):
    """Topic, question, answer and keyword of a case made of each chunk that is long enough."""
    return cases.make(QUERIES_RAW["case_rows"](c))


# --- projections -------------------------------------------------------------------------------


@query("search_results", "chunks")
def public_projection(r, c):
    meta = _chunks(c).select(F.col("chunk_id").alias("id"), "page_start", "page_end")
    one = r.select("query_id", "id", "score", "source", "file_id", "collection_id").dropDuplicates(["query_id", "id"])
    return one.join(meta, "id", "left").withColumn("score", _r("score"))


@query("search_results")
def public_json(r):
    one = r.dropDuplicates(["query_id", "id"])
    s = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return one.select("query_id", "id", F.to_json(F.struct("id", s("source"), F.struct(s("source"), s("file_id"), s("collection_id")).alias("metadata"))).alias("json"))


@query("search_results")
def debug_projection(r):
    one = r.dropDuplicates(["query_id", "id"])
    return one.select(
        "query_id", "id", F.col("strategy").alias("retrieval_mode"), _r(hybrid.hybrid_score(F.col("vector_score"), F.col("keyword_score")), 9).alias("hybrid_score"), _r("vector_score").alias("vector_score"),
        _r("keyword_score").alias("keyword_score"), _r("raw_distance").alias("raw_distance"), _r("raw_bm25").alias("raw_bm25"), F.coalesce(F.size("keyword_matched_tokens"), F.lit(0)).alias("matched"), _r("score").alias("score"),
    )


@query("files", "registry")
def active_filter(f, g):
    a = catalog.file_states(f).where(F.col("status") == catalog.ACTIVE).select(F.lit("file").alias("kind"), "file_id", F.lit("").alias("collection_id"))
    b = catalog.registry_states(g).where(F.col("index_status") == catalog.INDEXED).select(F.lit("registry").alias("kind"), "file_id", "collection_id")
    return a.unionByName(b)


@query("search_results", "chunks")
def get_by_ids(r, c):
    """Chunks by lists of ids in the order asked, without missing ones: each query's logged results."""
    asked = r.groupBy("query_id", "id").agg(F.min("rank").alias("pos"))
    return asked.join(_chunks(c).select(F.col("chunk_id").alias("id"), F.length("content").alias("chars")), "id").select("query_id", "pos", "id", "chars")


@query("chunks", "files")
def delete_by_file(c, f):
    gone = catalog.file_states(f).where(F.col("status") == catalog.DELETED).select("file_id")
    pairs = _chunks(c).select("file_id", "collection_id").distinct().join(gone, "file_id", "left_semi")
    return catalog.without_files(_chunks(c), pairs).groupBy("collection_id").agg(F.count("*").alias("chunks"))


@query("chunks")
def preview(c):
    return _chunks(c).select("chunk_id", X.preview(F.col("content"), 80).alias("preview"))


@query("chunks")
def page_label(c):
    return _chunks(c).select("chunk_id", answer.page_label(F.col("page_start"), F.col("page_end"), count=F.col("chunk_count")).alias("page"))


@query("search_results")
def labels_fmt(r):
    return r.dropDuplicates(["query_id", "id"]).select("query_id", "id", answer.score_label(F.col("score")).alias("score"), answer.source_label(F.col("source")).alias("source"))


# --- joins and sets ----------------------------------------------------------------------------


@query("search_results")
def hybrid_search(r):
    """Fusion of the logged branches: full outer join, weighted sum, stable order, best of each query."""
    fused = hybrid.fuse(*hybrid.branches(r, hybrid.candidate_k(TOP_K)))
    return fused.where(F.col("hybrid_rank") <= TOP_K).select("query_id", "hybrid_rank", "id", _r("hybrid_score", 9).alias("hybrid_score"), "vector_rank", "keyword_rank")


@query("eval_cases", "chunks")
def hybrid_chunks(q, c):
    """Hybrid search from the texts themselves: both branches within each search's collection, fused."""
    return hybrid_of(_searches(q), c)


def hybrid_of(asked, c):
    """The best chunks of every search (query_id, query, collection_id), from the texts of the chunks."""
    fetch = hybrid.candidate_k(TOP_K)
    model = HashingEmbedder()
    one = _chunks(c).select("chunk_id", "content", "collection_id")
    of = lambda df, key, text: vector.embed(df, key, text, model).join(df.select(key, "collection_id"), key)
    near = vector.search(of(asked, "query_id", "query"), of(one, "chunk_id", "content"), fetch, vec_id="chunk_id", group="collection_id")
    v = near.select("query_id", F.col("vec_id").alias("id"), "vector_score", F.col("distance").alias("raw_distance"), "vector_rank")
    k = keyword.search(asked.withColumn("top_k", F.lit(fetch)), c).select("query_id", F.col("chunk_id").alias("id"), "keyword_score", "raw_bm25", "keyword_rank")
    fused = hybrid.fuse(v, k)
    return fused.where(F.col("hybrid_rank") <= TOP_K).select("query_id", "hybrid_rank", "id", _r("hybrid_score").alias("hybrid_score"), "vector_rank", "keyword_rank")


@query("search_results")
def search_debug(r):
    """All candidates of both branches with their ranks, beside the final place."""
    fused = hybrid.fuse(*hybrid.branches(r, hybrid.candidate_k(TOP_K)))
    return fused.select("query_id", "id", "vector_rank", "keyword_rank", "hybrid_rank", _r("raw_distance").alias("raw_distance"), _r("raw_bm25").alias("raw_bm25"), _r("hybrid_score", 9).alias("hybrid_score"))


@query("chunks")
def index_consistency(c):
    """The keyword index has all chunks; the vector index those with a file."""
    one = _chunks(c)
    return hybrid.compare_indexes(one, one.where("file_id is not null"))


@query("embeddings")
def vector_search(e):
    """The vectors nearest every vector whose id is divisible by 100, against all."""
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.search(asked, e, TOP_K).select("query_id", "vector_rank", "vec_id", _r("distance").alias("distance"), _r("vector_score").alias("vector_score"))


@query("files", "registry")
def deletable_files(f, g):
    return catalog.deletable(f, g).select("file_id", "original_name")


@query("chunks")
def case_spread(c):
    """Six evenly spaced chunks of each file."""
    one = _chunks(c).where((F.length(F.trim("content")) >= 80) & F.col("file_id").isNotNull())
    return evaluate.spread(one, "file_id", ["source", "chunk_index", "chunk_id"], 6).select("file_id", "chunk_id")


@query("embeddings")
def boundary_scores(e):
    """Likeness across each boundary of a sequence: means of the two vectors before and after it."""
    w = W.partitionBy("label").orderBy("vec_id")
    v = e.withColumn("v", V.doubles(F.col("embedding")))
    before, after = F.collect_list("v").over(w.rowsBetween(-1, 0)), F.collect_list("v").over(w.rowsBetween(1, 2))
    rows = v.select("label", "vec_id", before.alias("b"), after.alias("a")).where(F.size("a") > 0)
    return rows.select("label", "vec_id", _r(V.cosine_score(V.mean(F.col("b")), V.mean(F.col("a")))).alias("score"))


# --- aggregates --------------------------------------------------------------------------------


@query("chunks", "files", "collections", "registry")
def inspect_counts(c, f, k, g):
    n = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    one = _chunks(c)
    parts = [n(one, "chunks"), n(one.select("source").distinct(), "sources"), n(catalog.file_states(f), "files"), n(k, "collections"), n(catalog.registry_states(g), "registry")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("registry")
def indexed_chunk_sum(g):
    s = catalog.registry_states(g)
    return s.groupBy("collection_id").agg(F.coalesce(F.sum(F.when(F.col("index_status") == catalog.INDEXED, F.col("indexed_chunk_count"))), F.lit(0)).alias("chunks"))


@query("chunks")
def list_sources(c):
    return c.select("collection_id", "source").distinct()


@query("pdf_pages")
def source_rows(p):
    """Each source with the metadata of its first page."""
    return _pages(p).groupBy("source").agg(F.min_by(F.struct("file_id", "collection_id", "file_name", "file_type"), F.struct("page_number", "page_doc_id")).alias("m")).select("source", "m.*")


@query("pdf_pages")
def pdf_edges(p):
    return clean.page_edges(p)


@query("chunks")
def bm25_stats(c):
    s = keyword.stats(c)
    return s.select("collection_id", "n_chunks", _r("avg_len").alias("avg_len"))


@query("eval_cases", "chunks")
def bm25(q, c):
    """How many chunks of its collection hold each token of the searches, and what that makes it weigh."""
    return keyword.weights(_searches(q), c).select("collection_id", "token", "df", _r("idf").alias("idf"))


@query("eval_cases", "chunks")
def keyword_candidates(q, c):
    return keyword.candidates(_searches(q), c).select("query_id", "bm25_rank", "chunk_id", _r("raw_bm25").alias("raw_bm25"))


@query("eval_cases", "chunks")
def keyword_search(q, c):
    cols = ["required_coverage", "optional_coverage", "exact_bonus", "bm25_signal", "structure_bonus"]
    return keyword.search(_searches(q), c).select("query_id", "keyword_rank", "chunk_id", _r("keyword_score").alias("keyword_score"), *(_r(x).alias(x) for x in cols), F.array_join("matched_tokens", " ").alias("matched_tokens"))


@query("search_results")
def confidence(r):
    return answer.confidence(r, r).select("query_id", _r("best_score").alias("best_score"), "confidence")


@query("search_results", "chunks")
def context_judge(r, c):
    rows = r.select("query_id", "id", "score").dropDuplicates(["query_id", "id"]).join(_chunks(c).select(F.col("chunk_id").alias("id"), "content"), "id", "left")
    return answer.judge(r, rows)


@query("search_results", "chunks")
def context_pack(r, c):
    rows = r.select("query_id", "id", "score").dropDuplicates(["query_id", "id"]).join(_chunks(c).select(F.col("chunk_id").alias("id"), "source", "content", answer.page_label(F.col("page_start"), F.col("page_end")).alias("page_label")), "id")
    return answer.pack(rows).select("query_id", "sections", F.length("context").alias("chars"), F.sha2(F.encode("context", "UTF-8"), 256).alias("context_hash"))


@query("search_results", "eval_cases")
def multi_query_search(r, q):
    """Queries asked of one collection as one question, in the order of their ids."""
    one = r.select("collection_id", "query_id", "id", "rank", "score").dropDuplicates(["query_id", "id"])
    no = one.select("collection_id", "query_id").distinct().withColumn("query_no", F.row_number().over(W.partitionBy("collection_id").orderBy("query_id")))
    merged = answer.merge_queries(one.join(no, ["collection_id", "query_id"]), "collection_id", TOP_K)
    return merged.select("collection_id", "place", "id", _r("score").alias("score"), "query_no")


@query("embeddings")
def adaptive_cutoff(e):
    b = QUERIES_RAW["boundary_scores"](e)
    return b.groupBy("label").agg(F.collect_list("score").alias("s")).select("label", _r(chunking.cutoff(F.col("s"))).alias("cutoff"))


@query("embeddings")
def mean_vector(e):
    at = e.select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    return at.groupBy("label", "pos").agg(_r(F.avg("x")).alias("mean"))


@query("embeddings")
def cosine_score(e):
    """Likeness of each vector to that of the next id."""
    a, b = e.select("vec_id", V.doubles(F.col("embedding")).alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), V.doubles(F.col("embedding")).alias("b"))
    return a.join(b, "vec_id").select("vec_id", _r(V.cosine_score(F.col("a"), F.col("b"))).alias("score"))


@query("chunks")
def char_jaccard(c):
    """Likeness of the characters of successive chunks of a file."""
    w = W.partitionBy("source").orderBy("chunk_index", "chunk_id")
    rows = _chunks(c).select("chunk_id", "content", F.lead("content").over(w).alias("next")).where("next is not null")
    return rows.select("chunk_id", _r(chunking.jaccard(F.col("content"), F.col("next"))).alias("score"))


# --- evaluation --------------------------------------------------------------------------------


def _scored(q, r, c):
    """Every case scored on the logged results of its query."""
    by_query = r.select("query_id", "query", "id", "rank", "source", "file_id", "keyword_matched_tokens").dropDuplicates(["query_id", "id"])
    content = _chunks(c).select(F.col("chunk_id").alias("id"), "content")
    case = _cases(q).select(F.col("id").alias("case_id"), "query")
    firsts = by_query.groupBy("query").agg(F.min("query_id").alias("query_id"))
    hits = case.join(firsts, "query").join(by_query.drop("query"), "query_id").join(content, "id", "left")
    rows = hits.select("case_id", "rank", "source", "file_id", "content", F.col("keyword_matched_tokens").alias("matched_tokens"))
    return evaluate.score_cases(q, rows)


@query("eval_cases", "search_results", "chunks")
def eval_score(q, r, c):
    return _scored(q, r, c).withColumn("mrr", _r("mrr"))


@query("eval_cases", "search_results", "chunks")
def eval_report(q, r, c):
    out = evaluate.report(_scored(q, r, c)).drop("avg_latency_ms")
    return out.select("case_count", "error_count", *(_r(x).alias(x) for x in out.columns[2:]))


@query("search_results")
def eval_evidence(r):
    """Logged results with their keyword evidence, where there is any."""
    one = r.dropDuplicates(["query_id", "id"])
    ev = one.where(F.size("keyword_matched_tokens") > 0).select("query_id", "id", F.size("keyword_matched_tokens").alias("tokens"))
    return one.select("query_id", "id", "rank").join(ev, ["query_id", "id"], "left")


@query("eval_cases", "chunks")
def eval_source_match(q, c):
    """Whether the chunk a case was made from has one of the sources it expects."""
    case = _cases(q).select("id", "chunk_id", "expected_sources")
    return case.join(_chunks(c).select("chunk_id", "source"), "chunk_id").select("id", evaluate.source_matches(F.col("source"), F.col("expected_sources")).alias("matches"))


@query("search_results")
def ranked_results(r):
    one = r.select("query_id", "id", "score").dropDuplicates(["query_id", "id"])
    order = W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return one.select("query_id", "id", F.row_number().over(order).alias("place"))


@query("files", "collections", "registry")
def catalog_order(f, k, g):
    a = catalog.numbered(catalog.file_states(f).select(F.lit("files").alias("kind"), "file_id", "created_at"), "created_at", "file_id").select("kind", F.col("file_id").alias("item"), "place")
    b = catalog.numbered(k.select(F.lit("collections").alias("kind"), "collection_id", "created_at"), "created_at", "collection_id").select("kind", F.col("collection_id").alias("item"), "place")
    c = catalog.numbered(catalog.registry_states(g).select(F.lit("registry").alias("kind"), "collection_id", "file_id"), "collection_id", "file_id").select("kind", F.concat_ws("|", "collection_id", "file_id").alias("item"), "place")
    return a.union(b).union(c)


@query("pdf_pages")
def page_order(p):
    """Pages of each source in order of their numbers."""
    return _pages(p).select("source", "page_doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.col("page_number").asc_nulls_last(), "page_doc_id")).alias("place"))


# --- cleaning, sections, chunks ----------------------------------------------------------------


@query("documents")
def clean_lines(d):
    return clean.clean_documents(d.select("doc_id", "text", "file_type")).select("doc_id", "cleaned")


@query("pdf_pages")
def page_markers(p):
    at = unnest(_pages(p), ["page_doc_id"], F.transform(X.lines(F.col("content")), X.clean_line), "line_no", "line")
    return at.where(F.col("line") != "").where(clean.is_marker(F.col("line")) | clean.is_bare_number(F.col("line")) | clean.is_decorative(F.col("line"))).select("page_doc_id", "line_no", "line")


@query("pdf_pages")
def edge_keys(p):
    """Comparison keys of the first and last line of every page."""
    full = F.filter(F.transform(X.lines(F.col("content")), X.clean_line), lambda x: x != "")
    return _pages(p).select("page_doc_id", full.alias("f")).where(F.size("f") > 0).select("page_doc_id", clean.edge_key(F.get("f", F.lit(0))).alias("top"), clean.edge_key(F.element_at("f", -1)).alias("bottom"))


@query("pdf_pages")
def pdf_clean(p):
    return clean.clean_pages(p).select("page_doc_id", "cleaned")


@query("documents")
def hard_breaks(d):
    cut = unnest(d.where("text is not null"), ["doc_id"], sections.sections(F.col("text")), "section_no", "s")
    return cut.select("doc_id", "section_no", "s.start_char", "s.end_char", "s.hard_break_key")


def _built(d, merge=False):
    return sections.build(d.where("text is not null"), "doc_id", "text", merge=merge)


@query("documents")
def blocks(d):
    at = unnest(_built(d), ["doc_id", "section_no"], F.col("blocks"), "block_no", "b")
    return at.select("doc_id", "section_no", "block_no", "b.start_char", "b.end_char")


@query("documents")
def block_clean(d):
    at = unnest(_built(d), ["doc_id", "section_no"], F.col("blocks"), "block_no", "b")
    return at.select("doc_id", "section_no", "block_no", "b.content", "b.words")


@query("documents")
def merge_blocks(d):
    at = unnest(_built(d, merge=True), ["doc_id", "section_no"], F.col("blocks"), "block_no", "b")
    return at.select("doc_id", "section_no", "block_no", "b.start_char", "b.end_char", "b.words")


@query("documents", "chunks")
def word_count(d, c):
    a = d.select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_key"), X.word_chars(F.col("text")).alias("words"))
    return a.union(_chunks(c).select(F.lit("chunks"), "chunk_id", X.word_chars(F.col("content"))))


@query("documents")
def char_chunks(d):
    return chunking.character_chunks(d, "doc_id", "text")


@query("documents")
def units(d):
    at = unnest(_built(d), ["doc_id", "section_no"], chunking.units(F.col("blocks")), "unit_no", "u")
    return at.select("doc_id", "section_no", "unit_no", "u.start_char", "u.end_char", "u.block_index", X.word_chars(F.col("u.content")).alias("words"))


@query("documents")
def semantic_chunks(d):
    return chunking.semantic_chunks(d, "doc_id", "text")


@query("pdf_pages")
def page_merge(p):
    return chunking.page_chunks(p)


@query("chunks")
def pair_similarity(c):
    """Likeness of successive chunks of a file, by weighted character sequences."""
    from foliora.functions.rows import map_rows

    w = W.partitionBy("source").orderBy("chunk_index", "chunk_id")
    rows = _chunks(c).select("chunk_id", "content", F.lead("content").over(w).alias("next")).where("next is not null")
    return map_rows(rows, ["chunk_id", "content", "next"], lambda i, a, b: [(i, round(chunking.similarity(a or "", b), 6))], "chunk_id string, score double")


# --- tokens and queries ------------------------------------------------------------------------


@query("chunks")
def tokenize(c):
    return _chunks(c).select("chunk_id", F.array_join(tokens.tokenize(F.col("content")), " ").alias("tokens"))


@query("documents", "eval_cases")
def special_tokens(d, q):
    a = d.where("text is not null").select(F.col("doc_id").cast("string").alias("item"), F.array_join(tokens.special_tokens(F.col("text")), " ").alias("tokens"))
    b = _cases(q).where("query is not null").select(F.col("id").alias("item"), F.array_join(tokens.special_tokens(F.col("query")), " ").alias("tokens"))
    return a.union(b).where("tokens <> ''")


@query("chunks")
def version_tokens(c):
    v = F.filter(tokens.special_tokens(F.col("content")), lambda t: F.contains(t, F.lit("_")))
    return unnest(_chunks(c), ["chunk_id"], v, "_i", "token").groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query("chunks")
def keyword_text(c):
    return _chunks(c).where("content is not null").select("chunk_id", tokens.keyword_text(F.col("content")).alias("keyword_text"))


@query("eval_cases")
def analyze_query(q):
    a = tokens.analyze(_cases(q).select("id", "query"))
    return a.select("id", *(F.array_join(k, " ").alias(k) for k in ("required", "optional", "ignored")))


@query("eval_cases")
def token_class(q):
    at = unnest(_cases(q), [], tokens.query_tokens(F.coalesce("query", F.lit(""))), "_i", "token")
    return at.groupBy("token").agg(F.count("*").alias("n")).withColumn("class", tokens.token_class(F.col("token")))


@query("search_results", "chunks")
def match_evidence(r, c):
    """What of its query each logged chunk matches."""
    q = tokens.analyze(r.select("query_id", "query").dropDuplicates(["query_id"]))
    pairs = r.select("query_id", "id").distinct().join(q, "query_id").join(_chunks(c).select(F.col("chunk_id").alias("id"), "content"), "id")
    e = pairs.select("query_id", "id", F.coalesce("content", F.lit("")).alias("content"), "required", "optional").withColumn("e", keyword.evidence(F.col("required"), F.col("optional"), F.col("content")))
    return e.select("query_id", "id", F.array_join("e.matched_tokens", " ").alias("matched"), _r("e.required_coverage").alias("required_coverage"), _r("e.optional_coverage").alias("optional_coverage"), "e.exact_bonus")


@query("search_results", "chunks")
def structure_bonus(r, c):
    """Bonus of each logged chunk, its headings before it, for its query with the words of a function's description."""
    q = tokens.analyze(r.select("query_id", F.concat("query", F.lit("的功能")).alias("query")).dropDuplicates(["query_id"]))
    head = F.when(F.col("chunk_index") % 2 == 0, F.lit("功能说明\n")).otherwise(F.lit("函数原型\n"))
    content = _chunks(c).select(F.col("chunk_id").alias("id"), F.concat(head, F.coalesce("content", F.lit(""))).alias("content"))
    pairs = r.select("query_id", "id").distinct().join(q, "query_id").join(content, "id")
    return pairs.select("query_id", "id", keyword.structure_bonus(F.col("content"), F.col("required"), F.col("optional")).alias("bonus"))


@query("answers")
def dedupe_queries(a):
    """Queries of each collection as they were asked, without repetitions."""
    one = a.dropDuplicates(["answer_id"])
    return answer.dedupe_queries(one, "collection_id", "answer_id")


@query("answers")
def clean_query(a):
    """Rewritten queries without list marks and quotes."""
    return a.dropDuplicates(["answer_id"]).where("rewritten_query is not null").select("answer_id", answer.clean_query(F.concat(F.lit("1. “"), "rewritten_query", F.lit("”"))).alias("query"))


@query("answers")
def unsupported_answer(a):
    """The outcome of each logged answer: text shown, reason of a fallback, and whether sources are shown."""
    one = a.dropDuplicates(["answer_id"]).withColumn("ok", F.coalesce("context_sufficient", F.lit(False)))
    out = answer.conclude(F.col("ok"), F.coalesce("fallback_reason", F.lit("no_results")), F.col("answer"), F.col("answer").isNull())
    return one.select("answer_id", out.alias("o")).select("answer_id", "o.fallback_reason", "o.show_sources", F.sha2(F.encode("o.answer", "UTF-8"), 256).alias("answer_hash"))


# --- catalog -----------------------------------------------------------------------------------


@query("documents")
def file_dedupe(d):
    return catalog.import_files(d)


@query("registry")
def registry_state(g):
    return catalog.registry_states(g)


@query("registry")
def registry_upsert(g):
    """The states with every failed entry tried again."""
    s = catalog.registry_states(g)
    again = s.where(F.col("index_status") == catalog.FAILED).withColumn("index_status", catalog.transition(F.col("index_status"), "ingest")).withColumn("indexed_chunk_count", F.lit(0)).withColumn("last_error", F.lit(None).cast("string"))
    return catalog.upsert(s, again, ["file_id", "collection_id"]).select("file_id", "collection_id", "index_status", "indexed_chunk_count", "last_error")


@query("registry")
def active_jobs(g):
    return catalog.job_of(g).where(F.col("status").isin(catalog.QUEUED, catalog.RUNNING)).select("job_id", "file_id", "collection_id")


@query("registry")
def interrupted_jobs(g):
    return catalog.interrupt(catalog.job_of(g)).select("job_id", "status", "last_error")


QUERIES_RAW: dict[str, Callable[..., DataFrame]] = {k: v for k, v in globals().items() if k in QUERIES}
