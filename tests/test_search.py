import numpy as np
import pytest
from pyspark.sql import functions as F

from foliora.errors import IndexConsistencyError, VectorStoreError
from foliora.functions import vectors as V
from foliora.operators import answer, catalog, evaluate, hybrid, vector


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [], [[1.0, 2.0], [3.0, 6.0]])], "a array<double>, b array<double>, e array<double>, m array<array<double>>")
    r = df.select(V.cosine_score(F.col("a"), F.col("b")).alias("c"), V.cosine_score(F.col("a"), F.col("e")).alias("z"), V.squared_distance(F.col("a"), F.col("b")).alias("d"), V.mean(F.col("m")).alias("m")).first()
    assert (r["c"], r["z"], r["d"], r["m"]) == (0.96, 0.0, 2.0, [2.0, 4.0])
    s = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (None,)], "d double").select(V.distance_score(F.col("d")).alias("s")).collect()
    assert [x["s"] for x in s] == [1.0, 0.5, 0.25, None]


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(300)] + [(900, None, 1), (901, [1.0], 1)], "vec_id bigint, embedding array<float>, query_id int")


def exact(rows, q, k):
    d = sorted((float(((np.array(e, float) - np.array(q, float)) ** 2).sum()), i) for i, e in rows)
    return [i for _, i in d[:k]]


def test_exact_search_against_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)  # several rounds
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] and len(r["embedding"]) == 8]
    asked = vectors.where("vec_id % 20 = 0 and vec_id < 300").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vector.search(asked, vectors, 5).orderBy("query_id", "vector_rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(by) == 15 and all(by[q] == exact(rows, e, 5) for q, e in rows if q in by)
    assert vector.search(asked.limit(0), vectors, 5).count() == 0 and vector.search(asked, vectors.limit(0), 5).count() == 0
    with pytest.raises(VectorStoreError):
        vector.search(asked, vectors, 0)


def test_queries_of_any_width_are_answered(spark, monkeypatch):
    v = spark.createDataFrame([(1, [0.0]), (2, [5.0]), (3, [0.0, 1.0]), (4, [2.0, 2.0]), (5, None)], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(10, [4.0]), (11, [0.0, 0.0]), (12, [1.0, 2.0, 3.0]), (13, None)], "query_id bigint, embedding array<float>")
    for block in (1, 2, 4096):
        monkeypatch.setattr(vector, "BLOCK", block)
        assert sorted((r["query_id"], r["vec_id"]) for r in vector.search(q, v, 1).collect()) == [(10, 2), (11, 3)]


def test_numbering_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS x", "id % 3 AS place")
    rows = catalog.numbered(df.drop("place"), "x", "id").collect()
    assert sorted((r["x"], r["place"]) for r in rows) == [(i, i + 1) for i in range(1000)] and catalog.numbered(df.drop("place").limit(0), "x").count() == 0


def test_search_within_groups(spark):
    v = spark.createDataFrame([("a", [0.0], "x"), ("b", [1.0], "y"), ("c", [2.0], "x"), ("d", [2.0], "x"), ("e", [9.0], None)], "vec_id string, embedding array<double>, g string")
    q = spark.createDataFrame([("q", [1.9], "x"), ("r", [1.9], "y"), ("s", [0.0], "none")], "query_id string, embedding array<double>, g string")
    got = [(r["query_id"], r["vec_id"]) for r in vector.search(q, v, 2, group="g").orderBy("query_id", "vector_rank").collect()]
    assert got == [("q", "c"), ("q", "d"), ("r", "b")]


def test_index_holds_every_vector_and_recalls(spark, vectors):
    sound = vectors.where(F.size("embedding") == 8)
    centres = vector.fit_cells(sound, cells=8)
    indexed = vector.index(sound, centres)
    assert indexed.count() == 300
    asked = sound.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = {(r["query_id"], r["vec_id"]) for r in vector.search_index(asked, indexed, centres, 5, probes=5).collect()}
    true = {(r["query_id"], r["vec_id"]) for r in vector.search(asked, sound, 5).collect()}
    assert len(near & true) / len(true) >= 0.9


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id int, x string")
    b = spark.createDataFrame([(2, "c"), (2, "c"), (3, "d")], "vec_id int, x string")
    assert sorted(map(tuple, vector.upsert(a, b).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_hybrid_scores_and_order(spark):
    v = spark.createDataFrame([("q", "a", 0.5, 1.0, 1), ("q", "b", 0.5, 1.0, 2)], "query_id string, id string, vector_score double, raw_distance double, vector_rank int")
    k = spark.createDataFrame([("q", "a", 0.6, -2.0, 1), ("q", "c", 0.6, -1.0, 2)], "query_id string, id string, keyword_score double, raw_bm25 double, keyword_rank int")
    rows = {r["id"]: (round(r["hybrid_score"], 6), r["hybrid_rank"]) for r in hybrid.fuse(v, k).collect()}
    assert rows == {"a": (0.535, 1), "b": (0.325, 2), "c": (0.21, 3)}


def test_index_consistency(spark):
    c = spark.createDataFrame([("k", "s1", "1"), ("k", "s2", "2")], "collection_id string, source string, chunk_id string")
    hybrid.check_indexes(c, c)
    with pytest.raises(IndexConsistencyError):
        hybrid.check_indexes(c, c.where("source = 's1'"))
    r = hybrid.compare_indexes(c, c.where("source = 's1'")).first()
    assert (r["missing_in_vector"], r["missing_in_keyword"], r["consistent"]) == (1, 0, False)


RESULT = "query_id string, id string, score double, source string, page_label string, content string"


def test_judge_and_confidence(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    r = spark.createDataFrame([("a", "1", 0.75, "s", "1", "x" * 80), ("b", "1", 0.449, "s", "1", "x" * 200), ("c", "1", 0.9, None, "1", "short"), ("d", "1", None, "s", "1", "  ")], RESULT)
    got = {x["query_id"]: (x["context_sufficient"], x["fallback_reason"]) for x in answer.judge(q, r).collect()}
    assert got == {"a": (True, None), "b": (False, "best_score_below_min_score"), "c": (False, "content_chars_below_min_chars"), "d": (False, "no_results")}
    conf = {x["query_id"]: x["confidence"] for x in answer.confidence(q, r.where("query_id <> 'd'")).collect()}
    assert conf == {"a": "high", "b": "low", "c": "high", "d": "low"}


def pack_by_hand(rows, budget):
    out, used = [], 0
    for i, (ident, score, source, page, content) in enumerate(sorted((r for r in rows if r[4].strip()), key=lambda r: (-(r[1] or 0.0), r[0])), 1):
        head = f"[{i}] [source: {source or 'unknown'} | page: {page} | score: {'n/a' if score is None else f'{score:.3f}'}]"
        room = budget - used - (2 if out else 0)
        if room <= 0:
            break
        body = content.strip()
        if len(head) + 1 + len(body) > room:
            if room - len(head) - 1 <= 0:
                break
            body = body[: room - len(head) - 1].rstrip()
        out.append(f"{head}\n{body}")
        used += (2 if len(out) > 1 else 0) + len(out[-1])
        if used >= budget:
            break
    return "\n\n".join(out)


@pytest.mark.parametrize("budget", [30, 90, 120, 150, 400, 4000])
def test_context_packing_against_a_loop(spark, budget):
    rows = [("a", 0.91, "s1", "1", " alpha beta "), ("b", 0.5, None, "2-3", "gamma " * 10), ("c", None, "s3", "n/a", "delta"), ("d", 0.5, "s4", "4", "  "), ("e", 0.25, "s5", "4", "omega")]
    df = spark.createDataFrame([("q", i, s, src, p, c) for i, s, src, p, c in rows], RESULT)
    got = answer.pack(df, budget).first()
    assert (got["context"] if got else "") == pack_by_hand(rows, budget)


def test_queries_are_cleaned_and_merged(spark):
    q = spark.createDataFrame([("g", i, t) for i, t in enumerate(["- “Margin call”", "margin CALL", "2) other", " ", None, "* `x`"])], "g string, i int, query string")
    assert [r["query"] for r in answer.dedupe_queries(q, "g", "i").orderBy("query_no").collect()] == ["Margin call", "other", "x"]
    r = spark.createDataFrame([("g", 0, 1, "a", 0.5), ("g", 1, 1, "a", 0.5), ("g", 1, 2, "b", 0.9), ("g", 0, 2, "c", None)], "g string, query_no int, rank int, id string, score double")
    got = [(x["place"], x["id"], x["query_no"]) for x in answer.merge_queries(r, "g", 3).orderBy("place").collect()]
    assert got == [(1, "b", 1), (2, "a", 0), (3, "c", 0)]


def test_labels(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 3, None), (None, None, 1), (None, None, 5)], "a int, b int, n int")
    assert [r["x"] for r in df.select(answer.page_label(F.col("a"), F.col("b"), count=F.col("n")).alias("x")).collect()] == ["1", "1-3", "1", "n/a"]


def test_scoring_cases(spark):
    cases = spark.createDataFrame([("1", ["b.md"], [], ["Margin"]), ("2", [], ["f9"], None), ("3", None, None, [])], "id string, expected_sources array<string>, expected_file_ids array<string>, expected_keywords array<string>")
    hits = spark.createDataFrame([("1", 1, "x/a.md", "f1", "none", ["z"]), ("1", 2, "y/b.md", "f2", "the margin", None), ("2", 1, "x", "f1", None, None)], "case_id string, rank int, source string, file_id string, content string, matched_tokens array<string>")
    scored = evaluate.score_cases(cases, hits)
    rows = {r["id"]: r for r in scored.collect()}
    assert (rows["1"]["first_hit_rank"], rows["1"]["mrr"], rows["1"]["keyword_hit"], rows["1"]["file_hit"]) == (2, 0.5, True, None)
    assert (rows["2"]["file_hit"], rows["2"]["hit_at_k"], rows["3"]["source_hit"]) == (False, 0.0, None)
    rep = evaluate.report(scored).first()
    assert rep["case_count"] == 3 and rep["recall_at_k"] == pytest.approx(1 / 3) and rep["source_hit_rate"] == 1.0
    assert evaluate.report(scored.limit(0)).first()["mrr"] is None


def test_spread_takes_evenly_spaced_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "g string, i int")
    got = sorted(r["i"] for r in evaluate.spread(df, "g", ["i"], 4).where("g = 'a'").collect())
    assert got == sorted({round(j * 9 / 3) for j in range(4)})
    assert evaluate.spread(df, "g", ["i"], 1).count() == 2 and evaluate.spread(df, "g", ["i"], 0).count() == 0


def test_catalog_states(spark):
    log = spark.createDataFrame(
        [("f", "c", "indexing", 0, None, "2031-01-01 00:00:00"), ("f", "c", "indexed", 5, None, "2031-01-03 00:00:00"), ("f", "c", "indexing", 0, None, "2031-01-02 00:00:00"), ("g", "c", "failed", 0, "boom", "2031-01-01 00:00:00"), ("h", "c", "indexing", 0, None, "2031-01-01 00:00:00"), ("h", "c", "indexing", 0, None, "2031-01-01 00:00:00")],
        "file_id string, collection_id string, index_status string, indexed_chunk_count int, last_error string, recorded_at string",
    )
    s = {r["file_id"]: r["index_status"] for r in catalog.registry_states(log).collect()}
    assert s == {"f": "indexed", "g": "failed", "h": "indexing"}
    files = spark.createDataFrame([("f", "a", "active", 1), ("g", "b", "active", 1), ("x", "c", "deleted", 1)], "file_id string, original_name string, status string, created_at int")
    assert [r["file_id"] for r in catalog.deletable(files, log).collect()] == ["g"]
    jobs = catalog.job_of(log)
    assert {r["file_id"]: r["status"] for r in jobs.collect()} == {"f": "succeeded", "g": "failed", "h": "running"}
    assert {r["file_id"]: r["status"] for r in catalog.interrupt(jobs).collect()} == {"f": "succeeded", "g": "failed", "h": "failed"}
    assert catalog.registry_states(log.limit(0)).count() == 0
    t = spark.createDataFrame([("indexed",), ("failed",), (None,)], "s string").select(catalog.transition(F.col("s"), "ingest").alias("i"), catalog.transition(F.col("s"), "de_ingest").alias("d")).collect()
    assert [(r["i"], r["d"]) for r in t] == [(None, "de_ingested"), ("indexing", None), ("indexing", None)]
