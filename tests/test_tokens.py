import sqlite3

import pytest
from pyspark.sql import functions as F

from foliora.operators import keyword
from foliora.operators import tokens as T


def tokens_of(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(T.tokenize(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Größe V1.2", ["v1_2", "v12", "gr", "e", "v1", "2"]),
        ("甲乙丙丁", ["甲乙", "乙丙", "丙丁", "甲乙丙", "乙丙丁"]),
        ("甲", []),
        ("", []),
        (None, []),
        ("Q3 x", ["q3", "question3", "x"]),
        ("第 三 题", ["第三题"]),
        ("1.2.3a", ["1_2", "12", "1", "2", "3a"]),
    ],
)
def test_tokenize(spark, text, expected):
    assert tokens_of(spark, text) == expected


def test_analyze(spark):
    q = spark.createDataFrame([("a", "Q3 retriever"), ("b", "接口的功能是什么？"), ("c", None), ("d", "the 2024 plan 7")], "id string, query string")
    rows = {r["id"]: r for r in T.analyze(q).collect()}
    assert (rows["a"]["required"], rows["a"]["optional"]) == (["q3", "question3", "retriever"], [])
    assert rows["b"]["optional"] == ["接口", "功能", "口的功"] and rows["b"]["required"] == []
    assert rows["c"]["required"] == rows["c"]["optional"] == rows["c"]["ignored"] == []
    assert rows["d"]["required"] == ["the", "2024", "plan"] and rows["d"]["ignored"] == ["7"]


def test_term_count_is_the_number_of_index_terms(spark):
    texts = ["v1.2 甲乙丙 x", "", "Q3", "甲", "a_b 1-2-3 文字", "第3题 Q12 9.9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(T.term_count(F.col("t")).alias("n"), F.size(T.index_terms(F.col("t"))).alias("m")).collect():
        assert r["n"] == r["m"]


def test_bm25_agrees_with_a_full_text_index(spark):
    texts = ["margin call v1.2 notice", "call the margin desk", "v1.2 v1.2 release", "1 2 v1 plain", "甲乙丙 margin", "", "notice notice notice", "v12 only", "desk v1.2.3"]
    chunks = spark.createDataFrame([("col", f"c{i}", t, "s", "f") for i, t in enumerate(texts)], "collection_id string, chunk_id string, content string, source string, file_id string")
    asked = ["margin v1.2", "notice desk", "甲乙丙", "absent notice"]
    queries = spark.createDataFrame([(f"q{i}", q, "col", None) for i, q in enumerate(asked)], "query_id string, query string, collection_id string, top_k int")
    got = {(r["query_id"], r["chunk_id"]): r["raw_bm25"] for r in keyword.candidates(queries, chunks).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, t, tokenize='unicode61')")
    for r in chunks.select("chunk_id", T.keyword_text(F.col("content")).alias("t")).collect():
        db.execute("insert into f values (?, ?)", (r["chunk_id"], r["t"]))
    want = {}
    for r in T.analyze(queries).collect():
        find = lambda ts, op: db.execute("select id, bm25(f) from f where f match ?", (f" {op} ".join(f'"{t}"' for t in ts),)).fetchall()
        rows = find(r["required"], "AND") if r["required"] else []
        rows = rows or find([*r["required"], *r["optional"]], "OR")
        want |= {(r["query_id"], i): s for i, s in rows}
    assert got.keys() == want.keys() and want
    for k, s in want.items():
        assert got[k] == pytest.approx(s, abs=1e-9)


def test_search_handles_empty_tables_and_clashing_names(spark):
    chunks = spark.createDataFrame([("col", "c1", "margin call", "s", "f", 1, 2)], "collection_id string, chunk_id string, content string, source string, file_id string, df int, query_id int")
    queries = spark.createDataFrame([("q", "margin", "col", 3), ("n", None, "col", 3)], "query_id string, query string, collection_id string, top_k int")
    assert [r["chunk_id"] for r in keyword.search(queries, chunks).collect()] == ["c1"]
    assert keyword.search(queries, chunks.limit(0)).count() == 0
    assert keyword.search(queries.limit(0), chunks).count() == 0


def test_score_ceiling_and_structure(spark):
    chunks = spark.createDataFrame([("c", "a", "功能说明 conv2d 的说明", "s", "f"), ("c", "b", "函数原型 conv2d", "s", "f"), ("c", "d", "conv2d", "s", "f")], "collection_id string, chunk_id string, content string, source string, file_id string")
    q = spark.createDataFrame([("q", "conv2d 的功能", "c", 5)], "query_id string, query string, collection_id string, top_k int")
    rows = {r["chunk_id"]: r for r in keyword.search(q, chunks).collect()}
    assert rows["a"]["structure_bonus"] == 1.0 and rows["b"]["structure_bonus"] == 0.6 and rows["d"]["structure_bonus"] == 0.0
    assert all(0 <= r["keyword_score"] <= 1 for r in rows.values())
