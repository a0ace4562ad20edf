import random

import pytest
from pyspark.sql import functions as F

from foliora.errors import ConfigurationError
from foliora.functions import text as X
from foliora.operators import chunking, clean, sections


def one(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_strip_knows_all_white_space(spark):
    s = "　\x1c a b  \n"
    assert one(spark, X.strip(F.col("t")), s) == s.strip()
    assert one(spark, X.has_content(F.col("t")), " 　\n") is False
    assert one(spark, X.has_content(F.col("t")), None) is False


def test_preview_and_fixed(spark):
    assert one(spark, X.preview(F.col("t"), 3), "ab cd") == "ab..."
    assert one(spark, X.preview(F.col("t"), 5), "ab cd") == "ab cd"
    assert spark.range(1).select(X.fixed(F.lit(0.5)).alias("x")).first()["x"] == "0.500"


@pytest.mark.parametrize(
    "line, key",
    [("", ""), ("-----", ""), ("Page 3 / 9", "<page-marker>"), ("第 三 页", "<page-marker>"), ("- 12 -", "<page-marker>"), ("Handbook 12", "handbook <num>"), ("x", ""), ("7", "<num>"), ("Rules – Vol. II", "rules vol ii")],
)
def test_edge_key(spark, line, key):
    assert one(spark, clean.edge_key(F.col("t")), line) == key


def test_clean_drops_lines_without_text(spark):
    df = spark.createDataFrame([(1, "Title\r\n-----\n(12)\nbody  text\nPage 3\n", ".txt"), (2, "a\nPage 3\nb", ".pdf"), (3, None, ".md")], "id int, text string, file_type string")
    rows = {r["id"]: r["cleaned"] for r in clean.clean_documents(df).collect()}
    assert rows == {1: "Title\nbody  text\nPage 3\n", 2: "a\nb", 3: None}


def test_repeated_edges(spark):
    pages = [(f"p{i}", "s", i, f"Handbook {i}\nbody {'xyz'[i % 3]} text goes on {i * 7}\nmore {i}\nlast line {chr(97 + i)}\nfoot note", ".pdf") for i in range(1, 6)] + [("p1", "s", 1, "Handbook 1\nbody y text goes on 7\nmore 1\nlast line b\nfoot note", ".pdf")]
    df = spark.createDataFrame(pages, "page_doc_id string, source string, page_number int, content string, file_type string")
    keys = {(r["side"], r["key"]): r["pages"] for r in clean.page_edges(df).collect()}
    assert keys[("top", "handbook <num>")] == 5 and keys[("bottom", "foot note")] == 5
    cleaned = {r["page_doc_id"]: r["cleaned"] for r in clean.clean_pages(df).collect()}
    assert "Handbook" not in cleaned["p2"] and "foot" not in cleaned["p2"] and "last line c" in cleaned["p2"]
    assert clean.clean_pages(df.limit(0)).count() == 0


def test_sections_at_headings(spark):
    text = "intro\nQ1: first\nbody\n问题 2、second\nQ12x no\n第三题"
    got = [(s["start_char"], s["end_char"], s["hard_break_key"]) for s in one(spark, sections.sections(F.col("t")), text)]
    assert [k for *_, k in got] == [None, "Q1", "问题2", "第三题"]
    assert "".join(text[a:b] for a, b, _ in got) == text
    assert [(s["start_char"], s["hard_break_key"]) for s in one(spark, sections.sections(F.col("t")), "plain")] == [(0, None)]


def test_blocks_and_their_offsets(spark):
    text = "  a \n b\n\n\n c  c \n\n \n"
    df = spark.createDataFrame([(text,)], "t string")
    plain = df.select(sections.blocks(F.col("t"), F.lit(10), F.lit(False)).alias("x")).first()["x"]
    assert [(b["content"], b["start_char"], b["end_char"], b["words"]) for b in plain] == [("a\nb", 12, 17, 2), ("c c", 21, 25, 2)]
    pdf = spark.createDataFrame([("under-\nlying co-\nOp 甲\n乙 x",)], "t string").select(sections.blocks(F.col("t"), F.lit(0), F.lit(True)).alias("x")).first()["x"]
    assert pdf[0]["content"] == "underlying co- Op 甲乙 x"


def merge_by_hand(sizes, least, most):
    out, skip = [], False
    for i, n in enumerate(sizes):
        if skip:
            skip = False
        elif n >= least:
            out.append([i, i, n])
        elif i + 1 < len(sizes) and n + sizes[i + 1] <= most:
            out.append([i, i + 1, n + sizes[i + 1]])
            skip = True
        elif out and out[-1][2] + n <= most:
            out[-1] = [out[-1][0], i, out[-1][2] + n]
        else:
            out.append([i, i, n])
    return out


def test_merge_blocks_against_a_loop(spark):
    rng = random.Random(5)
    cases = [[rng.choice([1, 3, 5, 9, 12, 20]) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = [(k, [("x" * n, i, i, n) for i, n in enumerate(c)]) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, bs array<{sections.BLOCK}>")
    for r in df.select("k", sections.merge_blocks(F.col("bs"), 6, 14).alias("m")).collect():
        want = merge_by_hand(cases[r["k"]], 6, 14)
        assert [[b["start_char"], b["end_char"], b["words"]] for b in r["m"]] == [[a, b, n] for a, b, n in (want if len(cases[r["k"]]) > 1 else [[0, 0, cases[r["k"]][0]]])]
        folded = chunking.fold_small([(i, i, n) for i, n in enumerate(cases[r["k"]])], lambda x: x[2], lambda a, b: (a[0], b[1], a[2] + b[2]), 6, 14)
        if len(cases[r["k"]]) > 1:
            assert [list(x) for x in folded] == want


def windows_by_hand(text, size, overlap):
    at = [i for i, c in enumerate(text) if c.isalnum()]
    if not text:
        return []
    out, k = [], 0
    while True:
        start = 0 if k == 0 else at[k]
        end = at[k + size] if k + size < len(at) else len(text)
        out.append((start, end))
        if end == len(text):
            return out
        k += size - overlap


def test_windows_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  甲,.\n") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["ab cd ef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((3, 1), (5, 0), (4, 3)):
        for r in df.select("i", chunking.windows(F.col("t"), size, overlap).alias("w")).collect():
            assert [(w["start_char"], w["end_char"]) for w in r["w"]] == windows_by_hand(texts[r["i"]], size, overlap)


def test_character_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "ab cd ef"), (2, None), (3, ""), (4, " \n"), (5, "...")], "id int, t string")
    rows = [(r["id"], r["chunk_index"], r["content"]) for r in chunking.character_chunks(df, "id", "t", 3, 1).orderBy("id", "chunk_index").collect()]
    assert rows == [(1, 1, "ab c"), (1, 2, "cd e"), (1, 3, "ef"), (5, 1, "...")]


@pytest.mark.parametrize("scores, want", [([0.4, 0.5, 0.6, 0.7, 0.9], 0.5), ([0.2, 0.4, 0.6, 0.8], 0.35), ([0.5, 0.52, 0.55], 0.35), ([0.9], 0.35)])
def test_cutoff(spark, scores, want):
    df = spark.createDataFrame([(scores,)], "s array<double>")
    assert df.select(chunking.cutoff(F.col("s")).alias("x")).first()["x"] == want == chunking.break_at(scores, 0.35)


def test_semantic_chunks(spark):
    long = "\n\n".join(f"Paragraph {i} about margin loans and collateral. " * 6 for i in range(6))
    df = spark.createDataFrame([(1, long, ".txt"), (2, None, ".txt"), (3, "  ", ".md"), (4, "short", ".pdf")], "doc_id int, text string, file_type string")
    rows = chunking.semantic_chunks(df, "doc_id", "text", size=300, least=40).collect()
    mine = [r for r in rows if r["doc_id"] == 1]
    assert {r["doc_id"] for r in rows} == {1, 4} and len(mine) > 1
    assert all(chunking.words(r["content"]) <= 300 for r in mine) and [r["chunk_index"] for r in sorted(mine, key=lambda r: r["start_char"])] == list(range(1, len(mine) + 1))


def test_pages_are_joined_only_where_they_fit(spark):
    def draft(page, text, n=0, key=None):
        return ("s", page, 0, n, key, text, 0, len(text), 1.0)

    rows = [draft(1, "margin loan rules"), draft(2, "margin loan rules too"), draft(4, "margin loan rules"), draft(5, "margin loan rules", key="Q1"), draft(6, "zzz qqq")]
    df = spark.createDataFrame(rows, "source string, page_number int, section_no int, draft_no int, hard_break_key string, content string, start_char int, end_char int, score double")
    got = sorted((r["page_start"], r["page_end"]) for r in chunking.merge_pages(df, 800, 0.5).collect())
    assert got == [(1, 2), (4, 4), (5, 5), (6, 6)]


def test_parameters_are_checked():
    for bad in ({"size": 0}, {"overlap": 800}, {"least": -1}, {"threshold": 2}, {"max_units": 0}):
        with pytest.raises(ConfigurationError):
            chunking.check_parameters(**bad)
    assert chunking.strategy(" Semantic ") == "semantic"
    with pytest.raises(ConfigurationError):
        chunking.strategy("other")


def test_likeness_against_dense_rows():
    import numpy as np

    texts = ["The margin desk  records the ratio.", "the margin desk rebuilds the form", "文本检索 margin", "x", "", "The margin desk  records the ratio."]
    bags = []
    for t in texts:
        t = __import__("re").sub(r"\s\s+", " ", t.lower())
        bags.append([t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)])
    names = sorted({g for b in bags for g in b})
    m = np.array([[b.count(g) for g in names] for b in bags], float)
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(0))) + 1
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    want = [chunking.cosine(m[max(0, i - 1) : i + 1].mean(0), m[i + 1 : i + 3].mean(0)) for i in range(len(texts) - 1)]
    assert chunking.boundary_scores(texts) == pytest.approx(want, abs=1e-12)
    assert chunking.similarity("ab", "ab ") == 1.0 and chunking.similarity("", "x") == 0.0 and chunking.similarity("a", "b") == 0.0
    assert chunking.boundary_scores(["a", "b"], lambda ts: [[1.0, 0.0], [1.0, 0.0]]) == [1.0]
