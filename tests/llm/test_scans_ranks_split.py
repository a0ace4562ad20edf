import random

import pytest

from foliora.llm import ranks, scans, split

WORDS = "margin desk records collateral ratio branch risk engine validates overdue contract manual review extension form gateway rebuilds query vocabulary quarter nightly batch archives signed agreement".split()


def volume(pages=8):
    import textwrap

    rng = random.Random(4)
    rows = []
    for p in range(1, pages + 1):
        body = textwrap.wrap(" ".join(rng.choice(WORDS) for _ in range(60)), 58)
        rows.append([f"v:{p}", [f"Credit Handbook   {p + 40}" if p % 2 else "Crcdit Handbook", "", *body, f"- {p + 40} -"], "v", p])
    rows[2][1][3:3] = ["margin desk co1lateral exten-", "sion form records the nightly bat-", "ch of the desk"]
    return [[a, "\n".join(b), c, d] for a, b, c, d in rows]


def test_running_lines_numbers_and_misread_words(spark):
    df = spark.createDataFrame([tuple(r) for r in volume()], "page_doc_id string, content string, source string, page_number int")
    got = {tuple(r) for r in scans.found(df.union(df.limit(1))).collect()}
    want = {(f"v:{p}", 1, "header") for p in range(1, 9)} | {(r[0], len(r[1].split("\n")), "page_number") for r in volume()}
    assert got == want | {("v:3", 4, "misread"), ("v:3", 4, "hyphen"), ("v:3", 5, "hyphen")}
    text = "".join(r["text"] for r in scans.repair(df).where("page_doc_id = 'v:3'").collect())
    assert "margin desk collateral extension form records the nightly batch of the desk" in text and "Handbook" not in text


def test_split_words_and_hyphens_that_belong():
    d = scans.Decoder({"extension": 90, "cross-margin": 50, "margin": 80, "read-only": 40, "only": 60, "read": 40, "contract": 70, "the": 900})
    assert d.joined("exten", "sion") == "extension"
    assert d.joined("cross", "margin") is None and d.joined("read", "only") is None
    assert d.joined("con", "tr@ct") == "contract"
    assert d.word("tbe") == "the" and d.word("c0ntrac†") == "contract" and d.word("margin") is None and d.word("qqq") is None


@pytest.mark.parametrize(
    "page, text, noise",
    [
        ("the marg in desk", "the margin desk", []),
        ("(ex ten sion) of", "(extension) of", []),
        ("theextension form ofthe margindesk.", "the extension form of the margin desk.", []),
        ("the co1lat eral, deskrec0rds", "the collateral, desk records", [(1, "misread")]),
        ("the exten\nsion form", "the extension form", [(1, "hyphen")]),
        ("the cross-\nmargin desk", "the cross-margin desk", []),
        ("the check list of qqq", "the check list of qqq", []),
    ],
)
def test_words_split_and_merged_by_blanks(page, text, noise):
    model = {"extension": 90, "form": 600, "the": 9000, "of": 8000, "collateral": 70, "margin": 300, "cross-margin": 30, "desk": 200, "records": 100, "check": 40, "list": 50, "tension": 6}
    got, paragraphs, _ = scans.read_page(scans.Decoder(model), page, 1, None, [], [], [])
    assert got == noise and paragraphs == [text]


def test_very_long_tokens_and_words_with_two_confusions():
    d = scans.Decoder({"collateral": 300.0, "handling": 90.0})
    assert d.word("co1latera|") == "collateral" and d.word("haridlinq") == "handling"
    # no variant of such a token is a word, and none is made that no word begins with
    assert d.word("l1" * 50_000) is None and scans.read_page(d, "l1" * 50_000, 1, None, [], [], [])[0] == []


def test_a_corpus_many_times_as_large_is_read_alike(spark):
    rows = [tuple(r) for r in volume(12)]
    kinds = "page_doc_id string, content string, source string, page_number int"
    once = {tuple(r) for r in scans.found(spark.createDataFrame(rows, kinds), rate=4e-3).collect()}
    more = [(f"{k}/{a}", b, f"{k}/{c}", d) for k in range(10) for a, b, c, d in rows]
    tenfold = [tuple(r) for r in scans.found(spark.createDataFrame(more, kinds), rate=4e-3).collect()]
    assert once and sorted(tenfold) == sorted((f"{k}/{a}", n, w) for k in range(10) for a, n, w in once)


def test_long_paragraphs_stay_whole():
    page = "\n".join(["the margin desk records the collateral ratio of each"] * 150)
    assert len(scans.read_page(scans.Decoder({}), page, 1, None, [], [], [])[1]) == 1


def test_paragraphs_that_run_over_pages_come_out_whole(spark):
    pages = [
        ("a:1", "The desk records a ratio.\n\nThe branch archives the", "a", 1), ("a:2", "nightly batch and the signed", "a", 2), ("a:3", "", "a", 3), ("a:4", "agreement of the quarter.\n\nThe risk engine validates.", "a", 4),
        ("a:6", "goes nowhere and the", "a", 6), ("a:8", "stands after a gap.", "a", 8), ("b:1", "保证金通知由系统", "b", 1), ("b:2", "自动发送。", "b", 2), ("c", "no volume and the", None, 1), ("d", "no volume either and the", None, 2), ("e", "no number and the", "a", None),
    ]
    df = spark.createDataFrame(pages, "page_doc_id string, content string, source string, page_number int")
    got = {(r["page_doc_id"], r["text"], r["page_start"], r["page_end"]) for r in scans.continuous(df.union(df.limit(3))).collect()}
    assert got == {
        ("a:1", "The desk records a ratio.", 1, 1), ("a:1", "The branch archives the nightly batch and the signed agreement of the quarter.", 1, 4), ("a:4", "The risk engine validates.", 4, 4),
        ("a:6", "goes nowhere and the", 6, 6), ("a:8", "stands after a gap.", 8, 8), ("b:1", "保证金通知由系统自动发送。", 1, 2), ("c", "no volume and the", 1, 1), ("d", "no volume either and the", 2, 2), ("e", "no number and the", None, None),
    }
    assert scans.continuous(df.limit(0)).count() == 0


@pytest.mark.parametrize("line, value", [("- 12 -", 12), ("Page 3 of 9", 3), ("第 7 页", 7), ("1/5", 1), ("[l2]", 12), ("p. 4", 4), ("— 3 —", 3), ("2 |", 2), ("120.82 31.04", None), ("Chapter", None), ("Total 5", None)])
def test_page_numbers(line, value):
    assert scans.page_value(line) == value


def test_pages_with_nulls_and_none_at_all(spark):
    df = spark.createDataFrame([("a", None, "s", 1), ("b", "", None, None), ("c", "one line of text", None, 3), ("d", "x", "s", None)], "page_doc_id string, content string, source string, page_number int")
    assert scans.found(df).count() == 0 and scans.repair(df.limit(0)).count() == 0


def median_by_hand(rows, weights):
    scored = []
    for i in range(len(rows)):
        rs = []
        for k in range(len(weights)):
            col = [r[1 + k] for r in rows]
            key = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
            less = sum(key(v) < key(col[i]) for v in col)
            same = sum(key(v) == key(col[i]) for v in col)
            rs.append(less + (same + 1) / 2)
        total, at = 0.0, None
        for r, w in sorted(zip(rs, weights)):
            total += w
            if at is None and total >= sum(weights) / 2:
                at = r
        scored.append((at, sum(r * w for r, w in zip(rs, weights)) / sum(weights), rows[i][0]))
    return [i for *_, i in sorted(scored)]


@pytest.mark.parametrize("large", [10**9, 3])
def test_ranking_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(ranks, "LARGE_GROUP", large)
    monkeypatch.setattr(ranks, "SLICES", 3)
    rng = random.Random(1)
    data = []
    for g, n in (("a", 9), ("b", 2), (None, 4)):
        data += [(g, f"i{j}", rng.choice([None, 1.0, 2.0, 3.0, float("nan")]), rng.choice([1, 2, 500, None]), rng.random(), 5) for j in range(n)]
    df = spark.createDataFrame(data + data[:3] + [("a", None, 1.0, 1, 1.0, 5)], "g string, id string, x double, y int, z double, place int")
    scores, weights = {"x": "asc", "y": "desc", "z": "asc"}, {"x": 1, "y": 2, "z": 1}
    got = {}
    for r in ranks.ranking(df, "g", "id", scores, weights).orderBy("place").collect():
        got.setdefault(r["g"], []).append(r["id"])
    for g in ("a", "b", None):
        assert got[g] == median_by_hand([(r[1], r[2], None if r[3] is None else -r[3], r[4]) for r in data if r[0] == g], [1, 2, 1])
    firsts = {r["g"]: r["id"] for r in ranks.first(df, "g", "id", scores, weights).collect()}
    assert firsts == {g: v[0] for g, v in got.items()}
    assert ranks.ranking(df.limit(0), "g", "id", scores).count() == 0


TEXT = "\n\n".join(" ".join(f"Sentence number {i * 10 + j} speaks of margin loans." for j in range(8)) for i in range(12))


@pytest.mark.parametrize("text, size, overlap", [(TEXT, 300, 40), (TEXT, 300, 0), ("字" * 5000, 200, 50), ("x" * 999, 100, 99), ("a b " * 2000, 70, 10), (". " * 50 + "abc" * 200, 50, 5), ("é" * 400, 60, 0)])
def test_pieces(text, size, overlap):
    got = split.pieces(text, size, overlap)
    count = lambda a, b: sum(c.isalnum() for c in text[a:b])
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and count(c, b) == overlap
    assert all(count(a, b) <= size for a, b in got)


def test_pieces_end_at_natural_boundaries():
    assert all(TEXT[:b].rstrip().endswith(".") for _, b in split.pieces(TEXT, 300, 40))


def test_an_edit_alters_only_pieces_near_it():
    a = split.pieces(TEXT, 300, 40)
    edited = TEXT[:50] + "Inserted words here. " + TEXT[50:]
    shift = len(edited) - len(TEXT)
    b = split.pieces(edited, 300, 40)
    same = {TEXT[x:y] for x, y in a} & {edited[x:y] for x, y in b}
    assert shift > 0 and len(same) >= len(a) // 2


def test_small_and_odd_items(spark):
    assert split.pieces("", 10, 2) == [] and split.pieces("short", 10, 2) == [(0, 5)]
    with pytest.raises(ValueError):
        split.pieces("abc", 5, 5)
    limits = spark.createDataFrame([("documents", ".md", 20, 4), ("chunks", "*", 10, 2)], "item_table string, file_type string, max_size int, overlap_size int")
    docs = spark.createDataFrame([(1, "word " * 20, ".md", "x"), (1, "word " * 20, ".md", "x"), (2, "word " * 20, ".pdf", "x"), (3, None, ".md", "x"), (4, "... " * 20, ".md", "x")], "doc_id bigint, text string, file_type string, max_size string")
    chunks = spark.createDataFrame([("c", "word " * 9), ("d", "tiny")], "chunk_id string, content string")
    assert {tuple(r) for r in split.found(docs, chunks, limits).collect()} == {("documents", "1"), ("chunks", "c")}
    assert split.found(docs.limit(0), chunks.limit(0), limits).count() == 0
