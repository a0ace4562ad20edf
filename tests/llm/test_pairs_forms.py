import unicodedata

import pytest

from foliora.llm import lookalikes, pairs

GOOD = "The margin desk reviews the collateral ratio each day. It sends a notice."


@pytest.mark.parametrize(
    "query, answer, want",
    [
        ("What does the desk do?", GOOD, []),
        ("What?", None, ["empty"]),
        ("What?", " ​ ", ["empty"]),
        ("What?", "N/A", ["empty"]),
        ("What?", "**回答**：", ["empty"]),
        ("What?", "<p></p>", ["empty"]),
        ("What?", "```\n```", ["empty"]),
        ("What does the desk do?", "The margin desk reviews the collateral ratio each day and the", ["truncated"]),
        ("What does the desk do?", "The steps are:", ["truncated"]),
        ("How?", "The desk runs it each day.\n```\nfor row in rows:\n    keep(row", ["truncated"]),
        ("How?", "The desk runs it each day (see the", ["truncated"]),
        ("What does the desk do?", "Sorry, I won't help with that request. Try again later.", ["refusal"]),
        ("如何办理？", "很遗憾，这个问题超出了我的职责范围，恕不作答。", ["refusal"]),
        ("What does the desk do?", "Das kann ich leider nicht beantworten.", ["refusal"]),
        ("What?", "The message “cannot determine source” means that the registry row is missing. " + GOOD, []),
        ("What does the desk do with it?", "You asked: What does the desk do with it?", ["copied_question"]),
        ("如何重建查询词表？", "“如何重建查询词表”", ["copied_question"]),
        ("如何重建查询词表？", "如何重建查询词表？合规专员每季度重建查询词表，并反馈结果。", []),
        ("What does the desk do?", "合规专员每季度重建查询词表，并反馈结果。", ["other_language"]),
        ("What does the desk do?", "Die Prüfstelle sperrt die Aktien für jede Zweigstelle und die", ["other_language", "truncated"]),
        ("Answer in German, please: What does the desk do?", "Die Prüfstelle sperrt die Aktien für jede Zweigstelle.", []),
        ("请用英文回答：如何办理？", GOOD, []),
        ("Wer?", "8080", []),
        ("如何？", "top_k=8", []),
        ("如何？", "`kb ingest <file_id>`", []),
        ("如何？", "1. col_a\n2. col_b", []),
        (None, GOOD, []),
        ("Is it so?", "Yes.", []),
        ("如何合并质押股份明细？", "您的问题是：如何合并质押股份明细？", ["copied_question"]),
        ("Qual è il rapporto di margine?", "Il rapporto di margine è del 130 per cento.", []),
        ("How high is the margin ratio of account A?", "The margin ratio of account A is high.", []),
        ("Is it the desk or the branch?", "The branch", []),
        ("Wer prüft?", "„Der Nachtlauf prüft alle Anträge. Er meldet sie“, schrieb Fr. Harnic. Der Dienst sperrt sie.", []),
        ("Wer prüft?", "„Der Nachtlauf prüft alle Anträge. Er meldet sie", ["truncated"]),
        ("Wer prüft?", "Der Nachtlauf prüft alle Anträge innerhalb von zwei Arbeitstagen, z. B.", ["truncated"]),
        ("How?", "The desk locks it once per quarter, as defined in No.", ["truncated"]),
        ("How?", "The desk locks it once per quarter for Orbal Corp., Tand Ltd., etc.", []),
        ("How?", "The desk does this:\n1. It locks the account.\n2.", ["truncated"]),
        ("¿Quién revisa los contratos y cómo se archivan?", "A mesa de garantias compara os contratos vencidos e não libera as ações antes da abertura do mercado.", ["other_language"]),
        ("Who checks the contracts and when is it done?", "Petugas memeriksa kontrak yang jatuh tempo dan tidak akan melepaskan saham sebelum pasar dibuka.", ["other_language"]),
        ("Who checks the contracts?", "I am not in a position to say.", ["refusal"]),
    ],
)
def test_defects(query, answer, want):
    assert pairs.defects(query, answer) == want


def test_suffix_automaton_against_brute_force():
    s, t, least = "abcabxabcd", "zzabcabzabxabcyyab", 3
    inside = set()
    for i in range(len(t)):
        for j in range(i + least, len(t) + 1):
            if t[i:j] in s:
                inside |= set(range(i, j))
    assert pairs.SuffixAutomaton(s).coverage(t, least)[0] == len(inside)


def test_pair_tables(spark):
    df = spark.createDataFrame([(1, "q", None, None, "x"), (1, "q", None, None, "x"), (2, None, GOOD, "no_results", "y")], "answer_id bigint, query string, answer string, fallback_reason string, defect string")
    assert [tuple(r) for r in pairs.found(df).collect()] == [(1, "empty")]
    assert pairs.found(df.limit(0)).count() == 0
    assert {r["defect"]: (r["pairs"], r["with_fallback_reason"]) for r in pairs.report(df).collect()} == {"empty": (1, 0), "none": (1, 1)}


SAME = [("RX-0001", "RХ-0001"), ("ratio", "rаtiо"), ("ＫＢ１", "KB1"), ("a b", "a\u00a0b"), ("é", "e\u0301"), ("fi", "ﬁ"), ("口", "⼝"), ("re-only", "re‑only"), ("de\u200bsk", "desk"), ("が", "か\u3099"), ("理", "\uf9e4"), ("so\u00adft", "soft"), ("ä", "\u04d3"), ("S", "\ua4e2"), ("A", "\ua4ee"), ("v", "\u1d20"), ("o", "\u2c9f"), ("A", "\U000102a0")]
OTHER = [("a", "A"), ("e", "é"), ("1", "2"), ("0", "⁰"), ("1", "①"), ("a", "a."), ("（", "("), ("l", "1"), ("R", "ℝ"), ("A", "𝔄")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_look(a, b):
    assert lookalikes.comparison_form(a) == lookalikes.comparison_form(b)


@pytest.mark.parametrize("a, b", OTHER)
def test_other_look(a, b):
    assert lookalikes.comparison_form(a) != lookalikes.comparison_form(b)


def test_canonical_is_idempotent_and_leaves_stable_text_alone():
    for s in ("plain", "文本。", "Größe", *(x for p in SAME for x in p), "e\u200b\u0301", "\u0301a", "한국어", "กำลัง", "हिन्दी"):
        c = lookalikes.canonical(s)
        assert lookalikes.canonical(c) == c and unicodedata.is_normalized("NFC", c)
    assert lookalikes.canonical("Größe 文本。हिन्दी") == "Größe 文本。हिन्दी"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Москва", "Москва"), ("Αθήνα", "Αθήνα"), ("M\u006fcквa", "Москва"), ("\u0430pple", "apple"), ("marg\u0456n \u0441all", "margin call"), ("Ответ: да, \u0441\u043e\u0440", "Ответ: да, \u0441\u043e\u0440"),
        ("ratio \u0420\u0425 1", "ratio PX 1"), ("коэффициент PX", "коэффициент PX"), ("ℝ", "ℝ"), ("ＫＢ", "KB"),
    ],
)
def test_words_come_out_in_their_own_script(text, want):
    assert lookalikes.canonical(text) == want == lookalikes.canonical(want)


def test_classes_without_pairs(spark):
    texts = ["RX 1", "R\u0425 1", "RX 1", "rx 1", None, " ", "ab", "\u0430b"]
    df = spark.createDataFrame([(f"c{i}", t, 1) for i, t in enumerate(texts)] + [("c0", "RX 1", 1)], "id string, query string, item int")
    got = {r["item"]: tuple(r)[2:] for r in lookalikes.grouped(lookalikes.classes(df, "eval_case", "id", "query")).collect()}
    assert got == {"c0": ("c0", "c0", 2, 3), "c1": ("c0", "c1", 2, 3), "c2": ("c0", "c0", 2, 3), "c3": ("c3", "c3", 1, 1), "c6": ("c6", "c6", 2, 2), "c7": ("c6", "c7", 2, 2)}
    assert lookalikes.grouped(lookalikes.classes(df.limit(0), "eval_case", "id", "query")).count() == 0


def test_pairs_of_forms_against_brute_force(spark):
    texts = ["RX 1", "RХ 1", "RX\u00a01", "RX 1", "rx 1", None, "", " ", "ab", "а b", "a b"]
    cases = spark.createDataFrame([(f"c{i:02d}", t, 1) for i, t in enumerate(texts)] + [("c01", "RХ 1", 1)], "id string, query string, form int")
    chunks = spark.createDataFrame([("k1", "x", 1), ("k2", "x", 1)], "chunk_id string, content string, raw int")
    want = {("eval_case", f"c{i:02d}", f"c{j:02d}") for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a.strip() and b.strip() and a != b and lookalikes.comparison_form(a) == lookalikes.comparison_form(b)}
    assert {tuple(r) for r in lookalikes.found(cases, chunks).collect()} == want and len(want) == 6
    assert lookalikes.found(cases.limit(0), chunks.limit(0)).count() == 0
    n = {r["id"]: (r["canonical"], r["changed"]) for r in lookalikes.normalize(cases, "id", "query").collect()}
    assert n["c05"] == (None, False) and n["c01"] == ("RX 1", True) and n["c00"] == ("RX 1", False)
