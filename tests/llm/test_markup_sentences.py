import pytest

from foliora.llm import markup, sentences


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("plain text, nothing else.", []),
        ("Use <file_id> and List<int>; x < 3 and y > 5.", []),
        ("The fee rose from $12 to $15 in R&D [3]; 2 * 3 * 4; C:\\temp\\new\\fields; {env}; top_k_value", []),
        ("a<br>b", ["html"]),
        ("a &nbsp; b", ["html"]),
        ("<!-- note -->text", ["html"]),
        ("# Title\n\n- item", ["markdown"]),
        ("some **bold\ntext** here", ["markdown"]),
        ("see [this](http://x.y)", ["markdown"]),
        ("== Title ==\n\n'''bold''' [[Page|text]]{{cite|1}}", ["wiki"]),
        ("\\section{Title}\n\\textbf{x}~\\cite{a}", ["latex"]),
        ("value $\\alpha \\leq 2$ here", ["latex"]),
        ("# T\n\n$$\\frac{a}{b}$$\n\n<br/>", ["html", "latex", "markdown"]),
        ("```\n<div>{{ x }}</div>\n```", ["markdown"]),
        ("\\begin{verbatim}\n<b>**x**</b>\n\\end{verbatim}", ["latex"]),
    ],
)
def test_kinds(text, kinds):
    assert markup.clean(text)[1] == kinds


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<h1>T</h1><p>a<p>b <b>c</b></p><ul><li>x<li>y</ul>", "T\n\na\n\nb c\n\n- x\n- y"),
        ("<style>p{}</style><p hidden>no</p><p>yes</p><script>var a;</script>", "yes"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<p>1 &lt; 2 &amp; 3</p>", "1 < 2 & 3"),
        ("<pre><code>if a &lt; b:\n    c</code></pre>", "if a < b:\n    c"),
        ("## Head ##\n\n1. one\n1. two\n\n> said", "Head\n\n1. one\n1. two\n\nsaid"),
        ("| a | b |\n|---|--:|\n| ccc | d |", "a    b\nccc  d"),
        ("[text](http://u) and ![alt](i.png) and `code`", "text and alt and code"),
        ("== H ==\n\n*one\n*two\n\n[[A|b]] ''c''", "H\n\n- one\n- two\n\nb c"),
        ("\\subsection{H}\n\n\\emph{a} \\href{u}{b} {\\it c}\\\\\nd", "H\n\na b c\n\nd"),
        ("a\n\n\\begin{tabular}{lrr}\nrule & 21 & 72.65 \\\\\nlong rule & 6 & 1\n\\end{tabular}\n\nb", "a\n\nrule       21  72.65\nlong rule  6   1\n\nb"),
        ("\\begin{tabular}[t]{l@{}r}\\hline\n\\textbf{a} & R\\&D \\\\[2pt] \\hline\n\\multicolumn{2}{c}{2. c} & d\\\\\n\\end{tabular}", "a     R&D\n2. c       d"),
        ("\\begin{tabular*}{9cm}{ll}x & {y & z}\\end{tabular*} \\begin{tabular}{l}a & b\n\nc & d", "x  y & z\n\na  b\n\nc & d"),
        ("$$\\sum_{i=1}^{n} x_i$$", "\\sum_{i=1}^{n} x_i"),
    ],
)
def test_clean_text(text, clean):
    assert markup.clean(text)[0] == clean


def test_strip_markup_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", "c"), (4, "<b>x</b>" * 3000, "d"), (4, "<b>x</b>", "d")], "doc_id bigint, text string, kinds string")
    rows = sorted((r["doc_id"], len(r["clean"]) if r["clean"] is not None else None, r["kinds"]) for r in markup.strip_markup(df).collect())
    assert rows == [(1, None, []), (2, 0, []), (3, 1, []), (4, 1, ["html"]), (4, 3000, ["html"])]
    assert markup.found(df.limit(0)).count() == 0 and markup.strip_markup(df.limit(0)).count() == 0


def units(text):
    return [text[a:b] for a, b in sentences.spans(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Mr. Smith paid 3.5 p.m. yesterday. Next", ["Mr. Smith paid 3.5 p.m. yesterday.", "Next"]),
        ("for A Corp., B Ltd., etc. The risk engine", ["for A Corp., B Ltd., etc.", "The risk engine"]),
        ("Title\n\nText over\ntwo lines. End", ["Title", "Text over\ntwo lines.", "End"]),
        ("“One. Two,” wrote H. Harnic in it. Then", ["“One. Two,” wrote H. Harnic in it.", "Then"]),
        ("He asked, “Why? Who?” before 4 p.m.? Yes", ["He asked, “Why? Who?” before 4 p.m.?", "Yes"]),
        ("甲。乙！“丙。”丁：“戊。己！”随后庚。", ["甲。", "乙！", "“丙。”", "丁：“戊。己！”随后庚。"]),
        ("甲（乙。丙）。丁", ["甲（乙。丙）。", "丁"]),
        ("甲……但乙。详见Sec. 6.8。丙.丁", ["甲……但乙。", "详见Sec. 6.8。", "丙.", "丁"]),
        ("「甲。乙。」と言います。丙か？丁", ["「甲。乙。」と言います。", "丙か？", "丁"]),
        ("यह है। डॉ. ने लिखा। क्या?", ["यह है।", "डॉ. ने लिखा।", "क्या?"]),
        ("ทีมตรวจสอบ 150.35 ต่อปี ฝ่ายหลัก", ["ทีมตรวจสอบ 150.35 ต่อปี", "ฝ่ายหลัก"]),
        ("Am 6. März lag er bei 2,5 Prozent, z. B. ab Version v4.4. Das", ["Am 6. März lag er bei 2,5 Prozent, z. B. ab Version v4.4.", "Das"]),
        ("в EE. UU. y otros. Ещё т. е. так, 3 млн. руб. за год. Да", ["в EE. UU. y otros.", "Ещё т. е. так, 3 млн. руб. за год.", "Да"]),
        ("the window.When it is on kb.example now", ["the window.", "When it is on kb.example now"]),
        ("closes ... but only in branch B. With it", ["closes ... but only in branch B.", "With it"]),
        ("", []),
        (" \n \n ", []),
    ],
)
def test_sentence_units(text, want):
    assert units(text) == want


def test_units_cover_all_but_white_space():
    text = ("Mixed 文本。 (a. b) “c?” д. ") * 5000
    got = sentences.spans(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert "".join("".join(units(text)).split()) == "".join(text.split())


def test_sentence_tables(spark):
    docs = spark.createDataFrame([(1, "Aa. Bb.", 7), (2, None, 7), (3, "C.", 7), (1, "Aa. Bb.", 7)], "doc_id bigint, text string, end_char int")
    sample = spark.createDataFrame([(1,), (2,), (1,)], "doc_id bigint")
    assert sorted(map(tuple, sentences.found(docs, sample).collect())) == [(1, 3), (1, 7)]
    assert sentences.found(docs.limit(0), sample).count() == 0
    assert sentences.sentences(docs, "doc_id", "text").where("doc_id = 3").first()["sentence"] == "C."


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<div>" * 100_000 + "deep text" + "</div>" * 100_000, "deep text"),
        ("<b>" * 20_000 + "<ul><li>one</ul>", "\n- one"),
        ("<table><tr><td>" * 3000 + "x", "x"),
        ("**" + "bold text " * 500 + "**", "bold text " * 499 + "bold text"),
        ("__" + "under text " * 500 + "__", "under text " * 499 + "under text"),
        ('<p title="a hidden fee">Visible text</p>', "Visible text"),
        ("<p data-x='display:none'>Visible</p><p hidden>no</p><p HIDDEN=''>no</p><p style='color:red; Display : none'>no</p>", "Visible"),
        ("# " * 20_000 + "title", "# " * 19_999 + "title"),
        ("= " * 2000 + "title" + " =" * 2000, "= " * 1999 + "title" + " =" * 1999),
    ],
)
def test_deep_long_and_hidden_markup(text, clean):
    got, kinds = markup.clean(text)
    assert got.strip("\n") == clean.strip("\n") and kinds


def test_a_very_wide_cell_does_not_widen_its_column():
    got = markup.clean(f"<table><tr><td>{'w' * 5000}</td><td>a</td></tr><tr><td>n</td><td>b</td></tr></table>")[0]
    assert got.split("\n") == ["w" * 5000 + "  a", "n  b"]


def test_every_terminator_of_unicode_ends_a_sentence():
    import regex

    every = regex.findall(r"\p{Sentence_Break=STerm}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    assert len(every) > 150
    for c in every:
        text = f"क ख{c} ग घ{c}"
        assert sentences.spans(text) == [(0, 4), (5, 9)], hex(ord(c))


@pytest.mark.parametrize(
    "text, units",
    [
        ("The art. It is good.", ["The art.", "It is good."]),
        ("It is under art. 5 and fig. 3 of the rules. Then it ends.", ["It is under art. 5 and fig. 3 of the rules.", "Then it ends."]),
        ("We saw the desk at the rue. Then it was closed.", ["We saw the desk at the rue.", "Then it was closed."]),
        ("Das ist bzw. Der Wert ist es und die Zahl.", ["Das ist bzw. Der Wert ist es und die Zahl."]),
        ("This is what the hr. Then the desk is in it.", ["This is what the hr.", "Then the desk is in it."]),
        ("Really?‍́ Yes.", ["Really?‍́", "Yes."]),
        ("ꦲꦤꦕꦫꦏ꧉ ꦢꦠꦱꦮꦭ꧉", ["ꦲꦤꦕꦫꦏ꧉", "ꦢꦠꦱꦮꦭ꧉"]),
    ],
)
def test_rules_of_languages_and_scripts(text, units):
    assert [text[a:b] for a, b in sentences.spans(text)] == units
