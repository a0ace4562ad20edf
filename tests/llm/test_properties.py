import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from foliora.llm import abuse, lookalikes, markup, mix, pairs, scans, sentences, split

ALPHABET = "aA1 .!?。“”()（）\n-<>b/&;*_`$\\{}[]|'=#文本е́​ｱ가คที่हि"
texts = st.text(alphabet=ALPHABET, max_size=120) | st.text(max_size=60)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_canonical_form(s):
    c = lookalikes.canonical(s)
    assert lookalikes.canonical(c) == c and unicodedata.is_normalized("NFC", c)
    assert lookalikes.comparison_form(lookalikes.comparison_form(s)) == lookalikes.comparison_form(s)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_units_are_apart_and_hold_all_but_white_space(s):
    got = sentences.spans(s)
    assert all(s[a:b] == s[a:b].strip() and s[a:b] for a, b in got)
    assert "".join("".join(s[a:b] for a, b in got).split()) == "".join(s.split())


@settings(max_examples=150, deadline=None)
@given(texts)
def test_nothing_breaks_on_odd_text(s):
    clean, kinds = markup.clean(s)
    assert kinds or clean == s
    assert set(pairs.defects(s, s)) <= {"empty", "refusal", "truncated", "copied_question", "other_language"}
    assert abuse.features(s) is not None and 0 <= abuse.fit([]).document(s)[0] <= 1
    noise, _, _ = scans.read_page(scans.Decoder({"the": 50}), s, 1, 0, [], [], [])
    assert all(1 <= n <= s.count("\n") + 1 for n, _ in noise)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 文\n.,-", max_size=400), st.integers(1, 30), st.integers(0, 29))
def test_pieces_keep_limit_overlap_and_text(s, size, overlap):
    if overlap >= size:
        overlap = size - 1
    count = lambda a, b: sum(c.isalnum() for c in s[a:b])
    got = split.pieces(s, size, overlap)
    assert all(count(a, b) <= size for a, b in got)
    if s:
        assert got[0][0] == 0 and got[-1][1] == len(s)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and count(c, b) == overlap


@given(st.integers(1, 400), st.integers(0, 2**63))
def test_orders_are_permutations(n, seed):
    assert sorted(mix.permuted(i, n, seed) for i in range(n)) == list(range(n))
