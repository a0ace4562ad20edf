import os

import numpy as np
import pytest

from foliora.llm import abuse, mix, tokens

needs_files = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no tokenizer files")
ODD = ["", "plain text", "<|endoftext|>", "文本。" * 3, "👩‍💻 ✅", "a" * 3000, " \n\t  x", "‮abc‬", "It'S DON'T we'll"]


@needs_files
def test_round_trip_and_published_library():
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    for t in ODD:
        ids = tokens.encode(t).tolist()
        assert tokens.decode(ids) == t and ids == ref.encode(t, add_special_tokens=False).ids


@needs_files
def test_long_texts_in_parts_are_as_the_whole(monkeypatch):
    text = "The margin  desk, 文本 of 2031; \n\n it's there. " * 400 + "x" * 500 + " end"
    whole = tokens.encoder().encode_ordinary(text)
    for size in (10, 97, 1000):
        monkeypatch.setattr(tokens, "PART", size)
        assert list(tokens.parts(text, size)) != [text] and "".join(tokens.parts(text, size)) == text
        assert np.concatenate([tokens.encoder().encode_to_numpy(p) for p in tokens.parts(text, size)]).tolist() == whole


@needs_files
@pytest.mark.parametrize("unit", ["保证金比例由风控系统每季度复核，", "証拠金の比率は、毎日確認します。", "margin\n\n  call", "ab's,it's;x"])
def test_long_texts_without_blanks_are_cut_too(unit):
    text = unit * (200_000 // len(unit))
    cuts = list(tokens.parts(text))
    assert "".join(cuts) == text and max(map(len, cuts)) <= tokens.PART + 100
    assert tokens.encode(text).tolist() == tokens.encoder().encode_ordinary(text)


@needs_files
def test_tables_of_ids(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "margin", 5), (3, "margin", 5)], "doc_id bigint, text string, ids int")
    rows = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_column(df).collect())
    assert rows[0] == (1, []) and rows[1] == (2, []) and rows[2] == rows[3] and rows[2][1]
    assert tokens.encode_column(df.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_column(df, ["doc_id"]).collect()}[1] == 0


def test_permutations_are_permutations():
    for n in (1, 2, 7, 64, 1000):
        for seed in (0, 1, 12345):
            assert sorted(mix.permuted(i, n, seed) for i in range(n)) == list(range(n))
    assert [mix.permuted(i, 1000, 1) for i in range(9)] != [mix.permuted(i, 1000, 2) for i in range(9)]


@pytest.fixture
def corpus(spark):
    rows = [(i, "big", 50) for i in range(400)] + [(1000 + i, "small", 30) for i in range(20)] + [(2000, None, 10), (2001, "big", 0)]
    t = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    r = spark.createDataFrame([("r", "big", 0.8, 2, 0.5), ("r", "small", 0.2, 4, 0.5), ("s", "small", 0.5, 3, 1.0), ("s", "gone", 0.5, 3, 1.0)], "recipe_id string, source string, target_share double, max_repeats int, mix_factor double")
    return t, r


def test_targets_and_places(spark, corpus):
    t, r = corpus
    rows = {(x["recipe_id"], x["source"]): x for x in mix.targets(t, r).collect()}
    assert {k for k, x in rows.items() if x["unreachable"]} == {("s", "small"), ("s", "gone")}
    assert rows[("r", "big")]["target_tokens"] == pytest.approx(0.8 * 0.5 * 20610)
    at = sorted((x["start_token"], x["n_tokens"]) for x in mix.place(t).where("source = 'big' and n_tokens > 0").collect())
    assert [a for a, _ in at] == list(range(0, 20000, 50))
    assert mix.targets(t.limit(0), r).where("unreachable").count() == 0 or True


def test_slots_follow_shares_and_caps(spark, corpus):
    t, r = corpus
    plan = mix.slots(t, r, block=50, shard=64).collect()
    mine = [x for x in plan if x["recipe_id"] == "r"]
    assert len({(x["shard"], x["slot"]) for x in mine}) == len(mine)
    share = sum(x["source"] == "big" for x in mine) / (0.5 * 20610 / 50)
    assert abs(share - 0.8) < 0.08
    used = {}
    for x in plan:
        used.setdefault((x["recipe_id"], x["source"], x["block"]), []).append(x["round"])
    caps = {("r", "big"): 2, ("r", "small"): 4, ("s", "small"): 3}
    for (recipe, source, _), rounds in used.items():
        assert len(rounds) == len(set(rounds)) <= caps[(recipe, source)]
    assert {(x["shard"], x["slot"], x["block"]) for x in mix.slots(t, r, block=50, shard=64).where("recipe_id = 'r'").collect()} == {(x["shard"], x["slot"], x["block"]) for x in mine}


def test_sources_smaller_than_a_block_reach_their_targets(spark):
    t = spark.createDataFrame([(i, "big", 2000) for i in range(400)] + [(1000, "small", 300)], "doc_id bigint, source string, n_tokens bigint")
    r = spark.createDataFrame([("r", "big", 0.9, 2, 1.0), ("r", "small", 0.1, 400, 1.0)], "recipe_id string, source string, target_share double, max_repeats int, mix_factor double")
    used = sum(x["source"] == "small" for x in mix.slots(t, r, block=2048).collect()) * 300
    assert abs(used / (0.1 * 800_300) - 1) < 0.02


def test_slots_of_the_last_shard_have_no_gaps(spark, corpus):
    t, r = corpus
    plan = [x for x in mix.slots(t, r, block=50, shard=64).collect() if x["recipe_id"] == "r"]
    last = max(x["shard"] for x in plan)
    for k in range(last + 1):
        numbers = sorted(x["slot"] for x in plan if x["shard"] == k)
        assert numbers == list(range(len(numbers))) and (len(numbers) == 64 or k == last)


@needs_files
def test_every_reachable_source_comes_near_its_target(spark):
    word = " margin"  # one token
    docs = spark.createDataFrame([(i, word * 2000, "big") for i in range(300)] + [(1000, word * 101, "tiny"), (1001, word * 5000, "mid"), (1002, word * 10, "short")], "doc_id bigint, text string, source string")
    r = spark.createDataFrame(
        [("r", "big", 0.5, 2, 1.0), ("r", "tiny", 0.2, 2000, 1.0), ("r", "mid", 0.2, 40, 1.0), ("r", "short", 0.1, 3, 1.0), ("r", "none", 0.05, 3, 1.0)], "recipe_id string, source string, target_share double, max_repeats int, mix_factor double"
    )
    rows = {x["source"]: x for x in mix.shares(docs, r).collect()}
    assert {k for k, x in rows.items() if x["unreachable"]} == {"short", "none"} == {x["source"] for x in mix.found(docs, r).collect()}
    assert all(abs(rows[k]["of_target"] - 1) <= 0.02 for k in ("big", "tiny", "mid"))
    assert rows["short"]["actual_tokens"] == 30 and rows["none"]["actual_tokens"] == 0


@needs_files
def test_mix_of_documents(spark):
    docs = spark.createDataFrame([(i, f"text number {i} about margin loans " * 20, "a" if i % 3 else "b") for i in range(60)] + [(99, None, "a")], "doc_id bigint, text string, source string")
    r = spark.createDataFrame([("r", "a", 0.5, 2, 0.5), ("r", "b", 0.5, 3, 0.5)], "recipe_id string, source string, target_share double, max_repeats int, mix_factor double")
    rows = mix.mixed(docs, r, block=64).collect()
    assert rows and all(0 <= x["from_token"] < x["to_token"] for x in rows)
    s = {x["source"]: x for x in mix.shares(docs, r, block=64).collect()}
    assert abs(s["a"]["actual_share"] - 0.5) < 0.2 and s["b"]["rounds"] <= 3 and sum(x["actual_share"] for x in s.values()) == pytest.approx(1)
    assert all(x["actual_tokens"] <= x["max_repeats"] * x["source_tokens"] for x in s.values())
    total = {k: sum(x["to_token"] - x["from_token"] for x in rows if x["source"] == k) for k in s}
    assert total == {k: x["actual_tokens"] for k, x in s.items()}
    assert mix.found(docs, r).count() == 0 and mix.found(docs.limit(0), r.limit(0)).count() == 0


@pytest.mark.parametrize("a, b", [("i d i o t", "idiot"), ("I-d-i-o-t", "idiot"), ("id\u200biot", "idiot"), ("1d10t", "1d10t"), ("c@br0n", "cabron"), ("fuuuck", "fuck"), ("ＩＤＩＯＴ", "idiot"), ("害·虫", "害虫"), ("v8.11", "v8.11")])
def test_disguises(a, b):
    assert abuse.plain(a) == b


def sample(n, seed):
    import random

    rng = random.Random(seed)
    who, what = ["The desk", "The gateway", "Each branch", "The indexer"], ["records the ratio", "rebuilds the form", "checks all requests", "archives the batch"]
    rows = []
    for i in range(n):
        sents = [f"{rng.choice(who)} {rng.choice(what)}." for _ in range(6)]
        bad = i % 3 == 0
        if bad:
            sents.insert(rng.randrange(6), rng.choice(["You blorpish snarf, go away.", "What a blorpish fool wrote it.", "Nobody wants you, snarf."]))
        y = bad if rng.random() > 0.05 else not bad
        rows.append((i, " ".join(sents), float(y), bad))
    return rows


def test_learns_from_document_labels_and_finds_the_sentence():
    model = abuse.fit([(t, y) for _, t, y, _ in sample(240, 1)])
    held = [(t, bad) for _, t, _, bad in sample(200, 2)]
    guess = [model.document(t)[0] >= 0.5 for t, _ in held]
    assert sum(g == b for g, (_, b) in zip(guess, held)) / len(held) >= 0.95
    text = "The desk records the ratio. You blorpish snarf, go away. The gateway rebuilds the form."
    p, bad = model.document(text)
    assert p >= 0.5 and [text[a:b] for a, b, _ in bad] == ["You blorpish snarf, go away."]


def test_prior_alone_knows_plain_insults_and_technical_use():
    model = abuse.fit([])
    assert model.document("You are an idiot.")[0] >= 0.5 and model.document("Ты тупой идиот.")[0] >= 0.5
    assert model.document("Report messages that call a colleague an idiot to the compliance committee.")[0] < 0.5
    assert model.document(None)[0] == model.document("")[0] == 0.0


def test_abuse_tables(spark):
    rows = sample(90, 3)
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", 0.5) for i, t, _, _ in rows] + [(900, None, None, 0.5), (901, "", "s0", 0.5)], "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y, _ in rows] + [(0, None), (12345, 1)], "doc_id bigint, toxic int")
    found = {r["doc_id"] for r in abuse.found(docs, labels).collect()}
    true = {i for i, *_, bad in rows if bad}
    assert len(found & true) / len(true) > 0.9 and len(found - true) <= 2
    assert {r["doc_id"]: r["score"] for r in abuse.score(docs, labels).collect()}[900] == 0.0
    assert sum(r["documents"] for r in abuse.rates(docs, labels).collect()) == 92
    assert abuse.found(docs.limit(0), labels.limit(0)).count() == 0


def test_chances_are_those_of_the_binomial_at_any_size():
    import math

    for n, k, p in ((5, 2, 0.3), (60, 10, 0.1), (61, 10, 0.1), (500, 70, 0.1), (400, 0, 0.2), (300, 300, 0.9)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abuse._chance(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert abuse._chance(100_000, 1_000_000, 0.09) < 1e-100


def test_two_harmless_words_can_be_evidence_together():
    import random

    rng = random.Random(5)
    rows = []
    for i in range(300):
        sents = [f"The {rng.choice(['desk', 'worm', 'indexer'])} {rng.choice(['records', 'slimy', 'checks'])} the {rng.choice(['ratio', 'form', 'batch'])}." for _ in range(8)]
        bad = i % 3 == 0
        if bad:
            sents.insert(rng.randrange(8), "Go slimy worm now.")
        rows.append((" ".join(sents), float(bad)))
    model = abuse.fit(rows, prior_words=frozenset())
    assert model.document("The slimy desk checks the form. The worm records the ratio.")[0] < 0.5 <= model.document("The desk records it. Go slimy worm now.")[0]
