import json

import pytest

from foliora import cli
from foliora.engine import Engine
from foliora.errors import ConfigurationError, DocumentError, FolioraError, RegistryError
from foliora.settings import Settings
from foliora.sources import loaders
from foliora.streaming.ingest import ingest_stream

TEXT = "Margin call procedure\n\nThe margin desk sends a margin call notice when the collateral ratio falls below the threshold. The client has two working days to add collateral.\n\n" + "Unrelated text about indexes and batches. " * 10


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Settings(root=str(tmp_path / "store"), chunk_size=300, chunk_overlap=20, chunk_min_chars=20))


def test_ingest_search_ask_and_remove(engine, tmp_path):
    (tmp_path / "a.md").write_text(TEXT)
    (tmp_path / "b.txt").write_bytes("Holiday calendar of the branch offices. ".encode() * 4 + b"\xff")
    col = engine.create_collection("rules")["collection_id"]
    a, b = engine.import_file(str(tmp_path / "a.md")), engine.import_file(str(tmp_path / "b.txt"))
    assert engine.import_file(str(tmp_path / "a.md"), "other.md") == a  # the same content
    for f in (a, b):
        assert engine.ingest(f["file_id"], col)["index_status"] == "indexed"
    with pytest.raises(RegistryError):
        engine.ingest(a["file_id"], col)
    with pytest.raises(RegistryError):
        engine.delete_file(a["file_id"])
    engine.check_indexes(col)
    for how in ("hybrid", "keyword", "vector"):
        hits = engine.search("margin call notice", col, 3, how)
        assert hits and hits[0]["file_id"] == a["file_id"] and 0 <= hits[0]["score"] <= 1, how
    assert "keyword_score" in engine.search("margin call notice", col, 1, debug=True)[0]
    said = engine.ask("margin call notice", col)
    assert "margin" in said["answer"].lower() and said["sources"]
    assert engine.ask("margin call notice", col, careful=True)["retrieval_queries"][0] == "margin call notice"
    assert engine.ask("zzz", engine.create_collection("empty")["collection_id"])["fallback_reason"] == "no_results"
    case = tmp_path / "cases.jsonl"
    case.write_text(json.dumps({"id": "1", "query": "margin call notice", "collection_id": col, "expected_sources": ["a.md"]}) + "\n{}\n\nnot json\n")
    cases = loaders.read_cases(engine.spark, str(case))
    assert sorted(r["error"] or "" for r in cases.collect()) == ["", "empty line", "missing id", "not valid JSON"]
    scored, report = engine.evaluate(cases, col, 3)
    assert scored.first()["source_hit"] is True and report.first()["recall_at_k"] == 1.0
    assert engine.inspect()["indexed_chunks"] >= 2 and engine.ready()["ready"]
    engine.de_ingest(a["file_id"], col)
    assert all(h["file_id"] == b["file_id"] for h in engine.search("margin call notice", col, 3))
    engine.delete_file(a["file_id"])
    assert [f["file_id"] for f in engine.list_files()] == [b["file_id"]]


def test_pages_and_failures(engine, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    col = engine.create_collection("scans")["collection_id"]
    f = engine.import_file(str(tmp_path / "p.pdf"))
    job = engine.create_job(f["file_id"], col)

    def broken(data):
        raise ValueError("no text")

    with pytest.raises(Exception):
        engine.ingest(f["file_id"], col, broken)
    assert engine.list_registry()[0]["index_status"] == "failed"
    again = Engine(engine.spark, engine.settings)
    assert again.get_job(job["job_id"])["status"] == "failed"
    assert engine.ingest(f["file_id"], col, lambda data: ["Handbook\nmargin loan rules of the desk", "Handbook\nmargin loan rules of the branch", "Handbook\nother things entirely"])["indexed_chunk_count"] >= 1
    assert engine.search("margin loan", col, 2)[0]["page_start"] == 1


def test_stream_ingests_each_file_once(engine, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.md").write_text(TEXT)
    col = engine.create_collection("stream")["collection_id"]
    for expected in (1, 2):
        ingest_stream(engine, str(inbox), col, str(tmp_path / "ck")).awaitTermination()
        assert sum(r["index_status"] == "indexed" for r in engine.list_registry()) == expected
        (inbox / "b.txt").write_text("Another file about margin loans and more.")


def test_debug_errors_reports_and_stored_index(engine, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text(TEXT)
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "i.png").write_bytes(b"png")
    col = engine.create_collection("x")["collection_id"]
    f = {n: engine.import_file(str(tmp_path / n))["file_id"] for n in ("a.md", "empty.txt", "i.png")}
    assert engine.ingest(f["a.md"], col)["loaded"] == 1
    report = engine.ingest(f["empty.txt"], col)
    assert (report["loaded"], report["skipped"], report["indexed_chunk_count"]) == (0, 1, 0) and report["messages"][0].startswith("empty document: ")
    with pytest.raises(DocumentError):
        engine.ingest(f["i.png"], col)
    assert engine._one("registry", file_id=f["i.png"], collection_id=col)["index_status"] == "failed"
    seeing = Engine(engine.spark, engine.settings, vision=lambda data, mime: f"A scanned notice about margin tables, {mime}, {len(data)} bytes")
    assert seeing.ingest(f["i.png"], col)["indexed_chunk_count"] == 1
    for bad in ({"strategy": "none"}, {"top_k": 0}, {"top_k": -1}):
        with pytest.raises(ConfigurationError):
            engine.search("margin", col, **bad)
    d = engine.debug_search("margin call notice", col, 2)
    assert d["candidate_k"] == 2 * engine.settings.candidate_multiplier and d["vector_candidates"] and d["keyword_candidates"] and len(d["results"]) <= 2
    assert [r["keyword_rank"] for r in d["keyword_candidates"]] == list(range(1, len(d["keyword_candidates"]) + 1))
    ready = engine.ready()
    assert ready["ready"] and len(ready) == 9
    # a search never makes terms of texts but of its candidates: the stored index is read
    from foliora.operators import keyword

    monkeypatch.setattr(keyword, "text_index", None)
    assert engine.search("margin call notice", col, 2, "keyword")[0]["file_id"] == f["a.md"]


def test_pages_read_from_their_images(engine, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    args = (engine.spark, str(tmp_path), lambda data: ["short", "text of a page that is long enough to be read as it is"])
    render, model = lambda data: [b"1", b"22"], lambda image, mime: f"seen {len(image)}"
    text = lambda how, *more: [r["content"][:6] for r in loaders.read_pages(*args, how, *more).orderBy("page_number").collect()]
    assert text("text") == ["short", "text o"] and text("auto", render, model) == ["seen 1", "text o"] and text("visual", render, model) == ["seen 1", "seen 2"]
    with pytest.raises(ConfigurationError):
        loaders.read_pages(*args, "auto")


def test_lines_of_cases(spark, tmp_path):
    good = {"id": "1", "query": "q", "collection_id": "c"}
    lines = [good, {**good, "top_k": 0}, {**good, "top_k": "x"}, {**good, "expected_sources": "a"}, {**good, "expected_keywords": [1]}, {**good, "id": 5}, {**good, "query": ""}, [1], {**good, "expected_file_ids": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    got = {r["line"]: r["error"] for r in loaders.read_cases(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {
        1: None, 2: "top_k must be above 0", 3: "top_k must be a whole number", 4: "expected_sources must be a list of strings", 5: "expected_keywords must be a list of strings", 6: "missing id", 7: "missing query", 8: "not an object", 9: None,
    }


def test_remote_models_and_public_results():
    from foliora import formatting
    from foliora.errors import ModelError
    from foliora.providers import RemoteModel

    said = {}
    model = lambda dialect="openai", **k: RemoteModel("http://x/", "m", dialect, batch=2, post=lambda path, payload: said[path](payload), **k)
    said["/embeddings"] = lambda p: {"data": [{"index": i, "embedding": [len(t), 1]} for i, t in reversed(list(enumerate(p["input"])))]}
    said["/api/embed"] = lambda p: {"embeddings": [[len(t), 1] for t in p["input"]]}
    assert model()(["a", "bb", "ccc"]) == model("ollama")(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and model()([]) == []
    for bad in ({"data": []}, {}, {"data": [{"index": 0, "embedding": ["x"]}]}, {"data": [{"index": 3, "embedding": [1]}]}, {"data": [{"embedding": [True]}]}):
        said["/embeddings"] = lambda p, bad=bad: bad
        with pytest.raises(ModelError):
            model()(["a"])
    said["/chat/completions"] = lambda p: {"choices": [{"message": {"content": str(p["messages"][-1]["content"])}}]}
    said["/api/chat"] = lambda p: {"message": {"content": p["messages"][-1]["images"][0]}}
    assert model().chat([{"role": "user", "content": "hi"}]) == "hi" and "data:image/png;base64,YWI=" in model().read_image(b"ab", "image/png")
    assert model("ollama").read_image(b"ab", "image/png") == "YWI=" and model().read_image(b"", "image/png") == ""
    said["/chat/completions"] = lambda p: {"choices": []}
    with pytest.raises(ModelError):
        model().chat([])
    with pytest.raises(ConfigurationError):
        RemoteModel("", "m")
    row = {"id": 1, "retrieval": {"x": 1}, "metadata": {"source": "s", "secret": 2}, "items": [{"retrieval": 1, "a": ({"metadata": {"secret": 1}},)}]}
    assert formatting.public(row) == {"id": 1, "metadata": {"source": "s"}, "items": [{"a": [{"metadata": {}}]}]}


def test_selection_fills_up_from_the_rest(spark):
    from foliora.operators import evaluate

    rows = [(f"{g}{i:02d}", g, i) for g, n in (("a", 20), ("b", 3), (None, 9)) for i in range(n)]
    df = spark.createDataFrame([(str(k), g, i) for k, g, i in rows], "id string, file_id string, chunk_index int")

    def even(xs, m):
        return xs if len(xs) <= m else xs[:1] if m == 1 else [xs[round(j * (len(xs) - 1) / (m - 1))] for j in range(m)]

    for count in (4, 15, 16, 17, 20, 27, 50):
        groups = [[r for r in rows if r[1] == g] for g in (None, "a", "b")]
        chosen = [x for g in groups for x in even(g, 6)]
        rest = [x for g in groups for x in g if x not in chosen]
        want = [str(x[0]) for x in (chosen + even(rest, max(0, count - len(chosen))) if count > len(chosen) else chosen)[:count]]
        assert [r["id"] for r in evaluate.select(df, "id", "file_id", ["chunk_index", "id"], count).collect()] == want, count


def test_command_line(engine, tmp_path, capsys):
    (tmp_path / "a.md").write_text(TEXT)
    p = cli.parser()
    col = cli.run(engine, p.parse_args(["collection-create", "x"]))["collection_id"]
    f = cli.run(engine, p.parse_args(["file-import", str(tmp_path / "a.md")]))["file_id"]
    cli.run(engine, p.parse_args(["ingest", f, col]))
    assert cli.run(engine, p.parse_args(["search", "margin", col, "--top-k", "1"]))
    assert cli.run(engine, p.parse_args(["inspect"]))["collections"] == 1
    with pytest.raises(FolioraError):
        cli.run(engine, p.parse_args(["file-delete", "nope"]))


def test_settings():
    assert Settings.from_environment({"FOLIORA_TOP_K": "9", "FOLIORA_VECTOR_WEIGHT": "0.5"}).top_k == 9
    for bad in ({"FOLIORA_TOP_K": "x"}, {"FOLIORA_TOP_K": "0"}, {"FOLIORA_RETRIEVAL_STRATEGY": "none"}, {"FOLIORA_CHUNK_SIZE": "-1"}):
        with pytest.raises(ConfigurationError):
            Settings.from_environment(bad)


def test_uploads_and_formatting(tmp_path):
    import io

    from foliora import formatting
    from foliora.sources import uploads

    p = uploads.stage("../a.md", io.BytesIO(b"x" * 100), str(tmp_path), limit=100)
    assert p.parent == tmp_path and p.read_bytes() == b"x" * 100
    for name, size in (("b.md", 101), ("", 1)):
        with pytest.raises(uploads.UploadError):
            uploads.stage(name, io.BytesIO(b"x" * size), str(tmp_path), limit=100)
    assert len(list(tmp_path.iterdir())) == 1
    row = {"source": None, "score": 0.5, "content": "x" * 200, "page_start": 1, "page_end": 2}
    assert "1. n/a, page 1-2, score 0.500" in formatting.results("q", [row]) and formatting.preview("abc", 2) == "ab..."
    said = {"query": "q", "confidence": "low", "answer": "a", "fallback_reason": "no_results", "sources": []}
    assert "Fallback: no_results" in formatting.answer(said) and formatting.records([]) == "none"


def test_skips_kinds_and_vision(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.MD", "text", ".md"), ("b.pdf", " ", ".pdf"), ("c.exe", "x", ".exe"), (None, None, ".txt")], "name string, content string, file_type string")
    assert loaders.loaded(df, "content").count() == 2
    assert {r["message"] for r in loaders.skipped(df, F.col("name"), "content").collect()} == {"empty document: b.pdf", "unsupported file type: c.exe", "empty document: ?"}
    rows = df.select(loaders.suffix(F.col("name")).alias("s"), loaders.mime_type(F.col("name")).alias("m"), loaders.needs_vision(F.col("content"), "auto", 3).alias("v")).collect()
    assert [(r["s"], r["m"], r["v"]) for r in rows[:3]] == [(".md", "text/markdown", False), (".pdf", "application/pdf", True), (".exe", "application/octet-stream", True)]
    with pytest.raises(ConfigurationError):
        loaders.load_strategy("other")


def test_cases_from_chunks(spark):
    from foliora.operators import cases

    df = spark.createDataFrame(
        [("1", "f/文件_1.md", 1, "请参阅《业务细则总览》第1条。甲。乙；丙。" + "丁" * 90), ("2", "f/a.md", 2, "问题 1：如何办理展期呢请说明？回答：" + "先提交申请再复核。" * 4 + " 问题 2：余下"), ("3", "f/plain_name.txt", 3, "no topic here at all")],
        "chunk_id string, source string, chunk_index int, content string",
    )
    rows = {r["chunk_id"]: r for r in cases.make(df).collect()}
    assert rows["1"]["topic"] == "业务细则总览" and rows["1"]["question"] == "业务细则总览有哪些要求？"
    assert rows["2"]["question"] == "如何办理展期呢请说明？" and rows["2"]["answer"] == "先提交申请再复核。" * 4
    assert rows["3"]["topic"] == "plain_name"
