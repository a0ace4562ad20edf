"""The engine: files, collections, ingestion, search, answers and evaluation over parquet tables.

One object with a method for each operation. The catalog is a handful of small tables written whole; the
indexes are parquet tables by collection and file. An ingestion writes both indexes before it marks the
registry entry as indexed, and clears what an earlier failed attempt left.
"""

from __future__ import annotations

import hashlib
import shutil
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.errors import ConfigurationError, DocumentError, JobError, RegistryError
from foliora.functions.lineage import cut
from foliora.functions.text import has_content
from foliora.operators import answer, catalog, chunking, evaluate, hybrid, keyword, tokens, vector
from foliora.providers import ExtractiveChat, HashingEmbedder
from foliora.settings import Settings
from foliora.sources import loaders

S, I, TS = T.StringType(), T.LongType(), T.TimestampType()
TABLES = {
    "files": [("file_id", S), ("original_name", S), ("content_hash", S), ("storage_path", S), ("file_type", S), ("size_bytes", I), ("status", S), ("created_at", TS)],
    "collections": [("collection_id", S), ("name", S), ("description", S), ("created_at", TS)],
    "registry": [("file_id", S), ("collection_id", S), ("index_status", S), ("indexed_chunk_count", I), ("indexed_at", TS), ("last_error", S), ("recorded_at", TS)],
    "jobs": [("job_id", S), ("job_type", S), ("file_id", S), ("collection_id", S), ("status", S), ("error", S), ("created_at", TS), ("ended_at", TS)],
}
CHUNK = "chunk_id string, content string, source string, file_id string, collection_id string, chunk_index int, chunk_count int, start_char int, end_char int, page_start int, page_end int, hard_break_key string, semantic_score double, doc_len int"

RULES = "Answer from the context only, briefly, and name no source that isn't in it. If the context doesn't hold the answer, say that it can't be determined from the knowledge base."


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embed: Callable | None = None, chat: Callable | None = None, vision: Callable | None = None, render: Callable | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.vision, self.render = vision, render  # a model that reads images, and what makes the images of a PDF's pages
        self.embed = embed or HashingEmbedder(self.settings.embedding_size)
        self.chat = chat or ExtractiveChat()
        self.root = Path(self.settings.root)
        for d in ("catalog", "files", "index"):
            (self.root / d).mkdir(parents=True, exist_ok=True)
        self._fail_open_jobs()

    # --- catalog: small tables, kept by the driver -------------------------------------------

    def _rows(self, name: str) -> list[dict]:
        path = self.root / "catalog" / f"{name}.parquet"
        if not path.exists():
            return []
        import pyarrow.parquet as pq

        return pq.read_table(path).to_pylist()

    def _store(self, name: str, rows: list[dict]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = {S: pa.string(), I: pa.int64(), TS: pa.timestamp("us")}
        path = self.root / "catalog" / f"{name}.parquet"
        new = path.with_suffix(".new")
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in TABLES[name]])), new)
        new.replace(path)  # whole or not at all

    def _put(self, name: str, keys: list[str], row: dict) -> dict:
        row = {n: row.get(n) for n, _ in TABLES[name]}
        self._store(name, [r for r in self._rows(name) if any(r[k] != row[k] for k in keys)] + [row])
        return row

    def table(self, name: str) -> DataFrame:
        """A table of the catalog as a DataFrame."""
        return self.spark.createDataFrame([tuple(r[n] for n, _ in TABLES[name]) for r in self._rows(name)], T.StructType([T.StructField(n, t) for n, t in TABLES[name]]))

    def _one(self, name: str, **keys) -> dict | None:
        return next((r for r in self._rows(name) if all(r[k] == v for k, v in keys.items())), None)

    # --- files ---------------------------------------------------------------------------------

    def import_file(self, path: str, name: str | None = None) -> dict:
        """Keep a copy of a file under an id of its content; a file that is active already is returned as it is."""
        source = Path(path)
        if not source.is_file():
            raise RegistryError(f"Not a file: {source}")
        digest = hashlib.sha256()
        with source.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        file_id = f"sha256_{digest.hexdigest()}"
        old = self._one("files", file_id=file_id)
        if old and old["status"] == catalog.ACTIVE:
            return old
        target = self.root / "files" / digest.hexdigest()[:2] / file_id / Path(name or source.name).name
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(source, target)
        return self._put("files", ["file_id"], {
            "file_id": file_id, "original_name": target.name, "content_hash": digest.hexdigest(), "storage_path": str(target), "file_type": target.suffix.lower(), "size_bytes": target.stat().st_size,
            "status": catalog.ACTIVE, "created_at": _now(),
        })

    def list_files(self) -> list[dict]:
        return sorted((r for r in self._rows("files") if r["status"] == catalog.ACTIVE), key=lambda r: (r["created_at"], r["file_id"]))

    def get_file(self, file_id: str) -> dict:
        row = self._one("files", file_id=file_id)
        if row is None or row["status"] != catalog.ACTIVE:
            raise RegistryError(f"No such file: {file_id}")
        return row

    def delete_file(self, file_id: str) -> dict:
        """Mark a file as deleted and drop its copy; refused while a collection has it indexed."""
        row = self.get_file(file_id)
        if any(r["file_id"] == file_id and r["index_status"] == catalog.INDEXED for r in self._rows("registry")):
            raise RegistryError(f"File is indexed: {file_id}")
        shutil.rmtree(Path(row["storage_path"]).parent, ignore_errors=True)
        return self._put("files", ["file_id"], {**row, "status": catalog.DELETED})

    # --- collections ---------------------------------------------------------------------------

    def create_collection(self, name: str, description: str = "") -> dict:
        return self._put("collections", ["collection_id"], {"collection_id": f"col_{uuid.uuid4().hex[:12]}", "name": name, "description": description, "created_at": _now()})

    def list_collections(self) -> list[dict]:
        return sorted(self._rows("collections"), key=lambda r: (r["created_at"], r["collection_id"]))

    def get_collection(self, collection_id: str) -> dict:
        row = self._one("collections", collection_id=collection_id)
        if row is None:
            raise RegistryError(f"No such collection: {collection_id}")
        return row

    def delete_collection(self, collection_id: str) -> None:
        """Drop a collection with its indexes; refused while files are indexed in it."""
        self.get_collection(collection_id)
        if any(r["collection_id"] == collection_id and r["index_status"] == catalog.INDEXED for r in self._rows("registry")):
            raise RegistryError(f"Collection has indexed files: {collection_id}")
        self._store("collections", [r for r in self._rows("collections") if r["collection_id"] != collection_id])
        shutil.rmtree(self._index(collection_id).parent, ignore_errors=True)

    # --- ingestion -----------------------------------------------------------------------------

    def _index(self, collection_id: str, file_id: str | None = None) -> Path:
        p = self.root / "index" / f"collection_id={collection_id}"
        return p / f"file_id={file_id}" if file_id else p / "any"

    def _register(self, file_id: str, collection_id: str, status: str, chunks: int = 0, error: str | None = None) -> dict:
        return self._put("registry", ["file_id", "collection_id"], {
            "file_id": file_id, "collection_id": collection_id, "index_status": status, "indexed_chunk_count": chunks, "indexed_at": _now() if status == catalog.INDEXED else None, "last_error": error, "recorded_at": _now(),
        })

    def list_registry(self) -> list[dict]:
        return sorted(self._rows("registry"), key=lambda r: (r["collection_id"], r["file_id"]))

    def chunk(self, documents: DataFrame) -> DataFrame:
        """Chunks of loaded documents (file_id, source, file_type, content, and for pages page_doc_id and page_number)."""
        s = self.settings
        how = {"size": s.chunk_size, "least": s.chunk_min_chars, "threshold": s.breakpoint_threshold, "max_units": s.max_units, "embed": self.embed}
        if "page_number" in documents.columns:
            c = chunking.page_chunks(documents, page_merge=s.page_merge_min_score, **how)
            return c.select("source", "content", "chunk_index", "chunk_count", "start_char", "end_char", "page_start", "page_end", "hard_break_key", "semantic_score")
        none = F.lit(None).cast("int")
        if chunking.strategy(s.chunk_strategy) == "character":
            c = chunking.character_chunks(documents, "source", "content", s.chunk_size, s.chunk_overlap).withColumn("chunk_count", none).withColumn("hard_break_key", F.lit(None).cast("string")).withColumn("semantic_score", F.lit(None).cast("double"))
        else:
            c = chunking.semantic_chunks(documents, "source", "content", **how)
        return c.select("source", "content", "chunk_index", "chunk_count", "start_char", "end_char", none.alias("page_start"), none.alias("page_end"), "hard_break_key", "semantic_score")

    def _load(self, file: dict, reader: Callable | None) -> DataFrame:
        """A file's documents, or pages: text as it is, pages by their text or image as the load strategy says, images by the vision model."""
        path, kind = file["storage_path"], file["file_type"]
        source = F.lit(f"{file['file_id']}/{file['original_name']}")
        if kind == loaders.PDF:
            pages = loaders.read_pages(self.spark, path, reader, self.settings.load_strategy, self.render, self.vision)
            return pages.withColumn("file_type", F.lit(loaders.PDF)).withColumn("source", source).withColumn("page_doc_id", F.concat_ws(":page:", "source", F.format_string("%04d", "page_number")))
        if kind in loaders.IMAGES:
            if self.vision is None:
                raise DocumentError(f"An image needs a vision model: {file['original_name']}")
            return loaders.read_images(self.spark, path, self.vision).withColumn("source", source)
        if kind not in loaders.TEXT:
            raise DocumentError(f"Unsupported file type: {kind}")
        return loaders.read_texts(self.spark, path).withColumn("source", source)

    def ingest(self, file_id: str, collection_id: str, reader: Callable | None = None) -> dict:
        """Load, chunk and index a file in a collection; the entry ends as indexed or failed.

        Returns the entry with the numbers of loaded and skipped documents (or pages) and why they were skipped."""
        file = self.get_file(file_id)
        self.get_collection(collection_id)
        old = self._one("registry", file_id=file_id, collection_id=collection_id)
        if old and old["index_status"] == catalog.INDEXED:
            raise RegistryError(f"Already indexed: {file_id} in {collection_id}")
        self._register(file_id, collection_id, catalog.INDEXING)
        place = self._index(collection_id, file_id)
        try:
            docs = cut(self._load(file, reader))
            name = F.concat_ws(", page ", "source", "page_number") if "page_number" in docs.columns else F.col("source")
            skipped = docs.where(~has_content(F.col("content"))).select(F.concat(F.lit("empty document: "), name).alias("m"))
            made = self.chunk(loaders.loaded(docs, "content"))
            chunk_id = F.format_string("%s:%s:chunk:%04d", F.lit(collection_id), F.lit(file_id), "chunk_index")
            full = made.withColumn("chunk_id", chunk_id).withColumn("file_id", F.lit(file_id)).withColumn("collection_id", F.lit(collection_id)).withColumn("doc_len", tokens.term_count(F.col("content")))
            shutil.rmtree(place, ignore_errors=True)
            full.write.mode("overwrite").parquet(str(place / "chunks"))
            stored = self.spark.read.parquet(str(place / "chunks"))
            keyword.write_postings(stored, str(place / "postings"))
            vector.embed(stored, "chunk_id", "content", self.embed).write.mode("overwrite").parquet(str(place / "vectors"))
            n, loaded, empty = stored.count(), docs.count(), skipped.count()
            report = {"loaded": loaded - empty, "skipped": empty, "messages": [r["m"] for r in skipped.orderBy("m").limit(100).collect()]}
        except Exception as e:
            shutil.rmtree(place, ignore_errors=True)
            self._register(file_id, collection_id, catalog.FAILED, error=str(e)[:500])
            raise
        return {**self._register(file_id, collection_id, catalog.INDEXED, n), **report}

    def de_ingest(self, file_id: str, collection_id: str) -> dict:
        """Take a file out of a collection's indexes."""
        old = self._one("registry", file_id=file_id, collection_id=collection_id)
        if not old or old["index_status"] != catalog.INDEXED:
            raise RegistryError(f"Not indexed: {file_id} in {collection_id}")
        shutil.rmtree(self._index(collection_id, file_id), ignore_errors=True)
        return self._register(file_id, collection_id, catalog.DE_INGESTED)

    # --- jobs ----------------------------------------------------------------------------------

    def create_job(self, file_id: str, collection_id: str) -> dict:
        self.get_file(file_id)
        self.get_collection(collection_id)
        if any(r["file_id"] == file_id and r["collection_id"] == collection_id and r["status"] in (catalog.QUEUED, catalog.RUNNING) for r in self._rows("jobs")):
            raise JobError(f"A job is open for {file_id} in {collection_id}")
        return self._put("jobs", ["job_id"], {"job_id": f"job_{uuid.uuid4().hex[:12]}", "job_type": "ingest", "file_id": file_id, "collection_id": collection_id, "status": catalog.QUEUED, "created_at": _now()})

    def run_job(self, job_id: str) -> dict:
        job = self.get_job(job_id)
        job = self._put("jobs", ["job_id"], {**job, "status": catalog.RUNNING})
        try:
            self.ingest(job["file_id"], job["collection_id"])
        except Exception as e:
            return self._put("jobs", ["job_id"], {**job, "status": catalog.FAILED, "error": str(e)[:500], "ended_at": _now()})
        return self._put("jobs", ["job_id"], {**job, "status": catalog.SUCCEEDED, "ended_at": _now()})

    def get_job(self, job_id: str) -> dict:
        row = self._one("jobs", job_id=job_id)
        if row is None:
            raise JobError(f"No such job: {job_id}")
        return row

    def list_jobs(self) -> list[dict]:
        return sorted(self._rows("jobs"), key=lambda r: (r["created_at"], r["job_id"]), reverse=True)

    def _fail_open_jobs(self) -> None:
        rows = self._rows("jobs")
        if any(r["status"] in (catalog.QUEUED, catalog.RUNNING) for r in rows):
            self._store("jobs", [{**r, "status": catalog.FAILED, "error": catalog.INTERRUPTED, "ended_at": _now()} if r["status"] in (catalog.QUEUED, catalog.RUNNING) else r for r in rows])

    # --- search --------------------------------------------------------------------------------

    def _part(self, collection_id: str, part: str) -> DataFrame | None:
        paths = [str(self._index(collection_id, r["file_id"]) / part) for r in self._rows("registry") if r["collection_id"] == collection_id and r["index_status"] == catalog.INDEXED and r["indexed_chunk_count"]]
        return self.spark.read.parquet(*paths) if paths else None

    def chunks(self, collection_id: str) -> DataFrame:
        self.get_collection(collection_id)
        c = self._part(collection_id, "chunks")
        return c if c is not None else self.spark.createDataFrame([], CHUNK)

    def _asked(self, top_k: int | None, strategy: str | None) -> tuple[int, str]:
        k = self.settings.top_k if top_k is None else top_k
        how = (strategy or self.settings.retrieval_strategy).strip().lower()
        if k <= 0:
            raise ConfigurationError("top_k must be above 0")
        if how not in ("vector", "keyword", "hybrid"):
            raise ConfigurationError(f"Unknown retrieval strategy: {strategy}")
        return k, how

    def search_many(self, queries: DataFrame, collection_id: str, top_k: int | None = None, strategy: str | None = None) -> DataFrame:
        """Results of every query (query_id, query) in one plan: rank, id, score, both branches' evidence, content and source."""
        k, how = self._asked(top_k, strategy)
        fetch = k * self.settings.candidate_multiplier if how == "hybrid" else k
        chunks = self.chunks(collection_id)
        q = queries.select(F.col("query_id").cast("string"), "query").withColumn("collection_id", F.lit(collection_id)).withColumn("top_k", F.lit(fetch))
        kw = vec = None
        if how in ("keyword", "hybrid"):
            q = keyword.analysed(q)
            stored = self._part(collection_id, "postings")
            index = None if stored is None else keyword.stored_index(stored, chunks.select("collection_id", "chunk_id", "doc_len"), q)
            kw = keyword.search(q, chunks, index=index).select("query_id", F.col("chunk_id").alias("id"), "keyword_score", "raw_bm25", "keyword_rank", "bm25_rank", "matched_tokens")
        if how in ("vector", "hybrid"):
            vectors = self._part(collection_id, "vectors")
            vec = self._vector(q, vectors, fetch)
        if how == "hybrid":
            fused = hybrid.fuse(vec, kw, self.settings.vector_weight).withColumn("score", F.col("hybrid_score")).withColumn("rank", F.col("hybrid_rank"))
        elif how == "keyword":
            fused = kw.withColumn("score", F.col("keyword_score")).withColumn("rank", F.col("keyword_rank"))
        else:
            fused = vec.withColumn("score", F.col("vector_score")).withColumn("rank", F.col("vector_rank"))
        body = chunks.select(F.col("chunk_id").alias("id"), "content", "source", "file_id", "collection_id", "page_start", "page_end")
        return fused.where(F.col("rank") <= k).join(body, "id")

    def _vector(self, q: DataFrame, vectors: DataFrame | None, k: int) -> DataFrame:
        none = "query_id string, id string, vector_score double, raw_distance double, vector_rank int"
        if vectors is None:
            return self.spark.createDataFrame([], none)
        near = vector.search(vector.embed(q, "query_id", "query", self.embed), vectors, k, vec_id="chunk_id")
        return near.select("query_id", F.col("vec_id").alias("id"), "vector_score", F.col("distance").alias("raw_distance"), "vector_rank")

    def search(self, query: str, collection_id: str, top_k: int | None = None, strategy: str | None = None, debug: bool = False) -> list[dict]:
        """Results of one query, best first; with the evidence of both branches if ``debug``."""
        rows = self.search_many(self.spark.createDataFrame([("q", query)], "query_id string, query string"), collection_id, top_k, strategy).orderBy("rank").collect()
        public = ("id", "content", "score", "source", "file_id", "collection_id", "page_start", "page_end")
        return [{k: v for k, v in r.asDict().items() if debug or k in public} for r in rows]

    def debug_search(self, query: str, collection_id: str, top_k: int | None = None, strategy: str | None = None) -> dict:
        """One query with what led to its results: weights, how many candidates were fetched, and those of either branch in their order."""
        k, how = self._asked(top_k, strategy)
        fetch = k * self.settings.candidate_multiplier if how == "hybrid" else k
        branch = {b: self.search(query, collection_id, fetch, b, debug=True) if how in (b, "hybrid") else [] for b in ("vector", "keyword")}
        return {
            "query": query, "collection_id": collection_id, "strategy": how, "top_k": k, "candidate_k": fetch, "vector_weight": self.settings.vector_weight, "keyword_weight": 1.0 - self.settings.vector_weight,
            "vector_candidates": branch["vector"], "keyword_candidates": branch["keyword"], "results": self.search(query, collection_id, k, how, debug=True),
        }

    # --- answers -------------------------------------------------------------------------------

    def ask(self, query: str, collection_id: str, top_k: int | None = None, careful: bool = False) -> dict:
        """An answer from the collection with its sources and confidence; ``careful`` adds rewriting, several queries and a judge of the context."""
        asked = [query]
        if careful:
            asked = self._queries(query)
        k, _ = self._asked(top_k, None)
        qs = self.spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "query_id string, query string")
        found = self.search_many(qs, collection_id, k).withColumn("page_label", answer.page_label(F.col("page_start"), F.col("page_end"))).cache()
        merged = answer.merge_queries(found.select(F.lit("q").alias("g"), F.col("query_id").cast("int").alias("query_no"), "rank", "id", "score"), "g", k)
        results = merged.drop("score", "query_no").join(found.dropDuplicates(["id"]).drop("rank", "query_id"), "id").withColumn("query_id", F.lit("q"))
        scores = {r["id"]: r["score"] for r in merged.collect()}
        rows = sorted((r.asDict() for r in results.collect()), key=lambda r: r["place"])
        for r in rows:
            r["score"] = scores[r["id"]]
        typed = self.spark.createDataFrame([("q", r["id"], r["score"], r["source"], r["page_label"], r["content"]) for r in rows], "query_id string, id string, score double, source string, page_label string, content string")
        one = self.spark.createDataFrame([("q",)], "query_id string")
        verdict = answer.judge(one, typed, self.settings.context_min_score, self.settings.context_min_chars).first()
        best = answer.confidence(one, typed).first()["confidence"]
        sufficient, reason = (verdict["context_sufficient"], verdict["fallback_reason"]) if careful else (bool(rows), None if rows else "no_results")
        text, failed = answer.FALLBACK, False
        if sufficient:
            packed = answer.pack(typed, self.settings.context_max_chars).first()
            try:
                text = self.chat([{"role": "system", "content": RULES}, {"role": "user", "content": f"{query}\n\nContext:\n{packed['context'] if packed else ''}"}]).strip() or answer.FALLBACK
            except Exception:
                failed, text, reason = True, answer.FALLBACK, "generation_failed"
        if careful and not failed and sufficient and any(p in text.lower() for p in answer.UNSUPPORTED):
            sufficient, reason = False, "answer_not_supported"
        found.unpersist()
        shown = rows if sufficient and not failed else []
        return {
            "query": query, "answer": text, "confidence": best, "sources": [{k: r[k] for k in ("id", "source", "score", "page_label")} for r in shown], "retrieval_queries": asked,
            "context_sufficient": bool(sufficient), "fallback_reason": reason,
        }

    def _queries(self, query: str) -> list[str]:
        """The query, its rewriting and further ones, without repetitions; a model's failure leaves those there are."""
        made = [query]
        try:
            made.append(self.chat([{"role": "user", "content": f"Rewrite the query for retrieval, on one line:\n{query}"}]))
            made += self.chat([{"role": "user", "content": f"Write further queries, one a line:\n{query}"}]).split("\n")
        except Exception:
            pass
        df = self.spark.createDataFrame([("q", i, m) for i, m in enumerate(made)], "g string, i int, query string")
        return [r["query"] for r in answer.dedupe_queries(df, "g", "i").orderBy("query_no").collect()][: self.settings.multi_query_count] or [query]

    # --- state and evaluation ------------------------------------------------------------------

    def inspect(self) -> dict:
        n = {t: len(self._rows(t)) for t in TABLES}
        return {**n, "active_files": len(self.list_files()), "indexed_chunks": sum(r["indexed_chunk_count"] or 0 for r in self._rows("registry") if r["index_status"] == catalog.INDEXED), "settings": self.settings}

    def ready(self) -> dict:

        def works(check: Callable[[], bool]) -> bool:
            try:
                return bool(check())
            except Exception:
                return False

        checks = {
            "storage": self.root.is_dir(), "catalog": works(lambda: all(self._rows(t) is not None for t in TABLES)), "files": (self.root / "files").is_dir(), "index": (self.root / "index").is_dir(), "spark": works(lambda: self.spark.range(1).count() == 1),
            "jobs": works(lambda: not any(r["status"] == catalog.RUNNING for r in self._rows("jobs"))), "embedding": works(lambda: len(self.embed(["x"])[0]) > 0), "chat": works(lambda: isinstance(self.chat([{"role": "user", "content": "ready?"}]), str)),
        }
        return {**checks, "ready": all(checks.values())}

    def check_indexes(self, collection_id: str) -> None:
        """Raise unless both indexes of a collection hold the same chunks."""
        c, v = self.chunks(collection_id), self._part(collection_id, "vectors")
        if v is not None:
            hybrid.check_indexes(c, c.join(v.select("chunk_id"), "chunk_id", "left_semi"))

    def evaluate(self, cases: DataFrame, collection_id: str, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Scores of all cases and their report, in one search of all queries."""
        sound = cases.where("error is null") if "error" in cases.columns else cases
        found = self.search_many(sound.select(F.col("id").alias("query_id"), "query"), collection_id, top_k)
        tokens = F.col("matched_tokens") if "matched_tokens" in found.columns else F.array().cast("array<string>")
        rows = found.select(F.col("query_id").alias("case_id"), "rank", "source", "file_id", "content", tokens.alias("matched_tokens"))
        scored = evaluate.score_cases(sound, rows)
        return scored, evaluate.report(scored)
