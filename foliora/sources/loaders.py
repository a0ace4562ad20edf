"""Loading: text files and pages, what is skipped and why, kinds of files, and evaluation cases."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliora.errors import ConfigurationError, DocumentError
from foliora.functions.text import has_content, strip

TEXT, PDF, IMAGES = (".md", ".txt"), ".pdf", (".png", ".jpg", ".jpeg", ".webp")
MIN_VISION_CHARS = 40
# Media types by suffix.
MIME = {
    ".md": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
}
OTHER_MIME = "application/octet-stream"


def load_strategy(name: str) -> str:
    s = name.strip().lower().replace("-", "_")
    if s not in ("text", "auto", "visual"):
        raise ConfigurationError(f"Unknown load strategy: {name}")
    return s


def suffix(name: Column) -> Column:
    """Suffix of a file name in small letters, with its point; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"\A.*/", ""), r"[^.](\.[^./]+)\z", 1))


def mime_type(name: Column) -> Column:
    s, out = suffix(name), F.lit(OTHER_MIME)
    for k, v in MIME.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def needs_vision(content: Column, strategy: str, least: int = MIN_VISION_CHARS) -> Column:
    """Whether a page is read from its image: always, never, or if its text is too short."""
    s = load_strategy(strategy)
    if s == "auto":
        return F.coalesce(F.length(strip(content)) < least, F.lit(True))
    return F.lit(s == "visual")


def loaded(df: DataFrame, content: str) -> DataFrame:
    """Rows with any content."""
    return df.where(has_content(F.col(content)))


def skipped(df: DataFrame, name: Column, content: str) -> DataFrame:
    """Adds a ``message`` to the rows that are not loaded."""
    kind = F.when(F.col("file_type").isin(*TEXT, PDF), F.lit("empty document: ")).otherwise(F.lit("unsupported file type: "))
    return df.where(~has_content(F.col(content)) | ~F.col("file_type").isin(*TEXT, PDF)).withColumn("message", F.concat(kind, F.coalesce(name, F.lit("?"))))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path: place below it, name, suffix and size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"\A.*/", "")
    return files.select("path", name.alias("file_name"), suffix(name).alias("file_type"), F.col("length").alias("size_bytes"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files under a path, each as one document; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"\A.*/", "")
    rows = files.select(F.col("path").alias("source"), name.alias("file_name"), suffix(name).alias("file_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size_bytes"))
    return rows.where(F.col("file_type").isin(*TEXT))


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] | None = None, strategy: str = "text", render: Callable[[bytes], list[bytes]] | None = None, model: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """Pages of the PDF files under a path; ``reader`` gives the texts of a file's pages (pypdf if none is given).

    By the strategies ``visual`` and ``auto`` all pages, or those with hardly any text, are read by the vision
    ``model`` from the images (PNG) that ``render`` makes of a file's pages; without both they are refused."""
    how = load_strategy(strategy)
    if how != "text" and (render is None or model is None):
        raise ConfigurationError(f"The load strategy {how} needs a renderer and a vision model.")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    read = reader or _pypdf

    def pages(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = read(data)
                if how != "text":
                    poor = [i for i, t in enumerate(texts) if how == "visual" or len((t or "").strip()) < MIN_VISION_CHARS]
                    images = render(bytes(data)) if poor else []
                    for i in poor:
                        texts[i] = model(images[i], "image/png")
                rows += [(source, i, len(texts), t) for i, t in enumerate(texts, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string())], names=["source", "page_number", "page_count", "content"])

    return files.select(F.col("path").alias("source"), "content").mapInArrow(pages, "source string, page_number int, page_count int, content string")


def _pypdf(data: bytes) -> list[str]:
    try:
        import io

        from pypdf import PdfReader
    except ImportError as e:
        raise DocumentError("Reading PDF files needs pypdf.") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def read_images(spark: SparkSession, path: str, model: Callable[[bytes, str], str]) -> DataFrame:
    """Texts of the images under a path, by a vision model that is called in the workers."""
    name = F.regexp_replace("path", r"\A.*/", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix(name).isin(*IMAGES))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            texts = pa.array([model(data, mime) for data, mime in zip(b.column(3).to_pylist(), b.column(4).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], texts], names=["source", "file_name", "file_type", "content"])

    rows = files.select(F.col("path").alias("source"), name.alias("file_name"), suffix(name).alias("file_type"), "content", mime_type(name).alias("mime"))
    return rows.mapInArrow(read, "source string, file_name string, file_type string, content string")


CASE = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("collection_id", T.StringType()), T.StructField("expected_sources", T.ArrayType(T.StringType())),
        T.StructField("expected_file_ids", T.ArrayType(T.StringType())), T.StructField("expected_keywords", T.ArrayType(T.StringType())), T.StructField("top_k", T.IntegerType()),
    ]
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line, with the ``line`` of each; adds ``error`` to lines that can't be used.

    A file of cases is read whole, since its lines are numbered."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)).alias("_i", "value"))
    parsed = lines.select((F.col("_i") + 1).alias("line"), "value", F.from_json("value", CASE, {"mode": "PERMISSIVE"}).alias("c"), F.try_parse_json("value").alias("j"))
    kind = lambda n: F.schema_of_variant(F.try_variant_get("j", f"$.{n}", "variant"))
    error = F.when(strip(F.col("value")) == "", "empty line").when(F.col("j").isNull(), "not valid JSON").when(~F.col("value").rlike(r"\A\s*\{"), "not an object")
    for n in ("id", "query", "collection_id"):
        error = error.when(F.coalesce(kind(n), F.lit("")) != "STRING", f"missing {n}").when(F.col(f"c.{n}") == "", f"missing {n}")
    for n in ("expected_sources", "expected_file_ids", "expected_keywords"):
        error = error.when(kind(n).isNotNull() & ~kind(n).isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{n} must be a list of strings")
    error = error.when(kind("top_k").isNotNull() & ~kind("top_k").isin("BIGINT", "VOID"), "top_k must be a whole number").when(F.col("c.top_k") <= 0, "top_k must be above 0")
    none = F.array().cast("array<string>")
    return parsed.select("line", "c.id", "c.query", "c.collection_id", *(F.coalesce(f"c.{n}", none).alias(n) for n in ("expected_sources", "expected_file_ids", "expected_keywords")), "c.top_k", error.alias("error"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON, one object a line, into the folder ``path``."""
    cases.select(F.to_json(F.struct(*cases.columns)).alias("value")).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a single row as indented JSON on the driver's disk."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(report.first().asDict(recursive=True), indent=2, ensure_ascii=False, default=str))
