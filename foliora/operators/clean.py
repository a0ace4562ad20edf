"""Cleaning of lines: decoration, bare numbers, page markers and repeated page edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliora.functions.rows import spread, unnest
from foliora.functions.text import SPACE, clean_line, has_content, let, lines, strip, word_chars

# Patterns of lines that carry no text.
NUMBER = r"(?:\p{Nd}+|[一二三四五六七八九十百千万〇零两]+)"
MARKS = r"[-_=*#~·•—–|+]"
S = f"[{SPACE}]"
DECORATIVE = rf"\A{S}*(?:{MARKS}{{3,}}|(?:[<《【\[]{S}*{MARKS}{{2,}}{S}*[>》】\]])+){S}*\z"
MARKER = rf"(?i)\A{S}*(?:第{S}*{NUMBER}{S}*页|Page{S}*\p{{Nd}}+(?:{S}*/{S}*\p{{Nd}}+)?|\p{{Nd}}+{S}*/{S}*\p{{Nd}}+|[-–—]{S}*\p{{Nd}}{{1,4}}{S}*[-–—]){S}*\z"
BARE_NUMBER = rf"\A[（(]?{S}*{NUMBER}{S}*[）)]?\z"
ENGLISH_PAGE = rf"\bpage{S}*\p{{Nd}}+(?:{S}*/{S}*\p{{Nd}}+)?\b"
CHINESE_PAGE = rf"第{S}*{NUMBER}{S}*页"
SEPARATED = rf"(^|[{SPACE}\-–—_/|:：])\p{{Nd}}{{1,4}}(?=$|[{SPACE}\-–—_/|:：])"
SEPARATORS = rf"[{SPACE}\-–—_/|:：,，.。]+"

EDGE_LINES, EDGE_SHARE, EDGE_PAGES, EDGE_CHARS = 3, 0.6, 3, 120
MARKER_KEY = "<page-marker>"


def is_decorative(line: Column) -> Column:
    return line.rlike(DECORATIVE)


def is_marker(line: Column) -> Column:
    return line.rlike(MARKER)


def is_bare_number(line: Column) -> Column:
    return (F.length(line) <= 4) & line.rlike(BARE_NUMBER)


def edge_key(line: Column) -> Column:
    """The form in which lines at page edges are compared; empty for lines that can't be compared."""
    k = F.replace(F.lower(line), F.lit("ß"), F.lit("ss"))
    k = F.regexp_replace(k, ENGLISH_PAGE, " page <num> ")
    k = F.regexp_replace(k, CHINESE_PAGE, " page <num> ")
    k = F.regexp_replace(k, SEPARATED, "$1<num>")
    k = strip(F.regexp_replace(k, SEPARATORS, " "))
    short = (word_chars(k) <= 1) & ~F.contains(k, F.lit("<num>"))
    return F.when((line == "") | is_decorative(line), "").when(is_marker(line), MARKER_KEY).when(short, "").otherwise(k)


def _edge(candidates: Column, side: str) -> Column:
    return F.slice(candidates, 1, EDGE_LINES) if side == "top" else F.reverse(F.slice(F.reverse(candidates), 1, EDGE_LINES))


def _side_keys(side: str) -> Column:
    """The distinct keys on one side of a page's candidate lines ``c``."""
    keys = F.array_distinct(F.transform(_edge(F.col("c"), side), edge_key))
    return F.transform(keys, lambda k: F.struct(F.lit(side).alias("side"), k.alias("key")))


def page_edges(pages: DataFrame) -> DataFrame:
    """Keys of lines repeated at the top or bottom of a source's pages: on six tenths of them at least.

    ``pages`` needs page_doc_id, source, page_number, content and file_type; only paged PDF sources of
    three pages or more have any. Repeated rows of a page count once. Pages are counted by key before
    the exchange; no source is gathered."""
    pdf = spread(pages.where((F.col("file_type") == ".pdf") & F.col("source").isNotNull() & F.col("page_number").isNotNull()).select("page_doc_id", "source", "content"))
    candidates = F.filter(F.transform(lines(F.coalesce("content", F.lit(""))), clean_line), lambda x: (x != "") & (F.length(x) <= EDGE_CHARS))
    per_page = pdf.select("page_doc_id", "source", candidates.alias("c")).dropDuplicates(["page_doc_id"])
    keys = F.concat(_side_keys("top"), _side_keys("bottom"))
    exploded = unnest(per_page, ["source"], keys, "_i", "k").select("source", "k.side", "k.key").where("key <> ''")
    counts = exploded.groupBy("source", "side", "key").agg(F.count("*").alias("pages"))
    totals = per_page.groupBy("source").agg(F.count("*").alias("n"))
    enough = (F.col("n") >= EDGE_PAGES) & (F.col("pages") >= F.greatest(F.lit(1), F.ceil(F.col("n") * EDGE_SHARE)))
    return counts.join(totals, "source").where(enough).select("source", "side", "key", "pages")


def clean_content(content: Column, is_pdf: Column, tops: Column, bottoms: Column) -> Column:
    """A text without lines that carry none; other lines stay as they are."""

    def of(raw: Column) -> Column:
        def kept(clean: Column) -> Column:
            full = F.filter(F.transform(clean, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())

            def repeated(places: Column, keys: Column) -> Column:
                return F.filter(F.slice(places, 1, EDGE_LINES), lambda i: F.coalesce(F.array_contains(keys, edge_key(F.get(clean, i))), F.lit(False)))

            # keys are made of the lines at the edges only, once a page
            edges = F.when(is_pdf & ((F.size(tops) > 0) | (F.size(bottoms) > 0)), let(full, lambda f: F.concat(repeated(f, tops), repeated(F.reverse(f), bottoms)))).otherwise(F.array().cast("array<int>"))

            def filtered(edge: Column) -> Column:
                def keep(x: Column, i: Column) -> Column:
                    c = F.get(clean, i)
                    dropped = is_decorative(c) | (is_pdf & is_marker(c)) | is_bare_number(c) | F.array_contains(edge, i)
                    return (c == "") | ~dropped

                return F.filter(raw, keep)

            return let(edges, filtered)

        return let(F.transform(raw, clean_line), kept)

    return F.array_join(let(lines(content), of), "\n")


def clean_documents(df: DataFrame, content: str = "text") -> DataFrame:
    """Adds ``cleaned`` to texts that aren't pages of a source; null stays null."""
    none = F.array().cast("array<string>")
    return spread(df).withColumn("cleaned", clean_content(F.col(content), F.coalesce(F.col("file_type") == ".pdf", F.lit(False)), none, none))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Adds ``cleaned`` to pages, without their source's repeated edges; repeated rows of a page count once."""
    found = page_edges(pages).groupBy("source").agg(
        # at most EDGE_LINES / EDGE_SHARE keys a side
        F.collect_set(F.when(F.col("side") == "top", F.col("key"))).alias("tops"), F.collect_set(F.when(F.col("side") == "bottom", F.col("key"))).alias("bottoms"),
    )
    none = F.array().cast("array<string>")
    one = pages.dropDuplicates(["page_doc_id"]).join(found, "source", "left")
    return one.withColumn("cleaned", clean_content(F.col("content"), F.coalesce(F.col("file_type") == ".pdf", F.lit(False)), F.coalesce("tops", none), F.coalesce("bottoms", none))).drop("tops", "bottoms")


__all__ = ["clean_content", "clean_documents", "clean_pages", "edge_key", "has_content", "is_bare_number", "is_decorative", "is_marker", "page_edges"]
