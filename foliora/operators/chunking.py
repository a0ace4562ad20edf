"""Chunks: character windows in closed form, and semantic chunks of units."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.errors import ConfigurationError
from foliora.functions.lineage import cut
from foliora.functions.rows import map_rows, spread, unnest
from foliora.functions.text import WORD, chars, has_content, let

SIZE, OVERLAP, LEAST, MAX_UNITS, BREAK, PAGE_MERGE = 800, 120, 120, 12, 0.35, 0.55
NARROW, QUANTILE = 0.08, 0.25


def check_parameters(size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, threshold: float = BREAK, page_merge: float = PAGE_MERGE, max_units: int = MAX_UNITS) -> None:
    """Raise ``ConfigurationError`` unless all parameters of chunking are in range."""
    for sound, what in (
        (size > 0, "size must be above 0"), (0 <= overlap < size, "overlap must be from 0 to below size"), (least >= 0, "least must not be negative"),
        (0 <= threshold <= 1, "threshold must be within [0, 1]"), (0 <= page_merge <= 1, "page_merge must be within [0, 1]"), (max_units > 0, "max_units must be above 0"),
    ):
        if not sound:
            raise ConfigurationError(what)


def strategy(name: str) -> str:
    """``character`` or ``semantic``, however spelled."""
    s = name.strip().lower().replace("-", "_")
    if s not in ("character", "semantic"):
        raise ConfigurationError(f"Unknown chunk strategy: {name}")
    return s


def windows(content: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` letters and digits, each ending where the next word character begins: (start_char, end_char).

    In closed form from the places of word characters: window i begins at that of number i * (size -
    overlap) and ends at that of number i * (size - overlap) + size, or with the text."""
    check_parameters(size=size, overlap=overlap)
    step = size - overlap

    def of(cs: Column) -> Column:
        def build(w: Column) -> Column:
            n, total = F.size(w), F.size(cs)
            count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(step)).cast("int"))
            return F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.struct(
                    F.when(i == 0, 0).otherwise(F.get(w, i * step)).cast("int").alias("start_char"), F.when(i * step + size < n, F.get(w, i * step + size)).otherwise(total).cast("int").alias("end_char")
                ),
            )

        places = F.filter(F.transform(cs, lambda c, i: F.when(c.rlike(f"[{WORD}]"), i)), lambda i: i.isNotNull())
        return F.when(F.size(cs) > 0, let(places, build)).otherwise(F.array().cast("array<struct<start_char:int,end_char:int>>"))

    return let(chars(content), of)


def character_chunks(df: DataFrame, key: str, content: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Character windows of every text: key, chunk_index from 1, start_char, end_char, content.

    Null and empty texts give no rows; a text without letters and digits gives one window if it isn't blank."""
    texts = spread(df.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_c")))
    placed = unnest(texts, [key, "_c"], windows(F.col("_c"), size, overlap), "_i", "w")
    text = F.expr("substring(_c, w.start_char + 1, w.end_char - w.start_char)")
    rows = placed.select(key, "_i", "w.start_char", "w.end_char", text.alias("content")).where(has_content(F.col("content")))
    return rows.withColumn("chunk_index", F.row_number().over(W.partitionBy(key).orderBy("_i"))).select(key, "chunk_index", "start_char", "end_char", "content")


def units(bs: Column, size: int = SIZE) -> Column:
    """Blocks cut to units of at most ``size`` letters and digits, without overlap."""

    def of(b: Column, k: Column) -> Column:
        from foliora.functions.text import lstrip, rstrip, strip

        def piece(w: Column) -> Column:
            text = F.substring(b["content"], w["start_char"] + 1, w["end_char"] - w["start_char"])
            return F.struct(
                strip(text).alias("content"),
                (b["start_char"] + w["start_char"] + F.length(text) - F.length(lstrip(text))).alias("start_char"),
                (b["start_char"] + w["start_char"] + F.length(rstrip(text))).alias("end_char"),
                k.alias("block_index"),
            )

        whole = F.array(F.struct(b["content"].alias("content"), b["start_char"].alias("start_char"), b["end_char"].alias("end_char"), k.alias("block_index")))
        parts = F.filter(F.transform(windows(b["content"], size, 0), piece), lambda u: u["content"] != "")
        return F.when(b["words"] <= size, whole).otherwise(parts)

    return F.flatten(F.transform(bs, of))


def cutoff(scores: Column, threshold: float = BREAK) -> Column:
    """Boundary score at which a chunk breaks: the threshold, or the lower quartile if that is higher and scores vary."""

    def of(s: Column) -> Column:
        quartile = F.get(s, F.floor((F.size(s) - 1) * QUANTILE).cast("int"))
        plain = (F.size(s) < 3) | (F.get(s, F.size(s) - 1) - F.get(s, F.lit(0)) < NARROW)
        return F.when(plain, F.lit(threshold)).otherwise(F.greatest(F.lit(threshold), quartile))

    return let(F.array_sort(scores), of)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of the characters of two texts; 0 if either is empty."""
    x, y = F.array_distinct(chars(a)), F.array_distinct(chars(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))))


# --- semantic chunks: numeric work on the units of one section ---------------------------------

Embedder = Callable[[list[str]], list[list[float]]]


def words(s: str) -> int:
    return sum(map(str.isalnum, s))


class GramRows:
    """Texts as rows of unit length: sequences of two to four characters weighted by smoothed inverse frequency.

    Rows are kept sparse, as sorted ids and weights, so that a section of any length fits; sequences are
    told apart by a 64-bit hash."""

    def __init__(self, texts: Sequence[str]):
        keys = [self._grams(t) for t in texts]
        self.empty = not any(len(k) for k, _ in keys)
        seen, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True) if not self.empty else (np.empty(0), np.empty(0, int))
        idf = np.log((1 + len(texts)) / (1 + np.bincount(where, minlength=len(seen)))) + 1
        self.rows, at = [], 0
        for k, n in keys:
            ids = where[at : at + len(k)]
            at += len(k)
            w = n * idf[ids]
            norm = math.sqrt(float(w @ w))
            self.rows.append((ids, w / norm if norm else w))
        self._dots: dict[tuple[int, int], float] = {}

    @staticmethod
    def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
        c = np.frombuffer(re.sub(r"\s\s+", " ", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        parts = []
        with np.errstate(over="ignore"):
            for n in (2, 3, 4):
                h = np.full(max(0, len(c) - n + 1), n, np.uint64)
                for k in range(n):
                    h = (h ^ (c[k : len(c) - n + 1 + k] + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(29)
                parts.append(h)
        return np.unique(np.concatenate(parts), return_counts=True)

    def dot(self, i: int, j: int) -> float:
        key = (min(i, j), max(i, j))
        if key not in self._dots:
            (a, x), (b, y) = self.rows[key[0]], self.rows[key[1]]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            same = b[at] == a if len(b) else np.zeros(len(a), bool)
            self._dots[key] = float(x[same] @ y[at[same]])
        return self._dots[key]

    def likeness(self, left: Sequence[int], right: Sequence[int]) -> float:
        """Cosine of the mean rows of two sets, within [0, 1]."""
        total = lambda a, b: sum(self.dot(i, j) for i in a for j in b)
        norm = math.sqrt(total(left, left)) * math.sqrt(total(right, right))
        return min(1.0, max(0.0, total(left, right) / norm)) if norm else 0.0


def cosine(a: Sequence[float], b: Sequence[float]) -> float:
    """Cosine within [0, 1]; 0 for empty vectors, zero norms and unequal lengths."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    if x.shape != y.shape or not x.size:
        return 0.0
    norm = math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def _shared_chars(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def boundary_scores(texts: Sequence[str], embed: Embedder | None = None) -> list[float]:
    """Likeness across each boundary between units: the two before it against the two after it."""
    if len(texts) < 2:
        return []
    n = len(texts)
    if embed:
        m = np.asarray(embed(list(texts)), float)
        return [cosine(m[max(0, i - 1) : i + 1].mean(0), m[i + 1 : i + 3].mean(0)) for i in range(n - 1)]
    rows = GramRows(texts)
    if rows.empty:
        return [_shared_chars(a, b) for a, b in zip(texts, texts[1:])]
    return [rows.likeness(range(max(0, i - 1), i + 1), range(i + 1, min(n, i + 3))) for i in range(n - 1)]


def similarity(a: str, b: str, embed: Embedder | None = None) -> float:
    """Likeness of two texts within [0, 1]."""
    a, b = a.strip(), b.strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if embed:
        return cosine(*embed([a, b]))
    rows = GramRows([a, b])
    return _shared_chars(a, b) if rows.empty else rows.likeness([0], [1])


def break_at(scores: Sequence[float], threshold: float) -> float:
    s = sorted(scores)
    if len(s) < 3 or s[-1] - s[0] < NARROW:
        return threshold
    return max(threshold, s[int((len(s) - 1) * QUANTILE)])


def _average(xs: Sequence[float]) -> float:
    return sum(xs) / len(xs) if xs else 1.0


def fold_small(items: list, size_of: Callable, join: Callable, least: int, most: int) -> list:
    """Join each small item with the following one, or else with the one before, where both fit."""
    if least <= 0 or len(items) < 2:
        return items
    out: list = []
    rest = list(reversed(items))
    while rest:
        x = rest.pop()
        if size_of(x) >= least:
            out.append(x)
        elif rest and size_of(x) + size_of(rest[-1]) <= most:
            out.append(join(x, rest.pop()))
        elif out and size_of(out[-1]) + size_of(x) <= most:
            out.append(join(out.pop(), x))
        else:
            out.append(x)
    return out


def _paragraph(a: str, b: str) -> str:
    return f"{a.rstrip()}\n\n{b.lstrip()}".strip()


def section_drafts(us: Sequence[dict], size: int, least: int, threshold: float, max_units: int, embed: Embedder | None = None) -> list[dict]:
    """Units of one section grouped to chunks: content, start_char, end_char, score."""
    texts = [u["content"] for u in us]
    scores = boundary_scores(texts, embed)
    stop = break_at(scores, threshold)
    drafts: list[dict] = []
    filled = count = 0
    inner: list[float] = []
    for i, u in enumerate(us):
        n = words(u["content"])
        if drafts and i and scores[i - 1] > stop and filled + n <= size and count < max_units:
            d = drafts[-1]
            gap = "" if u["block_index"] == us[i - 1]["block_index"] else "\n\n"
            d["content"] = d["content"].rstrip() + gap + u["content"].lstrip()
            d["end_char"] = u["end_char"]
            inner.append(scores[i - 1])
            filled, count = filled + n, count + 1
        else:
            drafts.append({"content": u["content"], "start_char": u["start_char"], "end_char": u["end_char"]})
            inner, filled, count = [], n, 1
        drafts[-1]["score"] = _average(inner)
    for d in drafts:
        d["content"] = d["content"].strip()

    def join(a: dict, b: dict) -> dict:
        return {"content": _paragraph(a["content"], b["content"]), "start_char": a["start_char"], "end_char": b["end_char"], "score": (a["score"] + b["score"]) / 2}

    return fold_small(drafts, lambda d: words(d["content"]), join, least, size)


DRAFT = "content string, start_char int, end_char int, score double"


def drafts(built: DataFrame, key: str, carry: Sequence[str] = (), size: int = SIZE, least: int = LEAST, threshold: float = BREAK, max_units: int = MAX_UNITS, embed: Embedder | None = None) -> DataFrame:
    """Draft chunks of every section that ``sections.build`` made: key, carried columns, section_no, hard_break_key, draft_no, and the draft."""
    check_parameters(size=size, overlap=0, least=least, threshold=threshold, max_units=max_units)
    names = [key, *carry, "section_no", "hard_break_key"]
    kinds = ", ".join(f"`{n}` {built.schema[n].dataType.simpleString()}" for n in names)

    def rows(*values):
        for i, d in enumerate(section_drafts(values[-1], size, least, threshold, max_units, embed)):
            yield (*values[:-1], i, d["content"], d["start_char"], d["end_char"], d["score"])

    return map_rows(built.withColumn("units", units(F.col("blocks"), size)), [*names, "units"], rows, f"{kinds}, draft_no int, {DRAFT}")


def semantic_chunks(df: DataFrame, key: str, content: str, **parameters) -> DataFrame:
    """Semantic chunks of texts that aren't pages: key, chunk_index, chunk_count, hard_break_key, semantic_score, offsets, content."""
    from foliora.operators import sections
    from foliora.operators.clean import clean_documents

    size, least = parameters.get("size", SIZE), parameters.get("least", LEAST)
    built = sections.build(clean_documents(df.select(key, content, "file_type"), content), key, "cleaned", least=least, most=size)
    d = drafts(built, key, **parameters)
    order = W.partitionBy(key).orderBy("section_no", "draft_no")
    return d.select(
        key, F.row_number().over(order).alias("chunk_index"), F.count("*").over(W.partitionBy(key)).cast("int").alias("chunk_count"), "hard_break_key", F.col("score").alias("semantic_score"), "start_char", "end_char", "content"
    )


MERGED = "source string, page_start int, page_end int, hard_break_key string, semantic_score double, start_char int, end_char int, content string"


def merge_pages(d: DataFrame, size: int = SIZE, least_score: float = PAGE_MERGE, embed: Embedder | None = None) -> DataFrame:
    """Join a draft that opens a page to the one that closed the page before, where they are alike and fit.

    ``d`` has source, page_number, section_no, draft_no, hard_break_key and the draft. Drafts of one page
    are never joined, nor are those of pages that don't follow each other or whose neighbours can't fit;
    there each source is cut into runs, and each run is folded by itself, not the source."""
    order = W.partitionBy("source").orderBy("page_number", "section_no", "draft_no")
    # one narrow row a draft
    sizes = d.select("source", "page_number", "section_no", "draft_no", F.length(F.regexp_replace("content", f"[^{WORD}]", "")).alias("w"))
    follows = (F.lag("page_number").over(order) + 1 == F.col("page_number")) & (F.lag("w").over(order) + F.col("w") <= size)
    runs = sizes.withColumn("_c", (~F.coalesce(follows, F.lit(False))).cast("bigint")).withColumn("run", F.sum("_c").over(order)).select("source", "page_number", "section_no", "draft_no", "run")
    counted = runs.withColumn("of", F.count("*").over(W.partitionBy("source", "run")))
    keyed = d.join(counted, ["source", "page_number", "section_no", "draft_no"])
    alone = keyed.where("of = 1").select(
        "source", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "hard_break_key", F.col("score").alias("semantic_score"), "start_char", "end_char", "content"
    )

    def fold(source, rows):
        out: list[dict] = []
        for r in rows:
            p = out[-1] if out else None
            new = {"source": source, "page_start": r["page_number"], "page_end": r["page_number"], "hard_break_key": r["hard_break_key"], "semantic_score": r["score"], "start_char": r["start_char"], "end_char": r["end_char"], "content": r["content"]}
            fits = (
                p is not None and p["page_end"] is not None and r["page_number"] is not None and r["page_number"] == p["page_end"] + 1
                and (r["hard_break_key"] is None or r["hard_break_key"] == p["hard_break_key"]) and words(p["content"]) + words(r["content"]) <= size
            )
            if fits and (s := similarity(p["content"], r["content"], embed)) >= least_score:
                p |= {"content": _paragraph(p["content"], r["content"]), "page_end": r["page_number"], "end_char": r["end_char"], "hard_break_key": p["hard_break_key"] or r["hard_break_key"], "semantic_score": s}
            else:
                out.append(new)
        return [tuple(x.values()) for x in out]

    # a run a row, so that many runs share a batch
    drafts_of = F.struct("page_number", "section_no", "draft_no", "hard_break_key", "content", "start_char", "end_char", "score")
    gathered = keyed.where("of > 1").groupBy("source", "run").agg(F.array_sort(F.collect_list(drafts_of)).alias("rows"))
    return alone.unionByName(map_rows(gathered, ["source", "rows"], fold, MERGED))


def page_chunks(pages: DataFrame, page_merge: float = PAGE_MERGE, **parameters) -> DataFrame:
    """Semantic chunks of paged sources, joined over page ends that are alike from ``page_merge`` on, with ids and numbers within their source."""
    check_parameters(page_merge=page_merge)
    from foliora.operators import sections
    from foliora.operators.clean import clean_pages

    size, least = parameters.get("size", SIZE), parameters.get("least", LEAST)
    cleaned = clean_pages(pages).where("source is not null and page_number is not null")
    built = sections.build(cleaned, "page_doc_id", "cleaned", least=least, most=size)
    # the narrow columns of the pages come back by key, without cleaning them again
    where = pages.select("page_doc_id", "source", "page_number").where("source is not null and page_number is not null").dropDuplicates(["page_doc_id"])
    merged = merge_pages(cut(drafts(built, "page_doc_id", **parameters).join(where, "page_doc_id")), size=size, least_score=page_merge, embed=parameters.get("embed"))
    order = W.partitionBy("source").orderBy("page_start", "start_char")
    numbered = merged.withColumn("chunk_index", F.row_number().over(order)).withColumn("chunk_count", F.count("*").over(W.partitionBy("source")).cast("int"))
    return numbered.withColumn("chunk_id", F.format_string("%s:chunk:%04d", "source", "chunk_index"))
