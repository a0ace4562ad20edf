"""Splitting oversized items at natural boundaries, by content-defined landmarks.

A rolling hash over letters and digits marks places that depend only on the text around them; each
snaps to the nearest natural boundary that keeps the piece within its least and greatest size, so an
edit alters only the pieces near it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliora.errors import ConfigurationError
from foliora.functions.rows import map_rows

WINDOW = 16  #: letters and digits under the rolling hash
MOST_LIMITS = 10_000  #: rows that a table of limits may have
LEAST = 0.4  #: least size of a piece's new part, as a share of the greatest
# Natural boundaries with their rank, the end of the match being the place to cut.
BOUNDARIES = [
    (4, re.compile(r"\n\s*\n\s*")),
    (3, re.compile(r"[.!?。！？।؟…]+[\"'”’»」』）)\]]*\s+|[。！？।]+[”’»」』）]*|\n\s*(?=\S)")),
    (2, re.compile(r"[,;:，；：、،؛]\s*")),
    (1, re.compile(r"[ \t　]+")),
]
JOINED = re.compile(r"[̀-֑ͯ-ׇؐ-ًؚ-ٟऀ-ःऺ-ॏัิ-ฺ็-๎‍⃐-⃿゙゚︀-️\U0001f3fb-\U0001f3ff]")


def word_places(text: str) -> np.ndarray:
    """Places of the letters and digits (Unicode L and N), which alone count for sizes."""
    return np.fromiter((i for i, c in enumerate(text) if c.isalnum()), np.int64)


def _landmarks(text: str, places: np.ndarray, every: int) -> np.ndarray:
    """Ordinals of letters and digits after which the rolling hash marks a place, about one in ``every``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)[places]
    h = np.zeros(len(codes), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(WINDOW, len(codes))):
            h[j:] += codes[: len(codes) - j] * power
            power *= base
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(max(2, every)) == 0) + 1


def pieces(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece; one piece if the text isn't too large, none for an empty text.

    Each piece has at most ``max_size`` letters and digits; each but the first begins exactly
    ``overlap`` of them before the end of the piece before it."""
    if max_size <= 0 or not 0 <= overlap < max_size:
        raise ValueError("needs 0 <= overlap < max_size")
    if not text:
        return []
    places = word_places(text)
    n = len(places)
    if n <= max_size:
        return [(0, len(text))]
    core = max_size - overlap
    least = max(1, int(core * LEAST))
    marks = _landmarks(text, places, max(2, (core - least) // 2))
    cut_at: dict[int, tuple[int, int]] = {}  # ordinal of the cut: rank, place
    for rank, pattern in BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        for e, o in zip(ends.tolist(), np.searchsorted(places, ends).tolist()):
            if o not in cut_at:
                cut_at[o] = (rank, e)
    naturals = np.array(sorted(cut_at), np.int64)
    ranks = np.array([cut_at[o][0] for o in naturals.tolist()], np.int64)
    ends_at: list[tuple[int, int]] = []  # ordinal and place of each cut
    done = 0
    while n - done > (max_size if not ends_at else core):
        # the first piece has no overlap before it, but must reach beyond that of the next
        lo, hi = done + least + (0 if ends_at else overlap), done + (core if ends_at else max_size)
        k = np.searchsorted(marks, lo)
        aim = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        a, b = np.searchsorted(naturals, [lo, hi + 1])
        if a < b:
            best = ranks[a:b].max()
            # words are cut apart only where nothing better is in reach; sentences and paragraphs are alike
            near = np.flatnonzero(ranks[a:b] >= min(best, 3))
            o = int(naturals[a:b][near[np.argmin(np.abs(naturals[a:b][near] - aim))]])
            place = cut_at[o][1]
        else:
            o = aim
            while o > lo and JOINED.match(text, int(places[o - 1]) + 1):
                o -= 1
            place = int(places[o - 1]) + 1
        ends_at.append((o, place))
        done = o
    out, start = [], 0
    for o, place in ends_at:
        out.append((start, place))
        start = int(places[o - overlap]) if overlap else place
    return [*out, (start, len(text))]


def _rows(k, text, max_size, overlap):
    places = pieces(text, max_size, overlap)
    if len(places) > 1:
        for i, (a, b) in enumerate(places, 1):
            yield k, i, len(places), a, b, text[a:b]


def split(df: DataFrame, key: str, text: str, max_size: str = "max_size", overlap: str = "overlap_size") -> DataFrame:
    """Pieces of every text above its limit: key, number from 1, count, start, end and text.

    Null, blank and small texts give no rows, nor do rows whose limit is null; repeated rows count
    once for each distinct key and text. ``max_size`` and ``overlap`` are columns of ``df``."""
    kind = df.schema[key].dataType.simpleString()
    # a text has at most as many letters and digits as characters, so this drops no oversized one
    large = df.select(key, text, max_size, overlap).where((F.length(text) > F.col(max_size)) & F.col(overlap).isNotNull()).dropDuplicates([key])
    return map_rows(large, [key, text, max_size, overlap], _rows, f"`{key}` {kind}, piece_no int, pieces int, start_char int, end_char int, piece string")


def limited(df: DataFrame, limits: DataFrame, item_table: str) -> DataFrame:
    """Rows of ``df`` with their limit: that of their file type, or else the table's row for all types; rows without either are left out.

    ``limits`` has a row for each table and file type, a handful whatever the size of the data; its size is checked
    before it is broadcast."""
    if limits.limit(MOST_LIMITS + 1).count() > MOST_LIMITS:
        raise ConfigurationError(f"more than {MOST_LIMITS} rows of limits")
    mine = limits.where(F.col("item_table") == item_table).select("file_type", "max_size", "overlap_size").dropDuplicates(["file_type"])

    def by(name: str) -> DataFrame:
        return F.broadcast(mine.select(F.col("file_type").alias(f"_{name}"), F.col("max_size").alias(f"_m_{name}"), F.col("overlap_size").alias(f"_o_{name}")))

    kind = F.lower("file_type") if "file_type" in df.columns else F.lit(None).cast("string")
    keyed = df.drop("max_size", "overlap_size").withColumn("_own", kind).withColumn("_any", F.lit("*"))
    both = keyed.join(by("own"), "_own", "left").join(by("any"), "_any", "left")
    own = F.col("_m_own").isNotNull()
    found = both.withColumn("max_size", F.when(own, F.col("_m_own")).otherwise(F.col("_m_any"))).withColumn("overlap_size", F.when(own, F.col("_o_own")).otherwise(F.col("_o_any")))
    return found.where("max_size is not null").select(*[c for c in df.columns if c not in ("max_size", "overlap_size")], "max_size", "overlap_size")


def all_pieces(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the oversized documents and chunks, with table and key of each."""
    parts = []
    for table, df, key, text in (("documents", documents.select("doc_id", "text", "file_type"), "doc_id", "text"), ("chunks", chunks.select("chunk_id", "content"), "chunk_id", "content")):
        p = split(limited(df, limits, table), key, text)
        parts.append(p.select(F.lit(table).alias("item_table"), F.col(key).cast("string").alias("item_key"), *p.columns[1:]))
    return parts[0].unionByName(parts[1])


def found(documents: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Items that had to be split, one row each."""
    return all_pieces(documents, chunks, limits).where("piece_no = 1").select("item_table", "item_key")
