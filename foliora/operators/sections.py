"""Sections at question headings, blocks at blank lines, and merging of small blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliora.functions.rows import spread, unnest
from foliora.functions.text import HAN, SPACE, clean_line, has_content, let, lstrip, rstrip, strip, unix_lines, word_chars
from foliora.operators.clean import NUMBER, S

# Patterns of headings and of the space between blocks.
HEADING = rf"(?im)^{S}*(?:(?:问题|问|题){S}*[:：.\-、]?{S}*{NUMBER}|第{S}*{NUMBER}{S}*(?:题|问|小题)|Q(?:uestion)?{S}*[:：.\-、]?{S}*\p{{Nd}}+)(?=[{SPACE}]|[、，,.:：。)\]】）-]|\z)"
HEADING_NOISE = rf"[{SPACE}:：.\-、，,。)\]】）]+"
BLANK = rf"\n{S}*\n+"
CUT = "\x01"

BLOCK = "struct<content:string,start_char:int,end_char:int,words:int>"


def _offsets(parts: Column, gaps: Column) -> Column:
    """Where each part begins, given the parts and what lay between them."""

    def step(acc: Column, i: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(last + F.length(F.get(parts, i)) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0))))

    at = F.when(F.size(parts) > 1, F.sequence(F.lit(0), F.size(parts) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.array(F.lit(0)), step)


def sections(content: Column) -> Column:
    """Sections as (start_char, end_char, hard_break_key, text); text before the first heading has no key."""

    def of(c: Column) -> Column:
        marked = F.regexp_replace(c, f"({HEADING})", f"{CUT}$1")

        def places(parts: Column) -> Column:
            def build(starts: Column) -> Column:
                key = lambda p: F.regexp_replace(F.regexp_extract(p, HEADING, 0), HEADING_NOISE, "")
                return F.transform(
                    parts,
                    lambda p, i: F.struct(
                        F.get(starts, i).alias("start_char"), (F.get(starts, i) + F.length(p)).alias("end_char"), F.when((i > 0), key(p)).alias("hard_break_key"), p.alias("text")
                    ),
                )

            return let(_offsets(parts, F.array().cast("array<string>")), build)

        whole = let(F.split(marked, CUT, -1), places)
        return F.filter(whole, lambda s: (F.length(s["text"]) > 0) | (F.size(whole) == 1))

    return let(unix_lines(F.replace(content, F.lit(CUT), F.lit(""))), of)


def _join_pdf(ls: Column) -> Column:
    """Lines of a page as one: split words are joined, Chinese lines run on, others get a space."""

    def step(acc: Column, x: Column) -> Column:
        first, last = F.substring(x, 1, 1), F.right(acc, F.lit(1))
        return (
            F.when(acc == "", x)
            .when((last == "-") & first.rlike(r"\p{Ll}"), F.concat(F.left(acc, F.length(acc) - 1), x))
            .when(last.rlike(f"[{HAN}]") & first.rlike(f"[{HAN}]"), F.concat(acc, x))
            .otherwise(F.concat(acc, F.lit(" "), x))
        )

    return F.aggregate(ls, F.lit(""), step)


def clean_block(raw: Column, is_pdf: Column) -> Column:
    """A block's text with its lines stripped and empty ones left out."""
    return let(F.filter(F.transform(F.split(raw, "\n", -1), clean_line), lambda x: x != ""), lambda ls: F.when(is_pdf, _join_pdf(ls)).otherwise(F.array_join(ls, "\n")))


def blocks(text: Column, start_char: Column, is_pdf: Column) -> Column:
    """Blocks of a section as (content, start_char, end_char, words), by blank lines."""

    def of(both: Column) -> Column:
        parts, gaps = both["parts"], both["gaps"]

        def build(starts: Column) -> Column:
            made = F.transform(
                parts,
                lambda p, i: F.struct(
                    clean_block(p, is_pdf).alias("content"),
                    (start_char + F.get(starts, i) + F.length(p) - F.length(lstrip(p))).alias("start_char"),
                    (start_char + F.get(starts, i) + F.length(rstrip(p))).alias("end_char"),
                ),
            )
            full = F.filter(made, lambda b: b["content"] != "")
            return F.transform(full, lambda b: F.struct(strip(b["content"]).alias("content"), b["start_char"].alias("start_char"), b["end_char"].alias("end_char"), word_chars(b["content"]).alias("words")))

        return let(_offsets(parts, gaps), build)

    return let(F.struct(F.split(text, BLANK, -1).alias("parts"), F.regexp_extract_all(text, F.lit(BLANK), F.lit(0)).alias("gaps")), of)


def merge_blocks(bs: Column, least: int = 120, most: int = 800) -> Column:
    """Small blocks joined with the next one, or else the one before, where both fit within ``most``."""
    if least <= 0:
        return bs

    def joined(a: Column, b: Column) -> Column:
        return F.struct(
            strip(F.concat(rstrip(a["content"]), F.lit("\n\n"), lstrip(b["content"]))).alias("content"), a["start_char"].alias("start_char"), b["end_char"].alias("end_char"), (a["words"] + b["words"]).alias("words")
        )

    def of(all_: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{BLOCK}>").alias("out"), F.lit(False).alias("skip"))

        def step(acc: Column, i: Column) -> Column:
            out, b, nxt = acc["out"], F.get(all_, i), F.get(all_, i + 1)
            last = F.get(out, F.size(out) - 1)
            append = lambda x: F.struct(F.concat(out, F.array(x)).alias("out"), F.lit(False).alias("skip"))
            with_next = F.struct(F.concat(out, F.array(joined(b, nxt))).alias("out"), F.lit(True).alias("skip"))
            with_last = F.struct(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined(last, b))).alias("out"), F.lit(False).alias("skip"))
            return (
                F.when(acc["skip"], F.struct(out.alias("out"), F.lit(False).alias("skip")))
                .when(b["words"] >= least, append(b))
                .when((i + 1 < F.size(all_)) & (b["words"] + nxt["words"] <= most), with_next)
                .when((F.size(out) > 0) & (last["words"] + b["words"] <= most), with_last)
                .otherwise(append(b))
            )

        folded = F.aggregate(F.sequence(F.lit(0), F.size(all_) - 1), start, step)["out"]
        return F.when(F.size(all_) <= 1, all_).otherwise(folded)

    return let(bs.cast(f"array<{BLOCK}>"), of)


def build(df: DataFrame, key: str, content: str, merge: bool = True, least: int = 120, most: int = 800) -> DataFrame:
    """Sections of every text with their blocks: key, section_no, start_char, end_char, hard_break_key, blocks.

    Sections without blocks are left out, so null and blank texts have no rows."""
    cut = unnest(spread(df.select(key, content, "file_type")), [key, "file_type"], sections(F.col(content)), "section_no", "s")
    # a section has a block just if it has anything but white space
    made = cut.where(has_content(F.col("s.text"))).withColumn("blocks", blocks(F.col("s.text"), F.col("s.start_char"), F.coalesce(F.col("file_type") == ".pdf", F.lit(False))))
    if merge:
        made = made.withColumn("blocks", merge_blocks(F.col("blocks"), least, most))
    return made.select(key, "section_no", "s.start_char", "s.end_char", "s.hard_break_key", "blocks")
