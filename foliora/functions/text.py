"""Text functions as Spark columns, with the white space and letters of Unicode rather than of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, with the separators U+001C to U+001F, as the inside of a class.
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}"
#: Chinese characters as the tokenizer and the line joiner know them.
HAN = r"\x{4e00}-\x{9fff}"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{SPACE}]+", "")


def has_content(c: Column) -> Column:
    """Whether anything but white space is there; false for null."""
    return F.coalesce(c.rlike(rf"[^{SPACE}]"), F.lit(False))


def unix_lines(c: Column) -> Column:
    """Line ends of any system as line feeds."""
    return F.regexp_replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    return F.split(unix_lines(c), "\n", -1)


def clean_line(c: Column) -> Column:
    """A line stripped, with runs of blanks and tabs as one blank."""
    return F.regexp_replace(strip(c), r"[ \t\f\x{b}]+", " ")


def word_chars(c: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(c, rf"[^{WORD}]", ""))


def chars(c: Column) -> Column:
    """The characters of a text, as an array."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def distinct_nonempty(a: Column) -> Column:
    """First occurrences, without empty strings."""
    return F.array_distinct(F.filter(a, lambda x: x != ""))


def preview(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(rstrip(F.substring(c, 1, n)), F.lit("..."))).otherwise(c)


def fixed(c: Column, digits: int = 3) -> Column:
    """A number with so many decimals; halves of the last decimal are rounded away from zero."""
    return F.round(c.cast("decimal(30,12)"), digits).cast("string")


def let(value: Column, fn) -> Column:
    """``fn(value)``, with ``value`` computed once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
