"""One consistent form for text that looks the same but differs in its characters.

Quick-check properties find the segments of a text that the canonical form would change; only these are
normalised, together with the character before them where marks may combine, and spliced back.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliora.functions.lineage import cut
from foliora.functions.rows import map_rows, spread

# Characters that can't be seen, spaces that look like one, and letters of other scripts
# that look like Latin letters (Unicode's confusables for the scripts in use).
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️ᅟᅠㅤﾠ"
SPACES = "         　\t  "
HYPHENS = "‐‑﹣－"
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ғ": "F", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
            "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "Ӏ": "I", "Ѵ": "V", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ό": "ó", "Ό": "Ó", "ϳ": "j", "Ϳ": "J", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "Ϲ": "C"}
# Letters of Cherokee, Lisu, Coptic, Carian, Lycian, Deseret and small capitals, and the Latin letters they look like.
SCRIPTS = "ᎠᎡᏀᏂᏏᏒᏔᏕᏙᏚᏞᏳ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ" "𐊠𐊡𐊢𐊥𐊫𐊱𐊲𐊇𐊗𐐄𐐬" "ᴄᴏꜱᴜᴠᴡᴢ"
LATIN = "DRGhbRWSVSLG" "BPDTGKJCZFMNLSRVHWXYAEIOU" "BHIKMNOPCTYXopc" "ABCFOXFFTOo" "cosuvwz"
OTHERS = dict(zip(SCRIPTS, LATIN)) | {"օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "Լ": "L", "ց": "g", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ǀ": "l", "ℓ": "l", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z"}
#: Compatibility decompositions that don't show: widths, ligatures, radicals, presentation forms, mathematical letters.
UNSEEN = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<vertical>")
#: Of these styles a reader sees the difference.
STYLED = ("DOUBLE-STRUCK", "FRAKTUR", "BLACK-LETTER", "SCRIPT")
BLANK = re.compile(r"[\s" + INVISIBLE + r"]*\Z")


def _single(c: str) -> str | None:
    """What a character becomes in the canonical form whatever stands around it, or None if it stays as it is."""
    if c in INVISIBLE:
        return ""
    if c in SPACES:
        return " "
    if c in HYPHENS:
        return "-"
    n = ord(c)
    tag, _, _ = unicodedata.decomposition(c).partition(" ")
    if tag == "<font>" and any(w in unicodedata.name(c) for w in STYLED):
        return None
    if tag in UNSEEN and not (0xFF00 <= n <= 0xFF60 and unicodedata.category(c)[0] not in "LN"):
        return unicodedata.normalize("NFKC", c)
    if tag == "<compat>" and (0x2E80 <= n <= 0x2FDF or 0xFB00 <= n <= 0xFB06 or 0xFB13 <= n <= 0xFB17 or 0x2160 <= n <= 0x217F or 0xFE00 <= n <= 0xFEFF):
        return unicodedata.normalize("NFKC", c)
    return None


@lru_cache(1)
def _tables() -> tuple[re.Pattern, dict[int, str]]:
    """Pattern of unstable segments and the map of single characters, from the properties above."""
    table: dict[int, str] = {}
    marks: list[int] = []
    for n in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        s = _single(c)
        if s is not None:
            table[n] = unicodedata.normalize("NFC", s)
        elif unicodedata.combining(c) or 0x1160 <= n <= 0x11FF or (unicodedata.category(c) == "Mc" and not unicodedata.is_normalized("NFC", "क" + c + c)):
            marks.append(n)
        elif not unicodedata.is_normalized("NFC", c):
            table[n] = unicodedata.normalize("NFC", c)

    def ranges(points: list[int]) -> str:
        out, points = [], sorted(set(points))
        start = prev = points[0]
        for p in [*points[1:], -1]:
            if p != prev + 1:
                out.append(f"\\U{start:08x}-\\U{prev:08x}")
                start = p
            prev = p
        return "".join(out)

    single, mark = ranges(list(table)), ranges(marks)
    # a mark may combine with what stands before it; invisible characters may stand between the two
    return re.compile(f"[\\s\\S]?[{single}]*(?:[{mark}]+[{single}]*)+|[{single}]+"), table


def _normal(text: str) -> str:
    """The text in normal form: its unstable segments normalised and spliced back."""
    pattern, table = _tables()
    return pattern.sub(lambda m: unicodedata.normalize("NFC", m[0].translate(table)), text).replace("\t", " ")


ALIKE = CYRILLIC | GREEK | OTHERS
TO_LATIN = str.maketrans(ALIKE)
FROM_LATIN = {"cyrillic": str.maketrans({v: k for k, v in reversed(CYRILLIC.items())}), "greek": str.maketrans({v: k for k, v in reversed(GREEK.items())})}
TWINS = frozenset(ALIKE)
SUSPECT = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ" + "".join(sorted(TWINS)) + "]")
WORD = re.compile(r"[^\W\d_]+")
SCRIPT = re.compile("(?P<latin>[A-Za-zÀ-ÖØ-öø-ɏ])|(?P<greek>[Ͱ-Ͽἀ-῿])|(?P<cyrillic>[Ѐ-ԯ])")
OWN = {"latin": re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]"), "greek": re.compile("[Ͱ-Ͽἀ-῿]"), "cyrillic": re.compile("[Ѐ-ԯ]")}


def _anchors(word: str) -> set[str]:
    """Scripts of which a word has letters that look like no letter of another script."""
    return {m.lastgroup for m in SCRIPT.finditer(word) if m[0] not in TWINS and not (m.lastgroup == "latin" and any(ord(m[0]) in t for t in FROM_LATIN.values()))}


def canonical(text: str) -> str:
    """The consistent form of a text, to be read on; idempotent.

    Beyond the normal form, look-alike letters come out in the script of their word: that of its letters which
    look like none of another script. A word without such letters takes the script of most words that have
    some, if it isn't in one script already that the text has words of, and else Latin. A Russian or Greek
    word so stays what it is; texts are compared by ``comparison_form``."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    s = _normal(text)
    if not SUSPECT.search(s):
        return s
    words = [(m.span(), m[0], _anchors(m[0])) for m in WORD.finditer(s)]
    votes: dict[str, int] = {}
    for _, _, of in words:
        if len(of) == 1:
            votes[next(iter(of))] = votes.get(next(iter(of)), 0) + 1
    most = max(sorted(votes), key=votes.get) if votes else "latin"
    out, at = [], 0
    for (a, b), w, of in words:
        if not SUSPECT.search(w):
            continue
        if len(of) == 1:
            script = next(iter(of))
        elif of:
            continue  # letters of several scripts that all belong there
        else:
            own = {m.lastgroup for m in SCRIPT.finditer(w)}
            script = next(iter(own)) if len(own) == 1 and next(iter(own)) in votes else most
        if script == "latin":
            fixed = w.translate(TO_LATIN)
        else:
            fixed = "".join(c if OWN[script].match(c) else c.translate(TO_LATIN).translate(FROM_LATIN[script]) for c in w)
        out += [s[at:a], fixed]
        at = b
    return unicodedata.normalize("NFC", "".join(out) + s[at:])


def skeleton(text: str) -> str:
    """The normal form with all look-alike letters as Latin ones: equal for texts that look the same, not to be read."""
    s = text.replace("\t", " ") if text.isascii() else _normal(text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(TO_LATIN)) if SUSPECT.search(s) else s


def comparison_form(text: str) -> str:
    """The skeleton without space that can't be seen: at the ends, at line ends and repeated."""
    return re.sub(r" *\n *", "\n", re.sub(r" {2,}", " ", skeleton(text).replace("\r\n", "\n"))).strip()


def is_blank(text: str | None) -> bool:
    return text is None or BLANK.match(text) is not None


def normalize(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row: key, canonical text, whether it differs from the input, and the form to compare by.

    Null gives nulls and false; empty and blank texts stay; only ``key`` and ``text`` are read."""
    kind = df.schema[key].dataType.simpleString()

    def rows(k, t):
        c = None if t is None else canonical(t)
        yield k, c, c != t, None if t is None else comparison_form(t)

    return map_rows(spread(df.select(key, text)), [key, text], rows, f"`{key}` {kind}, canonical string, changed boolean, compared string")


def _hash(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def classes(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """Kind, key, and hashes (128 bits) of the comparison form and of the text of each row whose text isn't blank."""

    def rows(k, t):
        if k is not None and not is_blank(t):
            yield kind, k, _hash(comparison_form(t)), _hash(t)

    return map_rows(spread(df.select(key, text)), [key, text], rows, "kind string, item string, form binary, raw binary")


def grouped(*members: DataFrame) -> DataFrame:
    """One row per item of ``classes``: kind, item, the least item that looks the same (its class), the least one that is
    also spelt the same (the representative of its spelling), and the number of spellings and items of the class.

    Linear in the items however many look the same; pairs of representatives of a class are all the links there are."""
    rows = cut(reduce(DataFrame.unionByName, members).groupBy("kind", "form", "item").agg(F.min("raw").alias("raw")))
    spelt = rows.groupBy("kind", "form", "raw").agg(F.min("item").alias("representative"), F.count("*").alias("n"))
    seen = spelt.groupBy("kind", "form").agg(F.min("representative").alias("class"), F.count("*").alias("spellings"), F.sum("n").alias("items"))
    return rows.join(spelt.drop("n"), ["kind", "form", "raw"]).join(seen, ["kind", "form"]).select("kind", "item", "class", "representative", "spellings", "items")


def found(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of different keys whose texts look the same and differ in their characters.

    Only forms with more than one spelling take part, so exact copies of one text, however many,
    give no pairs among themselves and never meet in a join."""
    # narrow rows, made once and read three times
    members = cut(classes(cases, "eval_case", "id", "query").unionByName(classes(chunks, "chunk", "chunk_id", "content")))
    mixed = members.groupBy("kind", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("kind", "form")
    some = members.join(mixed, ["kind", "form"], "left_semi").dropDuplicates(["kind", "form", "item", "raw"])
    a, b = some.alias("a"), some.alias("b")
    pairs = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.item") < F.col("b.item")) & (F.col("a.raw") != F.col("b.raw")))
    return pairs.select(F.col("a.kind").alias("kind"), F.col("a.item").alias("key_a"), F.col("b.item").alias("key_b")).distinct()
