"""Sentence units for every language and script.

Character-property rules (terminators, closing punctuation, separators), suppression of known
abbreviations, and a stack of quotes and brackets: what is quoted or bracketed within a sentence does
not end it. Scripts without terminators are cut at their spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from foliora.functions.rows import map_rows, spread
from foliora.llm.pairs import language



def _having(*properties: str) -> str:
    """All characters with one of some Unicode properties, in order."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return "".join(regex.findall("[" + "".join(rf"\p{{{p}}}" for p in properties) + "]", every))


def _ranges(characters: str) -> str:
    """The inside of a character class."""
    out, points = [], sorted(set(map(ord, characters)))
    for k, n in enumerate(points):
        if k and n == points[k - 1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in out)


#: Terminators of all scripts: those of the property, and full stops of wide and small form, of Khmer and of syllabics.
STRONG = _having("Sentence_Break=STerm") + "．﹒៕៚᙮܀"
SOFT = ".…․"
#: What goes on with the sentence right behind a terminator; marks that belong to the character before them.
CONTINUE = frozenset(_having("Sentence_Break=SContinue"))
ATTACHED = _ranges(_having("Sentence_Break=Extend", "Sentence_Break=Format"))
OPEN = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "《": "》", "〈": "〉", "„": "“”", "‚": "‘’", "｢": "｣", "{": "}"}
CLOSE = "".join(dict.fromkeys("”»›」』）)]】〕》〉’｣\"'" + _having("Pe", "Pf")))
BRACKETS = "（([【〔《〈{"

# Abbreviations that never end a sentence, by language (of the script, for others than Latin), and those that do before a new one begins.
ABBREVIATIONS = {
    "en": "mr mrs ms dr prof st sen gen col capt lt rev hon vs cf e.g i.e viz p pp vol ed eds sec secs ch fig figs eq no nos approx dept art arts par al jan feb mar apr jun jul aug sept oct nov dec",
    "de": "dr prof st vs z b u a d h bzw vgl abs nr s ca hr fr frl hrn str evtl ggf inkl zzgl max min tel abb kap bd aufl hrsg mio mrd art fig p m",
    "fr": "dr prof st vs cf p pp vol no m mm mme mlle me pr av bd env ex fig chap sect réf tél ste éd art par",
    "es": "dr prof sr sra srta dra ud uds d dña pág págs núm art cap fig ee ej p av vs vol no etc",
}
SCRIPTED = frozenset("г гг т е п см с ст стр рис табл гл им ул д кв обл р руб коп тыс млн млрд напр проф акад г-н डॉ सं श्री श्रीमती प्रो पृ रु क्र ص د أ م ج ت س أ.د".split())
BY_LANGUAGE = {k: SCRIPTED | frozenset(v.split()) - {"etc"} for k, v in ABBREVIATIONS.items()}
#: Those of all languages, for texts whose language isn't known.
NEVER = frozenset().union(*BY_LANGUAGE.values())
#: These are words too, and abbreviations only before a number or in small letters.
NUMBERED = frozenset("no max min ed me par al mar art arts cap fig sec ch".split())
MAYBE = frozenset("etc inc corp ltd co a.m p.m usw u.a uu u.s jr sr. др пр т.д т.п руб млн jh chr i.d.r ff etc. bros llc gmbh ag sa".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb".split())
STARTERS = frozenset(
    "the a an this that these those each every if when with without once after before under within for during as in it is did does do according to at on by we you they he she there what why how "
    "der die das ein eine jede jeder für nach bei auf im in am wenn le la les un une chaque pour après avant el los las una cada para tras antes al según sin".split()
)
THAI = r"฀-๿຀-໿ក-៿"
MARK = re.compile(
    rf"(?P<para>\r?\n[^\S\n]*\n\s*)|(?P<item>\n[ \t]*(?=(?:[•·*\-–]|\d{{1,3}}[.)]|[（(]\d{{1,3}}[）)])\s))|(?P<term>[{_ranges(STRONG + SOFT)}](?:[{ATTACHED}]*[{_ranges(STRONG + SOFT)}])*[{ATTACHED}]*)|(?P<open>[{re.escape(''.join(OPEN))}])|(?P<close>[{_ranges(CLOSE)}“])|(?P<thai>(?<=[{THAI}])[ 　]+(?=[{THAI}]))"
)
IS_ATTACHED = re.compile(f"[{ATTACHED}]+")
PARA = re.compile(r"\r?\n[^\S\n]*\n\s*")
WORD = re.compile(r"[^\s“”«»„‘\"'’(（\[「『。，、：；！？぀-ヿ㐀-鿿豈-﫿가-힯]+$")
QUOTES = "“„«‹「『\"'‘(（[¿¡*_"
NEXT = re.compile(r"\S+")
NOT_CLOSED = re.compile(r"\w")
HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
#: Words by which a sentence goes on after a quotation that it began with.
REPORTING = re.compile(r"\s*(?:と|って|ऐसा|說道?|说道?|道，|写道|ने कहा)")


class _Paragraph:
    """The abbreviations of a paragraph's language, asked for where one may stand."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.known: frozenset | None = None

    def __contains__(self, word: str) -> bool:
        if word not in NEVER:
            return False
        if self.known is None:
            self.known = BY_LANGUAGE.get(language(self.text[self.start : self.end]), NEVER)
        return word in self.known


def _suppressed(text: str, at: int, end: int, start: int, never: _Paragraph) -> bool:
    """Whether the full stop at ``at`` belongs to an abbreviation (of less than 24 characters), a number or a name."""
    m = WORD.search(text, max(start, at - 24), at)
    word = m[0] if m else ""
    after = NEXT.search(text, end)
    nxt = after[0] if after and "\n\n" not in text[end : after.start()] else ""
    tight = bool(after) and after.start() == end
    if not nxt:
        return False
    if not (bare := nxt.lstrip(QUOTES)) and (after := NEXT.search(text, after.end())):
        bare = after[0].lstrip(QUOTES)
    first = bare[:1]
    new = first.isupper() or (re.match(r"[a-z]+[A-Z]", nxt) is not None) or bool(HAN.match(first)) or (first.isalpha() and first.lower() == first.upper())
    low = word.lower().strip(".")
    last = low.rsplit(".", 1)[-1]
    if tight:
        if first.isalpha() and word and word[-1].isalpha() and new and not HAN.match(first):
            # "window.When": a missing space; "U.S", "e.g" and names of files are no boundaries
            return not (first.isupper() and len(last) > 1 and (len(nxt) == 1 or nxt[1:2].islower() or not nxt[1:2].isalnum()))
        if HAN.match(first) or nxt[0] in "“„«「『（":
            return low in never
        return True
    if not word and HAN.match(text[at - 1 : at]):
        return False
    if word[-1:].isdigit() or not word:
        if word and word.isdigit() and len(word) <= 2 and nxt.strip(".,;").lower() in MONTHS:
            return True
        return not new and first.islower() and first.isalpha() and not first.isdigit()
    if low in MAYBE or last in MAYBE and "." in low:
        return not new
    if len(last) == 1 and last.isalpha() and word[-1].isupper() and new:
        return bare.rstrip(",.;:!?").lower() not in STARTERS and not re.match(r"[a-z]+[A-Z]", bare)
    if low in NUMBERED:
        return first.isdigit() or not first.isupper()
    if low in never or "." in low and last in never:
        return True
    return not new and not first.isdigit() and not nxt[0].isdigit() and first.isalpha()


def spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence unit, in characters; white space lies outside."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    begin = 0
    stack: list[tuple[str, int, bool]] = []  # closing characters, place, opened at the start of a unit

    def cut(end: int) -> None:
        nonlocal begin
        piece = text[begin:end]
        s = piece.strip()
        if s:
            a = begin + len(piece) - len(piece.lstrip())
            out.append((a, a + len(s)))
        begin = end
        stack.clear()

    pos, n = 0, len(text)
    para = PARA.search(text)
    limit = para.start() if para else n
    never = _Paragraph(text, 0, limit)
    while m := MARK.search(text, pos):
        at, end = m.span()
        pos = end
        kind = m.lastgroup
        if kind == "para":
            cut(at)
            begin = end
            para = PARA.search(text, end)
            limit = para.start() if para else n
            never = _Paragraph(text, end, limit)
        elif kind == "item":
            cut(at)
        elif kind == "thai":
            if not stack:
                cut(at)
        elif kind == "open" and not (m[0] == "“" and stack and "“" in stack[-1][0]):
            closers = OPEN[m[0]]
            if any(text.find(c, end, limit) >= 0 for c in closers):
                stack.append((closers, at, not text[begin:at].strip()))
        elif kind in ("close", "open"):
            for k in range(len(stack) - 1, -1, -1):
                if m[0] in stack[k][0]:
                    closers, place, first = stack[k]
                    del stack[k:]
                    inner = text[place + 1 : at].rstrip()
                    if not stack and inner and (inner[-1] in STRONG or inner[-1] == ".") and text[place] not in BRACKETS:
                        pos = end = _closers(text, end, limit)
                        rest = text[end:limit].lstrip()
                        if rest[:1] and rest[0] in STRONG + SOFT:
                            break
                        if not rest or (first and not REPORTING.match(text, end) and not rest[0].islower() and rest[0] not in ",，;；—–-") or (
                            not first and rest[0].isupper() and end < n and text[end].isspace()
                        ):
                            cut(end)
                    break
        elif kind == "term":
            mark = IS_ATTACHED.sub("", m[0]) if len(m[0]) > 1 else m[0]
            if not stack:
                after = text[end : end + 1]
                if set(mark) <= set(SOFT):
                    if mark == ".":
                        if _suppressed(text, at, end, begin, never):
                            continue
                    else:  # an ellipsis ends a sentence only before a capital letter or a break
                        nxt = NEXT.search(text, end)
                        if nxt and not (nxt[0][0].isupper() and nxt.start() > end):
                            continue
                elif after and (after.isalnum() and not HAN.match(after)) and mark in "!?" and text[at - 1 : at].isalnum() and after.islower():
                    continue
                pos = end = _closers(text, end, limit)
                nxt = text[end : end + 1]
                if nxt in CONTINUE:
                    continue
                cut(end)
    cut(n)
    return out


def _closers(text: str, end: int, limit: int) -> int:
    """The place after closing quotes and brackets that belong to a sentence ending at ``end``."""
    while end < limit:
        if text[end] in CLOSE:
            end += 1
        elif text[end] in "   " and text[end + 1 : end + 2] == "»":
            end += 2
        else:
            break
    return end


def found(documents: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """End of every sentence unit of the documents named in ``sample``, one row per unit."""
    chosen = spread(documents.select(key, text)).join(sample.select(key).distinct(), key, "left_semi")
    return map_rows(chosen, [key, text], lambda k, t: ((k, b) for _, b in spans(t)), "doc_id bigint, end_char int").distinct()


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sentence units of every text: key, number from 1, start, end and the unit.

    Null, empty and blank texts have no units; repeated rows give repeated units; only ``key`` and
    ``text`` are read, so other columns can't clash."""

    def rows(k, t) -> Iterator[tuple]:
        return ((k, i, a, b, t[a:b]) for i, (a, b) in enumerate(spans(t), 1))

    kind = df.schema[key].dataType.simpleString()
    return map_rows(spread(df.select(key, text)), [key, text], rows, f"`{key}` {kind}, unit_no int, start_char int, end_char int, sentence string")
