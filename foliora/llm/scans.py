"""Noise in text from scanned pages: running lines, page numbers, split and misread words.

Three steps, none of which gathers a volume in one task: corpus counts of words and of character
contexts (the language model), per-volume statistics of the lines at page edges (grouped counts), and
a decoder that reads each page as one de-lined stream together with the top of the following page.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliora.functions.lineage import cut
from foliora.functions.rows import map_rows, spread

# What a scanner prints, and what was there.
CONFUSIONS = [
    ("c", "e"), ("c", "é"), ("c", "è"), ("†", "t"), ("@", "a"), ("í", "i"), ("0", "o"), ("1", "l"), ("1", "i"), ("1", "I"), ("ii", "u"), ("ii", "û"), ("cl", "d"), ("q", "g"), ("rn", "m"), ("m", "rn"),
    ("b", "h"), ("ri", "n"), ("vv", "w"), ("VV", "W"), ("U", "ti"), ("h", "li"), ("5", "S"), ("5", "s"), ("8", "B"), ("0", "O"), ("d", "cl"), ("|", "l"), ("$", "s"), ("6", "b"), ("9", "g"), ("l", "I"), ("I", "l"), ("¢", "c"),
]
HAN_CONFUSIONS = {
    "朗": "期", "菅": "管", "但": "担", "素": "索", "曰": "日", "绿": "录", "该": "核", "入": "人", "搜": "授", "帐": "账", "异": "导", "井": "开", "捡": "检", "纳": "约", "乎": "平", "末": "未", "列": "例",
    "贡": "质", "己": "已", "土": "士", "干": "千", "侯": "候", "拆": "折", "免": "兔", "辨": "辩", "折": "拆",
}
HYPHENS = "-­‐¬"
EDGE = 3  #: lines at the top and at the bottom of a page that may be page furniture
EDGE_SHARE = 0.2  #: a running line stands on this share of a volume's pages at least (so at most EDGE / EDGE_SHARE keys a side)
RATE = 1e-6  #: share of all words (or contexts) that counts as one: terms below it are as good as unseen, so the model has at most 1 / RATE of each
KNOWN = 5  #: count from which a term is a word that others are read as
MEMO = 200_000  #: entries of a worker's memos, which are emptied when full and change no result
MISREAD, SPLIT, MERGE, ODD = log(12), 6.0, 9.0, 1.2  #: costs (in -log of chance) of a misread word, a blank left out, a stray blank, a letter of an unknown word
FOLD = [("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("ti", "u")]
FOLD_ONE = str.maketrans({"e": "c", "é": "c", "†": "t", "@": "a", "í": "i", "0": "o", "1": "i", "l": "i", "|": "i", "q": "g", "h": "b", "5": "s", "8": "b", "$": "s", **HAN_CONFUSIONS})

TOKEN = re.compile(r"\S+")
CORE = re.compile(r"^[^\w@†$¢|]*(.*?)[^\w@†$¢|­‐¬-]*$", re.S)
LETTER = re.compile(r"[^\W\d_]")
HAN = re.compile(r"[㐀-鿿]")
NUMBER = re.compile(
    r"^\W*(?:(?:page|seite|página|pagina|p|s|第)\W*)?([0-9lO|I]{1,4})(?:\W*(?:页|頁))?(?:\W*(?:/|of|von|de|sur|共)\W*([0-9lO|I]{1,4})(?:\W*(?:页|頁))?)?\W*$",
    re.I,
)
RUN_NUMBER = re.compile(r"^\s*[0-9lO]{1,4}\s{2,}|\s{2,}[0-9lO]{1,4}\s*$")
UNKEYED = re.compile(r"[^\w@†|$]+|_+")
DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0"})


def _num(s: str) -> int | None:
    d = s.translate(DIGITS)
    return int(d) if d.isdigit() else None


@lru_cache(1 << 14)
def page_value(line: str) -> int | None:
    """The number of a line that holds only a page number, in one of the usual forms."""
    m = NUMBER.match(line)
    return _num(m[1]) if m and any(c.isdigit() or c in "lO" for c in m[1]) else None


@lru_cache(1 << 14)
def edge_key(line: str) -> str:
    """A line's form for comparison over pages: no page number, case, spacing, signs or look-alikes."""
    s = RUN_NUMBER.sub("", line).casefold()
    s = UNKEYED.sub("", s)
    for a, b in FOLD:
        s = s.replace(a, b)
    return s.translate(FOLD_ONE)


def edges(content: str) -> tuple[list[str], list[str]]:
    """First and last non-blank lines of a page."""
    lines = [x for x in content.split("\n") if x.strip()]
    return lines[:EDGE], lines[EDGE:][-EDGE:]


def core(token: str) -> str:
    return CORE.match(token)[1]


def count_terms(texts: Iterable[str]) -> Counter:
    """Counts of words, and of three-character contexts of characters that are easily confused."""
    raw: Counter = Counter()
    bag: Counter = Counter()
    for content in texts:
        if not HAN.search(content):
            raw.update(content.split())
            continue
        for line in content.split("\n"):
            raw.update(line.split() if not HAN.search(line) else [t for t in line.split() if not HAN.search(t)])
        bag.update(g for _, g in contexts(content.replace("\n", "")))
    for t, n in raw.items():  # each form once
        w = core(t)
        if w and LETTER.search(w):
            bag[w.rstrip(HYPHENS)] += n
    return bag


RIVALS = set(HAN_CONFUSIONS) | set(HAN_CONFUSIONS.values())
RIVAL = re.compile("[" + "".join(sorted(RIVALS)) + "]")


def contexts(text: str) -> Iterator[tuple[int, str]]:
    """(place, context) of each easily confused character in a text without line breaks."""
    text = re.sub(r"[0-9０-９]", "9", text)
    for m in RIVAL.finditer(text):
        i = m.start()
        yield i, (text[i - 1] if i else "^") + text[i] + (text[i + 1] if i + 1 < len(text) else "$")


def language_model(pages: DataFrame, content: str = "content", rate: float = RATE) -> dict[str, float]:
    """Counts of the terms that make up at least ``rate`` of all words, or of all contexts, over all pages.

    A count is in units of ``rate`` of the total (of 1 in small corpora), so that a corpus many times as
    large, with many times as many copies of each misreading, is read alike. Each batch is counted before the
    shuffle; only the entries kept, at most 1 / ``rate`` of either kind, reach the driver."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("term", StringType()), StructField("n", LongType())])

    def rows(bag: Counter):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(list(bag), pa.string()), pa.array(list(bag.values()), pa.int64())], names=["term", "n"])

    def count(batches):
        bag: Counter = Counter()
        for b in batches:
            bag.update(count_terms(x for x in b.column(0).to_pylist() if x))
            if len(bag) > MEMO:
                yield rows(bag)
                bag = Counter()
        if bag:
            yield rows(bag)

    terms = cut(pages.select(content).mapInArrow(count, schema).groupBy("term").agg(F.sum("n").alias("n")).withColumn("han", F.col("term").rlike(HAN.pattern)))
    units = {r["han"]: max(1.0, rate * r["n"]) for r in terms.groupBy("han").agg(F.sum("n").alias("n")).collect()}
    one = F.when(F.col("han"), units.get(True, 1.0)).otherwise(units.get(False, 1.0))
    kept = terms.where((F.col("n") >= one) & (F.col("n") > 1)).select("term", (F.col("n") / one).alias("n"))
    return {r["term"]: r["n"] for r in kept.collect()}


class Decoder:
    """Reads words against a language model, allowing confusions, hyphens, splits and merges."""

    def __init__(self, model: dict[str, float]):
        self.n = model
        self.memo: dict[str, str | None] = {}
        self.sound: set[str] = set()  # tokens that were read before and stay as they are
        self.seen: dict[str, tuple] = {}
        self.quiet: set[tuple[str, str]] = set()  # neighbours that were looked at before and are words on their own
        self.begun: dict[str, bool] = {}
        self.read: dict[tuple[str, ...], list] = {}
        words = {w.casefold() for w, n in model.items() if n >= KNOWN and not HAN.search(w)}
        self.words = sorted(words)  # asked by their beginnings
        self.all = log(max(2, sum(n for w, n in model.items() if not HAN.search(w))))
        self.by_first = defaultdict(list)
        for a, b in CONFUSIONS:
            self.by_first[a[0]].append((a, b))

    def count(self, w: str) -> float:
        n = self.n.get(w, 0)
        if w[:1].isupper():
            n = max(n, self.n.get(w[:1].lower() + w[1:], 0)) if w[1:].islower() else max(n, self.n.get(w.capitalize(), 0), self.n.get(w.lower(), 0)) if w.isupper() else n
        elif w[:1].islower():
            n = max(n, self.n.get(w[:1].upper() + w[1:], 0))
        return n

    def word(self, w: str) -> str | None:
        """The word that ``w`` is a misreading of, or None: of those with one or two confusions the most frequent, if it is far more frequent than ``w``."""
        if w in self.memo:
            return self.memo[w]
        best = None
        if len(w) >= 2 and LETTER.search(w):
            least = max(KNOWN, 12 * max(self.count(w), 0.4))
            found = [(-n, len(edits), v) for end, v, n, blanks, edits in self._arcs(w, 0, False) if end == len(w) and edits and n >= least and v != w]
            best = min(found)[2] if found else None
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[w] = best
        return best

    def _begins(self, x: str) -> bool:
        """Whether some word begins with ``x``."""
        got = self.begun.get(x)
        if got is None:
            low = x.casefold()
            k = bisect_left(self.words, low)
            if len(self.begun) > MEMO:
                self.begun.clear()
            got = self.begun[x] = k < len(self.words) and self.words[k].startswith(low)
        return got

    def _token(self, t: str) -> tuple[str, bool, bool, int, str, frozenset]:
        """Core of a token, whether nothing stands before and behind it, its count, small form and what may follow that in a word."""
        got = self.seen.get(t)
        if got is None:
            w = core(t)
            if not w or HAN.search(t):
                got = ("", False, False, KNOWN, "", frozenset())
            else:
                at, low = t.find(w), w.casefold()
                more, k = set(), bisect_left(self.words, low)
                while k < len(self.words) and self.words[k].startswith(low):
                    if nxt := self.words[k][len(low) : len(low) + 1]:
                        more.add(nxt)
                        k = bisect_left(self.words, low + chr(ord(nxt) + 1), k)
                    else:
                        k += 1
                got = (w, at == 0, at + len(w) == len(t), self.count(w) if LETTER.search(w) else KNOWN, low, frozenset(more))
            if len(self.seen) > MEMO:
                self.seen.clear()
            self.seen[t] = got
        return got

    def _arcs(self, s: str, i: int, inner: bool) -> Iterator[tuple[int, str, int, int, tuple]]:
        """Words that ``s`` may hold from ``i`` on, with stray blanks and up to two confusions: end, word, count, blanks, places of confusions."""
        todo = [(i, "", 0, ())]
        while todo:
            p, x, blanks, edits = todo.pop()
            if x and s[p - 1] != " ":
                n = self.n.get(x, 0) if inner else self.count(x)
                if n >= KNOWN:
                    yield p, x, n, blanks, edits
            if p == len(s):
                continue
            if s[p] == " ":
                if x:
                    todo.append((p + 1, x, blanks + 1, edits))
                continue
            c = s[p]
            if self._begins(x + c):
                todo.append((p + 1, x + c, blanks, edits))
            if c in self.by_first and len(edits) < 2:
                for a, b in self.by_first[c]:
                    if s.startswith(a, p) and self._begins(x + b):
                        todo.append((p + len(a), x + b, blanks, (*edits, p)))

    def stream(self, tokens: list[str]) -> list[tuple[int, int, str, list[int]]]:
        """Where the best reading of a de-lined stream differs from its tokens: first token, token behind, text and misread tokens.

        A Viterbi search over the words that the characters may hold, whatever the blanks. It is made only around
        rare tokens and neighbours that together begin a word, with the token on either side: elsewhere each
        token has one reading."""
        spots = [k for k, pair in enumerate(zip(tokens, [*tokens[1:], ""])) if pair not in self.quiet and self._spot(pair)]
        out, upto = [], 0
        while spots:
            lo, hi = spots[0], spots.pop(0) + 1
            lo = max(upto, lo - 1 if lo and self._joint(tokens[lo - 1], tokens[lo]) else lo)
            while hi < len(tokens) and self._joint(tokens[hi - 1], tokens[hi]):
                hi += 1
                if not (spots and spots[0] < hi):
                    if not (spots and spots[0] == hi):
                        break
                else:
                    spots.pop(0)
            upto = hi
            window = tuple(tokens[lo:hi])
            if (got := self.read.get(window)) is None:
                if len(self.read) > MEMO:
                    self.read.clear()
                got = self.read[window] = self._search(window)
            out += [(a + lo, b + lo, t, [k + lo for k in bad]) for a, b, t, bad in got]
        return out

    def _joint(self, t: str, u: str) -> bool:
        """Whether nothing but a blank stands between two tokens."""
        return self._token(t)[2] and self._token(u)[1]

    def _spot(self, pair: tuple[str, str]) -> bool:
        """Whether a token is rare, or begins a word together with the next."""
        x, y = self._token(pair[0]), self._token(pair[1])
        if x[3] < KNOWN or x[2] and y[1] and y[4][0] in x[5] and self._begins(x[4] + y[4]):
            return True
        if len(self.quiet) > MEMO:
            self.quiet.clear()
        self.quiet.add(pair)
        return False

    def _search(self, tokens: tuple[str, ...]) -> list[tuple[int, int, str, list[int]]]:
        known = [self._token(t) for t in tokens]
        s = " ".join(x[0] for x in known)
        starts, of = {}, []
        for k, x in enumerate(known):
            starts[len(of)] = k
            of += [k] * (len(x[0]) + 1)
        best: dict[int, tuple] = {0: (0.0, 0, None, ())}
        for p in range(len(s) + 1):
            if p not in best:
                continue
            cost, k = best[p][0], starts.get(p)

            def offer(end, c, word, edits):
                end += s[end : end + 1] == " "
                if end not in best or cost + c < best[end][0]:
                    best[end] = (cost + c, p, word, edits)

            if k is not None:
                w, n = known[k][0], known[k][3]
                offer(p + len(w), self.all - log(max(n, 0.4)) + (0 if n else ODD * len(w)), None, ())
            if p < len(s):
                for end, word, n, blanks, edits in self._arcs(s, p, k is None):
                    if k is None or blanks or end - p != len(known[k][0]):
                        offer(end, self.all - log(n) + (MISREAD if edits else 0) + MERGE * blanks + (SPLIT if k is None else 0), word, edits)
        path, p = [], len(s)
        while p:
            _, back, word, edits = best[p]
            path.append((back, p, word, edits))
            p = back
        out: list[tuple[int, int, str, list[int]]] = []
        words: list[str] = []
        bad: list[int] = []
        for a, b, word, edits in reversed(path):
            if word is None and not words:
                continue
            if not words:
                first = of[a]
            words.append(known[of[a]][0] if word is None else word)
            bad += [of[e] for e in edits]
            if b == len(s) or b in starts:
                end = of[b - 1] + 1
                head, tail = tokens[first].partition(known[first][0])[0], tokens[end - 1].rpartition(known[end - 1][0])[2]
                out.append((first, end, head + " ".join(words) + tail, bad))
                words, bad = [], []
        return out

    def han(self, context: str) -> str | None:
        """The character meant in the middle of a context, if it was misread."""
        y = HAN_CONFUSIONS.get(context[1])
        if y is None:
            return None
        right = self.n.get(context[0] + y + context[2], 0)
        return y if right >= 3 and right >= 6 * self.n.get(context, 0) else None

    def joined(self, left: str, right: str) -> str | None:
        """The word split over two lines as ``left``- and ``right``; None if the hyphen belongs to the word."""
        whole, kept = left + right, self.count(f"{left}-{right}")
        n, fixed = self.count(whole), self.word(whole)
        if fixed and self.count(fixed) > kept:
            return fixed
        if n >= 2 and n > kept:
            return whole
        if kept >= 2:
            return None
        if n == 0 and right[:1].islower() and self.count(right) <= 1 and (self.count(left) <= 1 or len(right) <= 3):
            return whole
        return None


@lru_cache(1 << 14)
def _alike(k: str, x: str) -> bool:
    """Whether two forms of a line are the same but for what is misread."""
    if k == x:
        return True
    if abs(len(k) - len(x)) > 3 or len(x) <= 3:
        return False
    m = SequenceMatcher(None, k, x)
    return m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


def furniture(lines: list[str], page: int | None, offset: int | None, tops: list[str], bottoms: list[str]) -> dict[int, str]:
    """Index and noise of the lines at a page's edges that are not body text."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    out: dict[int, str] = {}
    for side, keys in (("header", tops), ("footer", bottoms)):
        left = [i for i in full if i not in out]
        for i in left[:EDGE] if side == "header" else left[-EDGE:][::-1]:
            value = page_value(lines[i])
            if value is not None:
                if page is not None and offset is not None and value - page == offset:
                    out[i] = "page_number"
                    continue
                break
            k = edge_key(lines[i])
            if k and any(_alike(k, x) for x in keys):
                out[i] = side
            else:
                break
    return out


def read_page(decoder: Decoder, content: str, page, offset, tops, bottoms, next_top, last_bottom=(), build: bool = True) -> tuple[list[tuple[int, str]], list[str], bool]:
    """Noise of a page's lines (from 1), its repaired paragraphs (if ``build``), and whether the last one goes on."""
    return _read(decoder, content, page, offset, tops, bottoms, next_top, last_bottom, build)[:3]


def _read(decoder: Decoder, content: str, page, offset, tops, bottoms, next_top, last_bottom, build: bool) -> tuple[list[tuple[int, str]], list[str], bool, bool, float | None, float | None]:
    """As ``read_page``; also whether its first line begins in small letters, and what it costs to end its last
    paragraph with the page where the next page begins so or not (None: it does not go on there)."""
    lines = content.split("\n")
    noise = furniture(lines, page, offset, tops, bottoms)
    out = [(i + 1, what) for i, what in noise.items()]
    body = [i for i, x in enumerate(lines) if x.strip() and i not in noise and not _stray(x)]
    text = {i: lines[i].strip() for i in body}
    after = ""
    if next_top:
        skip = furniture([*next_top, *[""]], None if page is None else page + 1, offset, tops, [])
        after = next((x.strip() for j, x in enumerate(next_top) if j not in skip and not _stray(x)), "")
    begun = False  # a word that ends on the next page
    misread: set[int] = set()
    rest: dict[int, int] = {}  # characters at a line's start that belong to the line before
    read: dict[int, list[str]] = {}
    fixed: dict[int, str] = {}
    if last_bottom and body:
        # a word begun on the page before belongs there; only what was misread of it counts here
        pad = ["body"] * EDGE
        skip = furniture([*pad, *last_bottom], None if page is None else page - 1, offset, [], bottoms)
        before = next((x.strip() for j, x in reversed(list(enumerate(last_bottom))) if j + EDGE not in skip and not _stray(x)), "")
        last, first = (before.split() or [""])[-1], text[body[0]].split()[0]
        if len(last) > 1 and last[-1] in HYPHENS and not HAN.search(last + first):
            left, right = core(last).rstrip(HYPHENS), core(first)
            whole = decoder.joined(left, right) if left and right else None
            if whole is not None:
                rest[body[0]] = len(first)
                if not whole.endswith(right):
                    misread.add(body[0])
    for k, i in enumerate(body):
        line = text[i]
        follow = text[body[k + 1]] if k + 1 < len(body) else after
        tokens = line.split()
        if not rest.get(i) and line[-1] not in HYPHENS and decoder.sound.issuperset(tokens):
            read[i] = tokens
            continue
        done = []
        for j, t in enumerate(tokens):
            if j == 0 and rest.get(i):
                continue
            last = j == len(tokens) - 1
            if t in decoder.sound and not last:
                done.append(t)
                continue
            if HAN.search(t):
                done.append(t)
                if t[-1] not in HYPHENS and len(decoder.sound) < MEMO:
                    decoder.sound.add(t)
                continue
            w = core(t)
            if last and t[-1] in HYPHENS and follow and len(t) > 1 and LETTER.search(t):
                first = follow.split()[0]
                left, right = core(t).rstrip(HYPHENS), core(first)
                whole = decoder.joined(left, right) if left and right and not HAN.search(first) else None
                if whole is None and left and "-" in left:
                    head, _, tail = left.rpartition("-")
                    if (w2 := decoder.joined(tail, right)) and decoder.count(tail) < 2:
                        whole = f"{head}-{w2}"
                if whole is not None:
                    out.append((i + 1, "hyphen"))
                    same = 0
                    while same < min(len(whole), len(left)) and whole[same] == left[same]:
                        same += 1
                    if whole != left + right:
                        if same < len(left):
                            misread.add(i)
                        tail = len(right)
                        if whole[-tail:] != right and k + 1 < len(body):
                            misread.add(body[k + 1])
                    done.append(t[: t.find(left)] + whole + first[first.find(right) + len(right) :])
                    if k + 1 < len(body):
                        rest[body[k + 1]] = len(first)
                    else:
                        begun = True
                    continue
            if w and LETTER.search(w):
                v = decoder.word(w)
                if v is None and "-" in w.strip("-"):
                    parts = [decoder.word(p) or p for p in w.split("-")]
                    v = "-".join(parts) if "-".join(parts) != w and decoder.count(w) < 3 else None
                if v is not None:
                    misread.add(i)
                    t = t.replace(w, v)
                elif len(decoder.sound) < MEMO:
                    decoder.sound.add(t)
            elif len(decoder.sound) < MEMO:
                decoder.sound.add(t)
            done.append(t)
        read[i] = done
    flat = [(i, t) for i in body for t in read[i]]
    han = HAN.search(content) is not None
    for a, b, t, bad in reversed(decoder.stream([t for _, t in flat])):
        misread.update(flat[k][0] for k in bad)
        # a word broken by the end of a line without a hyphen
        out += [(flat[k][0] + 1, "hyphen") for k in range(a, b - 1) if flat[k][0] != flat[k + 1][0] and flat[k][1][-1] not in HYPHENS]
        flat[a:b] = [(flat[a][0], t)]
    if build:
        parts = defaultdict(list)
        for i, t in flat:
            parts[i].append(t)
        fixed = {i: " ".join(parts[i]) for i in body}
    if han:
        begins = list(accumulate((len(text[i]) for i in body), initial=0))
        repaired: dict[int, list[str]] = {}
        for p, g in contexts("".join(text[i] for i in body) + after[:1]):
            if p < begins[-1] and (y := decoder.han(g)):
                k = bisect_right(begins, p) - 1
                misread.add(body[k])
                repaired.setdefault(body[k], list(text[body[k]]))[p - begins[k]] = y
        if build:
            for i in body:
                if HAN.search(text[i]):
                    fixed[i] = "".join(repaired.get(i, text[i]))
    out += [(i + 1, "misread") for i in misread]
    paragraphs, goes_on = _paragraphs(lines, body, fixed) if build else ([], False)
    small, ends = False, [None, None]
    if build and body:
        small, width = text[body[0]][:1].islower(), _width(lines, body)
        ends = [1e9, 1e9] if begun else [_end(text[body[-1]], width, False) if goes_on else None, _end(text[body[-1]], width, True)]
    return sorted(set(out)), paragraphs, goes_on, small, *ends


def _stray(line: str) -> bool:
    """Figures from the margin or a table that interrupt a sentence."""
    return not (line[:1].isalpha() or any(c.isalpha() for c in line))


ENDS = re.compile(r"[.!?。！？…:：][\"'”’»」』）)]*$")


def _width(lines: list[str], body: list[int]) -> int:
    return sorted(len(lines[i].rstrip()) for i in body)[len(body) * 3 // 4]


def _end(prev: str, width: int, small: bool) -> float:
    """Cost of ending a paragraph with the line ``prev``, less that of none; ``small`` if the next line begins in small letters."""
    c = 1.0
    c += -1.5 if ENDS.search(prev) else 2.5
    c += -2.0 * (1 - len(prev) / max(width, 1)) * 2 if len(prev) < 0.8 * width else 0.6
    return c + small


def _glue(texts: Iterable[str]) -> str:
    """Consecutive parts of a paragraph as one text, without blanks between Han characters."""
    s = ""
    for t in texts:
        s += t if not s or not t or (HAN.match(s[-1]) or s[-1] in "，。、；：！？“”（）《》…") and (HAN.match(t) or t[0] in "，。、；：！？“”（）《》…" or HAN.search(t)) else " " + t
    return s


def _paragraphs(lines: list[str], body: list[int], fixed: dict[int, str]) -> tuple[list[str], bool]:
    """Paragraphs by dynamic programming over the lines: a boundary costs more where the text runs on.

    best[j] is the least cost of the first j lines; a boundary before line j pays for a line that does
    not end a sentence, is as wide as the rest or has no blank line after it, a missing one for the opposite."""
    if not body:
        return [], False
    width = _width(lines, body)

    def cost(k: int) -> float:  # of a boundary between lines k-1 and k, less the cost of none
        prev, here = lines[body[k - 1]].strip(), lines[body[k]]
        c = _end(prev, width, here.strip()[:1].islower())
        if body[k] - body[k - 1] > 1 and not any(lines[x].strip() for x in range(body[k - 1] + 1, body[k])):
            c -= 2.8 if len(prev) < 0.75 * width else 0.8  # after a title, or in the midst of a text
        return c

    n = len(body)
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    gains = [0.0] + [cost(k) for k in range(1, n)]
    least, at = 1e9, 0  # of all paragraphs that end with line j and have two lines or more
    for j in range(1, n + 1):
        if j > 1 and best[j - 2] + gains[j - 2] < least:
            least, at = best[j - 2] + gains[j - 2], j - 2
        best[j], back[j] = least, at
        c = best[j - 1] + gains[j - 1] + (0.7 if j > 1 else 0)
        if c < best[j]:
            best[j], back[j] = c, j - 1
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    out = []
    for a, b in reversed(cuts):
        s = _glue(fixed[i] for i in body[a:b])
        if s.strip():
            out.append(s)
    return out, not ENDS.search(lines[body[-1]].strip())


def _edge_row(d, source, page, content):
    """A page's lines at its edges, and what is counted of them over its volume: their forms by side, and page numbers less the page's place."""
    top, bottom = edges(content or "")
    keys, values = [], {}
    for side, ls in (("t", top), ("b", bottom)):
        forms = {}
        for x in ls:
            v = page_value(x)
            if v is None:
                forms[edge_key(x)] = None
            elif page is not None:
                values[v - page, side] = None
        keys += [(side, k) for k in forms if k]
    return [(d, source, page, top, bottom, keys + [("n", str(v)) for v, _ in values])]


def _prepare(pages: DataFrame, rate: float = RATE):
    """Pages with their volume's statistics, the top of the following and the bottom of the preceding page; and the decoder."""
    pages = pages.select("page_doc_id", "content", "source", "page_number")
    # a few short lines a page, made once and read four times
    narrow = cut(map_rows(
        spread(pages), ["page_doc_id", "source", "page_number", "content"], _edge_row,
        "page_doc_id string, source string, page_number int, top array<string>, bottom array<string>, keys array<struct<kind:string,val:string>>",
    ).dropDuplicates(["page_doc_id"]))
    counted = narrow.select("source", F.explode("keys").alias("k")).select("source", "k.kind", "k.val").groupBy("source", "kind", "val").agg(F.count("*").alias("n"))
    totals = narrow.groupBy("source").agg(F.count("*").alias("pages"))
    # at most EDGE / EDGE_SHARE keys a side and volume pass this filter
    kept = counted.join(totals, "source").where((F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * EDGE_SHARE))))
    stats = kept.groupBy("source").agg(
        F.collect_set(F.when(F.col("kind") == "t", F.col("val"))).alias("tops"),
        F.collect_set(F.when(F.col("kind") == "b", F.col("val"))).alias("bottoms"),
        F.max_by(F.when(F.col("kind") == "n", F.col("val")), F.when(F.col("kind") == "n", F.struct("n", F.col("val")))).alias("off"),
    )
    this = narrow.select("page_doc_id", "source", "page_number")
    preceding = narrow.select("source", (F.col("page_number") + 1).alias("page_number"), F.when(F.size("bottom") > 0, F.col("bottom")).otherwise(F.col("top")).alias("last_bottom")).dropDuplicates(["source", "page_number"])
    following = narrow.select("source", (F.col("page_number") - 1).alias("page_number"), F.col("top").alias("next_top")).dropDuplicates(["source", "page_number"])
    beside = this.join(following, ["source", "page_number"], "left").join(preceding, ["source", "page_number"], "left").join(stats, "source", "left").drop("source", "page_number")
    joined = pages.join(beside, "page_doc_id", "left")
    model = pages.sparkSession.sparkContext.broadcast(language_model(pages, rate=rate))
    return joined, model


COLUMNS = ["page_doc_id", "content", "page_number", "off", "tops", "bottoms", "next_top", "last_bottom"]


_LAST: list[Decoder] = []  # a worker's decoder with its memos, kept over tasks that share a model


def _reader(model, build: bool):
    def read(content, page, off, tops, bottoms, next_top, last_bottom):
        if not _LAST or _LAST[0].n is not model.value:
            _LAST[:] = [Decoder(model.value)]
        return _read(_LAST[0], content or "", page, None if off is None else int(off), tops or [], bottoms or [], next_top or [], last_bottom or [], build)

    return read


def found(pages: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per noisy line of a page and kind of noise; repeated pages count once.

    Null or empty content gives no rows; a null page number leaves page numbers undetected; a null
    source takes part in no volume, so only ``hyphen`` and ``misread`` are found."""
    joined, model = _prepare(pages, rate)
    read = _reader(model, False)
    return map_rows(joined, COLUMNS, lambda d, *a: [(d, n, w) for n, w in read(*a)[0]], "page_doc_id string, line_no int, noise string").distinct()


def repair(pages: DataFrame, rate: float = RATE) -> DataFrame:
    """Readable paragraphs of each page, with ``goes_on`` for one that continues on the following page."""
    joined, model = _prepare(pages, rate)
    read = _reader(model, True)

    def rows(d, *a):
        _, paragraphs, goes_on, *_ = read(*a)
        for k, p in enumerate(paragraphs, 1):
            yield d, k, p, goes_on and k == len(paragraphs)

    return map_rows(joined, COLUMNS, rows, "page_doc_id string, paragraph_no int, text string, goes_on boolean").dropDuplicates(["page_doc_id", "paragraph_no"])


def continuous(pages: DataFrame, rate: float = RATE) -> DataFrame:
    """Readable paragraphs of each volume, whole also where they run over pages, by the page on which they begin.

    ``paragraph_no`` counts on that page. A paragraph goes on over pages without text, but not over missing
    ones; pages without source or number stand alone. Only flags of the pages are sorted by volume, and only
    paragraphs that run on are gathered."""
    joined, model = _prepare(pages.dropDuplicates(["page_doc_id"]), rate)
    read = _reader(model, True)

    def rows(d, s, *a):
        _, paragraphs, _, *ends = read(*a)
        yield d, s, a[1], paragraphs, *ends

    of = cut(map_rows(
        joined, ["page_doc_id", "source", *COLUMNS[1:]], rows,
        "page_doc_id string, source string, page int, texts array<string>, small boolean, ends_before_large double, ends_before_small double",
    ))
    alone = F.when(F.col("source").isNull() | F.col("page").isNull(), F.col("page_doc_id"))
    order = W.partitionBy("source", "alone").orderBy("page", "page_doc_id")
    flags = of.select("page_doc_id", "source", "page", "small", "ends_before_large", "ends_before_small", F.size("texts").alias("m"), alone.alias("alone"))
    flags = flags.withColumn("gap", F.coalesce(F.col("page") - F.lag("page").over(order) != 1, F.lit(True)).cast("int")).withColumn("stretch", F.sum("gap").over(order)).where("m > 0")
    along = W.partitionBy("source", "alone", "stretch").orderBy("page", "page_doc_id")
    end = F.when(F.col("small"), F.lag("ends_before_small").over(along)).otherwise(F.lag("ends_before_large").over(along))
    flags = flags.withColumn("from_last", F.coalesce(end > 0, F.lit(False)))
    anew = F.when((F.col("m") > 1) | ~F.col("from_last"), F.struct("page_doc_id", "page", F.col("m").alias("no")))
    flags = flags.select(
        "page_doc_id", "m", "from_last", F.coalesce(F.lead("from_last").over(along), F.lit(False)).alias("to_next"),
        F.last(anew, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("begin"),
    )
    parts = of.join(flags, "page_doc_id").select("page_doc_id", "source", "page", "m", "from_last", "to_next", "begin", F.posexplode("texts").alias("at", "text")).withColumn("no", F.col("at") + 1)
    carried, runs_on = F.col("from_last") & (F.col("no") == 1), F.col("to_next") & (F.col("no") == F.col("m"))
    whole = parts.where(~(carried | runs_on)).select("source", "page_doc_id", F.col("no").alias("paragraph_no"), "text", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    run = parts.where(carried | runs_on).withColumn("begin", F.when(carried, F.col("begin")).otherwise(F.struct("page_doc_id", "page", "no")))
    runs = run.groupBy("source", "begin").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("texts"), F.max("page").alias("page_end"))
    runs = runs.select("source", F.col("begin.page_doc_id").alias("page_doc_id"), F.col("begin.no").alias("paragraph_no"), "texts.text", F.col("begin.page").alias("page_start"), "page_end")
    glued = map_rows(runs, runs.columns, lambda s, d, n, ts, a, b: [(s, d, n, _glue(ts), a, b)], "source string, page_doc_id string, paragraph_no int, text string, page_start int, page_end int")
    return whole.unionByName(glued)
