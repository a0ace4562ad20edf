"""Abusive, hateful or sexual content, by multiple-instance learning.

A document's label says only that some sentence offends. Sentences are scored by a logistic model over
words, word pairs and character sequences; a document's probability is the noisy-or of its sentences'.
The model is fitted on document labels (which may be wrong in either direction) and then shows the
offending sentences. Disguises (spaced, starred, swapped or doubled letters) are undone before.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliora.functions.rows import map_rows, spread
from foliora.llm.sentences import spans

#: Labelled documents on which the model is fitted at most, of either label: the documented bound of the sample.
SAMPLE = 3000
SAMPLE_CHARS = 20_000  #: longest text of the sample
THRESHOLD = 0.5

# Words that offend, or often do, as prior knowledge of the model; their weights are learned.
STRONG = """
maskedword
idiot idiots moron morons imbecile cretin retard retarded bastard bastards bitch whore slut cunt asshole fuck fucking fucker shit bullshit loser faggot scum vermin subhuman cockroach cockroaches parasites parasite horny nude nudes naked porn rapist pervert filth filthy moaned undressing sluts whores
abruti imbécile connard connasse salope pute crétin débile ordure vermine racaille enculé merde nique baise nue excitée excité crever gueule
idiot trottel arschloch hurensohn hure fotze wichser dummkopf vollidiot schlampe abschaum ungeziefer missgeburt verrecke nacktbilder geil versager verrecken
idiota imbécil cabrón pendejo puta hijoputa gilipollas mierda escoria basura maricón zorra estúpido payaso desnuda cachondo cachonda mueras
идиот придурок дебил кретин сука блядь мразь ублюдок тварь шлюха урод отбросы паразиты голые заткнись сдохни хуй пизда
馬鹿野郎 馬鹿 間抜け クズ ゴミ 死ね 消え失せろ 黙れ 役立たず 害虫 追い出せ ヤりたい 裸の写真 エロい 殺してやる ブス カス 変態 裸
傻逼 白痴 脑残 废物 蠢货 贱人 畜生 垃圾人 狗嘴 去死 该死 滚出去 人渣 杂种 婊子 妓女 操你 妈的 害虫 寄生虫 蟑螂 就是垃圾 都是垃圾 裸照 上床 骚样 脱光 强奸 淫荡 不配做人 打断你的腿 赶出去
كلب حقير غبي أحمق عاهرة حيوان قذر حثالة متخلف साला कुत्ता कमीना हरामी मूर्ख गधा ไอ้โง่ ควาย เหี้ย สัตว์ อีตัว ขยะ
""".split()
# General words of talk about conduct and language, and of computing, where the first list's words are mentioned or technical.
MENTION = """
policy policies rule rules forbid forbids forbidden prohibit prohibits prohibited report reports reported reporting complaint complaints compliance harassment moderation insult insulting offensive inappropriate language wording quote quoted term
process processes thread pointer terminal server database table memory kernel module node replica script test screening medical health
richtlinie verbietet melden meldung beschwerde beleidigung beleidigend beleidigende wortlaut prozess tabelle speicher datenbank politique interdit signaler signalé plainte injure injurieux propos processus table mémoire base
política prohíbe denunciar denuncia queja insulto ofensivo ofensiva lenguaje proceso tabla memoria servidor политика запрещает сообщать жалоба оскорбление оскорбительный процесс таблица память сервер
政策 规定 禁止 举报 上报 报告 投诉 合规 侮辱 措辞 进程 线程 指针 内存 数据 プロセス 禁止 規定 報告 通報 不適切 表現 メモリ
""".split()
_PRIOR = 3.5  #: prior weight of a word of the first list; the second has its negative half

LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤⁦-⁩﻿͏]")
CJK = "぀-ヿ㐀-鿿豈-﫿฀-๿"
APART = re.compile(r"[ ._\-·*]\w[ ._\-·*]\w")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_](?:[ ._\-·*](?! ))){2,}[^\W\d_](?!\w)")
SPLIT_CJK = re.compile(r"(?<=[぀-ヿ㐀-鿿])[ ·*._\-•]+(?=[぀-ヿ㐀-鿿])")
SWAPPED = re.compile(r"[^\W\d_][0-9@$!]|[@$][^\W\d_]")
AROUND = re.compile(r"[\w@$!]+")
THRICE = re.compile(r"(.)\1\1")
MASKED = re.compile(r"[^\W\d_](?:\*{3,}|\*(?=[^\W\d_]))[^\W\d_]*")
EVIDENCE = 0.08  #: weight from which a feature is evidence
LETTER = re.compile(r"[^\W\d_]")
TOKEN = re.compile(rf"(?P<c>[{CJK}]+)|(?P<w>(?:[^\W\d_]|[̀-ͯऀ-ॣً-ْ])+)")


def plain(text: str) -> str:
    """Text with disguises undone, in small letters."""
    s = unicodedata.normalize("NFKC", HIDDEN.sub("", text)).casefold()
    s = SPLIT_CJK.sub("", s)
    if APART.search(s):
        s = SPACED.sub(lambda m: re.sub(r"[ ._\-·*]", "", m[0]), s)
    if "*" in s:
        s = MASKED.sub(" maskedword ", s)
    if SWAPPED.search(s):
        s = _unswapped(s)
    if THRICE.search(s):
        s = re.sub(r"([^\W\d_])\1{2,}", r"\1", s)
    return s


def _unswapped(s: str) -> str:
    """Digits and signs that stand for letters within a word, as those letters."""
    out, at = [], 0
    for m in SWAPPED.finditer(s):
        if m.start() < at:
            continue
        a = m.start()
        while a > at and (s[a - 1].isalnum() or s[a - 1] in "@$!"):
            a -= 1
        w = AROUND.match(s, a)
        t = w[0].rstrip("!")
        letters = sum(c.isalpha() for c in t)
        if letters >= 2 and letters * 2 >= len(t) and not (t[-1].isdigit() and t[:-1].isalpha()):
            out += [s[at:a], t.translate(LEET)]
            at = a + len(t)
    return "".join(out) + s[at:]


def features(sentence: str) -> set[str]:
    """Words, pairs of words, and sequences of two to four characters of scripts without spaces.

    A word has a space on either side, so that it differs from the same letters within a sequence."""
    out: set[str] = set()
    before = None
    for m in TOKEN.finditer(plain(sentence)):
        t = m[0]
        if m.lastgroup == "c":
            before = None
            for n in (2, 3, 4):
                out.update(t[i : i + n] for i in range(len(t) - n + 1))
        else:
            out.add(f" {t} ")
            if before is not None:
                out.add(f" {before}    {t} ")
            before = t
    return out


def _as_features(w: str) -> list[str]:
    if not re.match(f"[{CJK}]", w):
        return [f" {w.casefold()} "]
    return [w] if len(w) <= 4 else [w[i : i + 4] for i in range(len(w) - 3)]


STRONG_FEATURES = frozenset(f for w in STRONG for f in _as_features(unicodedata.normalize("NFKC", w)))
MENTION_FEATURES = frozenset(f for w in MENTION for f in _as_features(w)) - STRONG_FEATURES


def _chance(k: int, n: int, p: float) -> float:
    """Probability of at least ``k`` in ``n``, each with probability ``p``."""
    if k <= 0 or not 0 < p < 1:
        return 1.0 if k <= 0 or p >= 1 else 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    for i in range(k, n):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < total * 1e-12:
            break
    return min(1.0, total)


class Model:
    """Weights by feature; those above zero are evidence, without which a sentence scores nothing."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._automaton = None

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def hints(self, text: str) -> bool:
        """Whether a text with its disguises undone has any evidence at all."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            # by first word: whether it is evidence alone, within a word, and the second words of its pairs
            known: dict[str, tuple[bool, bool, list[str]]] = {}
            for f, w in self.weights.items():
                if w > EVIDENCE:
                    one, *two = f.split()
                    alone, inside, seconds = known.get(one, (False, False, []))
                    known[one] = (alone or not two, inside or f[0] != " ", [*seconds, *two])
            for one, (alone, inside, seconds) in known.items():
                self._automaton.add_word(one, (len(one), alone, inside, tuple(seconds)))
            self._automaton.make_automaton()
        if not len(self._automaton):
            return False
        for end, (n, alone, inside, seconds) in self._automaton.iter(text):
            if inside or alone and not (LETTER.match(text, end + 1) or end >= n and LETTER.match(text, end - n)):
                return True
            if seconds and (m := LETTER.search(text, end + 1)) and m.start() > end + 1 and text.startswith(seconds, m.start()):
                return True
        return False

    def sentence(self, text: str) -> float:
        fs = features(text)
        found = [self.weights[f] for f in fs if f in self.weights]
        if not any(w > EVIDENCE for w in found):
            return 0.0
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, self.bias + sum(found))))))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences' probabilities, and the sentences likelier than not to offend."""
        if not text or not self.hints(plain(text)):
            return 0.0, []
        left, bad = 1.0, []
        for a, b in spans(text):
            p = self.sentence(text[a:b])
            left *= 1 - p
            if p >= THRESHOLD:
                bad.append((a, b, p))
        return 1 - left, bad


def fit(rows: list[tuple[str, float]], rounds: int = 250, rate: float = 0.15, flat: float = 0.004, prior_words: frozenset[str] = STRONG_FEATURES) -> Model:
    """Fit on texts and the share of their labels that call them unsafe.

    Maximises the likelihood of noisy labels: a share of either label is taken to be wrong. Weights are
    drawn to zero, those of ``prior_words`` (none for a model of the labels alone) to their prior. Words,
    pairs of words and sequences can be evidence; features of a single document carry no weight."""
    priors = dict.fromkeys(prior_words, _PRIOR) | (dict.fromkeys(MENTION_FEATURES - prior_words, -_PRIOR / 2) if prior_words else {})
    seen: dict[str, int] = {}
    docs_with: Counter = Counter()
    positive_docs: Counter = Counter()
    bags: list[list[set[str]]] = []
    for text, y in rows:
        sents = [f for a, b in spans(text) if (f := features(text[a:b]))]
        bags.append(sents)
        every = set().union(*sents) if sents else set()
        docs_with.update(every)
        if y > 0.5:
            positive_docs.update(every)
    n_pos, n_all = sum(y > 0.5 for _, y in rows), len(rows)
    base = n_pos / max(1, n_all)
    # only a feature over-represented in unsafe documents can be evidence; others weigh within such sentences
    # (pairs are many, and asked for more: one of the words must not be found everywhere)
    common = {f for f, n in docs_with.items() if n > 0.05 * n_all}
    telling = lambda f: "    " not in f or not all(f" {w} " in common for w in f.split())
    unlikely = lambda f, n: n >= 3 and n > 2 * base * docs_with[f] and _chance(n, docs_with[f], base) < (1e-7 if "    " in f else 0.0005)
    cand = {f for f, n in positive_docs.items() if unlikely(f, n) and telling(f)} | (prior_words & docs_with.keys())
    kept: list[tuple[int, np.ndarray]] = []
    for d, sents in enumerate(bags):
        for s in sents:
            if s & cand:
                ids = [seen.setdefault(f, len(seen)) for f in s if f in cand or prior_words and f in MENTION_FEATURES or docs_with[f] - positive_docs[f] >= 2]
                kept.append((d, np.array(ids, np.int64)))
    names = list(seen)
    if not kept:
        return Model(dict(priors), -1.5)
    prior = np.array([priors.get(f, 0.0) for f in names])
    # what isn't over-represented in unsafe documents can only speak against
    most = np.array([np.inf if f in cand else 0.0 for f in names])
    # words found everywhere say little against a sentence
    least = np.array([-0.1 if docs_with[f] > 0.05 * n_all else -2.0 for f in names])
    rare = np.array([1.0 / np.sqrt(docs_with[f]) for f in names])
    doc = np.array([d for d, _ in kept])
    row = np.repeat(np.arange(len(kept)), [len(x) for _, x in kept])
    col = np.concatenate([x for _, x in kept])
    y = np.array([v for _, v in rows])
    w, b = prior.copy(), -1.5
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    wrong_safe, wrong_unsafe = 0.03, 0.3 * base
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(kept))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_left = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_all)
        q = 1 - np.exp(log_left)
        lik = (1 - wrong_safe) * q + wrong_unsafe * (1 - q)
        slope = (y / np.maximum(lik, 1e-9) - (1 - y) / np.maximum(1 - lik, 1e-9)) * (1 - wrong_safe - wrong_unsafe)
        g = slope[doc] * (1 - q[doc]) * p  # d q / d z = (1 - q) p
        gw = np.bincount(col, g[row], len(w)) - flat * n_pos * rare * (w - prior) - 0.1 * (w - prior)
        grad = np.append(gw, g.sum() - 0.05 * (b + 2.0))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = np.maximum(np.minimum(w + step[:-1], most), least)
        b = min(-0.5, b + step[-1])
    weights = {f: float(x) for f, x in zip(names, w) if abs(x) > 0.02}
    weights |= {f: p for f, p in priors.items() if f not in seen}
    return Model(weights, float(b))


def train(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, chars: int = SAMPLE_CHARS, prior_words: frozenset[str] = STRONG_FEATURES) -> Model:
    """Fit on a sample of at most ``size`` labelled documents of either label, chosen by hash of their id, of at most ``chars`` characters.

    Both bounds hold for the sample only, which the driver fits on; all texts are scored whole. Null labels are
    left out; several labels of a document count as shares."""
    votes = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars))
    order = F.xxhash64("doc_id")
    unsafe = votes.where("y > 0").orderBy(order, "doc_id").limit(size)
    safe = votes.where("y = 0").orderBy(order, "doc_id").limit(size)
    sample = texts.join(F.broadcast(unsafe.unionByName(safe)), "doc_id").select("doc_id", "text", "y")
    return fit([(r["text"], r["y"]) for r in sorted(sample.collect(), key=lambda r: r["doc_id"])], prior_words=prior_words)


def _scorer(documents: DataFrame, labels: DataFrame, **sample):
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels, **sample))
    return lambda text: held.value.document(text)


def score(documents: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Score of each document in [0, 1] with its source and offending sentences (start, end, score).

    ``sample`` as in ``train``. Null, empty and blank texts score 0; repeated rows are kept; labels of unknown documents are ignored."""
    run = _scorer(documents, labels, **sample)

    def rows(i, source, text):
        p, bad = run(text)
        yield i, source, p, [(a, b, s) for a, b, s in bad]

    return map_rows(spread(documents.select("doc_id", "source", "text")), ["doc_id", "source", "text"], rows, "doc_id bigint, source string, score double, offending array<struct<start_char:int,end_char:int,score:double>>")


def found(documents: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Documents scored at ``THRESHOLD`` or above; ``sample`` as in ``train``."""
    run = _scorer(documents, labels, **sample)

    def rows(i, text) -> Iterator[tuple]:
        if run(text)[0] >= THRESHOLD:
            yield (i,)

    return map_rows(spread(documents.select("doc_id", "text")), ["doc_id", "text"], rows, "doc_id bigint").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, unsafe documents and their rate, by source; a null source is a source of its own."""
    return score(documents, labels).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("unsafe"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("unsafe_rate")
    )
