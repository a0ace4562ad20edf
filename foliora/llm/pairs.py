"""Defects of prompt and response pairs: empty, truncated, refusal, copied question, other language.

A suffix automaton of the prompt measures how much of the response is copied from it; an automaton of
refusal phrases reads what lies outside quotations; a stack of delimiters and the last character show
a text cut short; votes of scripts and stop words name the language of both sides.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliora.functions.rows import map_rows, spread

# Phrases by which a response declines, in several languages.
REFUSALS = """
i cannot answer|i can't answer|cannot answer this|can't answer|unable to answer|not able to answer|i cannot help|i can't help|i won't help|won't help with|not able to comment|cannot comment|can't comment|i do not know|i don't know|have no information|no information about|not enough information|insufficient information|
do not cover this|does not cover this|have to decline|must decline|i decline|outside of what i may|outside my scope|beyond my scope|not in a position to|not at liberty to|decline to answer|refuse to answer|against my guidelines|unable to comment|unable to say|cannot say|can't say|cannot tell you|can't tell you|cannot discuss|can't discuss|cannot share|can't share|do not have enough|don't have enough|don't have that information|do not have that information|cannot determine|can't determine|unable to determine|cannot assist|can't assist|unable to assist|not permitted to|prefer not to|cannot provide|can't provide|unable to provide|as an ai|i'm not sure|
无法从当前知识库中确定|无法确定|无法判断|无法回答|不能回答|没法回答|无法提供|不能提供|无法给出|恕不作答|恕不|恕难|不便就此|不便回答|不便提供|没有相关内容|没有相关信息|没有相关资料|没有找到|未找到相关|资料不足|信息不足|不知道|不清楚|不了解|超出了我的|无可奉告|拒绝回答|爱莫能助|
kann ich leider nicht|leider nicht beantworten|kann ich nicht beantworten|keine angaben|keine informationen|keine auskunft|weiß ich nicht|weiss ich nicht|darf dazu nichts|darf ich nichts|nicht in der lage|möchte ich nichts|kann nicht helfen|nicht genügend informationen|
ne peux pas répondre|ne peux pas vous|ne permettent pas de|ne permet pas de répondre|préfère ne pas|je ne sais pas|pas d'information|pas assez d'information|informations insuffisantes|impossible de répondre|ne suis pas en mesure|ne peux pas aider|
no puedo responder|no puedo contestar|no puedo ayudar|no dispongo de información|no tengo información|fuera de lo que puedo|no lo sé|no sé la|prefiero no|no es posible responder|no hay información suficiente|información insuficiente|no puedo comentar|
не могу ответить|не могу помочь|не могу сказать|нет таких сведений|нет сведений|нет информации|не знаю|недостаточно информации|недостаточно данных|воздержусь|не вправе|
判断できません|お答えできません|回答できません|わかりません|分かりません|情報がありません|お手伝いできません|答えられません|回答は控え|お答えを控え|
لا أستطيع الإجابة|لا يمكنني الإجابة|لا أعرف|لا توجد معلومات|لا تتوفر معلومات|أعتذر عن|لا أعلم|لا يمكنني المساعدة|
ไม่สามารถตอบ|ไม่ทราบ|ไม่มีข้อมูล|ขออภัย|ไม่สามารถให้|
उत्तर नहीं दे सकता|जवाब नहीं दे सकता|जानकारी नहीं है|पता नहीं|क्षमा करें|उत्तर देने में असमर्थ|मैं नहीं जानता|
답변할 수 없|알 수 없|모르겠|정보가 없|도와드릴 수 없|
não posso responder|não sei|não tenho informaç|não posso ajudar|não há informaç|prefiro não|non posso rispondere|non lo so|non ho informazioni|non posso aiutar|preferisco non|informazioni insufficienti|kan ik niet beantwoorden|weet ik niet|geen informatie|tidak dapat menjawab|tidak bisa menjawab|tidak tahu|tidak memiliki informasi
"""
# Frequent function words by language, and words of assent that alone make an answer.
STOPWORDS = {
    "en": "the a an of and to in is for with on by that this each every before after under if when once all per at as it be are was or not yes no from which what who how why where does do did has have will would can should its their there these those into over about than",
    "de": "der die das den dem des und in zu ist für mit auf bei nach vor ohne gemäß jede jeden jeder einmal pro alle ein eine einen nicht ja nein im am von wie wer wann wird während innerhalb welche welcher welches was warum wo sind hat haben kann soll werden durch über unter gegen",
    "fr": "le la les l un une des de du d et à en est pour avec sur par que qui chaque sans après avant pendant selon dès fois oui non au aux ce cette quand comment s sous deux quel quelle quels quelles où pourquoi sont ont peut doit dans ne pas se",
    "pt": "o a os as um uma de do da dos das e em no na nos nas é para com por pelo pela que cada sem após antes durante segundo vez ao à não sim se quando como quem qual quais onde são tem pode deve seu sua seus suas mais pelos pelas este esta isso foi ser há",
    "it": "il lo la i gli le un uno una di del della dei delle degli e è in nel nella per con su sul sulla che ogni senza dopo prima durante secondo volta al alla non sì no si quando come chi quale quali dove sono ha può deve suo sua più dal dalla questo questa da ai",
    "nl": "de het een en van in is voor met op bij na voordat zonder volgens elke iedere per alle niet ja nee wordt worden tijdens binnen welke wie wat waarom waar wanneer hoe zijn heeft hebben kan moet door over onder tegen dat die aan om te naar",
    "id": "yang dan di ke dari untuk dengan pada adalah ini itu tidak atau oleh setiap sebelum setelah selama akan dapat harus telah sudah dalam jika bila siapa apa kapan bagaimana berapa mengapa mana oleh para sebagai karena juga lebih",
    "es": "el la los las un una de del y a en es para con por que cada sin tras antes durante según vez al sí no se cuándo cómo quién ocupa superar qué cuál dónde son tiene puede debe su sus lo más",
}
STOPS = {w: [k for k, v in STOPWORDS.items() if w in v.split()] for k in STOPWORDS for w in STOPWORDS[k].split()}
SCRIPTS = [("kana", "぀-ヿ"), ("han", "㐀-鿿"), ("ru", "Ѐ-ӿ"), ("ar", "؀-ۿ"), ("th", "฀-๿"), ("hi", "ऀ-ॿ"), ("ko", "가-힯")]
LETTERS = re.compile("|".join(f"(?P<{k}>[{r}]+)" for k, r in SCRIPTS) + r"|(?P<latin>[^\W\d_]+)")
# Languages a prompt can ask for, and how it names them.
ASKED = [
    ("en", r"in english|auf englisch|en anglais|en inglés|по-английски|用英[文语]|英語で|英文回答|بالإنجليزية|अंग्रेज़ी में|เป็นภาษาอังกฤษ"),
    ("de", r"in german|auf deutsch|en allemand|en alemán|по-немецки|用德[文语]|ドイツ語で"),
    ("fr", r"in french|auf französisch|en français|en francés|по-французски|用法[文语]|フランス語で"),
    ("es", r"in spanish|auf spanisch|en espagnol|en español|по-испански|用西班牙[文语]|スペイン語で"),
    ("zh", r"in chinese|auf chinesisch|en chinois|en chino|по-китайски|用中文|用汉语|中国語で"),
    ("ja", r"in japanese|auf japanisch|en japonais|en japonés|по-японски|用日[文语]|日本語で"),
    ("ru", r"in russian|auf russisch|en russe|en ruso|по-русски|用俄[文语]|ロシア語で"),
]
ASKING = re.compile(r"answer|respond|reply|antwort|répond|respond|contest|ответ|回答|作答|答え|أجب|उत्तर|ตอบ", re.I)
ASKED_RE = [(k, re.compile(p, re.I)) for k, p in ASKED]

CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|https?://\S+|<[^<>\n]{1,60}>", re.S)
QUOTED = re.compile(r"“[^“”]*”|«[^«»]*»|「[^「」]*」|„[^„“”]*[“”]|\"[^\"\n]*\"|『[^『』]*』")
LABEL = re.compile(r"^\W*(?:answer|antwort|réponse|respuesta|ответ|response|回答|答案|答|回覆|返答|الإجابة|उत्तर|คำตอบ)\W*[:：]\W*$", re.I)
NOTHING = frozenset("null none n/a na nil nan undefined tbd - -- ... … 。 无 なし".split())
TERMINAL = re.compile(r"[.!?。！？।؟۔…]['\"”’»」』）)\]】*_`]*$")
PAIRED = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "{": "}"}
HAN = re.compile("[぀-ヿ㐀-鿿]")
OPEN_END = re.compile(r"(?:^|[\s(（,;，；])((?:[^\W\d_]{1,5}\.[ \u00a0]?)?[^\W\d_]{1,5})\.$")
# Abbreviations that lead on to something, so that a text that ends with one is cut short.
LEADING = frozenset("e.g i.e cf vs viz no nos sec fig vol ch pp mr mrs ms dr prof z.b d.h u.a bzw vgl nr abs kap abb fr hr p.ex c.-à-d p.ej pág págs núm sra sr dra m mme см т.е п стр напр рис табл гл г-н".split())
VALUE = re.compile(r"^\W*[\w.%$€°+/=:<>@#-]*\W*$")


class SuffixAutomaton:
    """All substrings of a text, built in one pass; ``coverage`` reads another text against it."""

    def __init__(self, s: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in s:
            cur = len(self.len)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.len)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, s: str, least: int) -> tuple[int, int]:
        """Characters of ``s`` that lie in a common substring of at least ``least`` characters, and the length of the longest one."""
        state = length = covered = upto = longest = 0
        for i, c in enumerate(s):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            longest = max(longest, length)
            if length >= least:
                start = max(upto, i + 1 - length)
                covered += i + 1 - start
                upto = i + 1
        return covered, longest


NO_LETTERS = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
# Words that introduce a question which is given back.
LEADS = frozenset(
    plain_lead
    for plain_lead in (
        "question yourquestion yourquestionis youasked youaskedabout youareasking youwanttoknow regarding about thequestionis query frage ihrefrage ihrefragelautet siefragten siefragen zu zurfrage question votrequestion votrequestionest "
        "vousavezdemandé vousdemandez concernant sur ausujetde pregunta supregunta supreguntaes ustedpreguntó ustedpregunta sobre pergunta suapergunta vocêperguntou domanda lasuadomanda haichiesto vraag uwvraag pertanyaan pertanyaananda вопрос вашвопрос выспросили выспрашиваете поповоду "
        "问题 您的问题是 你的问题是 您问的是 你问的是 您的问题 您问 关于 提问 您想知道 质问 質問 ご質問 ご質問は お問い合わせ سؤال سؤالك प्रश्न आपकाप्रश्न คำถาม คำถามของคุณ คำถามของคุณคือ 질문 answer antwort réponse respuesta ответ 回答 答案 答"
    ).split()
)


def plain(s: str) -> str:
    """Letters, marks and digits in one form, for comparing prompt and response."""
    return NO_LETTERS.sub("", unicodedata.normalize("NFKC", s).casefold())


def language(s: str) -> str | None:
    """The language most words vote for; None without a clear vote."""
    votes: Counter = Counter()
    kana = han = words = 0
    for m in LETTERS.finditer(s):
        k, w = m.lastgroup, m[0]
        if k == "kana":
            kana += len(w)
        elif k == "han":
            han += len(w)
        elif k == "latin":
            words += 1
            for lang in STOPS.get(w.casefold(), ()):
                votes[lang] += 1
        else:
            votes[k] += max(1, len(w) // 6) if k == "th" else 1
    if kana or han:
        votes["ja" if kana >= 0.15 * (kana + han) else "zh"] += (kana + han) / 2.5
    if not votes:
        return None
    (a, n), *rest = votes.most_common(2)
    if rest and rest[0][1] == n:
        # accents decide between equal votes
        marks = {"de": "äöüß", "fr": "éèàçêùœ", "es": "ñóíúá¿¡"}
        tied = [k for k, v in votes.items() if v == n]
        best = max(tied, key=lambda k: sum(s.count(c) for c in marks.get(k, "")))
        return best if any(c in s for c in marks.get(best, "")) else None
    return a


def asked(query: str) -> str | None:
    """The language a prompt asks the response to be in."""
    if ASKING.search(query):
        for k, p in ASKED_RE:
            if p.search(query):
                return k
    return None


_AUTOMATON = None


def _refusals():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for p in REFUSALS.replace("\n", "").split("|"):
            if p := p.strip():
                _AUTOMATON.add_word(p, len(p))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def is_refusal(answer: str) -> bool:
    """A phrase of refusal outside quotations, and no answer besides."""
    s = QUOTED.sub("“”", answer).casefold().replace("’", "'")
    hits = [end for end, _ in _refusals().iter(s)]
    if not hits:
        return False
    rest = s[hits[0] + 1 :]
    body = re.split(r"[.!?。！？।؟]\s*", rest, maxsplit=1)
    after = body[1] if len(body) > 1 else ""
    head = s[: hits[0] + 1]
    # a refusal may be followed by a short hint, not by an answer
    return len(plain(after)) <= 60 and len(re.split(r"[.!?。！？।؟]\s+|[。！？]", head)) <= 2


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    s = "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Cc", "Zs", "Zl", "Zp")).strip()
    if s.casefold() in NOTHING or LABEL.match(answer.strip()):
        return True
    bare = re.sub(r"</?[a-zA-Z][^<>]*>|`+|~~~", "", s)
    return not any(unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("So", "Sc") for c in bare)


def is_truncated(answer: str) -> bool:
    s = answer.strip().strip("﻿​")
    if s.count("```") % 2:
        return True
    bare = CODE.sub("`", s)
    if not bare.strip("` \n"):
        return False
    stack: list[str] = []
    for c in bare:
        if stack and c in stack[-1]:
            stack.pop()
        elif c in PAIRED:
            stack.append(PAIRED[c])
    if any(x not in "}]" for x in stack):
        return True
    if re.search(r"\n[ \t]*(?:[-*•]|\d{1,3}[.)])$", bare.rstrip()):  # an item that was only begun
        return True
    if m := OPEN_END.search(bare.rstrip()):
        return m[1].casefold().replace(" ", "") in LEADING
    if s.endswith(("```", "~~~", "`")) or TERMINAL.search(bare.rstrip()):
        return False
    if VALUE.match(bare) and not bare.rstrip().endswith((",", "，", ":", "：", "、", "-")):
        return False
    last = bare.rstrip().split("\n")[-1]
    if re.match(r"^\s*(?:[-*•]|\d+[.)])\s+\S+$", last) or VALUE.match(last) and "\n" in bare.strip():
        return False
    letters = sum(c.isalpha() for c in bare)
    han = len(re.findall("[぀-ヿ㐀-鿿]", bare))
    return last.rstrip()[-1:] in ":：,，、;；" or han >= 6 or (letters - han) >= 12 and len(bare.split()) >= 3


def is_copied(query: str, answer: str) -> bool:
    """Whether a response gives back the question, once or repeatedly, with nothing new but words that introduce it.

    Nearly all of the question must stand in the response at one piece: a response that takes up its words to
    answer (with a value, or in another order) isn't a copy."""
    q, a = plain(query), plain(answer)
    rim = len(q) // 10
    if not q or q[rim : len(q) - rim] not in a:
        return False
    cjk = HAN.search(q) is not None
    covered, longest = SuffixAutomaton(q).coverage(a, min(len(q), 4 if cjk else 10))
    if longest < 0.9 * len(q):
        return False
    head, _, tail = a.partition(q)
    new = len(a) - covered
    return new <= (2 if cjk else 3) and not any(c.isdigit() and c not in q for c in a) or head in LEADS and len(tail.replace(q, "")) <= 2


def defects(query: str | None, answer: str | None) -> list[str]:
    """Kinds of defect of a pair, sorted; empty for a sound one."""
    if is_empty(answer):
        return ["empty"]
    if is_refusal(answer):
        return ["refusal"]
    if is_copied(query or "", answer):
        return ["copied_question"]
    out = ["truncated"] if is_truncated(answer) else []
    text = QUOTED.sub(lambda m: m[0] if len(m[0]) > 60 else " ", CODE.sub(" ", answer))
    if any(c.isalpha() for c in text) and not (VALUE.match(text.strip()) and not ASSENT.match(text.strip())):
        got = language(text)
        want = asked(query or "") or language(query or "")
        if got and want and got != want and {got, want} != {"zh", "ja"} or (got and want and got != want and re.search("[぀-ヿ]", answer + (query or ""))):
            out.append("other_language")
    return sorted(out)


ASSENT = re.compile(r"^(?:yes|no|ja|nein|oui|non|sí|si|да|нет|はい|いいえ|是的?|不是|نعم|لا|ใช่|हाँ)\W*$", re.I)


def found(answers: DataFrame) -> DataFrame:
    """One row per defective pair and kind of defect; repeated rows count once.

    A null or contentless response is ``empty``; a null query takes part only in the checks that read
    the response alone; ids may be null (such rows come out with a null id)."""
    return map_rows(spread(answers.select("answer_id", "query", "answer")), ["answer_id", "query", "answer"], lambda i, q, a: ((i, d) for d in defects(q, a)), "answer_id bigint, defect string").distinct()


def report(answers: DataFrame) -> DataFrame:
    """Pairs, defects found and how often the recorded fallback reason agrees, by kind of defect."""
    pairs = answers.select("answer_id", "query", "answer", "fallback_reason").dropDuplicates(["answer_id"])
    kinds = map_rows(spread(pairs), ["answer_id", "query", "answer", "fallback_reason"], lambda i, q, a, f: [(i, d, f is not None) for d in defects(q, a) or ["none"]], "answer_id bigint, defect string, hinted boolean")
    return kinds.groupBy("defect").agg(F.count("*").alias("pairs"), F.sum(F.col("hinted").cast("int")).alias("with_fallback_reason"))
