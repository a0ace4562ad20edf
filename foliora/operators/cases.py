"""Making evaluation cases of indexed chunks: topic, question, answer and keyword of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliora.functions.text import HAN, let, lstrip, strip
from foliora.operators.clean import S

# Forms of questions in turn, words that are no topic or keyword, and endings of topics.
QUESTIONS = ["有哪些要求？", "的办理流程是什么？", "需要注意什么？", "如何执行？", "的适用条件是什么？", "涉及哪些材料或留痕要求？", "在通知中是如何规定的？", "相关的风险控制要求是什么？"]
STOPWORDS = ["公司", "客户", "业务", "进行", "相关", "融资融券", "信用", "证券", "通知", "要求", "系统", "账户"]
ENDINGS = "流程|要求|标准|条件|规则|模板|通知|管理|监控|平仓|展期|授信|留痕|合同|担保物"
TITLE = "《([^》]{4,40})》"
TERM = rf"([{HAN}A-Za-z0-9]{{4,24}}(?:{ENDINGS}))"
FAQ = rf"问题{S}*\p{{Nd}}+{S}*[：:]{S}*(.{{6,80}}?)[？?]{S}*回答(?:{S}*\p{{Nd}}+)?[：:]{S}*(.{{20,500}})"
NEXT_FAQ = rf"{S}*问题{S}*\p{{Nd}}+{S}*[：:].*\z"
EDGES = r"[ ，。、；;：:()（）]+"
SENTENCE = "[^。；;]*[。；;]|[^。；;]+"
LEAST_ANSWER, SHORT_ANSWER, LONGEST_ANSWER = 80, 260, 420


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{EDGES}|{EDGES}\z", "")


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def topic(content: Column, file_name: Column) -> Column:
    """The first title or term of a text, or else of its file's name, of 4 to 28 characters; else the name's beginning."""
    found = F.transform(F.concat(_all(content, TITLE, 1), _all(content, TERM, 1), _all(file_name, TERM, 1)), _trim)
    fit = F.filter(found, lambda x: F.length(x).between(4, 28) & ~x.isin(STOPWORDS))
    stem = F.substring(F.regexp_replace(file_name, r"(?<=.)\.[^.]*\z", ""), 1, 24)
    return let(fit, lambda f: F.coalesce(F.get(f, F.lit(0)), stem))


def answer(content: Column) -> Column:
    """The first three sentences of a text, or its beginning if they are short."""

    def of(parts: Column) -> Column:
        first = strip(F.array_join(F.transform(F.slice(parts, 1, 3), lambda p, i: F.when(i == 0, p).otherwise(lstrip(p))), ""))
        return F.substring(F.when(F.length(first) < LEAST_ANSWER, strip(F.substring(content, 1, SHORT_ANSWER))).otherwise(first), 1, LONGEST_ANSWER)

    return let(_all(content, SENTENCE, 0), of)


def keyword(question: Column, about: Column, said: Column) -> Column:
    """The first title or run of letters in question, topic or answer that isn't a stop word."""
    found = F.concat(*(F.concat(_all(c, "《[^》]{4,40}》", 0), _all(c, rf"[{HAN}A-Za-z0-9]{{2,12}}", 0)) for c in (question, about, said)))
    fit = F.filter(F.transform(found, _trim), lambda x: (x != "") & ~x.isin(STOPWORDS))
    return let(fit, lambda f: F.get(f, F.lit(0)))


def make(chunks: DataFrame) -> DataFrame:
    """A case of each chunk (chunk_id, source, chunk_index, content with single blanks); questions take turns by chunk_index."""
    name = F.regexp_replace("source", r"\A.*/", "")
    turn = F.get(F.array(*map(F.lit, QUESTIONS)), F.pmod(F.col("chunk_index") - 1, F.lit(len(QUESTIONS))))
    faq = F.regexp_extract("content", FAQ, 1)
    rows = chunks.withColumn("_faq", faq).withColumn("_asked", F.when(F.col("_faq") != "", F.concat(strip(F.col("_faq")), F.lit("？"))))
    rows = rows.withColumn("topic", topic(F.coalesce("_asked", "content"), name))
    rows = rows.withColumn("question", F.coalesce("_asked", F.concat("topic", turn)))
    said = F.substring(strip(F.regexp_replace(F.regexp_extract("content", FAQ, 2), NEXT_FAQ, "")), 1, LONGEST_ANSWER)
    rows = rows.withColumn("answer", F.when(F.col("_asked").isNotNull(), said).otherwise(answer(F.col("content"))))
    return rows.select("chunk_id", "topic", "question", "answer", keyword(F.col("question"), F.col("topic"), F.col("answer")).alias("keyword"))



