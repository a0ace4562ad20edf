"""Tokens of texts and queries for keyword search, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliora.functions.text import HAN, SPACE, distinct_nonempty, let

# The vocabulary of query analysis.
OPTIONAL = ["功能", "作用", "参数", "接口", "算子", "说明", "示例", "返回", "返回值", "约束", "函数", "原型", "模板", "类型", "数据", "输入", "输出", "配置"]
IGNORED = [
    "什么", "是什么", "是什", "能是", "用是", "能是什", "用是什", "的功", "的作", "的参", "的接", "的算", "子的", "口的", "数的", "子的功", "口的作", "的功能", "的作用", "的参数", "功能是", "作用是",
    "如何", "怎么", "怎样", "哪些", "是否", "请问",
]
NOISE = ["什么", "如何", "怎么", "怎样", "是否", "请问", "怎", "么"]
ALIASES = {"作用": ["功能", "用途"], "功能": ["作用", "用途"], "接口": ["函数", "原型"]}

# Patterns of special tokens.
NUMERAL = "[0-9零〇一二三四五六七八九十百千万两]"
PREFIXED = rf"(?:问题|问|题)[{SPACE}]*[:：.\-、]?[{SPACE}]*({NUMERAL}+)"
ORDINAL = rf"第[{SPACE}]*({NUMERAL}+)[{SPACE}]*(?:题|问|小题)"
ENGLISH = rf"(?i)(?<![A-Za-z0-9])Q(?:uestion)?[{SPACE}]*[:：.\-、]?[{SPACE}]*(\p{{Nd}}+)(?![A-Za-z0-9])"
VERSION = r"(?<![A-Za-z0-9])([A-Za-z]*\p{Nd}+(?:[._-]\p{Nd}+)+)(?![A-Za-z0-9])"
RUN = rf"[A-Za-z0-9]+|[{HAN}]+"
IS_QUESTION = rf"\A(?:问题{NUMERAL}+|第{NUMERAL}+题|q\p{{Nd}}+|question\p{{Nd}}+)\z"
IS_VERSION = r"\A(?:[a-z]*\p{Nd}+(?:_\p{Nd}+)+|[a-z]*\p{Nd}{2,})\z"
IS_ASCII = r"\A(?=.*[A-Za-z])[A-Za-z0-9]{2,}\z"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def special_tokens(c: Column) -> Column:
    """Tokens of questions (by prefix, ordinal or ``Q3``), then of versions, in the order of the text within each kind."""
    prefixed = F.transform(_all(c, PREFIXED, 1), lambda x: F.concat(F.lit("问题"), x))
    ordinal = F.transform(_all(c, ORDINAL, 1), lambda x: F.concat(F.lit("第"), x, F.lit("题")))
    english = F.flatten(F.transform(_all(c, ENGLISH, 1), lambda x: F.array(F.concat(F.lit("q"), x), F.concat(F.lit("question"), x))))
    versions = F.flatten(F.transform(_all(c, VERSION, 1), lambda x: F.array(F.regexp_replace(F.lower(x), "[._-]+", "_"), F.regexp_replace(F.lower(x), "[._-]+", ""))))
    return F.concat(prefixed, ordinal, english, versions)


def _grams(run: Column) -> Column:
    """All pairs, then all triples of successive characters of a run."""

    def of(parts: Column) -> Column:
        def grams(n: int) -> Column:
            count = F.length(run) - (n - 1)
            at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: F.concat(*(F.get(parts, i + k) for k in range(n))))

        return F.concat(grams(2), grams(3))

    return let(F.split(run, ""), of)


def all_tokens(c: Column) -> Column:
    """Special tokens, then ASCII runs and the pairs and triples of Chinese runs, with repetitions."""
    runs = F.transform(_all(c, RUN), lambda r: F.when(r.rlike("^[A-Za-z0-9]"), F.array(F.lower(r))).otherwise(_grams(r)))
    return F.concat(special_tokens(c), F.flatten(runs))


def tokenize(c: Column) -> Column:
    """``all_tokens`` without repetitions."""
    return distinct_nonempty(all_tokens(c))


def keyword_text(c: Column) -> Column:
    """What the keyword index holds of a text."""
    return F.array_join(all_tokens(c), " ")


def index_terms(c: Column) -> Column:
    """The index's own terms: tokens cut at underscores, in order, with repetitions."""
    return F.filter(F.flatten(F.transform(all_tokens(c), lambda t: F.split(t, "_"))), lambda t: t != "")


def term_count(c: Column) -> Column:
    """Number of ``index_terms``, without making them: a Chinese run of n characters has 2n - 3, if that is above 0."""
    special = F.size(F.filter(F.flatten(F.transform(special_tokens(c), lambda t: F.split(t, "_"))), lambda t: t != ""))
    of_run = lambda r: F.when(r.rlike("^[A-Za-z0-9]"), 1).otherwise(F.greatest(2 * F.length(r) - 3, F.lit(0)))
    return special + F.aggregate(_all(c, RUN), F.lit(0), lambda n, r: n + of_run(r))


def is_required(t: Column) -> Column:
    return t.rlike(IS_QUESTION) | t.rlike(IS_VERSION) | t.rlike(IS_ASCII)


def is_ignored(t: Column) -> Column:
    noise = F.lit(False)
    for n in NOISE:
        noise = noise | t.contains(n)
    return ~t.isin(OPTIONAL) & (t.isin(IGNORED) | t.rlike(r"\A\p{Nd}\z") | (t.endswith("的") & (F.length(t) > 2)) | noise)


def token_class(t: Column) -> Column:
    return F.when(is_required(t), "required").when(is_ignored(t), "ignored").otherwise("optional")


def known_terms(q: Column) -> Column:
    """Terms of the vocabulary in a query, by place, longer ones first."""
    vocabulary = F.array(*(F.lit(t) for t in [*OPTIONAL, *IGNORED]))
    there = F.filter(vocabulary, lambda t: F.contains(F.lower(q), t))
    placed = F.transform(there, lambda t: F.struct(F.instr(F.lower(q), t).alias("at"), (-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda s: s["t"])


def query_tokens(q: Column) -> Column:
    """Tokens of a query before classification."""
    base = distinct_nonempty(F.concat(special_tokens(q), F.transform(_all(q, "[A-Za-z0-9]+"), F.lower), known_terms(q)))
    more = F.filter(tokenize(q), lambda t: ~is_ignored(t))
    return let(base, lambda b: F.when(F.exists(b, is_required), b).otherwise(F.array_distinct(F.concat(b, more))))


def analyze(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``required``, ``optional`` and ``ignored`` token arrays; all empty for a null query."""

    def classes(ts: Column) -> Column:
        return F.struct(
            F.filter(ts, is_required).alias("required"), F.filter(ts, lambda x: ~is_required(x) & ~is_ignored(x)).alias("optional"), F.filter(ts, lambda x: ~is_required(x) & is_ignored(x)).alias("ignored")
        )

    made = let(query_tokens(F.coalesce(F.col(query), F.lit(""))), classes)
    return queries.select("*", F.inline_outer(F.array(made))) if not {"required", "optional", "ignored"} & set(queries.columns) else analyze(queries.drop("required", "optional", "ignored"), query)


def matched(tokens: Column, content_tokens: Column) -> Column:
    """Those of ``tokens`` that a content has, itself or by an alias."""

    def there(t: Column) -> Column:
        hit = F.array_contains(content_tokens, t)
        for word, others in ALIASES.items():
            hit = hit | ((t == word) & F.arrays_overlap(content_tokens, F.array(*map(F.lit, others))))
        return hit

    return F.filter(tokens, there)
