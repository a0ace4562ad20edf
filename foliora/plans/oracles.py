"""Standard SQL of the engine's queries, on the same tables; each states a result without regard to how it is computed."""

from __future__ import annotations

from foliora.functions.text import HAN, SPACE, WORD
from foliora.operators import answer, cases, tokens
from foliora.operators.clean import BARE_NUMBER, CHINESE_PAGE, DECORATIVE, ENGLISH_PAGE, MARKER, SEPARATORS, NUMBER, S
from foliora.operators.sections import BLANK
from foliora.sources.loaders import MIME, OTHER_MIME

SQL: dict[str, str] = {}

CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM chunks)"
PAGES = "(SELECT DISTINCT ON (page_doc_id) * FROM pdf_pages)"
CASES = "(SELECT DISTINCT ON (id) * FROM eval_cases)"
ANSWERS = "(SELECT DISTINCT ON (answer_id) * FROM answers)"
RESULTS = "(SELECT DISTINCT ON (query_id, id) * FROM search_results)"
FILES = "(SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY created_at DESC, coalesce(status, '') DESC, coalesce(original_name, '') DESC) = 1)"
REGISTRY = "(SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY file_id, collection_id ORDER BY recorded_at DESC, coalesce(index_status, '') DESC, coalesce(CAST(indexed_chunk_count AS VARCHAR), '') DESC, coalesce(last_error, '') DESC) = 1)"


def q(s: str) -> str:
    """A text literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(rf'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def lstrip(c: str) -> str:
    return f"regexp_replace({c}, {q(rf'^[{SPACE}]+')}, '')"


def rstrip(c: str) -> str:
    return f"regexp_replace({c}, {q(rf'[{SPACE}]+$')}, '')"


def full(c: str) -> str:
    return f"coalesce(regexp_matches({c}, {q(f'[^{SPACE}]')}), false)"


def unix(c: str) -> str:
    return rf"regexp_replace({c}, '\r\n?', chr(10), 'g')"


def lines(c: str) -> str:
    return f"string_split({unix(c)}, chr(10))"


def clean(c: str) -> str:
    return rf"regexp_replace({strip(c)}, '[ \t\f\x{{b}}]+', ' ', 'g')"


def words(c: str) -> str:
    return f"length(regexp_replace({c}, {q(f'[^{WORD}]')}, '', 'g'))"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def dedupe(c: str) -> str:
    """First occurrences of a list, in order, without empty texts."""
    return f"list_filter({c}, lambda x, i: x <> '' AND list_position({c}, x) = i)"


# --- scans, sources, sinks ---------------------------------------------------------------------

SQL["load_text"] = f"SELECT doc_id, source, CAST(length({strip('text')}) AS INTEGER) AS chars FROM documents WHERE file_type IN ('.md', '.txt') AND {full('text')}"
SQL["load_pages"] = f"""
SELECT page_doc_id, source, page_number, pages, CAST(length(content) AS INTEGER) AS chars
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS pages FROM {PAGES}) WHERE {full('content')} AND source IS NOT NULL"""
SQL["load_skipped"] = f"""
SELECT doc_id, CASE WHEN file_type IN ('.md', '.txt', '.pdf') THEN 'empty document: ' ELSE 'unsupported file type: ' END || coalesce(file_name, '?') AS message
FROM documents WHERE NOT {full('text')} OR file_type NOT IN ('.md', '.txt', '.pdf')"""
SQL["vision_route"] = f"SELECT page_doc_id, coalesce(length({strip('content')}) < 40, true) AS auto, true AS visual, false AS text FROM {PAGES}"
_SUFFIX = r"lower(regexp_extract(regexp_replace({0}, '^.*/', ''), '[^.](\.[^./]+)$', 1))"
SQL["mime_type"] = (
    "SELECT DISTINCT file_id, CASE " + " ".join(f"WHEN {_SUFFIX.format('original_name')} = '{k}' THEN '{v}'" for k, v in MIME.items()) + f" ELSE '{OTHER_MIME}' END AS mime_type FROM files"
)
SQL["loader_meta"] = f"SELECT doc_id, concat_ws('/', file_id, file_name) AS source, file_name, {_SUFFIX.format('file_name')} AS file_type FROM documents"

# tokens: the dialect has no look-around, so separators are doubled and captured instead
_D = "regexp_replace({0}, '([^A-Za-z0-9._\\p{{Nd}}-])', '\\1\\1', 'g')"
_NOT = "(?:^|[^A-Za-z0-9])"
_END = "(?:$|[^A-Za-z0-9])"


def special(c: str) -> str:
    version = f"regexp_extract_all({_D.format(c)}, {q(_NOT + r'([A-Za-z]*\p{Nd}+(?:[._-]\p{Nd}+)+)' + _END)}, 1)"
    english = f"regexp_extract_all({_D.format(c)}, {q('(?i)' + _NOT + rf'Q(?:uestion)?[{SPACE}]*[:：.\-、]?[{SPACE}]*(\p{{Nd}}+)' + _END)}, 1)"
    return (
        f"list_concat(list_concat(list_transform(regexp_extract_all({c}, {q(tokens.PREFIXED)}, 1), lambda x: '问题' || x), list_transform(regexp_extract_all({c}, {q(tokens.ORDINAL)}, 1), lambda x: '第' || x || '题')), "
        f"list_concat(flatten(list_transform({english}, lambda x: ['q' || x, 'question' || x])), "
        f"flatten(list_transform({version}, lambda x: [regexp_replace(lower(x), '[._-]+', '_', 'g'), regexp_replace(lower(x), '[._-]+', '', 'g')]))))"
    )


def scan(c: str) -> str:
    return (
        f"flatten(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+|[{HAN}]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [lower(r)] "
        "ELSE list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3))) END))"
    )


def all_tokens(c: str) -> str:
    return f"list_concat({special(c)}, {scan(c)})"


def is_required(t: str) -> str:
    return f"({has(t, tokens.IS_QUESTION)} OR {has(t, tokens.IS_VERSION)} OR ({has(t, '^[A-Za-z0-9]{2,}$')} AND {has(t, '[A-Za-z]')}))"


def _in(t: str, vs: list[str]) -> str:
    return f"{t} IN ({', '.join(map(q, vs))})"


def is_ignored(t: str) -> str:
    noise = " OR ".join(f"contains({t}, {q(n)})" for n in tokens.NOISE)
    return f"(NOT {_in(t, tokens.OPTIONAL)} AND ({_in(t, tokens.IGNORED)} OR {has(t, r'^\p{Nd}$')} OR ({t} LIKE '%的' AND length({t}) > 2) OR {noise}))"


def analysed(source: str, key: str, query: str) -> str:
    """CTEs a0 to a3; a3 has the key, the query and the lists req, opt and ign."""
    vocabulary = "[" + ", ".join(map(q, [*tokens.OPTIONAL, *tokens.IGNORED])) + "]"
    return f"""
a0 AS (SELECT {key} AS k, coalesce({query}, '') AS query FROM {source}),
a1 AS (SELECT k, query, list_concat(list_concat({special('query')}, list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x))),
  list_transform(list_sort(list_transform(list_filter({vocabulary}, lambda t: contains(lower(query), t)), lambda t: {{'at': instr(lower(query), t), 'n': -length(t), 't': t}})), lambda s: s.t)) AS b,
  {all_tokens('query')} AS m FROM a0),
a2 AS (SELECT k, query, {dedupe('b')} AS b, list_filter(m, lambda t: t <> '' AND NOT {is_ignored('t')}) AS m FROM a1),
a2b AS (SELECT k, query, CASE WHEN len(list_filter(b, lambda t: {is_required('t')})) > 0 THEN b ELSE list_concat(b, m) END AS t FROM a2),
a2c AS (SELECT k, query, {dedupe('t')} AS t FROM a2b),
a3 AS (SELECT k, query, t, list_filter(t, lambda x: {is_required('x')}) AS req, list_filter(t, lambda x: NOT {is_required('x')} AND NOT {is_ignored('x')}) AS opt,
  list_filter(t, lambda x: NOT {is_required('x')} AND {is_ignored('x')}) AS ign FROM a2c)"""


_TERMS = f"""
t0 AS (SELECT collection_id, chunk_id, {all_tokens('content')} AS l FROM {CHUNKS}),
t1 AS (SELECT collection_id, chunk_id, coalesce(list_filter(flatten(list_transform(l, lambda x: string_split(x, '_'))), lambda x: x <> ''), []) AS terms FROM t0),
t2 AS (SELECT collection_id, chunk_id, len(terms) AS doc_len, unnest(terms) AS token, unnest(range(len(terms))) AS pos FROM t1)"""
SQL["postings"] = f"""
WITH {_TERMS}
SELECT collection_id, token, chunk_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(doc_len) AS INTEGER) AS doc_len, CAST(min(pos) AS INTEGER) AS first_pos FROM t2 GROUP BY collection_id, token, chunk_id"""
SQL["vector_upsert"] = "SELECT vec_id, label, round(CAST(CASE WHEN label >= 5 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings"
SQL["eval_cases"] = f"""
SELECT id, collection_id, CAST(coalesce(len(expected_sources), 0) AS INTEGER) AS sources, CAST(coalesce(len(expected_keywords), 0) AS INTEGER) AS keywords, top_k,
  CASE WHEN coalesce(id, '') = '' THEN 'missing id' WHEN coalesce(query, '') = '' THEN 'missing query' WHEN coalesce(collection_id, '') = '' THEN 'missing collection_id' WHEN top_k <= 0 THEN 'top_k must be above 0' END AS error FROM {CASES}"""
SQL["case_rows"] = f"SELECT chunk_id, source, chunk_index, {strip(f'regexp_replace(content, {q(f'[{SPACE}]+')}, {q(' ')}, {q('g')})')} AS content FROM {CHUNKS} WHERE length(trim(content)) >= 80"

_TRIM = f"regexp_replace({{0}}, {q('^' + cases.EDGES + '|' + cases.EDGES + '$')}, '', 'g')"
_STOP = ", ".join(map(q, cases.STOPWORDS))


def _first(lists: str, test: str) -> str:
    return f"list_filter(list_transform({lists}, lambda x: {_TRIM.format('x')}), lambda x: {test} AND x NOT IN ({_STOP}))[1]"


SQL["case_topic"] = f"""
WITH r AS ({SQL['case_rows']}), a AS (SELECT *, regexp_replace(source, '^.*/', '') AS name, regexp_extract(content, {q(cases.FAQ)}, 1) AS fq, regexp_extract(content, {q(cases.FAQ)}, 2) AS fa FROM r),
b AS (SELECT *, CASE WHEN fq <> '' THEN {strip('fq')} || '？' END AS asked FROM a), b2 AS (SELECT *, coalesce(asked, content) AS src FROM b),
c AS (SELECT *, coalesce({_first(f"list_concat(list_concat(regexp_extract_all(src, {q(cases.TITLE)}, 1), regexp_extract_all(src, {q(cases.TERM)}, 1)), regexp_extract_all(name, {q(cases.TERM)}, 1))", 'length(x) BETWEEN 4 AND 28')},
  substr(regexp_replace(name, '(.)\\.[^.]*$', '\\1'), 1, 24)) AS topic FROM b2),
d AS (SELECT *, coalesce(asked, topic || [{', '.join(map(q, cases.QUESTIONS))}][((chunk_index - 1) % 8 + 8) % 8 + 1]) AS question, regexp_extract_all(content, {q(cases.SENTENCE)}) AS parts FROM c),
e AS (SELECT *, {strip(f"array_to_string(list_transform(parts[1:3], lambda p, i: CASE WHEN i = 1 THEN p ELSE {lstrip('p')} END), '')")} AS three FROM d),
f AS (SELECT *, CASE WHEN asked IS NOT NULL THEN substr({strip(f"regexp_replace(fa, {q(cases.NEXT_FAQ.replace(chr(92) + 'z', '$'))}, '')")}, 1, 420)
  ELSE substr(CASE WHEN length(three) < 80 THEN {strip('substr(content, 1, 260)')} ELSE three END, 1, 420) END AS answer FROM e)
SELECT chunk_id, topic, question, answer, {_first("flatten(list_transform([question, topic, answer], lambda t: list_concat(regexp_extract_all(t, '《[^》]{4,40}》'), regexp_extract_all(t, '[" + HAN + "A-Za-z0-9]{2,12}'))))", "x <> ''")} AS keyword FROM f"""

# --- projections -------------------------------------------------------------------------------

SQL["public_projection"] = f"""
SELECT r.query_id, r.id, round(r.score, 6) AS score, r.source, r.file_id, r.collection_id, c.page_start, c.page_end FROM {RESULTS} r LEFT JOIN {CHUNKS} c ON c.chunk_id = r.id"""
SQL["public_json"] = f"""
SELECT query_id, id, CAST(to_json({{'id': id, 'source': coalesce(source, ''), 'metadata': {{'source': coalesce(source, ''), 'file_id': coalesce(file_id, ''), 'collection_id': coalesce(collection_id, '')}}}}) AS VARCHAR) AS json FROM {RESULTS}"""
_HYBRID = "0.65 * coalesce(vector_score, 0) + (1 - CAST(0.65 AS DOUBLE)) * coalesce(keyword_score, 0)"
SQL["debug_projection"] = f"""
SELECT query_id, id, strategy AS retrieval_mode, round({_HYBRID}, 9) AS hybrid_score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score, round(raw_distance, 6) AS raw_distance,
  round(raw_bm25, 6) AS raw_bm25, CAST(coalesce(len(keyword_matched_tokens), 0) AS INTEGER) AS matched, round(score, 6) AS score FROM {RESULTS}"""
SQL["active_filter"] = f"""
SELECT 'file' AS kind, file_id, '' AS collection_id FROM {FILES} WHERE status = 'active'
UNION ALL SELECT 'registry', file_id, collection_id FROM {REGISTRY} WHERE index_status = 'indexed'"""
SQL["get_by_ids"] = f"""
SELECT r.query_id, r.pos, r.id, CAST(length(c.content) AS INTEGER) AS chars FROM (SELECT query_id, id, min(rank) AS pos FROM search_results GROUP BY query_id, id) r JOIN {CHUNKS} c ON c.chunk_id = r.id"""
SQL["delete_by_file"] = f"""
SELECT collection_id, count(*) AS chunks FROM {CHUNKS} c WHERE NOT EXISTS (SELECT 1 FROM {FILES} f WHERE f.file_id = c.file_id AND f.status = 'deleted') GROUP BY collection_id"""
SQL["preview"] = f"SELECT chunk_id, CASE WHEN length(content) > 80 THEN {rstrip('substr(content, 1, 80)')} || '...' ELSE content END AS preview FROM {CHUNKS}"
_PAGE = "CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END"
SQL["page_label"] = f"SELECT chunk_id, coalesce({_PAGE} END, CASE WHEN chunk_count = 1 THEN '1' END, 'n/a') AS page FROM {CHUNKS}"
_SCORE = "coalesce(CAST(CAST(round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(30, 12)), 3) AS DECIMAL(20, 3)) AS VARCHAR), 'n/a')"
_SOURCE = "CASE WHEN coalesce({0}, '') = '' THEN 'unknown' ELSE {0} END"
SQL["labels_fmt"] = f"SELECT query_id, id, {_SCORE.format('score')} AS score, {_SOURCE.format('source')} AS source FROM {RESULTS}"

# --- joins and sets ----------------------------------------------------------------------------

_FUSED = f"""
r AS (SELECT * FROM {RESULTS}),
v AS (SELECT query_id, id, vector_score, raw_distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw_distance, id) AS INTEGER) AS vector_rank FROM r WHERE raw_distance IS NOT NULL QUALIFY vector_rank <= 40),
k AS (SELECT query_id, id, keyword_score, raw_bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC NULLS LAST, raw_bm25, id) AS INTEGER) AS keyword_rank FROM r WHERE raw_bm25 IS NOT NULL QUALIFY keyword_rank <= 40),
b AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, vector_score, raw_distance, vector_rank, keyword_score, raw_bm25, keyword_rank FROM v FULL JOIN k ON v.query_id = k.query_id AND v.id = k.id),
f AS (SELECT *, CAST({_HYBRID} AS DOUBLE) AS hybrid_score FROM b),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id) AS INTEGER) AS hybrid_rank FROM f)"""
SQL["hybrid_search"] = f"WITH {_FUSED} SELECT query_id, hybrid_rank, id, round(hybrid_score, 9) AS hybrid_score, vector_rank, keyword_rank FROM g WHERE hybrid_rank <= 10"
SQL["search_debug"] = f"WITH {_FUSED} SELECT query_id, id, vector_rank, keyword_rank, hybrid_rank, round(raw_distance, 6) AS raw_distance, round(raw_bm25, 6) AS raw_bm25, round(hybrid_score, 9) AS hybrid_score FROM g"
SQL["index_consistency"] = f"""
WITH c AS (SELECT * FROM {CHUNKS}), k AS (SELECT collection_id, source, count(DISTINCT chunk_id) AS n FROM c GROUP BY ALL), v AS (SELECT collection_id, source, count(DISTINCT chunk_id) AS n FROM c WHERE file_id IS NOT NULL GROUP BY ALL),
b AS (SELECT coalesce(k.collection_id, v.collection_id) AS collection_id, k.n AS kn, v.n AS vn FROM k FULL JOIN v ON k.collection_id = v.collection_id AND k.source = v.source),
s AS (SELECT collection_id, CAST(sum(coalesce(kn, 0)) AS BIGINT) AS keyword_chunks, CAST(sum(coalesce(vn, 0)) AS BIGINT) AS vector_chunks, count(*) FILTER (vn IS NULL) AS missing_in_vector, count(*) FILTER (kn IS NULL) AS missing_in_keyword FROM b GROUP BY collection_id)
SELECT *, missing_in_vector = 0 AND missing_in_keyword = 0 AND keyword_chunks = vector_chunks AS consistent FROM s"""
_DOUBLES = "CAST({0} AS DOUBLE[])"
SQL["vector_search"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM e a JOIN e b ON a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS vector_rank FROM d)
SELECT query_id, vector_rank, vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS vector_score FROM r WHERE vector_rank <= 10"""
SQL["deletable_files"] = f"SELECT file_id, original_name FROM {FILES} f WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM {REGISTRY} g WHERE g.file_id = f.file_id AND g.index_status = 'indexed')"
SQL["case_spread"] = f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source, chunk_index, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM {CHUNKS} WHERE length(trim(content)) >= 80 AND file_id IS NOT NULL)
SELECT file_id, chunk_id FROM c WHERE n <= 6 OR i IN (SELECT CAST(round_even(j * (n - 1) / 5.0, 0) AS INTEGER) FROM range(6) t(j))"""
SQL["boundary_scores"] = """
WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
w AS (SELECT label, vec_id, list(v) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS b, list(v) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM e),
m AS (SELECT label, vec_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(b, lambda x: x[i]))) AS b, list_transform(range(1, 65), lambda i: list_avg(list_transform(a, lambda x: x[i]))) AS a FROM w WHERE a IS NOT NULL AND len(a) > 0)
SELECT label, vec_id, round(greatest(0, least(1, list_cosine_similarity(b, a))), 6) AS score FROM m"""

# --- aggregates --------------------------------------------------------------------------------

SQL["inspect_counts"] = f"""
SELECT 'chunks' AS what, count(*) AS n FROM {CHUNKS} UNION ALL SELECT 'sources', count(*) FROM (SELECT DISTINCT source FROM chunks) UNION ALL SELECT 'files', count(*) FROM {FILES}
UNION ALL SELECT 'collections', count(*) FROM collections UNION ALL SELECT 'registry', count(*) FROM {REGISTRY}"""
SQL["indexed_chunk_sum"] = f"SELECT collection_id, CAST(coalesce(sum(indexed_chunk_count) FILTER (index_status = 'indexed'), 0) AS BIGINT) AS chunks FROM {REGISTRY} GROUP BY collection_id"
SQL["list_sources"] = "SELECT DISTINCT collection_id, source FROM chunks"
SQL["source_rows"] = f"SELECT source, file_id, collection_id, file_name, file_type FROM {PAGES} QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_number, page_doc_id) = 1"


def edge_key(line: str) -> str:
    # separators are doubled so that each number has its own on both sides; runs of them become one blank anyway
    doubled = f"regexp_replace(regexp_replace(regexp_replace(replace(lower({line}), 'ß', 'ss'), {q(ENGLISH_PAGE)}, ' page <num> ', 'g'), {q(CHINESE_PAGE)}, ' page <num> ', 'g'), {q(rf'([{SPACE}\-–—_/|:：])')}, '\\1\\1', 'g')"
    k = f"regexp_replace({doubled}, {q(rf'(^|[{SPACE}\-–—_/|:：])\p{{Nd}}{{1,4}}($|[{SPACE}\-–—_/|:：])')}, '\\1<num>\\2', 'g')"
    k = strip(f"regexp_replace({k}, {q(SEPARATORS)}, ' ', 'g')")
    return f"CASE WHEN {line} = '' OR {has(line, DECORATIVE)} THEN '' WHEN {has(line, MARKER)} THEN '<page-marker>' WHEN {words(k)} <= 1 AND NOT contains({k}, '<num>') THEN '' ELSE {k} END"


_EDGES = f"""
p AS (SELECT page_doc_id, source, list_filter(list_transform({lines("coalesce(content, '')")}, lambda x: {clean('x')}), lambda x: x <> '' AND length(x) <= 120) AS c FROM {PAGES} WHERE file_type = '.pdf' AND source IS NOT NULL AND page_number IS NOT NULL),
l AS (SELECT page_doc_id, source, 'top' AS side, unnest(c[1:3]) AS line FROM p UNION ALL SELECT page_doc_id, source, 'bottom', unnest(c[-3:]) FROM p),
k AS (SELECT DISTINCT page_doc_id, source, side, {edge_key('line')} AS key FROM l),
n AS (SELECT source, count(*) AS n FROM p GROUP BY source),
e AS (SELECT source, side, key, count(*) AS pages FROM k JOIN n USING (source) WHERE key <> '' GROUP BY source, side, key, n HAVING n >= 3 AND count(*) >= greatest(1, ceil(n * CAST(0.6 AS DOUBLE))))"""
SQL["pdf_edges"] = f"WITH {_EDGES} SELECT * FROM e"
SQL["bm25_stats"] = f"WITH {_TERMS} SELECT collection_id, count(*) AS n_chunks, round(avg(len(terms)), 6) AS avg_len FROM t1 GROUP BY collection_id"

_ASKED = f"(SELECT id AS query_id, query, collection_id, coalesce(top_k, 5) AS top_k FROM {CASES} WHERE CAST(right(id, 6) AS INTEGER) % 100 = 0)"
_CANDIDATES = f"""
{_TERMS},
asked AS (SELECT * FROM {_ASKED}),
{analysed('asked', 'query_id', 'query')},
ph AS (SELECT k AS query_id, len(req) AS n_req, unnest(req) AS token, true AS is_req FROM a3 UNION ALL SELECT k, len(req), unnest(opt), false FROM a3),
ph2 AS (SELECT ph.*, collection_id, list_filter(string_split(token, '_'), lambda x: x <> '') AS parts FROM ph JOIN asked USING (query_id)),
want AS (SELECT DISTINCT collection_id, token, parts FROM ph2),
wp AS (SELECT collection_id, token, len(parts) AS n, unnest(parts) AS term, unnest(range(len(parts))) AS part FROM want),
lined AS (SELECT w.collection_id, w.token, w.n, t.chunk_id, t.pos - w.part AS start, count(*) AS c, any_value(t.doc_len) AS doc_len FROM wp w JOIN t2 t ON t.collection_id = w.collection_id AND t.token = w.term GROUP BY ALL),
occ AS (SELECT collection_id, token, chunk_id, count(*) AS f, any_value(doc_len) AS doc_len FROM lined WHERE c = n GROUP BY collection_id, token, chunk_id),
df AS (SELECT collection_id, token, count(*) AS df FROM occ GROUP BY collection_id, token),
st AS (SELECT collection_id, count(*) AS n_chunks, sum(len(terms)) / count(*) AS avg_len FROM t1 GROUP BY collection_id),
wt AS (SELECT o.collection_id, o.token, o.chunk_id, -(CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_chunks - df + 0.5) / (df + 0.5)) ELSE CAST(0.000001 AS DOUBLE) END) * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * o.doc_len / avg_len)) AS w
  FROM occ o JOIN df USING (collection_id, token) JOIN st USING (collection_id)),
pc AS (SELECT query_id, chunk_id, count(*) FILTER (is_req) AS n, any_value(n_req) AS n_req, sum(w) FILTER (is_req) AS strict, sum(w) AS relaxed FROM ph2 JOIN wt USING (collection_id, token) GROUP BY query_id, chunk_id),
fl AS (SELECT *, n = n_req AND n_req > 0 AS is_strict, max(CAST(n = n_req AND n_req > 0 AS INTEGER)) OVER (PARTITION BY query_id) AS any_strict FROM pc),
cand AS (SELECT query_id, chunk_id, CASE WHEN any_strict = 1 THEN strict ELSE relaxed END AS raw_bm25 FROM fl WHERE is_strict OR any_strict = 0),
best AS (SELECT c.*, top_k, CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY round(raw_bm25, 9), chunk_id) AS INTEGER) AS bm25_rank FROM cand c JOIN asked USING (query_id) QUALIFY bm25_rank <= greatest(8 * top_k, 50))"""
SQL["bm25"] = f"""
WITH {_CANDIDATES} SELECT collection_id, token, df, round(CASE WHEN ln((n_chunks - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_chunks - df + 0.5) / (df + 0.5)) ELSE CAST(0.000001 AS DOUBLE) END, 6) AS idf FROM df JOIN st USING (collection_id)"""
SQL["keyword_candidates"] = f"WITH {_CANDIDATES} SELECT query_id, bm25_rank, chunk_id, round(raw_bm25, 6) AS raw_bm25 FROM best"


def matched(ts: str, of: str) -> str:
    alias = " ".join(f"WHEN {q(k)} THEN list_has_any({of}, [{', '.join(map(q, v))}])" for k, v in tokens.ALIASES.items())
    return f"list_filter({ts}, lambda t: list_contains({of}, t) OR CASE t {alias} ELSE false END)"


def bonus(content: str, req: str, opt: str) -> str:
    first = f"list_min(list_filter(list_transform({req}, lambda t: instr(lower({content}), t) - 1), lambda p: p >= 0))"
    return (
        f"CASE WHEN {first} IS NULL THEN 0.0 WHEN list_has_any({opt}, ['功能', '作用']) AND contains(substr(lower({content}), 1, 80), '功能说明') AND {first} <= 160 THEN 1.0 "
        f"WHEN contains(substr(lower({content}), 1, 160), '函数原型') AND {first} <= 160 THEN 0.6 ELSE 0.0 END"
    )


_LETTERED = r"len(list_filter(rm, lambda t: regexp_matches(t, '^[\x{0}-\x{7f}]+$') AND regexp_matches(t, '[A-Za-z]'))) > 0"
SQL["keyword_search"] = f"""
WITH {_CANDIDATES},
j AS (SELECT b.*, a3.req, a3.opt, c.content, {all_tokens('c.content')} AS toks FROM best b JOIN a3 ON a3.k = b.query_id JOIN {CHUNKS} c USING (chunk_id)),
e AS (SELECT *, {matched('req', 'toks')} AS rm, {matched('opt', 'toks')} AS om, {bonus('content', 'req', 'opt')} AS sb FROM j),
f AS (SELECT *, CASE WHEN len(req) = 0 THEN 0 ELSE CAST(len(rm) AS DOUBLE) / len(req) END AS rc, CASE WHEN len(opt) = 0 THEN 0 ELSE CAST(len(om) AS DOUBLE) / len(opt) END AS oc,
  CASE WHEN len(rm) = 0 THEN 0.0 WHEN {_LETTERED} THEN 1.0 ELSE 0.5 END AS xb,
  CASE WHEN min(raw_bm25) OVER w = max(raw_bm25) OVER w THEN 1.0 ELSE (max(raw_bm25) OVER w - raw_bm25) / (max(raw_bm25) OVER w - min(raw_bm25) OVER w) END AS bs FROM e WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, CAST(0.55 * rc + 0.20 * oc + 0.15 * xb + 0.05 * bs + 0.05 * sb AS DOUBLE) AS raw FROM f),
t AS (SELECT *, greatest(0, least(1, CASE WHEN len(req) > 0 AND rc = 0 THEN least(raw, 0.2) ELSE raw END)) AS keyword_score FROM s),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(keyword_score, 9) DESC, round(raw_bm25, 9), chunk_id) AS INTEGER) AS keyword_rank FROM t)
SELECT query_id, keyword_rank, chunk_id, round(CAST(keyword_score AS DOUBLE), 6) AS keyword_score, round(CAST(rc AS DOUBLE), 6) AS required_coverage, round(CAST(oc AS DOUBLE), 6) AS optional_coverage, CAST(xb AS DOUBLE) AS exact_bonus,
  round(CAST(bs AS DOUBLE), 6) AS bm25_signal, CAST(sb AS DOUBLE) AS structure_bonus, array_to_string(list_concat(rm, om), ' ') AS matched_tokens FROM u WHERE keyword_rank <= top_k"""
SQL["confidence"] = """
SELECT query_id, round(max(coalesce(score, 0)), 6) AS best_score, CASE WHEN max(coalesce(score, 0)) >= 0.75 THEN 'high' WHEN max(coalesce(score, 0)) >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM search_results GROUP BY query_id"""
SQL["context_judge"] = f"""
WITH r AS (SELECT r.query_id, r.score, c.content FROM {RESULTS} r JOIN {CHUNKS} c ON c.chunk_id = r.id WHERE {full('c.content')}),
s AS (SELECT query_id, max(coalesce(score, 0)) AS best, sum(length({strip('content')})) AS chars FROM r GROUP BY query_id),
w AS (SELECT q.query_id, CASE WHEN s.query_id IS NULL THEN 'no_results' WHEN best < 0.45 THEN 'best_score_below_min_score' WHEN chars < 80 THEN 'content_chars_below_min_chars' END AS fallback_reason
  FROM (SELECT DISTINCT query_id FROM search_results) q LEFT JOIN s USING (query_id))
SELECT query_id, fallback_reason IS NULL AS context_sufficient, fallback_reason FROM w"""
SQL["context_pack"] = f"""
WITH r AS (SELECT r.query_id, r.id, r.score, c.source, {strip('c.content')} AS body, coalesce({_PAGE} END, 'n/a') AS page FROM {RESULTS} r JOIN {CHUNKS} c ON c.chunk_id = r.id WHERE {full('c.content')}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) AS i FROM r),
h AS (SELECT *, '[' || i || '] [source: ' || {_SOURCE.format('source')} || ' | page: ' || page || ' | score: ' || {_SCORE.format('score')} || ']' AS header FROM o),
b AS (SELECT *, 4000 - coalesce(sum(length(header) + 1 + length(body) + 2) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM h),
k AS (SELECT *, CAST(room - length(header) - 1 AS BIGINT) AS budget FROM b WHERE room > 0),
s AS (SELECT query_id, i, header || chr(10) || CASE WHEN length(body) <= budget THEN body ELSE {rstrip('substr(body, 1, budget)')} END AS section FROM k WHERE length(body) <= budget OR budget > 0)
SELECT query_id, CAST(count(*) AS INTEGER) AS sections, CAST(length(string_agg(section, chr(10) || chr(10) ORDER BY i)) AS INTEGER) AS chars, sha256(string_agg(section, chr(10) || chr(10) ORDER BY i)) AS context_hash FROM s GROUP BY query_id"""
SQL["multi_query_search"] = f"""
WITH r AS (SELECT collection_id, query_id, id, rank, score, dense_rank() OVER (PARTITION BY collection_id ORDER BY query_id) AS query_no FROM {RESULTS}),
f AS (SELECT *, min(query_no * 1000000 + rank) OVER (PARTITION BY collection_id, id) AS seen FROM r),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY collection_id, id ORDER BY coalesce(score, -1) DESC, query_no, rank) = 1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY coalesce(score, 0) DESC, seen, id) AS INTEGER) AS place FROM b)
SELECT collection_id, place, id, round(score, 6) AS score, CAST(query_no AS INTEGER) AS query_no FROM p WHERE place <= 10"""
SQL["adaptive_cutoff"] = f"""
WITH b AS ({SQL['boundary_scores']}), s AS (SELECT label, list_sort(list(score)) AS s FROM b GROUP BY label)
SELECT label, round(CAST(CASE WHEN len(s) < 3 OR s[-1] - s[1] < 0.08 THEN 0.35 ELSE greatest(0.35, s[CAST(floor((len(s) - 1) * 0.25) AS INTEGER) + 1]) END AS DOUBLE), 6) AS cutoff FROM s"""
SQL["mean_vector"] = """
WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM e GROUP BY label, pos"""
SQL["cosine_score"] = """
SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
_NEXT = f"(SELECT chunk_id, content, lead(content) OVER (PARTITION BY source ORDER BY chunk_index, chunk_id) AS next FROM {CHUNKS})"
SQL["char_jaccard"] = f"""
WITH s AS (SELECT chunk_id, list_distinct(string_split(coalesce(content, ''), '')) AS a, list_distinct(string_split(next, '')) AS b, content, next FROM {_NEXT} WHERE next IS NOT NULL)
SELECT chunk_id, CASE WHEN content IS NULL THEN NULL WHEN length(content) = 0 OR length(next) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) END AS score FROM s"""

# --- evaluation --------------------------------------------------------------------------------

_SCORED = f"""
c AS (SELECT * FROM {CASES}), r AS (SELECT * FROM {RESULTS}),
fq AS (SELECT query, min(query_id) AS query_id FROM r GROUP BY query),
h AS (SELECT c.id, r.rank, r.source, r.file_id, k.content, r.keyword_matched_tokens AS toks, c.expected_sources AS es, c.expected_file_ids AS ef, c.expected_keywords AS ek
  FROM c LEFT JOIN (fq JOIN r USING (query_id) LEFT JOIN {CHUNKS} k ON k.chunk_id = r.id) ON fq.query = c.query),
m AS (SELECT id, any_value(es) AS es, any_value(ef) AS ef, any_value(ek) AS ek,
  min(rank) FILTER (coalesce(len(es), 0) > 0 AND coalesce(source, '') <> '' AND len(list_filter(es, lambda e: contains(lower(source), lower(e)) OR contains(lower(e), lower(source)))) > 0) AS sr,
  min(rank) FILTER (coalesce(len(ef), 0) > 0 AND list_contains(ef, file_id)) AS fr,
  min(rank) FILTER (coalesce(len(ek), 0) > 0 AND len(list_filter(ek, lambda x: contains(lower(coalesce(content, '')), lower(x)) OR list_contains(list_transform(coalesce(toks, []), lambda t: lower(t)), lower(x)))) = len(ek)) AS kr,
  coalesce(bool_or(len(toks) > 0), false) AS ev FROM h GROUP BY id),
z AS (SELECT id, CASE WHEN coalesce(len(es), 0) > 0 THEN sr IS NOT NULL END AS source_hit, CASE WHEN coalesce(len(ef), 0) > 0 THEN fr IS NOT NULL END AS file_hit, CASE WHEN coalesce(len(ek), 0) > 0 THEN kr IS NOT NULL END AS keyword_hit,
  least(sr, fr, kr) AS first_hit_rank, ev AS retrieval_evidence_present FROM m)"""
SQL["eval_score"] = f"WITH {_SCORED} SELECT id, source_hit, file_hit, keyword_hit, first_hit_rank, CAST(first_hit_rank IS NOT NULL AS DOUBLE) AS hit_at_k, round(coalesce(1.0 / first_hit_rank, 0), 6) AS mrr, retrieval_evidence_present FROM z"
SQL["eval_report"] = f"""
WITH {_SCORED} SELECT count(*) AS case_count, CAST(0 AS BIGINT) AS error_count, round(avg(CAST(first_hit_rank IS NOT NULL AS DOUBLE)), 6) AS recall_at_k, round(avg(coalesce(CAST(1 AS DOUBLE) / first_hit_rank, 0)), 6) AS mrr,
  round(avg(CAST(source_hit AS DOUBLE)), 6) AS source_hit_rate, round(avg(CAST(file_hit AS DOUBLE)), 6) AS file_hit_rate, round(avg(CAST(keyword_hit AS DOUBLE)), 6) AS keyword_hit_rate, round(avg(CAST(retrieval_evidence_present AS DOUBLE)), 6) AS retrieval_evidence_coverage FROM z"""
SQL["eval_evidence"] = f"SELECT query_id, id, rank, CAST(nullif(coalesce(len(keyword_matched_tokens), 0), 0) AS INTEGER) AS tokens FROM {RESULTS}"
SQL["eval_source_match"] = f"""
SELECT c.id, coalesce(k.source, '') <> '' AND coalesce(len(list_filter(c.expected_sources, lambda e: contains(lower(k.source), lower(e)) OR contains(lower(e), lower(k.source)))), 0) > 0 AS matches FROM {CASES} c JOIN {CHUNKS} k USING (chunk_id)"""
SQL["ranked_results"] = f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS INTEGER) AS place FROM {RESULTS}"
SQL["catalog_order"] = f"""
SELECT 'files' AS kind, file_id AS item, CAST(row_number() OVER (ORDER BY created_at, file_id) AS INTEGER) AS place FROM {FILES}
UNION ALL SELECT 'collections', collection_id, CAST(row_number() OVER (ORDER BY created_at, collection_id) AS INTEGER) FROM collections
UNION ALL SELECT 'registry', collection_id || '|' || file_id, CAST(row_number() OVER (ORDER BY collection_id, file_id) AS INTEGER) FROM {REGISTRY}"""
SQL["page_order"] = f"SELECT source, page_doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY page_number NULLS LAST, page_doc_id) AS INTEGER) AS place FROM {PAGES}"

# --- cleaning, sections, chunks ----------------------------------------------------------------


def dropped(c: str, pdf: str) -> str:
    return f"({has(c, DECORATIVE)} OR ({pdf} AND {has(c, MARKER)}) OR (length({c}) <= 4 AND {has(c, BARE_NUMBER)}))"


SQL["clean_lines"] = f"""
SELECT doc_id, array_to_string(list_filter({lines('text')}, lambda x: {clean('x')} = '' OR NOT {dropped(clean('x'), "file_type = '.pdf'")}), chr(10)) AS cleaned FROM documents"""
SQL["page_markers"] = f"""
WITH l AS (SELECT page_doc_id, unnest({lines('content')}) AS x, CAST(unnest(range(len({lines('content')}))) AS INTEGER) AS line_no FROM {PAGES}), c AS (SELECT page_doc_id, line_no, {clean('x')} AS line FROM l)
SELECT page_doc_id, line_no, line FROM c WHERE line <> '' AND {dropped('line', 'true')}"""
SQL["edge_keys"] = f"""
WITH p AS (SELECT page_doc_id, list_filter(list_transform({lines('content')}, lambda x: {clean('x')}), lambda x: x <> '') AS f FROM {PAGES}), e AS (SELECT page_doc_id, f[1] AS a, f[-1] AS b FROM p WHERE len(f) > 0)
SELECT page_doc_id, {edge_key('a')} AS top, {edge_key('b')} AS bottom FROM e"""
SQL["pdf_clean"] = f"""
WITH {_EDGES},
x0 AS (SELECT page_doc_id, source, file_type, content, unnest({lines('content')}) AS raw, unnest(range(len({lines('content')}))) AS i FROM {PAGES} WHERE content IS NOT NULL),
x1 AS (SELECT *, {clean('raw')} AS c FROM x0),
x2 AS (SELECT *, count(*) FILTER (c <> '') OVER (PARTITION BY page_doc_id ORDER BY i) AS up, count(*) FILTER (c <> '') OVER (PARTITION BY page_doc_id) AS total FROM x1),
x3 AS (SELECT x2.*, {edge_key('c')} AS key FROM x2),
x4 AS (SELECT *, c <> '' AND ({dropped('c', "coalesce(file_type = '.pdf', false)")} OR (coalesce(file_type = '.pdf', false) AND
   ((up <= 3 AND EXISTS (SELECT 1 FROM e WHERE e.source = x3.source AND e.side = 'top' AND e.key = x3.key)) OR (up > total - 3 AND EXISTS (SELECT 1 FROM e WHERE e.source = x3.source AND e.side = 'bottom' AND e.key = x3.key))))) AS gone FROM x3),
x5 AS (SELECT page_doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS cleaned FROM x4 GROUP BY page_doc_id)
SELECT p.page_doc_id, CASE WHEN p.content IS NULL THEN NULL ELSE coalesce(x5.cleaned, '') END AS cleaned FROM {PAGES} p LEFT JOIN x5 USING (page_doc_id)"""

_HEADING = rf"(?im)(^{S}*(?:(?:问题|问|题){S}*[:：.\-、]?{S}*{NUMBER}|第{S}*{NUMBER}{S}*(?:题|问|小题)|Q(?:uestion)?{S}*[:：.\-、]?{S}*\p{{Nd}}+))([{SPACE}]|[、，,.:：。)\]】）-]|\z)"
_SECTIONS = f"""
s0 AS (SELECT doc_id, file_type, {unix("replace(text, chr(1), '')")} AS c FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, file_type, string_split(regexp_replace(c, {q(_HEADING)}, chr(1) || '\\1\\2', 'g'), chr(1)) AS parts FROM s0),
s2 AS (SELECT doc_id, file_type, len(parts) AS n, unnest(parts) AS text, unnest(range(len(parts))) AS i FROM s1),
s3 AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM s2),
s4 AS (SELECT doc_id, file_type, text, CAST(start_char AS INTEGER) AS start_char, CAST(start_char + length(text) AS INTEGER) AS end_char,
  CASE WHEN i > 0 THEN regexp_replace(regexp_extract(text, {q(_HEADING)}, 1), {q(rf'[{SPACE}:：.\-、，,。)\]】）]+')}, '', 'g') END AS hard_break_key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section_no
  FROM s3 WHERE length(text) > 0 OR n = 1)"""
SQL["hard_breaks"] = f"WITH {_SECTIONS} SELECT doc_id, section_no, start_char, end_char, hard_break_key FROM s4"
_PDF_JOIN = f"""CASE WHEN len(ls) = 0 THEN '' ELSE list_reduce(ls, lambda a, x: CASE WHEN right(a, 1) = '-' AND regexp_matches(x[1:1], '\\p{{Ll}}') THEN left(a, length(a) - 1) || x
  WHEN regexp_matches(right(a, 1), '[{HAN}]') AND regexp_matches(x[1:1], '[{HAN}]') THEN a || x ELSE a || ' ' || x END) END"""
_BLOCKS = f"""
{_SECTIONS},
b0 AS (SELECT doc_id, file_type, section_no, start_char, string_split_regex(text, {q(BLANK)}) AS parts, regexp_extract_all(text, {q(BLANK)}) AS gaps FROM s4),
b1 AS (SELECT doc_id, file_type, section_no, start_char, unnest(parts) AS p, unnest(list_concat(gaps, [''])) AS g, unnest(range(len(parts))) AS i FROM b0),
b2 AS (SELECT *, start_char + coalesce(sum(length(p) + length(g)) OVER (PARTITION BY doc_id, section_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  list_filter(list_transform(string_split(p, chr(10)), lambda x: {clean('x')}), lambda x: x <> '') AS ls FROM b1),
b3 AS (SELECT doc_id, section_no, i, CASE WHEN coalesce(file_type = '.pdf', false) THEN {_PDF_JOIN} ELSE array_to_string(ls, chr(10)) END AS content,
  CAST(off + length(p) - length({lstrip('p')}) AS INTEGER) AS start_char, CAST(off + length({rstrip('p')}) AS INTEGER) AS end_char FROM b2),
b4 AS (SELECT doc_id, section_no, CAST(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i) - 1 AS INTEGER) AS block_no, {strip('content')} AS content, start_char, end_char, CAST({words('content')} AS INTEGER) AS words FROM b3 WHERE content <> '')"""
SQL["blocks"] = f"WITH {_BLOCKS} SELECT doc_id, section_no, block_no, start_char, end_char FROM b4"
SQL["block_clean"] = f"WITH {_BLOCKS} SELECT doc_id, section_no, block_no, content, words FROM b4"
SQL["merge_blocks"] = f"""
WITH RECURSIVE {_BLOCKS},
m0 AS (SELECT doc_id, section_no, list({{'s': start_char, 'e': end_char, 'w': words}} ORDER BY block_no) AS bs FROM b4 GROUP BY doc_id, section_no),
m1 AS (
  SELECT doc_id, section_no, bs, 1 AS i, bs[1:0] AS done FROM m0
  UNION ALL
  SELECT doc_id, section_no, bs,
    CASE WHEN bs[i].w < 120 AND i < len(bs) AND bs[i].w + bs[i + 1].w <= 800 THEN i + 2 ELSE i + 1 END,
    CASE WHEN len(bs) = 1 OR bs[i].w >= 120 THEN list_append(done, bs[i])
      WHEN i < len(bs) AND bs[i].w + bs[i + 1].w <= 800 THEN list_append(done, {{'s': bs[i].s, 'e': bs[i + 1].e, 'w': bs[i].w + bs[i + 1].w}})
      WHEN len(done) > 0 AND done[-1].w + bs[i].w <= 800 THEN list_append(done[1:len(done) - 1], {{'s': done[-1].s, 'e': bs[i].e, 'w': done[-1].w + bs[i].w}})
      ELSE list_append(done, bs[i]) END
  FROM m1 WHERE i <= len(bs)),
m2 AS (SELECT doc_id, section_no, unnest(done) AS b, unnest(range(len(done))) AS block_no FROM m1 WHERE i > len(bs))
SELECT doc_id, section_no, CAST(block_no AS INTEGER) AS block_no, b.s AS start_char, b.e AS end_char, b.w AS words FROM m2"""
SQL["word_count"] = f"""
SELECT 'documents' AS item_table, CAST(doc_id AS VARCHAR) AS item_key, CAST({words('text')} AS INTEGER) AS words FROM documents UNION ALL SELECT 'chunks', chunk_id, CAST({words('content')} AS INTEGER) FROM {CHUNKS}"""


def _windows(rows: str, text: str, size: int, overlap: int) -> str:
    """CTEs w0 to w3 on rows with a key k: each window's number i, start s and end e."""
    step = size - overlap
    return f"""
w0 AS (SELECT k, {text} AS t, string_split({text}, '') AS cs FROM {rows} WHERE length({text}) > 0),
w1 AS (SELECT k, t, len(cs) AS total, list_filter(list_transform(cs, lambda c, i: CASE WHEN regexp_matches(c, '[{WORD}]') THEN i - 1 END), lambda p: p IS NOT NULL) AS w FROM w0),
w2 AS (SELECT *, unnest(range(CASE WHEN len(w) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT) END)) AS i FROM w1),
w3 AS (SELECT k, t, i, CASE WHEN i = 0 THEN 0 ELSE w[i * {step} + 1] END AS s, CASE WHEN i * {step} + {size} < len(w) THEN w[i * {step} + {size} + 1] ELSE total END AS e FROM w2)"""


SQL["char_chunks"] = f"""
WITH d AS (SELECT doc_id AS k, text FROM documents), {_windows('d', 'text', 800, 120)},
x AS (SELECT k AS doc_id, i, CAST(s AS INTEGER) AS start_char, CAST(e AS INTEGER) AS end_char, substr(t, s + 1, e - s) AS content FROM w3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_index, start_char, end_char, content FROM x WHERE {full('content')}"""
SQL["units"] = f"""
WITH {_BLOCKS},
big AS (SELECT {{'d': doc_id, 's': section_no, 'b': block_no, 'off': start_char}} AS k, content FROM b4 WHERE words > 800), {_windows('big', 'content', 800, 0)},
x AS (SELECT k.d AS doc_id, k.s AS section_no, k.b AS block_index, i, k.off + s AS off, substr(t, s + 1, e - s) AS p FROM w3),
y AS (SELECT doc_id, section_no, block_index, i, off + length(p) - length({lstrip('p')}) AS start_char, off + length({rstrip('p')}) AS end_char, {words('p')} AS words FROM x WHERE {full('p')}
  UNION ALL SELECT doc_id, section_no, block_no, 0, start_char, end_char, words FROM b4 WHERE words <= 800)
SELECT doc_id, section_no, CAST(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY block_index, i) - 1 AS INTEGER) AS unit_no, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, CAST(block_index AS INTEGER) AS block_index, CAST(words AS INTEGER) AS words FROM y"""

# --- tokens and queries ------------------------------------------------------------------------

SQL["tokenize"] = f"WITH t AS (SELECT chunk_id, {all_tokens('content')} AS l FROM {CHUNKS}) SELECT chunk_id, coalesce(array_to_string({dedupe('l')}, ' '), '') AS tokens FROM t"
SQL["special_tokens"] = f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS item, array_to_string({special('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL UNION ALL SELECT id, array_to_string({special('query')}, ' ') FROM {CASES} WHERE query IS NOT NULL)
SELECT item, tokens FROM t WHERE tokens <> ''"""
SQL["version_tokens"] = f"""
WITH t AS (SELECT chunk_id, unnest(list_filter({special('content')}, lambda x: contains(x, '_'))) AS token FROM {CHUNKS}) SELECT token, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM t GROUP BY token"""
SQL["keyword_text"] = f"SELECT chunk_id, array_to_string({all_tokens('content')}, ' ') AS keyword_text FROM {CHUNKS} WHERE content IS NOT NULL"
SQL["analyze_query"] = f"WITH {analysed(CASES, 'id', 'query')} SELECT k AS id, array_to_string(req, ' ') AS required, array_to_string(opt, ' ') AS optional, array_to_string(ign, ' ') AS ignored FROM a3"
SQL["token_class"] = f"""
WITH {analysed(CASES, 'id', 'query')}, u AS (SELECT unnest(t) AS token FROM a3)
SELECT token, count(*) AS n, CASE WHEN {is_required('token')} THEN 'required' WHEN {is_ignored('token')} THEN 'ignored' ELSE 'optional' END AS class FROM u GROUP BY token"""
SQL["match_evidence"] = f"""
WITH {analysed('(SELECT DISTINCT ON (query_id) query_id, query FROM search_results)', 'query_id', 'query')},
j AS (SELECT r.query_id, r.id, a3.req, a3.opt, {all_tokens("coalesce(c.content, '')")} AS toks FROM {RESULTS} r JOIN a3 ON a3.k = r.query_id JOIN {CHUNKS} c ON c.chunk_id = r.id),
e AS (SELECT *, {matched('req', 'toks')} AS rm, {matched('opt', 'toks')} AS om FROM j)
SELECT query_id, id, array_to_string(list_concat(rm, om), ' ') AS matched, CASE WHEN len(req) = 0 THEN 0.0 ELSE round(CAST(len(rm) AS DOUBLE) / len(req), 6) END AS required_coverage,
  CASE WHEN len(opt) = 0 THEN 0.0 ELSE round(CAST(len(om) AS DOUBLE) / len(opt), 6) END AS optional_coverage, CAST(CASE WHEN len(rm) = 0 THEN 0.0 WHEN {_LETTERED} THEN 1.0 ELSE 0.5 END AS DOUBLE) AS exact_bonus FROM e"""
SQL["structure_bonus"] = f"""
WITH {analysed("(SELECT DISTINCT ON (query_id) query_id, query || '的功能' AS query FROM search_results)", 'query_id', 'query')},
j AS (SELECT r.query_id, r.id, a3.req, a3.opt, CASE WHEN c.chunk_index % 2 = 0 THEN '功能说明' ELSE '函数原型' END || chr(10) || coalesce(c.content, '') AS content FROM {RESULTS} r JOIN a3 ON a3.k = r.query_id JOIN {CHUNKS} c ON c.chunk_id = r.id)
SELECT query_id, id, CAST({bonus('content', 'req', 'opt')} AS DOUBLE) AS bonus FROM j"""


def clean_query(c: str) -> str:
    mark = f"regexp_replace({strip(c)}, {q(r'^(?:[-*]|\p{Nd}+[.)、])[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]*')}, '')"
    return f"regexp_replace({mark}, {q('^[\"' + chr(39) + '“”‘’` ]+|[\"' + chr(39) + '“”‘’` ]+$')}, '', 'g')"


SQL["dedupe_queries"] = f"""
WITH c AS (SELECT collection_id, answer_id, {clean_query('query')} AS query FROM {ANSWERS}), f AS (SELECT * FROM c WHERE query <> '' QUALIFY row_number() OVER (PARTITION BY collection_id, lower(query) ORDER BY answer_id) = 1)
SELECT collection_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY answer_id) AS INTEGER) AS query_no, query FROM f"""
SQL["clean_query"] = f"WITH a AS (SELECT answer_id, '1. “' || rewritten_query || '”' AS x FROM {ANSWERS} WHERE rewritten_query IS NOT NULL) SELECT answer_id, {clean_query('x')} AS query FROM a"
_UNSUPPORTED = " OR ".join(f"contains(lower({strip('answer')}), {q(p)})" for p in answer.UNSUPPORTED)
SQL["unsupported_answer"] = f"""
WITH a AS (SELECT answer_id, coalesce(context_sufficient, false) AS ok, coalesce(fallback_reason, 'no_results') AS reason, answer, coalesce({_UNSUPPORTED}, false) AS unsupported FROM {ANSWERS}),
b AS (SELECT *, CASE WHEN NOT ok THEN reason WHEN answer IS NULL THEN 'generation_failed' WHEN unsupported THEN 'answer_not_supported' END AS fallback_reason, CASE WHEN NOT ok OR answer IS NULL OR NOT {full('answer')} THEN {q(answer.FALLBACK)} ELSE answer END AS shown FROM a)
SELECT answer_id, fallback_reason, fallback_reason IS NULL AS show_sources, sha256(shown) AS answer_hash FROM b"""

# --- catalog -----------------------------------------------------------------------------------

SQL["file_dedupe"] = """
WITH d AS (SELECT 'sha256_' || sha256(text) AS file_id, file_name, loaded_at, strlen(text) AS size FROM documents WHERE text IS NOT NULL)
SELECT file_id, arg_min(file_name, (loaded_at, file_name)) AS original_name, max(size) AS size_bytes, count(*) AS imports, min(loaded_at) AS created_at FROM d GROUP BY file_id"""
SQL["registry_state"] = f"SELECT * FROM {REGISTRY}"
SQL["registry_upsert"] = f"""
SELECT file_id, collection_id, CASE WHEN index_status = 'failed' THEN 'indexing' ELSE index_status END AS index_status, CASE WHEN index_status = 'failed' THEN 0 ELSE indexed_chunk_count END AS indexed_chunk_count,
  CASE WHEN index_status = 'failed' THEN NULL ELSE last_error END AS last_error FROM {REGISTRY}"""
_JOB = "'job_' || substr(sha256(file_id || '|' || collection_id), 1, 12) AS job_id"
SQL["active_jobs"] = f"SELECT {_JOB}, file_id, collection_id FROM {REGISTRY} WHERE index_status = 'indexing'"
SQL["interrupted_jobs"] = f"""
SELECT {_JOB}, CASE WHEN index_status IN ('failed', 'indexing') THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN index_status = 'indexing' THEN 'Interrupted by a restart before it ended.' ELSE last_error END AS last_error FROM {REGISTRY}"""
