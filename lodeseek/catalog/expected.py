"""The registered queries once more, as SQL over the same tables."""

from __future__ import annotations

from lodeseek.catalog import queries as q
from lodeseek.functions.tokens import STOPWORDS
from lodeseek.operators import rank as r
from lodeseek.operators.chunk import MAX_CHUNK_CHARS
from lodeseek.sources.tables import KINDS, LANGS, SOURCES

NL = "chr(10)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _lines(text: str) -> str:
    return f"string_split(regexp_replace({text}, '\\n\\z', ''), {NL})"


DOC_PATH = "'src/' || source || '/' || doc_id || '.md'"
DOCS = f"docs AS (SELECT doc_id, {DOC_PATH} AS path, text FROM documents)"
TEXTS = f"t AS (SELECT {DOC_PATH} AS path, doc_id::VARCHAR AS stem, text FROM documents)"
INCOMING = f"""incoming AS (
    SELECT {DOC_PATH} AS path, doc_id::VARCHAR AS symbol, source,
           CASE WHEN toxic = 1 THEN text || {NL} || 'reviewed' ELSE text END AS content
    FROM documents JOIN labels USING (doc_id))"""
STORED = f"""stored AS (
    SELECT {DOC_PATH} AS path, doc_id::VARCHAR AS symbol, text AS content FROM documents)"""
ROW_ID = "left(sha256(path || '::' || symbol || '::1'), 32)"


# -- vectors --------------------------------------------------------------------

VECTORS = f"""v AS (
    SELECT vec_id AS id, label, 'lib' || label || '/v' || vec_id AS path,
           {_list(LANGS)}[label % {len(LANGS)} + 1] AS lang,
           {_list(KINDS)}[label % {len(KINDS)} + 1] AS kind,
           coalesce(CASE WHEN label < 3 THEN 'test_' || replace(p_name, ' ', '_')
                WHEN label < 7 THEN replace(p_name, ' ', '_')
                ELSE list_aggregate(list_transform(string_split(p_name, ' '),
                       lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', '')
                END, 'anon') AS symbol,
           embedding::DOUBLE[] AS vec
    FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
d AS (
    SELECT v.* EXCLUDE (vec),
           list_distance(vec, (SELECT vec FROM v WHERE id = {q.QUERY_VECTOR})) ** 2 AS distance
    FROM v)"""


def _query_tokens(text: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), "
        f"lambda w: NOT list_contains({_list(STOPWORDS)}, w))"
    )


def _symbol_tokens(symbol: str) -> str:
    return (
        f"list_distinct(list_concat(regexp_extract_all(lower({symbol}), '[a-z0-9]+'), "
        f"list_transform(regexp_extract_all({symbol}, '[A-Z]+(?:[a-z0-9]+)?|[a-z0-9]+'), "
        "lambda w: lower(w))))"
    )


def _rerank(tokens: str) -> str:
    overlap = f"len(list_intersect({tokens}, {_symbol_tokens('symbol')}))"
    coverage = f"{overlap}::DOUBLE / len({_symbol_tokens('symbol')})"
    head = "string_split(symbol, ':part')[1]"
    return f"""distance
        * CASE WHEN kind IN ('function', 'method') THEN {r.FUNCTION_FACTOR} ELSE 1 END::DOUBLE
        * CASE WHEN kind IN ('function', 'method')
               AND (starts_with({head}, 'test_') OR starts_with({head}, 'Test'))
               THEN {r.TEST_NAME_FACTOR} ELSE 1 END::DOUBLE
        * CASE WHEN {overlap} >= 2 THEN {r.OVERLAP_STRONG_FACTOR}
               WHEN {overlap} = 1 THEN {r.OVERLAP_WEAK_FACTOR} ELSE 1 END::DOUBLE
        * CASE WHEN {overlap} = 0 THEN 1
               WHEN {coverage} >= 0.9 THEN {r.COVERAGE_FULL_FACTOR}
               WHEN {coverage} >= 0.5 THEN {r.COVERAGE_HALF_FACTOR} ELSE 1 END::DOUBLE"""


QUERY_TOKENS = _query_tokens(f"'{q.QUERY_TEXT}'")


# -- chunking ---------------------------------------------------------------------


def _markdown_pieces(source: str = "t") -> str:
    """CTEs from (path, stem, text) to `p`: (path, symbol, kind, start_line, content)."""
    return f"""
l AS (SELECT path, stem, unnest({_lines('text')}) AS line,
             generate_subscripts({_lines('text')}, 1) AS i
      FROM {source} WHERE regexp_matches(text, '\\S')),
f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY i) AS fences FROM f),
h AS (SELECT *, NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^\\s*##? ') AS head
      FROM g),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY i) AS section FROM h),
a AS (SELECT path, section, any_value(stem) AS stem, min(i) AS start_line, max(i) AS end_line,
             string_agg(line, {NL} ORDER BY i) AS content, bool_or(head) AS headed,
             count(*) FILTER (regexp_matches(line, '\\S')) AS filled,
             arg_min(line, i) AS title
      FROM s GROUP BY path, section),
kept AS (SELECT path, start_line, end_line, content, 'section' AS kind,
                CASE WHEN NOT headed THEN stem
                     ELSE coalesce(nullif(trim(regexp_replace(trim(title), '^#+', '')), ''),
                                   'section-' || start_line) END AS symbol
         FROM a WHERE filled > 0 AND NOT (headed AND filled = 1)),
whole AS (SELECT path, 1 AS start_line, len({_lines('text')}) AS end_line,
                 array_to_string({_lines('text')}, {NL}) AS content,
                 'module' AS kind, regexp_extract(path, '[^/]*$') AS symbol
          FROM {source}
          WHERE regexp_matches(text, '\\S') AND path NOT IN (SELECT path FROM kept)),
p AS (SELECT path, symbol, kind, start_line, end_line, content FROM kept
      UNION ALL BY NAME SELECT path, symbol, kind, start_line, end_line, content FROM whole)"""


def _packed(cap: int, source: str = "p", out: str = "c") -> str:
    """CTEs from pieces to `c`: (path, symbol, kind, start_line, end_line, content)."""
    return f"""
big AS (SELECT *, string_split(content, {NL}) AS ls FROM {source} WHERE length(content) > {cap}),
lens AS (SELECT *, flatten([[
             {{'line': substr(ls[i], k * {cap} + 1, {cap}), 'i': i,
               'ended': k = greatest(1, (length(ls[i]) + {cap} - 1) // {cap}) - 1 AND i < len(ls)}}
             FOR k IN range(greatest(1, (length(ls[i]) + {cap} - 1) // {cap}))]
             FOR i IN range(1, len(ls) + 1)]) AS us
         FROM big),
fold AS (SELECT *, list_reduce(
            list_prepend({{'n': {cap} + 1, 'p': 0, 'ids': []::BIGINT[]}},
                list_transform(us, lambda x: {{'n': length(x.line)::INT + x.ended::INT, 'p': 0,
                                               'ids': []::BIGINT[]}})),
            lambda acc, x: CASE WHEN acc.n + x.n > {cap}
                THEN {{'n': x.n, 'p': acc.p + 1, 'ids': list_append(acc.ids, acc.p + 1)}}
                ELSE {{'n': acc.n + x.n, 'p': acc.p,
                       'ids': list_append(acc.ids, acc.p)}} END).ids AS ids
         FROM lens),
un AS (SELECT path, symbol, kind, start_line AS first, unnest(us) AS u, unnest(ids) AS part,
              generate_subscripts(us, 1) AS seq FROM fold),
parts AS (SELECT path, symbol || ':part' || part AS symbol, kind,
                 first + min(u.i) - 1 AS start_line, first + max(u.i) - 1 AS end_line,
                 rtrim(string_agg(u.line || CASE WHEN u.ended THEN {NL} ELSE '' END, ''
                                  ORDER BY seq), {NL}) AS content
          FROM un GROUP BY path, symbol, kind, first, part),
{out} AS (SELECT path, symbol, kind, start_line, end_line, content FROM parts
      UNION ALL BY NAME
      SELECT path, symbol, kind, start_line, end_line, content FROM {source}
      WHERE length(content) <= {cap})"""


CHUNK_OUT = """SELECT path, 'markdown' AS lang, symbol, kind, start_line::INT AS start_line,
       end_line::INT AS end_line, content, sha256(content) AS content_hash FROM c"""


def _markdown_chunks(texts: str) -> str:
    return f"WITH {texts}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)} {CHUNK_OUT}"


TURN_PATH = "'chats/' || conv_id || '/' || turn || '.md'"
TURN_MARKDOWN = f"""t AS (SELECT {TURN_PATH} AS path, turn::VARCHAR AS stem,
    {NL} || 'by a user' || {NL} || '# ' || role || {NL} || '## Empty' || {NL} || {NL} || '## Said'
    || {NL} || replace(text, {NL}, {NL} || '## Next' || {NL}) AS text FROM conversations)"""
TURN_FENCED = f"""t AS (SELECT {TURN_PATH} AS path, turn::VARCHAR AS stem,
    '# Log' || {NL} || '```sh' || {NL} || replace(text, {NL}, {NL} || '# not a heading' || {NL})
    || {NL} || '~~~' || {NL} || '## After' || {NL} || role || {NL} || '  ```' || {NL} || '# x'
    AS text FROM conversations)"""

PY_LINES = f"""docs AS (
    SELECT 'src/' || source || '/' || doc_id || '.py' AS path, doc_id, n_chars,
           {_lines('text')} AS ls FROM documents),
fs AS (SELECT path, generate_subscripts(ls, 1) - 1 AS i, length(unnest(ls)) AS n FROM docs)"""


def _brace_each() -> str:
    branches = []
    for i, (_, each, _last) in enumerate(SOURCES.values()):
        sql = each.strip().replace("%1$d", "' || i || '").replace("%2$d", "' || n || '")
        branches.append(f"WHEN {i} THEN '{sql}'")
    return "CASE nth " + " ".join(branches) + " END"


# -- hashed embeddings ----------------------------------------------------------------


def _hashed(source: str, key: str, text: str, name: str) -> str:
    """CTEs from (key, text) to `name`: (key, slot, x), the non-zero vector entries."""
    dim = q.HASHED.dim
    return f"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w
             FROM {source}),
{name}_n AS (SELECT {key}, w, md5(w) AS h, count(*) AS n FROM {name}_w GROUP BY {key}, w),
{name}_s AS (SELECT {key}, (('0x' || left(h, 8))::UBIGINT % {dim})::INT AS slot,
                    sum(n)::DOUBLE AS x
             FROM {name}_n GROUP BY {key}, slot),
{name} AS (SELECT {key}, slot,
                  (x / sqrt(sum(x * x) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x
           FROM {name}_s)"""


SEMANTIC = f"""WITH {TEXTS}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)},
ci AS (SELECT *, left(sha256(path || '::' || symbol || '::' || start_line), 32) AS id FROM c),
{_hashed('ci', 'id', 'content', 'e')},
{_hashed('benchmark', 'item_id', 'text', 'b')},
en AS (SELECT id, sum(x * x) AS xx FROM e GROUP BY id),
bn AS (SELECT item_id, sum(x * x) AS xx FROM b GROUP BY item_id),
dots AS (SELECT item_id, id, sum(e.x * b.x) AS xy FROM e JOIN b USING (slot) GROUP BY ALL),
dist AS (SELECT bn.item_id, en.id, bn.xx + en.xx - 2 * coalesce(xy, 0) AS distance
         FROM bn CROSS JOIN en LEFT JOIN dots USING (item_id, id)),
near AS (SELECT * FROM dist
         QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(distance, 9), id) <= 15),
hits AS (SELECT item_id, id, path, symbol, kind, start_line, distance,
                {_query_tokens('text')} AS tokens
         FROM near JOIN ci USING (id) JOIN benchmark USING (item_id)),
scored AS (SELECT *, {_rerank('tokens')} AS score FROM hits)
SELECT item_id AS query_id, path, symbol, start_line::INT AS start_line,
       round(distance, 6) AS score, round(score, 6) AS rerank_score,
       row_number() OVER (PARTITION BY item_id
                          ORDER BY round(score, 9), round(distance, 9), id)::INT AS rank
FROM scored QUALIFY rank <= 5"""


STORED_SEARCH = f"""WITH {TEXTS}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)},
ci AS (SELECT *, left(sha256(path || '::' || symbol || '::' || start_line), 32) AS id FROM c
       WHERE starts_with(path, 'src/src1')),
qs AS (SELECT 0 AS item_id, '{q.QUERY_TEXT}' AS text),
{_hashed('ci', 'id', 'content', 'e')},
{_hashed('qs', 'item_id', 'text', 'b')},
en AS (SELECT id, sum(x * x) AS xx FROM e GROUP BY id),
dots AS (SELECT id, sum(e.x * b.x) AS xy FROM e JOIN b USING (slot) GROUP BY id),
bn AS (SELECT sum(x * x) AS bb FROM b),
dist AS (SELECT id, xx + bb - 2 * coalesce(xy, 0) AS distance
         FROM en CROSS JOIN bn LEFT JOIN dots USING (id)),
near AS (SELECT * FROM dist ORDER BY round(distance, 9), id LIMIT 30),
scored AS (SELECT *, {_rerank(QUERY_TOKENS)} AS total FROM near JOIN ci USING (id))
SELECT path, symbol, kind, 'markdown' AS lang, start_line::INT AS start_line,
       end_line::INT AS end_line, content, round(distance, 6) AS score,
       round(total, 6) AS rerank_score
FROM scored ORDER BY round(total, 9), round(distance, 9), id LIMIT 10"""


# -- line search ------------------------------------------------------------------------

LINE_HITS = f"""{DOCS},
ls AS (SELECT path, unnest({_lines('text')}) AS snippet,
              generate_subscripts({_lines('text')}, 1)::INT AS line FROM docs),
hits AS (SELECT path, line, snippet FROM ls WHERE regexp_matches(snippet, '{q.WORD_PATTERN}'))"""
PAGE_PATH = "page_id || '/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g')"


# -- changes -----------------------------------------------------------------------------

EVENTS = """ev AS (
    SELECT CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted'
                ELSE 'modified' END AS change,
           'src/u' || user_id || '.py' AS path, ts, event_id AS seq FROM events)"""
LATEST = f"WITH {EVENTS} SELECT path, arg_max(change, (ts, seq)) AS change FROM ev GROUP BY path"



# A chunk without a word gets no vector and no row.
HAS_WORDS = "regexp_matches(lower(content), '[a-z0-9]')"

CHUNK_ID = "left(sha256(path || '::' || symbol || '::' || start_line), 32)"

def _second_run(select: str) -> str:
    """A query over `c`: the chunks of the labelled documents, first run in `before`."""
    again = f"t AS (SELECT path, symbol AS stem, content AS text FROM incoming), " + (
        f"{_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)}"
    )
    return f"""WITH {INCOMING}, {TEXTS},
first_run AS (WITH {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)}
              SELECT *, sha256(content) AS content_hash FROM c WHERE {HAS_WORDS}),
second_run AS (WITH {again} SELECT *, sha256(content) AS content_hash FROM c),
same AS (SELECT * FROM second_run SEMI JOIN first_run
         USING (path, symbol, start_line, content_hash))
{select}"""


EXPECTED: dict[str, str] = {
    "knn_l2_topk": f"""WITH {VECTORS}
SELECT id, symbol, round(distance, 6) AS distance FROM d ORDER BY d.distance, id LIMIT 10""",
    "knn_filtered": f"""WITH {VECTORS}
SELECT id, path, lang, round(distance, 6) AS distance FROM d
WHERE lang = 'typescript' AND starts_with(path, 'lib3/') ORDER BY d.distance, id LIMIT 10""",
    "knn_batch": f"""WITH {VECTORS},
qs AS (SELECT id AS query_id, vec AS qv FROM v WHERE id % 20 = 0),
nd AS (SELECT query_id, id, list_distance(vec, qv) ** 2 AS x FROM v CROSS JOIN qs)
SELECT query_id, id, round(x, 6) AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY x, id)::INT AS rank
FROM nd QUALIFY rank <= 10""",
    "knn_all": f"""WITH {VECTORS},
nd AS (SELECT q.id AS query_id, v.id, list_distance(v.vec, q.vec) ** 2 AS x FROM v CROSS JOIN v AS q)
SELECT query_id, id, round(x, 6) AS distance,
       row_number() OVER (PARTITION BY query_id ORDER BY x, id)::INT AS rank
FROM nd QUALIFY rank <= 3""",
    "rerank_hits": f"""WITH {VECTORS},
near AS (SELECT * FROM d ORDER BY distance, id LIMIT 60),
scored AS (SELECT *, {_rerank(QUERY_TOKENS)} AS score FROM near)
SELECT id, symbol, kind, round(distance, 6) AS distance, round(score, 6) AS rerank_score
FROM scored ORDER BY score, scored.distance, id LIMIT 20""",
    "rerank_all": f"""WITH {VECTORS}
SELECT id, round({_rerank(QUERY_TOKENS)}, 6) AS rerank_score FROM d""",
    "semantic_search": SEMANTIC,
    "stored_search": STORED_SEARCH,
    "stored_search_each": SEMANTIC,
    "symbol_token_sets": f"""WITH s AS (
    SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '),
        lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', '')
        || '_' || p_type || ':part1' AS symbol FROM part)
SELECT p_partkey, unnest({_symbol_tokens('symbol')}) AS token FROM s""",
    "query_token_sets": f"""
SELECT doc_id, unnest({_query_tokens('text')}) AS token FROM documents""",
    "lexical_top": f"WITH {LINE_HITS} SELECT * FROM hits ORDER BY path, line LIMIT 50",
    "lexical_all": f"WITH {LINE_HITS} SELECT * FROM hits",
    "lexical_indexed": f"""WITH {DOCS},
ls AS (SELECT path, unnest({_lines('text')}) AS snippet,
              generate_subscripts({_lines('text')}, 1)::INT AS line FROM docs)
SELECT path, line, snippet FROM ls WHERE regexp_matches(snippet, '{q.INDEX_PATTERN}')""",
    "lexical_per_file_cap": f"""WITH {LINE_HITS}
SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 2""",
    "lexical_pages": f"""WITH pg AS (SELECT {PAGE_PATH} AS path, html FROM pages),
ls AS (SELECT path, unnest({_lines('html')}) AS snippet,
              generate_subscripts({_lines('html')}, 1)::INT AS line FROM pg)
SELECT path, line, snippet FROM ls
WHERE regexp_matches(path, '(^|/)[^/]*\\.example\\.com/.')
  AND regexp_matches(snippet, '{q.PAGE_PATTERN}')""",
    "lexical_crlf": f"""WITH {DOCS},
ls AS (SELECT path, unnest({_lines('text')}) AS snippet,
              generate_subscripts({_lines('text')}, 1)::INT AS line FROM docs)
SELECT path, line, snippet FROM ls WHERE regexp_matches(snippet, '[a-z]\\.$')""",
    "chunk_coverage": f"""WITH {TEXTS}
SELECT path, length(replace(text, {NL}, '')) AS chars,
       length(replace(text, {NL}, ''))::HUGEINT::BIGINT AS kept_chars
FROM t WHERE regexp_matches(text, '\\S')""",
    "structural_python": f"""WITH {PY_LINES}
SELECT path, (3 * i + 5)::INT AS line, 'return ' || n AS snippet FROM fs""",
    "structural_rust": f"""WITH docs AS (
    SELECT 'src/' || source || '/' || doc_id || '.rust' AS path, {_lines('text')} AS ls
    FROM documents WHERE doc_id % {len(LANGS)} = 0),
fs AS (SELECT path, generate_subscripts(ls, 1) - 1 AS i, length(unnest(ls)) AS n FROM docs)
SELECT path, (i + 2)::INT AS line, 'fn f' || i || '(x: u8) -> u64 {{ ' || n || ' }}' AS snippet
FROM fs""",
    "markdown_sections": _markdown_chunks(TURN_MARKDOWN),
    "markdown_fenced": _markdown_chunks(TURN_FENCED),
    "heading_only_drop": f"""WITH {TURN_MARKDOWN}, {_markdown_pieces()}
SELECT path, count(*) AS sections, count(*) FILTER (headed AND filled = 1) AS heading_only
FROM a GROUP BY path""",
    "whole_file_chunk": f"""WITH t AS (
    SELECT path, {_lines("replace(text, '. ', '.' || chr(10))")} AS ls FROM (
        SELECT {DOC_PATH} AS path, text FROM documents))
SELECT path, regexp_extract(path, '[^/]*$') AS symbol, 'module' AS kind, 1 AS start_line,
       len(ls)::INT AS end_line, array_to_string(ls, {NL}) AS content FROM t""",
    "pack_oversized": f"""WITH {DOCS},
p AS (SELECT path, 'doc' AS symbol, 'section' AS kind, 5 AS start_line, 0 AS end_line,
             text AS content FROM docs WHERE length(text) > {q.PACK_CAP}),
{_packed(q.PACK_CAP)}
SELECT path, symbol, kind, start_line::INT AS start_line, end_line::INT AS end_line, content
FROM c""",
    "chunk_documents": _markdown_chunks(TEXTS),
    "code_chunks_python": f"""WITH {PY_LINES},
p AS (SELECT path, 'D' || doc_id AS symbol, 'class' AS kind, 1 AS start_line, 2 AS end_line,
             'class D' || doc_id || ':' || {NL} || '    size = ' || n_chars AS content FROM docs
      UNION ALL
      SELECT path, 'f' || i, 'function', 3 * i + 4, 3 * i + 5,
             'def f' || i || '(x):' || {NL} || '    return ' || n FROM fs)
SELECT path, 'python' AS lang, symbol, kind, start_line::INT AS start_line,
       end_line::INT AS end_line, content, sha256(content) AS content_hash FROM p""",
    "code_chunks_braces": f"""WITH docs AS (
    SELECT doc_id % {len(LANGS)} AS nth, 'src/' || source || '/' || doc_id || '.'
           || {_list(LANGS)}[doc_id % {len(LANGS)} + 1] AS path, {_lines('text')} AS ls
    FROM documents),
fs AS (SELECT nth, path, generate_subscripts(ls, 1) - 1 AS i, length(unnest(ls)) AS n FROM docs),
each AS (SELECT *, {_brace_each()} AS content FROM fs),
joined AS (SELECT path, nth, count(*) AS k,
                  string_agg('  ' || content, {NL} ORDER BY i) AS body FROM each GROUP BY ALL),
p AS (SELECT path, nth, 'f' || i AS symbol, CASE nth WHEN 5 THEN 'method' ELSE 'function' END
             AS kind, i + 2 AS start_line, i + 2 AS end_line, content FROM each
      UNION ALL
      SELECT path, nth, 'module@1', 'module', 1, 1,
             CASE WHEN nth IN (1, 6) THEN 'package a' ELSE '// {{' END
      FROM joined WHERE nth NOT IN (0, 5)
      UNION ALL
      SELECT path, nth, 'module@' || (k + 2), 'module', k + 2, k + 2,
             CASE WHEN nth IN (2, 3, 4) THEN '"}}"' ELSE '// end }}' END
      FROM joined WHERE nth <> 5
      UNION ALL
      SELECT path, nth, 'D', 'class', 1, k + 2,
             'class D {{' || {NL} || body || {NL} || '}}' FROM joined WHERE nth = 5),
{_packed(MAX_CHUNK_CHARS)}
SELECT path, {_list(LANGS)}[list_position({_list(LANGS)}, regexp_extract(path, '[a-z]+$'))] AS lang,
       symbol, kind, start_line::INT AS start_line, end_line::INT AS end_line, content,
       sha256(content) AS content_hash FROM c""",
    "chunk_ids": f"""WITH {STORED}
SELECT path, {ROW_ID} AS id, sha256(content) AS content_hash FROM stored""",
    "glob_filter": f"""WITH {DOCS}
SELECT path FROM docs WHERE NOT regexp_matches(path, '(^|/)src3/')
  AND NOT regexp_matches(path, '^src/[^/]*/1[^/]*\\.md$')
  AND NOT regexp_matches(path, '^src/src1[^/]/')""",
    "glob_pages": f"""WITH pg AS (SELECT {PAGE_PATH} AS path FROM pages)
SELECT path, (regexp_matches(path, '(^|/)[^/]*\\.example\\.[^/]*/[a-e][^/]/')
       OR regexp_matches(path, '(^|/)[^/]*\\.net(/|$)'))
       AND NOT regexp_matches(path, '(^|/)9') AS hit FROM pg""",
    "lang_detect": f"""WITH docs AS (
    SELECT 'src/' || source || '/' || doc_id AS base,
           {_list(LANGS)}[doc_id % {len(LANGS)} + 1] AS lang FROM documents)
SELECT base || '.' || CASE lang WHEN 'rust' THEN 'RS' WHEN 'kotlin' THEN 'kt' ELSE lang END
       AS path,
       CASE WHEN lang IN ('rust', 'kotlin', 'go', 'tsx', 'java') THEN lang END AS detected
FROM docs""",
    "size_cap": """SELECT count(*) AS files, count(*) FILTER (strlen(text) > 4000) AS oversize
FROM documents""",
    "decoded_lines": f"""WITH {DOCS}
SELECT path, strlen(text) AS size, length(text)::INT AS chars,
       len({_lines('text')})::INT AS lines, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped
FROM docs WHERE regexp_matches(text, '\\S')""",
    "modules": """SELECT DISTINCT page_id::VARCHAR AS module FROM pages
WHERE NOT regexp_matches(page_id::VARCHAR, '^[1-3]')""",
    "indexed_paths": f"WITH {STORED} SELECT DISTINCT path FROM stored",
    "existing_hashes": f"""WITH {STORED}, {INCOMING}
SELECT path, symbol, 1 AS start_line, sha256(content) AS content_hash
FROM stored WHERE path IN (SELECT path FROM incoming)""",
    "cache_hits": f"""WITH {STORED}, {INCOMING}
SELECT i.path, sha256(i.content) AS content_hash FROM incoming i JOIN stored s
ON i.path = s.path AND i.content = s.content""",
    "cache_misses": f"""WITH {STORED}, {INCOMING}
SELECT i.path, sha256(i.content) AS content_hash FROM incoming i JOIN stored s
ON i.path = s.path AND i.content <> s.content""",
    "upsert_by_path": f"""WITH {STORED}, {INCOMING},
merged AS (SELECT path, symbol, content FROM stored WHERE path NOT IN (SELECT path FROM incoming)
           UNION ALL SELECT path, symbol, content FROM incoming)
SELECT {ROW_ID} AS id, path, sha256(content) AS content_hash FROM merged""",
    "upsert_by_id": f"""WITH {STORED}, {INCOMING},
old AS (SELECT *, {ROW_ID} AS id FROM stored), new AS (SELECT *, {ROW_ID} AS id FROM incoming)
SELECT id, path, sha256(content) AS content_hash FROM old
WHERE NOT EXISTS (FROM new WHERE new.id = old.id)
UNION ALL SELECT id, path, sha256(content) FROM new""",
    "delete_path": f"""WITH {STORED}
SELECT {ROW_ID} AS id, path FROM stored WHERE path <> 'src/src0/0.md'""",
    "orphan_paths": f"""WITH {STORED}, {INCOMING}
SELECT path FROM stored EXCEPT SELECT path FROM incoming""",
    "prune_orphans": f"""WITH {STORED}, {INCOMING}
SELECT {ROW_ID} AS id, path FROM stored WHERE path IN (SELECT path FROM incoming)""",
    "embed_stage": f"""WITH {DOCS}, {_hashed('docs', 'path', 'text', 'e')},
slots AS (SELECT unnest(range({q.HASHED.dim})) AS slot)
SELECT paths.path, slots.slot::INT AS slot, round(coalesce(x, 0), 6) AS weight
FROM (SELECT DISTINCT path FROM e) paths CROSS JOIN slots
LEFT JOIN e ON e.path = paths.path AND e.slot = slots.slot""",
    "embed_once": f"""WITH {DOCS}, {_hashed('docs', 'path', 'text', 'e')},
slots AS (SELECT unnest(range({q.HASHED.dim})) AS slot)
SELECT paths.path, slots.slot::INT AS slot, round(coalesce(x, 0), 6) AS weight
FROM (SELECT DISTINCT path FROM e) paths CROSS JOIN slots
LEFT JOIN e ON e.path = paths.path AND e.slot = slots.slot""",
    "embed_calls": """SELECT count(DISTINCT text) AS calls, CAST(count(text) AS BIGINT) AS documents
FROM documents""",
    "embed_precomputed": f"""WITH docs AS (
    SELECT {DOC_PATH} AS path, doc_id, sha256(text) AS content_hash FROM documents),
given AS (SELECT content_hash, arg_min(embedding, vec_id) AS vector
          FROM embeddings JOIN docs ON vec_id = doc_id WHERE doc_id % 2 = 0 GROUP BY content_hash)
SELECT path, round(CAST(vector[1] AS DOUBLE), 6) AS first,
       CASE WHEN vector IS NULL THEN 'precomputed: no vector of this content' END AS skip_reason
FROM docs LEFT JOIN given USING (content_hash)""",
    "skip_log": """WITH rs AS (
    SELECT url AS path, CASE WHEN url LIKE '%#%'
        THEN regexp_replace(html, '[a-zA-Z0-9]+', '', 'g') ELSE html END AS content FROM pages)
SELECT path, 'page' AS symbol, 'html' AS lang, 1 AS start_line, 1 AS end_line,
       length(content)::INT AS chars, 'protocol: no words to embed' AS reason
FROM rs WHERE NOT regexp_matches(lower(content), '[a-z0-9]')""",
    "decoded_invalid": f"""
SELECT {DOC_PATH} AS path, sha256(text || chr(65533) || '-' || chr(65533)) AS digest
FROM documents""",
    "index_run": f"""WITH {TEXTS}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)}
SELECT {CHUNK_ID} AS id, path, symbol, start_line::INT AS start_line, end_line::INT AS end_line,
       sha256(content) AS content_hash FROM c WHERE {HAS_WORDS}""",
    "index_commits": f"""WITH {TEXTS}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)}
SELECT {CHUNK_ID} AS id, path, symbol, sha256(content) AS content_hash FROM c WHERE {HAS_WORDS}""",
    "table_upsert_path": f"""WITH {STORED}, {INCOMING},
merged AS (SELECT path, symbol, content FROM stored WHERE path NOT IN (SELECT path FROM incoming)
           UNION ALL SELECT path, symbol, content FROM incoming)
SELECT {ROW_ID} AS id, path, sha256(content) AS content_hash FROM merged""",
    "table_upsert_id": f"""WITH {STORED},
incoming AS (SELECT path, CASE WHEN toxic = 1 THEN 'toxic' ELSE symbol END AS symbol, content
             FROM stored JOIN documents d ON path = 'src/' || d.source || '/' || d.doc_id || '.md'
             JOIN labels USING (doc_id)),
old AS (SELECT *, {ROW_ID} AS id FROM stored), new AS (SELECT *, {ROW_ID} AS id FROM incoming)
SELECT id, path, sha256(content) AS content_hash FROM old
WHERE NOT EXISTS (FROM new WHERE new.id = old.id)
UNION ALL SELECT id, path, sha256(content) FROM new""",
    "table_delete_path": f"""WITH {STORED}
SELECT {ROW_ID} AS id, path FROM stored WHERE path <> 'src/src0/0.md'""",
    "table_grown": f"""WITH {STORED}
SELECT {ROW_ID} AS id, path, sha256(content) AS content_hash FROM stored""",
    "index_update": _second_run(
        f"""SELECT {CHUNK_ID} AS id, path, symbol, content_hash FROM first_run
WHERE path NOT IN (SELECT path FROM incoming)
UNION ALL SELECT {CHUNK_ID}, path, symbol, content_hash FROM second_run WHERE {HAS_WORDS}"""
    ),
    "change_apply": _second_run(
        f"""SELECT {CHUNK_ID} AS id, path, symbol, content_hash FROM first_run
WHERE path NOT IN (SELECT path FROM incoming)
UNION ALL SELECT {CHUNK_ID}, path, symbol, content_hash FROM second_run WHERE {HAS_WORDS}
AND path NOT IN (SELECT {DOC_PATH} FROM documents JOIN labels USING (doc_id)
                 WHERE quality = 0 AND coalesce(toxic, 0) = 0)"""
    ),
    "index_stats": _second_run(
        f"""SELECT (SELECT count(*) FROM incoming) AS files,
       (SELECT count(*) FROM second_run) AS chunks,
       (SELECT count(*) FROM second_run WHERE {HAS_WORDS}) - (SELECT count(*) FROM same)
           AS embedded,
       (SELECT count(*) FROM second_run WHERE NOT {HAS_WORDS}) AS skipped, (SELECT count(*) FROM same) AS cache_hits,
       (SELECT count(*) FROM incoming WHERE strlen(content) > 4000) AS chunker_skipped_files"""
    ),
    "index_prune": f"""WITH {INCOMING}, {STORED}
SELECT DISTINCT path FROM incoming WHERE path IN (SELECT path FROM stored WHERE {HAS_WORDS})""",
    "table_stats": f"""WITH {TEXTS}, {_markdown_pieces()}, {_packed(MAX_CHUNK_CHARS)}
SELECT count(*) AS rows, 'chunks' AS "table" FROM c WHERE {HAS_WORDS}""",
    "changes_union": f"""WITH {DOCS}, {EVENTS}
SELECT path FROM docs UNION SELECT path FROM ev""",
    "change_latest": LATEST,
    "change_stream": LATEST,
    "change_listing": f"""WITH {STORED}, {INCOMING}
SELECT CASE WHEN i.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, s.path
FROM stored s LEFT JOIN incoming i ON s.path = i.path
WHERE i.path IS NULL OR strlen(i.content) <> strlen(s.content)""",
}
EXPECTED["skip_log_file"] = EXPECTED["skip_log"]
