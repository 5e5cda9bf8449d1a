"""DuckDB twins of the registered queries (the independent correctness oracle).

Written as plain SQL over the pre-registered views; shared *fixed values*
(regex patterns, entity table) come from the operator modules so the two
engines apply the same rules.
"""

from __future__ import annotations

from webloom.functions.text import (ASCII_SPACE_CLASS, sql_decode_entities, sql_inner_text,
                                    sql_js_trim, sql_squeeze)
from webloom.functions.urls import sql_resolve_root_or_absolute
from webloom.operators import html as H
from webloom.operators.outline import REF_ATTR
from webloom.plans import oracle_elements
from webloom.plans import queries as Q

# The oracle's own reading of anchors in the given pages.
ANCHOR = r"(?is)<a\b[^>]*>.*?</a>"
ANCHOR_PARTS = r"(?is)^<a\b([^>]*)>(.*)</a>$"


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _title(expr: str) -> str:
    t = sql_squeeze(sql_decode_entities(f"regexp_extract({expr}, {lit(H.TITLE_RE)}, 1)"))
    return f"regexp_replace({t}, {lit(f'^{ASCII_SPACE_CLASS}+|{ASCII_SPACE_CLASS}+$')}, '', 'g')"


def _href(attrs: str) -> str:
    g = [f"regexp_extract({attrs}, {lit(H.HREF_RE)}, {i})" for i in (1, 2, 3)]
    return (f"(CASE WHEN regexp_matches({attrs}, {lit(H.HREF_RE)}) THEN "
            f"{sql_decode_entities(' || '.join(g))} END)")


def _base_href(html: str) -> str:
    g = [f"regexp_extract({html}, {lit(H.BASE_RE)}, {i})" for i in (1, 2, 3)]
    return sql_decode_entities(" || ".join(g))


EXTRACT_LINKS = f"""
WITH pb AS (
  SELECT page_id, html,
         CASE WHEN regexp_matches(html, {lit(H.BASE_RE)})
              THEN {sql_resolve_root_or_absolute('url', _base_href('html'))} ELSE url END AS url
  FROM pages
), a AS (
  SELECT page_id, url, unnest(l) AS anc, unnest(generate_series(1, len(l))) AS k
  FROM (SELECT page_id, url, regexp_extract_all(html, {lit(ANCHOR)}) AS l FROM pb)
), b AS (
  SELECT page_id, k,
         {sql_inner_text(f"regexp_extract(anc, {lit(ANCHOR_PARTS)}, 2)")} AS text,
         {sql_resolve_root_or_absolute('url', _href(f"regexp_extract(anc, {lit(ANCHOR_PARTS)}, 1)"))} AS href
  FROM a
)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS pos,
       text, href
FROM b WHERE starts_with(href, 'http')
"""

LIST_PAGES = f"""
SELECT CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS idx,
       row_number() OVER (ORDER BY page_id) = 1 AS active, url, {_title('html')} AS title
FROM pages
"""


def _slice(start: int, end: int) -> str:
    return f"""
SELECT page_id, 'html' AS mode, total_length, s AS start_index, e AS end_index,
       greatest(0, total_length - e) AS remaining_characters,
       CASE WHEN ea > s THEN substr(html, CAST(s + 1 AS INTEGER), CAST(ea - s AS INTEGER)) ELSE '' END AS content
FROM (
  SELECT page_id, html, total_length, s, e,
         CASE WHEN e < 0 THEN greatest(total_length + e, 0) ELSE e END AS ea
  FROM (SELECT page_id, html, CAST(length(html) AS BIGINT) AS total_length,
               CAST(greatest(0, floor({start})) AS BIGINT) AS s,
               CAST(least(length(html), floor({end})) AS BIGINT) AS e FROM pages))
"""


CHUNK_PAGES = f"""
SELECT page_id, CAST(start_index // {Q.CHUNK_SIZE} AS BIGINT) AS chunk, start_index,
       least(len, start_index + {Q.CHUNK_SIZE}) AS end_index,
       len - least(len, start_index + {Q.CHUNK_SIZE}) AS remaining_characters,
       substr(html, CAST(start_index + 1 AS INTEGER), {Q.CHUNK_SIZE}) AS content
FROM (SELECT page_id, html, CAST(length(html) AS BIGINT) AS len,
             CAST(unnest(generate_series(0, greatest(length(html) - 1, 0), {Q.CHUNK_SIZE})) AS BIGINT) AS start_index
      FROM pages)
"""

SQUEEZE_HTML = f"""
SELECT page_id, CAST(length({sql_squeeze('html')}) AS BIGINT) AS total_length,
       substr({sql_squeeze('html')}, 1, {Q.SQUEEZE_LEN}) AS content
FROM pages
"""

PAGE_METADATA = f"""
SELECT page_id,
       lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
       nullif(lower(regexp_extract(html, {lit(H.HTML_LANG_RE)}, 1)), '') AS lang,
       nullif(lower(regexp_extract(html, {lit(H.CHARSET_RE)}, 1)), '') AS charset,
       {_title('html')} AS title
FROM pages
"""

_BOUNDED = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
   FROM events) WHERE rn <= {Q.LOG_N})"""

LAST_N_LOG = f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       event_id, event_type
FROM {_BOUNDED}
"""

NETWORK_REQUESTS = f"""
SELECT * FROM ({LAST_N_LOG}) WHERE event_type NOT IN ({', '.join(lit(t) for t in Q.STATIC_FIXTURE_TYPES)})
"""

SINCE_LAST_RESET = f"""
SELECT e.user_id, e.event_id, e.event_type
FROM events e
LEFT JOIN (SELECT user_id, max({{'ts': ts, 'id': event_id}}) AS r FROM events
           WHERE event_type = {lit(Q.RESET_TYPE)} GROUP BY user_id) m USING (user_id)
WHERE m.r IS NULL OR {{'ts': e.ts, 'id': e.event_id}} > m.r
"""

TAB_EVICTIONS = """
SELECT user_id, event_id AS opened_event,
       lead(event_id, 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS evicted_by
FROM events
"""

LOGS_PER_PAGE = """
SELECT c.c_custkey AS user_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_entries, coalesce(l.ids, '') AS entries
FROM customer c LEFT JOIN (
  SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn <= 100 GROUP BY user_id) l ON l.user_id = c.c_custkey
"""

FIRST_IDLE = f"""
WITH c AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
a AS (SELECT user_id, min(ts) AS st,
             min(CASE WHEN nx IS NULL OR nx >= ts + INTERVAL {Q.IDLE_FIXTURE} THEN ts + INTERVAL {Q.IDLE_FIXTURE} END) AS q
      FROM c GROUP BY user_id)
SELECT user_id,
       CASE WHEN q > st + INTERVAL {Q.IDLE_TIMEOUT_FIXTURE} THEN st + INTERVAL {Q.IDLE_TIMEOUT_FIXTURE} ELSE q END AS idle_at,
       q > st + INTERVAL {Q.IDLE_TIMEOUT_FIXTURE} AS timed_out
FROM a
"""

IDLE_SESSIONS = """
WITH g AS (
  SELECT user_id, ts, event_id,
         CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 15 MINUTE AS session_end,
       CAST(count(*) AS BIGINT) AS n_calls
FROM s GROUP BY user_id, sid
"""

EXPIRED = f"SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '{Q.AS_OF}' - INTERVAL 5 DAY"
RETAINED = f"SELECT event_id, ts FROM events WHERE NOT coalesce(ts < TIMESTAMP '{Q.AS_OF}' - INTERVAL 5 DAY, false)"

_URL_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_FILENAME = f"coalesce(nullif(regexp_extract({_URL_PATH}, '([^/]+)/*$', 1), ''), 'downloaded_file')"

DOWNLOAD_MANIFEST = f"""
SELECT page_id, '{Q.ROOT}/downloads' AS folder, {_FILENAME} AS filename,
       '{Q.ROOT}/downloads/' || {_FILENAME} AS path
FROM pages
"""

FINAL_FILES = f"""
SELECT path, max(page_id) AS page_id, CAST(count(*) AS BIGINT) AS n_writes
FROM ({DOWNLOAD_MANIFEST}) GROUP BY path
"""

DISTINCT_FOLDERS = f"""
SELECT DISTINCT folder FROM (
  SELECT '{Q.ROOT}/downloads' || CASE WHEN regexp_extract({_URL_PATH}, '^/([^/]*)', 1) = '' THEN ''
         ELSE '/' || regexp_extract({_URL_PATH}, '^/([^/]*)', 1) END AS folder FROM pages)
WHERE folder <> '{Q.ROOT}/downloads/en'
"""

_RESPONSES = """
responses AS (
  SELECT 'page' AS kind, page_id AS id, url, 'text/html; charset=utf-8' AS ct, html AS txt FROM pages
  UNION ALL
  SELECT 'event', event_id, 'https://api.example.com/events/' || CAST(event_id AS VARCHAR),
         'application/json', props FROM events
  UNION ALL
  SELECT 'doc', doc_id, 'https://files.example.com/docs/' || CAST(doc_id AS VARCHAR) || '.bin',
         'application/octet-stream', text FROM documents),
r AS (
  SELECT *, CASE WHEN id % 17 = 0 THEN 404 ELSE 200 END AS status,
         CASE WHEN id % 17 = 0 THEN 'Not Found' ELSE 'OK' END AS status_text,
         CASE WHEN contains(ct, 'application/json') THEN 'json'
              WHEN contains(ct, 'text/') OR contains(ct, 'application/xml') OR contains(ct, 'application/xhtml+xml') THEN 'text'
              ELSE 'base64' END AS body_kind
  FROM responses),
b AS (
  SELECT *, CASE body_kind WHEN 'json' THEN CAST(json(txt) AS VARCHAR) WHEN 'text' THEN txt
                 ELSE to_base64(encode(txt)) END AS body_text
  FROM r)
"""

DECODE_BODY = f"""WITH {_RESPONSES}
SELECT kind, id, body_kind, CAST(length(body_text) AS BIGINT) AS body_length FROM b
"""

TRUNCATE_BODY = f"""WITH {_RESPONSES}
SELECT kind, id, status BETWEEN 200 AND 299 AS ok, CAST(length(body_text) AS BIGINT) AS body_length,
       length(body_text) > {Q.BODY_LIMIT} AS truncated,
       CASE WHEN length(body_text) > {Q.BODY_LIMIT} THEN substr(body_text, 1, {Q.BODY_LIMIT}) ELSE body_text END AS body
FROM b
"""

NORMALIZE_HEADERS = f"""WITH {_RESPONSES}
SELECT kind, id, 'content-type' AS name, ct AS value FROM r
UNION ALL SELECT kind, id, 'content-length', CAST(octet_length(encode(txt)) AS VARCHAR) FROM r
UNION ALL SELECT kind, id, 'x-request-id', kind || '-' || CAST(id AS VARCHAR) FROM r
"""

ENVELOPE = f"""WITH {_RESPONSES}
SELECT kind, id, status NOT BETWEEN 200 AND 299 AS is_error,
       CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'Error: Failed to fetch file: ' || status_text
            ELSE 'File downloaded to: {Q.ROOT}/downloads/' || {_FILENAME} END AS text
FROM r
"""

CLASSIFY_TIMEOUTS = """
SELECT event_id, elapsed_ms,
       CASE WHEN elapsed_ms >= 60000 THEN 'Request timed out after 60 seconds' END AS error
FROM (SELECT event_id,
             CAST(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS DOUBLE) / 1000.0 AS elapsed_ms
      FROM events)
"""

VALID_REQUESTS = """
SELECT id, url IS NOT NULL AND coalesce(method IN ('GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS'), false)
           AND lim IS NOT NULL AND (redirect IS NULL OR redirect IN ('follow','error','manual')) AS valid
FROM (SELECT event_id AS id, 'https://api.example.com/events/' || CAST(event_id AS VARCHAR) AS url,
             ['GET','POST','PUT','DELETE','PATCH','HEAD','OPTIONS','FETCH','get'][event_id % 9 + 1] AS method,
             CASE WHEN event_id % 5 = 0 THEN NULL ELSE 200.0 END AS lim,
             ['follow','error','manual','bounce'][event_id % 4 + 1] AS redirect
      FROM events)
"""

# ---- search / language ----------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')".replace("{{", "{").replace("}}", "}")


ENRICH_SQL = ("CASE WHEN NOT contains(lower({t}), 'best') AND NOT contains(lower({t}), 'tips') "
              "THEN {t} || ' best tips' ELSE {t} END")

ENRICH_QUERY = f"""
SELECT conv_id, turn, {ENRICH_SQL.format(t='text')} AS query FROM conversations WHERE role = 'user'
"""


def _form(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"


SEARCH_URLS = f"""
SELECT item_id, 'https://www.googleapis.com/customsearch/v1?key=API_KEY&cx=ENGINE_ID&q=' || {_form('text')}
       || '&num={Q.SEARCH_NUM}&lr=lang_en' AS url
FROM benchmark
"""

PARSE_SEARCH_RESPONSE = """
SELECT id, CAST(k AS BIGINT) AS rank, 'Line ' || CAST(k AS VARCHAR) AS title,
       'https://files.example.com/docs/' || CAST(id AS VARCHAR) || '#L' || CAST(k AS VARCHAR) AS link,
       line AS snippet
FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line,
             unnest(generate_series(1, len(string_split(text, chr(10))))) AS k
      FROM documents WHERE n_chars >= 10)
"""


def _search_sql(queries_sql: str, num: int, start: int = 1, doc_filter: str = "TRUE") -> str:
    """BM25 top-k per query in DuckDB; ``queries_sql`` yields (item_id, text)."""
    return f"""
docs AS (SELECT doc_id, {doc_filter} AS keep_doc, {_tok('text')} AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM ({queries_sql}))),
dt AS (SELECT doc_id, keep_doc, len(toks) AS dl, unnest(toks) AS term FROM docs),
post AS (SELECT doc_id, term, dl, keep_doc, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT q.item_id, p.doc_id,
              round(sum(ln(1 + (stats.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2
                        / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / stats.avgdl))), 6) AS score
       FROM post p JOIN dfs USING (term) JOIN q USING (term), stats WHERE p.keep_doc GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
top AS (SELECT item_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM ranked WHERE rank BETWEEN {start} AND {start + num - 1})
"""


_META = ("substr(regexp_replace(split_part(text, chr(10), 1), '^{c}+|{c}+$', '', 'g'), 1, 80) AS title, "
         "substr(text, 1, 160) AS snippet").format(c=__import__('webloom.functions.text', fromlist=['x']).JS_SPACE_CLASS)

MULTI_SEARCH = f"""WITH {_search_sql('SELECT item_id, text FROM benchmark', Q.SEARCH_NUM)}
SELECT top.item_id, top.rank, top.doc_id, top.score, {_META}
FROM top JOIN documents USING (doc_id)
"""

SEARCH_FILTERED = f"""WITH {_search_sql('SELECT item_id, text FROM benchmark', Q.FILTER_NUM, Q.FILTER_START, "lang = '" + Q.FILTER_LANG + "'")}
SELECT top.item_id, top.rank, top.doc_id, top.score, {_META}
FROM top JOIN documents USING (doc_id)
"""

INDEX_SEARCH_OPTIONS = f"""WITH {_search_sql("SELECT conv_id * 1000 + turn AS item_id, text FROM conversations WHERE role = 'user'", Q.FILTER_NUM, 1,
    "lang = '" + Q.FILTER_LANG + "' AND source = (SELECT min(source) FROM documents)")}
SELECT top.item_id, top.rank, top.doc_id, top.score, {_META}
FROM top JOIN documents USING (doc_id)
"""

_LANGMAP = "CASE {x} WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE {x} END"


def _grams(src_sql: str) -> str:
    """(id, gram, cnt) for src_sql yielding (id, text)."""
    return f"""(SELECT id, gram, count(*) AS cnt FROM (
      SELECT id, substr(s, i, 3) AS gram FROM (
        SELECT id, s, unnest(generate_series(1, length(s) - 2)) AS i FROM (
          SELECT id, ' ' || regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g') || ' ' AS s FROM ({src_sql}))
        WHERE length(s) >= 3))
    WHERE NOT contains(gram, '  ') GROUP BY ALL)""".replace("{{", "{").replace("}}", "}")


PROFILES = f"""prof AS (
  SELECT lang, gram, r FROM (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, gram) AS r FROM (
      SELECT {_LANGMAP.format(x='d.lang')} AS lang, g.gram, sum(g.cnt) AS cnt
      FROM {_grams('SELECT doc_id AS id, text FROM documents')} g JOIN documents d ON d.doc_id = g.id
      GROUP BY ALL))
  WHERE r <= 300)"""


def _detect(name: str, src_sql: str) -> str:
    """CTE ``name`` (id, lang_code) for src_sql yielding (id, text)."""
    return f"""{name}_own AS (
  SELECT id, gram, rd FROM (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY cnt DESC, gram) AS rd
                            FROM {_grams(src_sql)}) WHERE rd <= 300),
{name}_best AS (
  SELECT id, lang FROM (
    SELECT id, lang, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS k FROM (
      SELECT id, lang, sum(300 - abs(rd - r)) AS score FROM {name}_own JOIN prof USING (gram) GROUP BY ALL))
  WHERE k = 1),
{name} AS (
  SELECT s.id, CASE WHEN length(s.text) < 10 THEN 'und' ELSE coalesce(b.lang, 'und') END AS lang_code
  FROM ({src_sql}) s LEFT JOIN {name}_best b ON b.id = s.id)"""


DETECT_LANGUAGE = f"""WITH {PROFILES},
{_detect('det', 'SELECT doc_id AS id, text FROM documents')}
SELECT id AS doc_id, lang_code FROM det
"""

_DICT_CASE = ("CASE lower(w) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in __import__('webloom.operators.language', fromlist=['x']).FIXTURE_DICTIONARY.items())
    + " ELSE w END")


def _translate(text: str, lang: str) -> str:
    return (f"CASE WHEN {lang} NOT IN ('eng', 'und') THEN "
            f"array_to_string(list_transform(string_split({text}, ' '), lambda w: {_DICT_CASE}), ' ') "
            f"ELSE {text} END")


TRANSLATE_QUERIES = f"""WITH {PROFILES},
{_detect('det', "SELECT conv_id * 100000 + turn AS id, text FROM conversations WHERE role = 'user'")}
SELECT c.conv_id, c.turn, {_translate('c.text', 'det.lang_code')} AS query
FROM conversations c JOIN det ON det.id = c.conv_id * 100000 + c.turn
WHERE c.role = 'user'
"""

SEARCH_REPORT = f"""WITH {PROFILES},
{_detect('det', 'SELECT item_id AS id, text FROM benchmark')},
qq AS (SELECT b.item_id, det.lang_code, {ENRICH_SQL.format(t='(' + _translate('b.text', 'det.lang_code') + ')')} AS query
       FROM benchmark b JOIN det ON det.id = b.item_id),
{_search_sql('SELECT item_id, query AS text FROM qq', Q.SEARCH_NUM)},
ids AS (SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM top GROUP BY item_id)
SELECT qq.item_id, 'Detected language: ' || qq.lang_code || chr(10) || 'Enriched query: ' || qq.query
       || chr(10) || chr(10) || 'Results:' || chr(10) || '[' || coalesce(ids.ids, '') || ']' AS report
FROM qq LEFT JOIN ids USING (item_id)
"""

# ---- page text / selectors / batch / correlation -----------------------------------

_FR = "regexp_matches(html, '(?is)<html\\b[^>]*\\slang\\s*=\\s*\"fr\"')"
PAGES_WITH = f"SELECT page_id, url FROM pages WHERE {_FR}"
PAGES_WITHOUT = f"SELECT page_id, url FROM pages WHERE NOT {_FR}"

EVALUATE_PAGES = """
SELECT page_id, CAST((length(html) - length(replace(html, '<p', ''))) / 2 AS BIGINT) AS value,
       CAST(NULL AS VARCHAR) AS error
FROM pages
"""

def _pkey(expr: str) -> str:
    """Normalised URL without fragment (resolving an absolute URL against itself)."""
    return f"regexp_replace({sql_resolve_root_or_absolute(expr, expr)}, '#.*$', '')"


_BATCH = f"""
reqs AS (
  SELECT page_id, 0 AS kind, -1 AS lpos, url FROM pages
  UNION ALL SELECT page_id, 1, pos, href FROM ({EXTRACT_LINKS})),
ordered AS (SELECT CAST(row_number() OVER (ORDER BY page_id, kind, lpos) - 1 AS BIGINT) AS pos, url FROM reqs),
res AS (
  SELECT o.pos, o.url, CASE WHEN p.page_id IS NOT NULL THEN 'success' ELSE 'error' END AS status,
         CASE WHEN p.page_id IS NOT NULL THEN CAST(least(o.pos, 9) AS INTEGER) END AS tab_index,
         CASE WHEN p.page_id IS NULL THEN 'net::ERR_NAME_NOT_RESOLVED at ' || o.url END AS error
  FROM ordered o LEFT JOIN (SELECT {_pkey('url')} AS k, min(page_id) AS page_id FROM pages GROUP BY k) p
    ON p.k = {_pkey('o.url')})
"""

BATCH_FETCH = f"WITH {_BATCH} SELECT * FROM res"
BATCH_SUMMARY = f"WITH {_BATCH} SELECT status, CAST(count(*) AS BIGINT) AS n FROM res GROUP BY status"

_CORR = """
WITH u AS (SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts
           FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, turn - 1 AS rid,
             TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn - 1) + to_seconds(7 * (1 + conv_id % 6)) AS ts
      FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn AS req_turn, u.ts AS qts, a.turn AS reply_turn, a.ts AS rts
      FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.rid = u.turn
                         AND a.ts BETWEEN u.ts AND u.ts + INTERVAL 30 SECOND),
c AS (SELECT conv_id, req_turn, qts, arg_min(reply_turn, rts) AS reply_turn,
             CAST(date_diff('second', qts, min(rts)) AS DOUBLE) AS latency_s, min(rts) IS NULL AS timed_out
      FROM j GROUP BY conv_id, req_turn, qts)
"""

CORRELATE = _CORR + "SELECT conv_id, req_turn, reply_turn, latency_s, timed_out FROM c"

# Stream twins: what an availableNow run has emitted -- everything final under
# the watermark (max event time - delay).
def _stream_log(ends: str) -> str:
    return f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       event_id, event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM (SELECT e.* FROM events e
            LEFT JOIN (SELECT user_id, max({{'ts': ts, 'id': event_id}}) AS r FROM events
                       WHERE event_type IN ({ends}) GROUP BY user_id) m USING (user_id)
            WHERE m.r IS NULL OR {{'ts': e.ts, 'id': e.event_id}} > m.r))
WHERE rn <= {Q.LOG_N}
"""


STREAM_LAST_N = _stream_log(lit(Q.RESET_TYPE))
STREAM_CLOSES = _stream_log(f"{lit(Q.RESET_TYPE)}, {lit(Q.CLOSE_TYPE)}")

STREAM_SESSIONS = f"""
SELECT * FROM ({IDLE_SESSIONS})
WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL {Q.STREAM_DELAY}
"""

STREAM_CORRELATE = _CORR + """
SELECT conv_id, req_turn, reply_turn, latency_s, timed_out FROM c
WHERE qts + INTERVAL 30 SECOND < (
  SELECT least(max(CASE WHEN role = 'user' THEN TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) END),
               max(CASE WHEN role = 'assistant' THEN TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn - 1)
                                                     + to_seconds(7 * (1 + conv_id % 6)) END)) - INTERVAL 1 MINUTE
  FROM conversations)
"""

STREAM_TABS = f"SELECT * FROM ({TAB_EVICTIONS}) WHERE evicted_by IS NOT NULL"

LINKS_JSON = f"""
SELECT p.page_id,
       CASE WHEN count(l.pos) = 0 THEN '[]' ELSE
         '[' || chr(10) || string_agg('  {{' || chr(10) || '    "text": ' || CAST(to_json(l.text) AS VARCHAR) || ',' || chr(10)
                                      || '    "href": ' || CAST(to_json(l.href) AS VARCHAR) || chr(10) || '  }}',
                                      ',' || chr(10) ORDER BY l.pos) || chr(10) || ']' END AS json
FROM pages p LEFT JOIN ({EXTRACT_LINKS}) l USING (page_id)
GROUP BY p.page_id
"""

FOLLOW_LINKS = f"""
WITH RECURSIVE nx AS (SELECT page_id, arg_min(href, pos) AS next_url FROM ({EXTRACT_LINKS}) GROUP BY page_id),
step AS (SELECT p.u, nx.next_url, split_part(nx.next_url, '#', 1) AS k
         FROM (SELECT split_part(url, '#', 1) AS u, min(page_id) AS page_id FROM pages GROUP BY 1) p
         JOIN nx ON nx.page_id = p.page_id),
walk(start, hop, url, seen, key) AS (
  SELECT page_id, 0, url, [split_part(url, '#', 1)], split_part(url, '#', 1) FROM pages
  UNION ALL
  SELECT w.start, w.hop + 1, s.next_url, list_append(w.seen, s.k), s.k
  FROM walk w JOIN step s ON s.u = w.key
  WHERE s.next_url IS NOT NULL AND NOT list_contains(w.seen, s.k) AND w.hop + 1 < {Q.FOLLOW_MAX_PAGES})
SELECT start, CAST(hop AS INTEGER) AS hop, url FROM walk
"""

FOLLOW_CHAINS = f"""
WITH RECURSIVE s AS (SELECT page_id AS id, CASE WHEN page_id % 97 = 96 THEN NULL WHEN page_id % {Q.CHAIN_TURN} = {Q.CHAIN_TURN - 1}
                            THEN page_id - {Q.CHAIN_BACK} ELSE page_id + 1 END AS nx FROM pages),
walk(start, hop, id, seen) AS (
  SELECT page_id, 0, page_id, [page_id] FROM pages
  UNION ALL SELECT w.start, w.hop + 1, s.nx, list_append(w.seen, s.nx) FROM walk w JOIN s ON s.id = w.id
  WHERE s.nx IS NOT NULL AND NOT list_contains(w.seen, s.nx) AND w.hop + 1 < {Q.CHAIN_PAGES})
SELECT start, CAST(hop AS INTEGER) AS hop, 'https://chain.example/p/' || id AS url FROM walk
"""

# Punycode without a state machine: the i-th character (by code, then place) that is written has the number
# (code - code before) * (length + 1) + place - place before - 1, where places are among the characters written so
# far; a number's bias depends on the one number before it.
HOST_NAMES = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}]+') AS l FROM documents),
lab AS (SELECT doc_id, k, lower(coalesce(l[k], 'x')) AS label FROM w, range(1, 4) t(k)),
odd AS (SELECT DISTINCT label FROM lab WHERE regexp_matches(label, '[^\\x00-\\x7F]')),
ch AS (SELECT label, unnest(range(length(label))) AS p, unicode(unnest(string_split(label, ''))) AS c FROM odd),
ba AS (SELECT label, count(*) FILTER (c < 128) AS b, coalesce(string_agg(chr(c), '' ORDER BY p) FILTER (c < 128), '') AS basic FROM ch GROUP BY label),
num AS (SELECT x.label, x.c, x.p, row_number() OVER z AS i, lag(x.c) OVER z AS pc,
               (SELECT count(*) FROM ch y WHERE y.label = x.label AND y.p < x.p AND y.c <= x.c)
               AS pl FROM ch x WHERE x.c >= 128 WINDOW z AS (PARTITION BY x.label ORDER BY x.c, x.p)),
del AS (SELECT num.label, i, b + i - 1 AS h, (c - coalesce(pc, 128)) * (b + i) + pl - coalesce(lag(pl) OVER z + 1, 0) AS delta
        FROM num JOIN ba USING (label) WINDOW z AS (PARTITION BY num.label ORDER BY i)),
pre AS (SELECT label, i, delta, lag(delta) OVER z AS last, lag(h) OVER z AS lh FROM del WINDOW z AS (PARTITION BY label ORDER BY i)),
d0 AS (SELECT *, CASE WHEN last IS NULL THEN NULL ELSE (CASE WHEN i = 2 THEN last // 700 ELSE last // 2 END) END AS half FROM pre),
ad(label, i, d, k) AS (SELECT label, i, half + half // (lh + 1), 0 FROM d0 WHERE half IS NOT NULL
      UNION ALL SELECT label, i, d // 35, k + 36 FROM ad WHERE d > 455),
bi AS (SELECT label, i, max(k) + arg_max(36 * d // (d + 38), k) AS bias FROM ad GROUP BY label, i),
st AS (SELECT pre.label, pre.i, delta, CAST(coalesce(bias, 72) AS BIGINT) AS bias FROM pre LEFT JOIN bi ON bi.label = pre.label AND bi.i = pre.i),
vi(label, i, bias, q, k, s, done) AS (
  SELECT label, i, bias, CAST(delta AS BIGINT), CAST(36 AS BIGINT), '', false FROM st
  UNION ALL
  SELECT label, i, bias, CASE WHEN q < t THEN q ELSE (q - t) // (36 - t) END, k + 36,
         s || substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(CASE WHEN q < t THEN q ELSE t + (q - t) % (36 - t) END AS INTEGER) + 1, 1), q < t
  FROM (SELECT *, greatest(1, least(26, k - bias)) AS t FROM vi WHERE NOT done)),
en AS (SELECT label, string_agg(s, '' ORDER BY i) AS tail FROM vi WHERE done GROUP BY label),
pu AS (SELECT label, 'xn--' || basic || CASE WHEN b > 0 THEN '-' ELSE '' END || tail AS wire FROM en JOIN ba USING (label)),
ho AS (SELECT doc_id, string_agg(coalesce(wire, lab.label), '.' ORDER BY k) || '.example' AS host FROM lab LEFT JOIN pu USING (label) GROUP BY doc_id)
SELECT doc_id, 'https://' || host || '/p' AS url, host FROM ho
"""

CONSOLE_MESSAGES = f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       event_id, 'error' AS type, props AS text, 'https://api.example.com/events/' || CAST(event_id AS VARCHAR) AS url
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE event_type = 'error')
WHERE rn <= {Q.CONSOLE_BOUND}
"""

REQUEST_BODIES = """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(json(props) AS VARCHAR) END AS body FROM events
"""

FILE_INVENTORY = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents"
FETCH_SOURCE = f"""
WITH u AS (SELECT page_id AS pos, CASE WHEN page_id % {Q.MISSING_EVERY} = 0 THEN 'https://missing.example/' || page_id ELSE url END AS url FROM pages),
s AS (SELECT url, min(html) AS html FROM pages GROUP BY url)
SELECT pos, u.url, CASE WHEN s.url IS NOT NULL THEN 200 END AS status, CAST(length(html) AS BIGINT) AS length,
       CASE WHEN s.url IS NULL THEN 'net::ERR_NAME_NOT_RESOLVED at ' || u.url END AS error
FROM u LEFT JOIN s ON s.url = u.url
"""
PARSE_DOCUMENTS = "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(NULL AS VARCHAR) AS error FROM documents"

STREAM_IDLE = f"""
WITH c AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
a AS (SELECT user_id, min(ts) AS st, max(ts) AS mx,
             min(CASE WHEN nx IS NOT NULL AND nx >= ts + INTERVAL 1 HOUR THEN ts + INTERVAL 1 HOUR END) AS qn
      FROM c GROUP BY user_id),
b AS (SELECT *, coalesce(qn, mx + INTERVAL 1 HOUR) AS q FROM a)
SELECT user_id, CASE WHEN q > st + INTERVAL 24 HOUR THEN st + INTERVAL 24 HOUR ELSE q END AS idle_at,
       q > st + INTERVAL 24 HOUR AS timed_out
FROM b
WHERE qn IS NOT NULL OR mx + INTERVAL 1 HOUR > st + INTERVAL 24 HOUR
   OR mx + INTERVAL 1 HOUR < (SELECT max(ts) FROM events) - INTERVAL {Q.STREAM_DELAY}
"""

# Elements with RE2's means: no possessive loops, the given pages' quotes are balanced.
_TOK = ("(?is)<!--.*?-->|<script[\\s>].*?</script\\s*>|<style[\\s>].*?</style\\s*>|<template[\\s>].*?</template\\s*>"
        "|<noscript[\\s>].*?</noscript\\s*>|<head[\\s>].*?</head\\s*>"
        "|</?[a-z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>|<[!?][^>]*>|[^<]+|<")


def _own(attr: str) -> str:
    p = f"(?is)\\s{attr}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))"
    return "(" + " || ".join(f"regexp_extract(t, '{p}', {g})" for g in (1, 2, 3)) + ")"


LINKS_EDGE = f"""
WITH own AS ({EXTRACT_LINKS})
SELECT page_id, CAST(pos AS BIGINT) AS pos, text, {sql_resolve_root_or_absolute('url', "'/' || (pos + 1)")} AS href
FROM (SELECT page_id, url, unnest(range(4)) AS pos, unnest(['one', 'two', 'thr\u00e9e', 'four ' || page_id]) AS text FROM pages)
UNION ALL SELECT page_id, pos + 4, text, href FROM own
"""

REQUEST_LOG = f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_id,
       'https://api.example.com/events/' || event_id AS url, 'GET' AS method, event_type AS "resourceType", '*/*' AS accept
FROM {_BOUNDED}
"""

DROP_CLOSED = f"""
SELECT e.user_id, e.event_id, e.event_type
FROM events e
LEFT JOIN (SELECT user_id, max({{'ts': ts, 'id': event_id}}) AS r FROM events
           WHERE event_type = {lit(Q.RESET_TYPE)} GROUP BY user_id) m USING (user_id)
WHERE m.r IS NULL OR {{'ts': e.ts, 'id': e.event_id}} > m.r
"""

REF_SELECTORS = f"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[{REF_ATTR}="' || event_id || '"]' ELSE '#e' || event_id END AS selector
FROM events
"""

REQUEST_DEFAULTS = """
SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 1000.0::DOUBLE ELSE 200.0::DOUBLE END AS "limit" FROM events
"""

VALIDATION_ROWS = """
SELECT event_id AS id, CASE WHEN event_id % 9 >= 7 THEN 'Invalid args' END AS method_error,
       CASE WHEN event_id % 12 >= 10 THEN 'Invalid tab index' END AS index_error
FROM events
"""

SQUEEZED_SLICES = f"""
SELECT page_id, CAST(s // {Q.SQUEEZE_LEN} AS BIGINT) AS chunk, s AS start_index, least(n, s + {Q.SQUEEZE_LEN}) AS end_index,
       n - least(n, s + {Q.SQUEEZE_LEN}) AS remaining_characters, substr(t, CAST(s + 1 AS INTEGER), {Q.SQUEEZE_LEN}) AS content
FROM (SELECT page_id, t, CAST(length(t) AS BIGINT) AS n,
             CAST(unnest(generate_series(0, greatest(length(t) - 1, 0), {Q.SQUEEZE_LEN})) AS BIGINT) AS s
      FROM (SELECT page_id, regexp_replace(html, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g') AS t FROM pages))
"""

_ODD_JSON = '{"1":1.2345678901234568e+22,"2":[null,0],"b":1}'
DIRTY_BODIES = f"""
SELECT doc_id AS id, CASE WHEN doc_id % 5 < 2 THEN 'text' ELSE 'json' END AS body_kind,
       CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || chr(65533) WHEN 3 THEN NULL ELSE {lit(_ODD_JSON)} END AS body_text,
       doc_id % 5 = 3 AS failed
FROM documents
"""

ORACLE = {
    "extract_links": EXTRACT_LINKS,
    "list_pages": LIST_PAGES,
    "html_slice": _slice(Q.SLICE_START, Q.SLICE_END),
    "html_slice_tail": _slice(0, Q.TAIL_END),
    "chunk_pages": CHUNK_PAGES,
    "squeeze_html": SQUEEZE_HTML,
    "page_metadata": PAGE_METADATA,
    "last_n_log": LAST_N_LOG,
    "network_requests": NETWORK_REQUESTS,
    "since_last_reset": SINCE_LAST_RESET,
    "tab_evictions": TAB_EVICTIONS,
    "logs_per_page": LOGS_PER_PAGE,
    "first_idle": FIRST_IDLE,
    "idle_sessions": IDLE_SESSIONS,
    "expired": EXPIRED,
    "retained": RETAINED,
    "download_manifest": DOWNLOAD_MANIFEST,
    "final_files": FINAL_FILES,
    "distinct_folders": DISTINCT_FOLDERS,
    "valid_requests": VALID_REQUESTS,
    "decode_body": DECODE_BODY,
    "truncate_body": TRUNCATE_BODY,
    "normalize_headers": NORMALIZE_HEADERS,
    "envelope": ENVELOPE,
    "classify_timeouts": CLASSIFY_TIMEOUTS,
    "enrich_query": ENRICH_QUERY,
    "search_urls": SEARCH_URLS,
    "parse_search_response": PARSE_SEARCH_RESPONSE,
    "multi_search": MULTI_SEARCH,
    "search_filtered": SEARCH_FILTERED,
    "index_search": MULTI_SEARCH,
    "index_search_options": INDEX_SEARCH_OPTIONS,
    "search_report": SEARCH_REPORT,
    "detect_language": DETECT_LANGUAGE,
    "translate_queries": TRANSLATE_QUERIES,
    "pages_with": PAGES_WITH,
    "pages_without": PAGES_WITHOUT,
    "evaluate_pages": EVALUATE_PAGES,
    "batch_fetch": BATCH_FETCH,
    "batch_summary": BATCH_SUMMARY,
    "correlate": CORRELATE,
    "stream_last_n": STREAM_LAST_N,
    "stream_closes": STREAM_CLOSES,
    "stream_sessions": STREAM_SESSIONS,
    "stream_correlate": STREAM_CORRELATE,
    "stream_tabs": STREAM_TABS,
    "stream_links": EXTRACT_LINKS,
    "stream_retention": EXPIRED,
    "stream_idle": STREAM_IDLE,
    "links_json": LINKS_JSON,
    "follow_links": FOLLOW_LINKS,
    "follow_chains": FOLLOW_CHAINS,
    "host_names": HOST_NAMES,
    "console_messages": CONSOLE_MESSAGES,
    "request_bodies": REQUEST_BODIES,
    "file_inventory": FILE_INVENTORY,
    "file_sink": FILE_INVENTORY,
    "fetch_source": FETCH_SOURCE,
    "links_edge": LINKS_EDGE,
    "request_log": REQUEST_LOG,
    "drop_closed": DROP_CLOSED,
    "ref_selectors": REF_SELECTORS,
    "request_defaults": REQUEST_DEFAULTS,
    "validation_rows": VALIDATION_ROWS,
    "squeezed_slices": SQUEEZED_SLICES,
    "dirty_bodies": DIRTY_BODIES,
    "parse_documents": PARSE_DOCUMENTS,
} | oracle_elements.ORACLE

ORACLE |= {
    "search_outcomes": f"""
SELECT id, rank, title, link, snippet, CAST(NULL AS VARCHAR) AS error FROM ({PARSE_SEARCH_RESPONSE}) WHERE id % 7 <> 0 AND id % 13 <> 0
UNION ALL
SELECT doc_id, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 13 = 0 THEN 'Google Search error: Service Unavailable'
                                            ELSE 'Unexpected token in search response' END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 13 = 0
""",
    "page_head": f"SELECT m.*, 'Page ' || page_id || ' & more' AS description FROM ({PAGE_METADATA}) m",
    "translate_with": f"""WITH {PROFILES},
{_detect('det', "SELECT conv_id * 100000 + turn AS id, text FROM conversations WHERE role = 'user'")}
SELECT c.conv_id, c.turn, CASE WHEN det.lang_code IN ('eng', 'und') OR length(text) % 5 = 0 THEN text ELSE '[en] ' || text END AS query
FROM conversations c JOIN det ON det.id = c.conv_id * 100000 + c.turn WHERE c.role = 'user'
""",
    "stream_chunks": CHUNK_PAGES,
    "stream_text": oracle_elements.ORACLE["page_text"],
}


def every() -> dict[str, str]:
    """All twins; those of the results are built on the ones above."""
    from webloom.plans import oracle_results
    return ORACLE | oracle_results.ORACLE
