"""DuckDB twins of the results as JSON: the text is put together by hand, member by member."""

from __future__ import annotations

from webloom.plans import oracle as O
from webloom.plans import queries as Q

NL = "chr(10)"


def _s(x: str) -> str:
    """A JSON string."""
    for raw, out in (("chr(92)", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'")):
        x = f"replace({x}, {raw}, {out})"
    return f"""coalesce('"' || {x} || '"', 'null')"""


def _object(members: list[tuple[str, str]], depth: int) -> str:
    """Members whose value is NULL are left out."""
    pad, end = "  " * (depth + 1), "  " * depth
    rows = ", ".join(f"""'{pad}"{n}": ' || {v}""" for n, v in members)
    return f"'{{' || {NL} || array_to_string(list_filter([{rows}], lambda x: x IS NOT NULL), ',' || {NL}) || {NL} || '{end}}}'"


def _listed(obj: str, order: str, depth: int = 0) -> str:
    pad, end = "  " * (depth + 1), "  " * depth
    return f"'[' || {NL} || string_agg('{pad}' || {obj}, ',' || {NL} ORDER BY {order}) || {NL} || '{end}]'"


TABS = f"""
SELECT CAST(idx // {Q.TABS_PER_WINDOW} AS BIGINT) AS "window",
       {_listed(_object([("index", f"idx % {Q.TABS_PER_WINDOW}"), ("active", "CASE WHEN active THEN 'true' ELSE 'false' END"),
                         ("url", _s("url")), ("title", _s("title"))], 1), "idx")} AS json
FROM ({O.LIST_PAGES}) GROUP BY 1
"""

_LOCATION = _object([("url", _s("url")), ("lineNumber", "1"), ("columnNumber", "0")], 2)
CONSOLE = f"""
SELECT c.c_custkey AS user_id, coalesce(j.json, '[]') AS json
FROM customer c LEFT JOIN (SELECT user_id, {_listed(_object([("type", _s("type")), ("text", _s("text")), ("location", _LOCATION)], 1), "seq")} AS json
                           FROM ({O.CONSOLE_MESSAGES}) GROUP BY user_id) j ON j.user_id = c.c_custkey
"""

_HEADERS = _object([("accept", _s("accept"))], 2)
NETWORK = f"""
SELECT c.c_custkey AS user_id, coalesce(j.json, '[]') AS json
FROM customer c LEFT JOIN (
  SELECT user_id, {_listed(_object([("url", _s("url")), ("method", _s("method")), ("resourceType", _s('"resourceType"')), ("headers", _HEADERS)], 1), "seq")} AS json
  FROM ({O.REQUEST_LOG}) WHERE "resourceType" NOT IN ({', '.join(O.lit(t) for t in Q.STATIC_FIXTURE_TYPES)}) GROUP BY user_id) j ON j.user_id = c.c_custkey
"""

BATCH = f"""
SELECT CAST(pos // {Q.BATCH_SIZE} AS BIGINT) AS batch,
       {_listed(_object([("url", _s("url")), ("status", _s("status")), ("tabIndex", "CAST(tab_index AS VARCHAR)"),
                         ("error", f"CASE WHEN error IS NOT NULL THEN {_s('error')} END")], 1), "pos")} AS json
FROM ({O.BATCH_FETCH}) GROUP BY 1
"""

SLICE = f"""
SELECT page_id, {_object([("mode", _s("mode")), ("totalLength", "total_length"), ("startIndex", "start_index"), ("endIndex", "end_index"),
                          ("remainingCharacters", "remaining_characters"), ("content", _s("content"))], 0)} AS json
FROM ({O._slice(Q.SLICE_START, Q.SLICE_END)})
"""

_ITEM = [("title", _s("title")), ("link", _s("'https://files.example.com/docs/' || doc_id")), ("snippet", _s("snippet"))]


def _found(results: str, depth: int) -> str:
    return f"SELECT item_id, {_listed(_object(_ITEM, depth + 1), 'rank', depth)} AS json FROM ({results}) GROUP BY item_id"


SEARCH = f"""
SELECT b.item_id, {_object([("query", _s("b.text")), ("results", "coalesce(f.json, '[]')")], 0)} AS json
FROM benchmark b LEFT JOIN ({_found(O.MULTI_SEARCH, 1)}) f USING (item_id)
"""

REPORT = f"""WITH {O.PROFILES},
{O._detect('det', 'SELECT item_id AS id, text FROM benchmark')},
qq AS (SELECT b.item_id, det.lang_code, {O.ENRICH_SQL.format(t='(' + O._translate('b.text', 'det.lang_code') + ')')} AS query
       FROM benchmark b JOIN det ON det.id = b.item_id),
{O._search_sql('SELECT item_id, query AS text FROM qq', Q.SEARCH_NUM)},
res AS (SELECT top.item_id, top.rank, top.doc_id, {O._META} FROM top JOIN documents USING (doc_id)),
f AS ({_found('SELECT * FROM res', 0)})
SELECT qq.item_id, 'Detected language: ' || lang_code || {NL} || 'Enriched query: ' || query || {NL} || {NL} || 'Results:' || {NL} || coalesce(f.json, '[]') AS report
FROM qq LEFT JOIN f USING (item_id)
"""

_HEAD = _object([("content-length", _s("CAST(octet_length(encode(txt)) AS VARCHAR)")), ("content-type", _s("ct")), ("x-request-id", _s("kind || '-' || id"))], 1)
# Props are objects of one number.
_PROPS = f"""'{{' || {NL} || '    "' || json_keys(txt)[1] || '": ' || json_extract_string(txt, '$.' || json_keys(txt)[1]) || {NL} || '  }}'"""
_MS = "rtrim(rtrim(CAST(CAST((b.id % 1000) * 90.5 AS DECIMAL(18, 1)) AS VARCHAR), '0'), '.')"
_RECORD = _object([("status", "status"), ("statusText", _s("status_text")), ("headers", _HEAD),
                   ("body", f"CASE WHEN len > lim THEN {_s('substr(body_text, 1, CAST(lim AS INTEGER))')} WHEN body_kind = 'json' THEN {_PROPS} ELSE {_s('body_text')} END"),
                   ("ok", "CASE WHEN status BETWEEN 200 AND 299 THEN 'true' ELSE 'false' END"), ("url", _s("url")), ("bodyLength", "len"),
                   ("truncated", "CASE WHEN len > lim THEN 'true' ELSE 'false' END"), ("responseTimeMs", "ms")], 0)
FETCH_API = f"""WITH {O._RESPONSES},
v AS ({O.VALID_REQUESTS}),
q AS (SELECT event_id AS id, value * 1000 AS tmo, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 200.0 END AS lim FROM events),
one AS (SELECT b.*, length(body_text) AS len, (b.id % 1000) * 90.5 AS el, {_MS} AS ms FROM b WHERE kind <> 'page'
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind) = 1),
j AS (SELECT one.*, valid, lim, coalesce(tmo, 60000) AS tmo FROM one JOIN q USING (id) JOIN v USING (id)),
e AS (SELECT *, CASE WHEN NOT valid THEN 'Invalid args' WHEN el >= tmo THEN 'Request timed out after '
        || CASE WHEN tmo / 1000 = floor(tmo / 1000) THEN CAST(CAST(tmo / 1000 AS BIGINT) AS VARCHAR) ELSE CAST(tmo / 1000 AS VARCHAR) END || ' seconds' END AS err FROM j)
SELECT id, err IS NOT NULL AS is_error, CASE WHEN err IS NOT NULL THEN 'Error: ' || err ELSE {_RECORD} END AS text FROM e
"""

ORACLE = {
    "tabs_json": TABS, "console_json": CONSOLE, "network_json": NETWORK, "batch_json": BATCH, "slice_json": SLICE,
    "search_json": SEARCH, "search_results_report": REPORT, "fetch_api": FETCH_API,
}
