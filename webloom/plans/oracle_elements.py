"""DuckDB twins of the queries over element intervals, with patterns and an algorithm of their own.

No stack and no fold: a start tag is matched by the running level of its own
tag, an open ``p`` or ``b`` ends at the next block or with what contains it,
and everything else is a join on containment of ``[pos, e)``.
"""

from __future__ import annotations

from webloom.functions.text import sql_decode_entities, sql_js_trim
from webloom.plans.queries import DENSITY_MARK, MARKUP, SELECTORS, TEXT_NEEDLE


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOKEN = (r"(?is)<!--.*?-->|<script.*?</script\s*>|<style.*?</style\s*>|<title.*?</title\s*>"
          r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|<![^>]*>|[^<]+""")
_BLOCKS = ("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
           "h6 header hgroup hr html li main menu nav ol option p pre section select table tbody td textarea tfoot th thead tr ul")
_CLOSE_P = ("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
            "hgroup hr li main menu nav ol p pre section table ul")


def _in(names: str) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names.split()) + ")"


def _attr(t: str, name: str) -> str:
    return f"""regexp_extract({t}, '\\s{name}="([^"]*)"', 1)"""


def intervals(source: str) -> str:
    """CTEs over ``source(page_id, html)``: x (tokens), el (elements), tx (shown texts, with their line)."""
    return f"""
src AS ({source}),
x AS (SELECT page_id, unnest(l) AS t, unnest(range(len(l))) AS pos, len(l) AS n
      FROM (SELECT page_id, regexp_extract_all(html, {_lit(_TOKEN)}) AS l FROM src)),
c AS (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag,
             regexp_matches(t, '^<[a-zA-Z]') AS st, regexp_matches(t, '^</') AS en FROM x),
k AS (SELECT *, tag IN {_in("br hr img input link meta base script style title")} AS alone,
             tag IN {_in(_BLOCKS)} AS brk FROM c),
lv AS (SELECT *, sum(CASE WHEN alone THEN 0 WHEN st THEN 1 WHEN en THEN -1 ELSE 0 END)
                   OVER (PARTITION BY page_id, tag ORDER BY pos) AS v,
              min(CASE WHEN st AND tag IN {_in(_CLOSE_P)} THEN pos END)
                   OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM k),
mt AS (SELECT *, lead(pos) OVER (PARTITION BY page_id, tag, CASE WHEN st THEN v ELSE v + 1 END ORDER BY pos) AS m
       FROM lv WHERE (st OR en) AND NOT alone),
wf AS (SELECT page_id, pos, coalesce(m, n) AS e, tag, t FROM mt WHERE st AND tag NOT IN ('p', 'b')
       UNION ALL SELECT page_id, pos, pos + 1, tag, t FROM k WHERE st AND alone),
ps AS (SELECT p.page_id, p.pos, least(coalesce(any_value(p.m), any_value(p.n)), coalesce(any_value(p.nb), any_value(p.n)),
              coalesce(min(w.e), any_value(p.n))) AS e, 'p' AS tag, any_value(p.t) AS t
       FROM mt p LEFT JOIN wf w ON w.page_id = p.page_id AND w.pos < p.pos AND p.pos < w.e
       WHERE p.st AND p.tag = 'p' GROUP BY p.page_id, p.pos),
wp AS (SELECT * FROM wf UNION ALL SELECT * FROM ps),
bs AS (SELECT p.page_id, p.pos, least(coalesce(any_value(p.m), any_value(p.n)), coalesce(min(w.e), any_value(p.n))) AS e,
              'b' AS tag, any_value(p.t) AS t
       FROM mt p LEFT JOIN wp w ON w.page_id = p.page_id AND w.pos < p.pos AND p.pos < w.e
       WHERE p.st AND p.tag = 'b' GROUP BY p.page_id, p.pos),
el AS (SELECT * FROM wp UNION ALL SELECT * FROM bs),
hid AS (SELECT page_id, pos, e FROM el
        WHERE tag IN {_in("head script style template noscript meta link title base")} OR regexp_matches(t, '^<[a-z]+ hidden')
           OR regexp_matches({_attr('t', 'style')}, 'display:\\s*none')),
ln AS (SELECT page_id, pos, t, sum(CASE WHEN (st OR en) AND brk THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS line,
              NOT st AND NOT en AND NOT starts_with(t, '<') AS txt FROM k),
tx AS (SELECT ln.page_id, ln.pos, line, t FROM ln ANTI JOIN hid h ON h.page_id = ln.page_id AND h.pos <= ln.pos AND ln.pos < h.e
       WHERE txt)"""


_SPACES = "regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g')"


def _plain(expr: str) -> str:
    return "trim(" + _SPACES.format(expr) + ")"


_FRAMED = f"SELECT page_id, {_lit(MARKUP)} || html AS html FROM pages"
_UNMARKED = f"SELECT page_id, regexp_replace(html, '</?article>', {_lit(DENSITY_MARK)}, 'g') AS html FROM pages"


def _lines(source: str) -> str:
    """CTE ls(page_id, line, s): the lines of text that are not empty; held white space of pre given back."""
    held = "translate(" + sql_decode_entities("tx.t") + ", ' ' || chr(10) || chr(9), chr(1) || chr(2) || chr(3))"
    return f"""{intervals(source)},
pt AS (SELECT tx.page_id, tx.pos, tx.line, CASE WHEN p.pos IS NOT NULL THEN {held} ELSE {sql_decode_entities("tx.t")} END AS t
       FROM tx LEFT JOIN el p ON p.page_id = tx.page_id AND p.tag = 'pre' AND p.pos < tx.pos AND tx.pos < p.e),
ls AS (SELECT page_id, line, {_plain("string_agg(t, '' ORDER BY pos)")} AS s FROM pt GROUP BY page_id, line
       HAVING {_plain("string_agg(t, '' ORDER BY pos)")} <> '')"""


def _text(source: str) -> str:
    back = "translate(string_agg(s, chr(10) ORDER BY line), chr(1) || chr(2) || chr(3), ' ' || chr(10) || chr(9))"
    return f"""WITH {_lines(source)},
tt AS (SELECT src.page_id, coalesce(t, '') AS text
       FROM src LEFT JOIN (SELECT page_id, {sql_js_trim(back)} AS t FROM ls GROUP BY page_id) USING (page_id))"""


PAGE_TEXT = _text("SELECT page_id, html FROM pages") + "\nSELECT page_id, CAST(length(text) AS BIGINT) AS text_length, text FROM tt"
PAGE_TEXT_FRAMED = _text(_FRAMED) + "\nSELECT page_id, CAST(length(text) AS BIGINT) AS text_length, text FROM tt"
PAGES_WITH_TEXT = _text("SELECT page_id, html FROM pages") + f"\nSELECT page_id FROM tt WHERE contains(text, {_lit(TEXT_NEEDLE)})"


def _article(source: str) -> str:
    back = "translate(string_agg(s, chr(10) ORDER BY line), chr(1) || chr(2) || chr(3), ' ' || chr(10) || chr(9))"
    words = "len(list_filter(regexp_split_to_array({}, '[ \\x01-\\x03]+'), lambda w: w <> ''))"
    return f"""WITH {_lines(source)},
fl AS (SELECT tx.page_id, tx.line, bool_or(el.tag IN ('nav', 'header', 'footer', 'aside') OR {_attr('el.t', 'class')} = 'ad') AS b,
              bool_or(el.tag IN ('article', 'main')) AS m
       FROM tx LEFT JOIN el ON el.page_id = tx.page_id AND el.pos < tx.pos AND tx.pos < el.e AND regexp_matches(tx.t, '\\S') GROUP BY ALL),
li AS (SELECT page_id, line, sum({words.format(_plain(sql_decode_entities('tx.t')))}) AS n FROM tx
       SEMI JOIN el a ON a.page_id = tx.page_id AND a.tag = 'a' AND a.pos < tx.pos AND tx.pos < a.e GROUP BY ALL),
bl AS (SELECT ls.page_id, ls.line, s, {words.format('s')} AS w, coalesce(li.n, 0) AS lw, coalesce(b, false) AS b, coalesce(m, false) AS m
       FROM ls LEFT JOIN fl USING (page_id, line) LEFT JOIN li USING (page_id, line)),
nb AS (SELECT *, lw / greatest(w, 1) AS d, coalesce(lag(w) OVER z, 0) AS pw, coalesce(lead(w) OVER z, 0) AS nw,
              coalesce(lag(lw / greatest(w, 1)) OVER z, 0) AS pd FROM bl WHERE NOT b WINDOW z AS (PARTITION BY page_id ORDER BY line)),
has AS (SELECT page_id, bool_or(m) AS art FROM bl GROUP BY page_id),
kp AS (SELECT page_id, line, s FROM nb JOIN has USING (page_id)
       WHERE CASE WHEN art THEN m ELSE d <= 0.333333 AND CASE WHEN pd <= 0.555556 THEN w > 16 OR nw > 15 OR pw > 4 ELSE w > 40 OR nw > 17 END END),
tt AS (SELECT src.page_id, coalesce(t, '') AS text
       FROM src LEFT JOIN (SELECT page_id, {sql_js_trim(back)} AS t FROM kp GROUP BY page_id) USING (page_id))
SELECT page_id, CAST(length(text) AS BIGINT) AS text_length, text FROM tt"""


MAIN_ARTICLE = _article("SELECT page_id, html FROM pages")
MAIN_ARTICLE_NESTED = _article(_FRAMED)
MAIN_ARTICLE_BLOCKS = _article(_UNMARKED)

_NAME = sql_js_trim("substr(" + sql_js_trim(
    "split_part(translate(" + _plain("string_agg(pt.t, '' ORDER BY pt.pos)") +
    ", chr(1) || chr(2) || chr(3), ' ' || chr(10) || chr(9)), chr(10), 1)") + ", 1, 50)")


def _outline(source: str) -> str:
    return f"""WITH {_lines(source)},
sh AS (SELECT el.* FROM el ANTI JOIN hid h ON h.page_id = el.page_id AND h.pos <= el.pos AND el.pos < h.e WHERE tag NOT IN ('html', 'body')),
f1 AS (SELECT sh.page_id, sh.pos, sh.e, sh.tag, min(tx.line) AS line FROM sh
       JOIN tx ON tx.page_id = sh.page_id AND sh.pos < tx.pos AND tx.pos < sh.e AND regexp_matches(tx.t, '\\S') GROUP BY ALL),
nm AS (SELECT f1.page_id, f1.pos, f1.tag, {_NAME} AS name FROM f1
       JOIN pt ON pt.page_id = f1.page_id AND pt.line = f1.line AND f1.pos < pt.pos AND pt.pos < f1.e GROUP BY f1.page_id, f1.pos, f1.tag)
SELECT page_id, CAST(pos AS BIGINT) AS pos, tag,
       CASE WHEN tag = 'a' THEN 'link' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' ELSE 'generic' END AS role, name,
       CASE WHEN tag = 'a' THEN substr(sha256(page_id || '/' || pos), 1, 8) END AS ref
FROM nm"""


OUTLINE_ELEMENTS = _outline("SELECT page_id, html FROM pages")
OUTLINE_FRAMED = _outline(_FRAMED)

# Each selector by hand: conditions on el, its parent q and siblings.
_BY_HAND = {
    "article p": "tag = 'p' AND inside('article')",
    "section > p": "tag = 'p' AND ptag = 'section'",
    "h1 + p": "tag = 'p' AND prev = 'h1'",
    "li ~ li": "tag = 'li' AND before_li",
    "div[title], pre": "(tag = 'div' AND regexp_matches(t, '\\stitle=')) OR tag = 'pre'",
    ".btn": "list_contains(string_split(class, ' '), 'btn')",
    'nav ul > li a[href^="/"]': "tag = 'a' AND starts_with(href, '/') AND nav_li",
    "p.btn-primary b + i": "tag = 'i' AND prev = 'b' AND btn_p",
}
assert set(_BY_HAND) == set(SELECTORS)

SELECT_ELEMENTS = f"""WITH {intervals(_FRAMED)},
pa AS (SELECT e.page_id, e.pos, max(a.pos) AS parent, count(a.pos) AS depth FROM el e
       LEFT JOIN el a ON a.page_id = e.page_id AND a.pos < e.pos AND e.pos < a.e GROUP BY ALL),
sb AS (SELECT el.*, parent, depth, lag(tag) OVER w AS prev,
              coalesce(bool_or(tag = 'li') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before_li
       FROM el JOIN pa USING (page_id, pos) WINDOW w AS (PARTITION BY page_id, parent ORDER BY pos)),
an AS (SELECT e.page_id, e.pos, list(DISTINCT a.tag) AS around, bool_or(a.tag = 'p' AND {_attr('a.t', 'class')} = 'btn-primary') AS btn_p
       FROM el e JOIN el a ON a.page_id = e.page_id AND a.pos < e.pos AND e.pos < a.e GROUP BY ALL),
lis AS (SELECT l.page_id, l.pos, l.e FROM sb l JOIN el u ON u.page_id = l.page_id AND u.pos = l.parent AND u.tag = 'ul'
        JOIN an ON an.page_id = u.page_id AND an.pos = u.pos WHERE l.tag = 'li' AND list_contains(around, 'nav')),
al AS (SELECT sb.*, q.tag AS ptag, around, coalesce(btn_p, false) AS btn_p, {_attr('sb.t', 'class')} AS class, {_attr('sb.t', 'href')} AS href,
              EXISTS (SELECT 1 FROM lis WHERE lis.page_id = sb.page_id AND lis.pos < sb.pos AND sb.pos < lis.e) AS nav_li
       FROM sb LEFT JOIN el q ON q.page_id = sb.page_id AND q.pos = sb.parent LEFT JOIN an ON an.page_id = sb.page_id AND an.pos = sb.pos)
""" + " UNION ALL ".join(
    f"SELECT page_id, {_lit(s)} AS selector, CAST(pos AS BIGINT) AS pos, CAST(e AS BIGINT) AS \"end\", CAST(depth AS INTEGER) AS depth, tag "
    f"FROM al WHERE {w}".replace("inside('article')", "coalesce(list_contains(around, 'article'), false)") for s, w in _BY_HAND.items())

PAGES_WITH_CHAIN = f"WITH {intervals('SELECT page_id, html FROM pages')}" + """
SELECT DISTINCT a.page_id FROM el a JOIN el p ON p.page_id = a.page_id AND a.pos < p.pos AND p.pos < a.e
JOIN el b ON b.page_id = p.page_id AND p.pos < b.pos AND b.pos < p.e WHERE a.tag = 'article' AND p.tag = 'p' AND b.tag = 'br'"""

ORACLE = {
    "page_text": PAGE_TEXT,
    "page_text_framed": PAGE_TEXT_FRAMED,
    "pages_with_text": PAGES_WITH_TEXT,
    "main_article": MAIN_ARTICLE,
    "main_article_nested": MAIN_ARTICLE_NESTED,
    "main_article_blocks": MAIN_ARTICLE_BLOCKS,
    "outline_elements": OUTLINE_ELEMENTS,
    "outline_framed": OUTLINE_FRAMED,
    "select_elements": SELECT_ELEMENTS,
    "pages_with_chain": PAGES_WITH_CHAIN,
}
