"""HTML projections over a pages table ``(page_id, url, html)``.

P3/P4/P5 link extraction, P6 page text, P7 title, P28 squeeze, P30 metadata,
P31 text predicate (P29 main article: ``operators.elements``).  All are narrow (no shuffle):
regex extraction, higher-order array functions and explode run per row
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import (ASCII_SPACE_CLASS, decode_entities, inner_text,
                                    js_trim, let, squeeze_spaces)
from webloom.functions.urls import resolve_url, url_host
from webloom.operators.outline import BLOCK as BREAKS

# One pattern walks the page: comments and raw-text elements are consumed first, so
# nothing inside them is an anchor; a start tag's quotes are consumed as a
# whole, so ">" in an attribute does not end it; an anchor's content runs to
# the next <a or </a (an open anchor ends the one before it) or to the page's end.  All
# loops are possessive: no backtracking, and no recursion on long pages.
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SKIP_RE = (r"<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
            r"|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)"
            r"|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)")
ANCHOR_RE = (rf"(?is){_SKIP_RE}|<a(?=[\s/>]){_ATTRS}>"
             rf"(?:[^<]++|<!--.*?(?:-->|\z)|<(?!/?a[\s/>]|!--))*+")
ANCHOR_PARTS_RE = rf"(?is)^<a(?=[\s/>])({_ATTRS})>(.*)$"
COMMENT_RE = r"(?s)<!--.*?(?:-->|$)"
HREF_RE = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title>"
BASE_RE = r"""(?is)<base\b[^>]*\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
HTML_LANG_RE = r"""(?is)<html\b[^>]*\slang\s*=\s*["']?([^"'\s>]*)"""
CHARSET_RE = r"""(?is)<meta\b[^>]*\scharset\s*=\s*["']?([^"'\s/>]*)"""


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def href_of(tag_attrs) -> Column:
    """Raw href attribute value (any quoting), NULL when absent, entities decoded."""
    a = _col(tag_attrs)
    raw = F.concat(F.regexp_extract(a, HREF_RE, 1), F.regexp_extract(a, HREF_RE, 2),
                   F.regexp_extract(a, HREF_RE, 3))
    return F.when(a.rlike(HREF_RE), decode_entities(raw))


def _keeps_scheme(base: Column, raw_href: Column, prefix: str) -> Column:
    """Cheap test of ``resolve_url(base, href).startswith(prefix)``: an absolute
    href keeps its own (lower-cased) scheme, any other reference inherits the
    base's."""
    from webloom.functions.urls import SCHEME_RE
    h = F.regexp_replace(raw_href, r"^[\x{00}-\x{20}]+", "")
    own = F.lower(h).startswith(prefix) & h.rlike(SCHEME_RE)
    return raw_href.isNotNull() & F.when(h.rlike(SCHEME_RE), own) \
        .otherwise(F.lower(base).startswith(prefix))


def anchor_array(html, base, schemes_prefix: str | None = "http") -> Column:
    """Array<struct<inner, href_raw>> of anchors in document order; with
    ``schemes_prefix`` only anchors whose resolved href starts with it
    (P4: the reference keeps ``startsWith('http')``).  Duplicates are kept."""
    anchors = F.filter(F.regexp_extract_all(_col(html), F.lit(ANCHOR_RE), 0), lambda a: a.rlike(r"(?i)^<a[\s/>]"))
    parts = F.transform(anchors, lambda a: F.struct(
        F.regexp_replace(F.regexp_extract(a, ANCHOR_PARTS_RE, 2), COMMENT_RE, "").alias("inner"),
        href_of(F.regexp_extract(a, ANCHOR_PARTS_RE, 1)).alias("href_raw")))
    if schemes_prefix:
        b = _col(base)
        parts = F.filter(parts, lambda p: _keeps_scheme(b, p["href_raw"], schemes_prefix))
    return parts


def document_base(html, url) -> Column:
    """Base URL for relative links: the first ``<base href>`` resolved against
    the page URL, else the page URL."""
    h = _col(html)
    raw = F.concat(*[F.regexp_extract(h, BASE_RE, i) for i in (1, 2, 3)])
    return F.when(h.rlike(BASE_RE), resolve_url(_col(url), decode_entities(raw))).otherwise(_col(url))


def extract_links(pages: DataFrame, schemes_prefix: str | None = "http") -> DataFrame:
    """One row per kept link: ``(page_id, pos, text, href)``, ``pos`` 0-based in
    the kept list (document order).  Anchors are filtered inside the array
    (cheap scheme test), exploded, then cleaned and resolved per link
    against the document base."""
    exploded = (pages.select("page_id", "html", document_base("html", "url").alias("_base"))
                .select("page_id", "_base", F.posexplode(anchor_array("html", "_base", schemes_prefix))))
    return exploded.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"),
        inner_text(F.col("col.inner")).alias("text"),
        resolve_url(F.col("_base"), F.col("col.href_raw")).alias("href"))


def link_list(html, base, schemes_prefix: str | None = "http") -> Column:
    """Array<struct<text, href>> per page (the reference's link result), built
    inside the row: no explode, no shuffle."""
    b = _col(base)
    return F.transform(anchor_array(html, base, schemes_prefix), lambda a: F.struct(
        inner_text(a["inner"]).alias("text"), resolve_url(b, a["href_raw"]).alias("href")))


def page_title(html) -> Column:
    """document.title: first <title> text, entities decoded, ASCII white space
    collapsed and trimmed; '' when there is no title."""
    t = F.regexp_extract(_col(html), TITLE_RE, 1)
    return F.regexp_replace(squeeze_spaces(decode_entities(t)),
                            f"^{ASCII_SPACE_CLASS}+|{ASCII_SPACE_CLASS}+$", "")


def page_metadata(pages: DataFrame) -> DataFrame:
    """``(page_id, host, lang, charset, title)``; NULL when absent.
    :func:`page_head` has the description too."""
    return pages.select("page_id", *_metadata())


def _metadata() -> list[Column]:
    h = F.col("html")
    return [url_host("url").alias("host"),
            F.nullif(F.lower(F.regexp_extract(h, HTML_LANG_RE, 1)), F.lit("")).alias("lang"),
            F.nullif(F.lower(F.regexp_extract(h, CHARSET_RE, 1)), F.lit("")).alias("charset"),
            page_title(h).alias("title")]


def squeeze_html(pages: DataFrame, length: int = 500) -> DataFrame:
    """White-space runs collapsed to one space; first ``length`` chars (the
    first slice; :func:`squeezed_slices` gives the others)."""
    sq = squeeze_spaces("html")
    return pages.select("page_id", F.length(sq).cast("bigint").alias("total_length"),
                        F.substring(sq, 1, length).alias("content"))


def squeezed_slices(pages: DataFrame, length: int = 500) -> DataFrame:
    """P28 paging: every slice of the squeezed page, ``(page_id, chunk, start_index,
    end_index, remaining_characters, content)``."""
    from webloom.operators.slices import chunk_pages
    return chunk_pages(pages.select("page_id", squeeze_spaces("html").alias("html")), length)


# A page is "plain" if no element may be hidden or keep its white space; such a page
# needs no element intervals for its text.
_NOT_PLAIN_RE = r"(?i)\shidden(?=[\s=/>])|display\s*:\s*none|<(?:pre|textarea)(?=[\s/>])"
_RAW_RE = (r"<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?=[\s/>]){_ATTRS}>.*?(?:</{t}\s*>|\z)"
                                          for t in ("script", "style", "template", "noscript", "title")))
_UNSEEN_RE = rf"(?is)<head(?=[\s/>]){_ATTRS}>(?:[^<]++|{_RAW_RE}|<(?!/head[\s>]|body[\s/>]))*+|{_RAW_RE}"
_BREAK_RE = rf"(?i)</?(?:{'|'.join(sorted(BREAKS, key=len, reverse=True))})(?=[\s/>]){_ATTRS}(?:>|\z)"
_TAG_RE = rf"(?i)</?[a-z]{_ATTRS}(?:>|\z)|<[!?/][^>]*+(?:>|\z)"


def _plain_text(html: Column) -> Column:
    s = squeeze_spaces(F.regexp_replace(html, _UNSEEN_RE, ""))
    s = F.regexp_replace(F.regexp_replace(s, _BREAK_RE, "\n"), _TAG_RE, "")
    lines = F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(squeeze_spaces(decode_entities(x)), "^ | $", ""))
    return js_trim(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def page_text_col(html) -> Column:
    """innerText of the page without layout: what is never rendered or hidden is left out, a block begins a
    new line, white space is collapsed (kept in ``pre``), empty lines go.  A page where that takes more than
    patterns is read by its element intervals."""
    from webloom.operators.elements import element_columns, rendered_text
    h = F.coalesce(_col(html), F.lit(""))
    nested = let(element_columns(h), lambda e: rendered_text(e["toks"], e["marks"]))
    return F.when(h.rlike(_NOT_PLAIN_RE), nested).otherwise(_plain_text(h))


def page_text(pages: DataFrame) -> DataFrame:
    t = page_text_col("html")
    return (pages.select("page_id", t.alias("text"))
            .select("page_id", F.length("text").cast("bigint").alias("text_length"), "text"))


def pages_with_text(pages: DataFrame, needle: str, present: bool = True) -> DataFrame:
    """Pages whose rendered text contains (or lacks) ``needle``."""
    cond = page_text_col("html").contains(needle)
    return pages.where(cond if present else ~cond).select("page_id")


DESCRIPTION_RE = r"""(?is)<meta\s[^>]*?name\s*=\s*["']?description["']?[^>]*>"""
CONTENT_RE = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_description(html) -> Column:
    """The description of the page's metadata, entities decoded, NULL when absent."""
    tag = F.regexp_extract(_col(html), DESCRIPTION_RE, 0)
    raw = F.concat(*[F.regexp_extract(tag, CONTENT_RE, i) for i in (1, 2, 3)])
    return F.nullif(js_trim(squeeze_spaces(decode_entities(raw))), F.lit(""))


def page_head(pages: DataFrame) -> DataFrame:
    """P30 with the description: ``(page_id, host, lang, charset, title, description)``."""
    return pages.select("page_id", *_metadata(), page_description("html").alias("description"))
