"""T1 outline node table, T2 outline text, P16-P19 (visibility, role, name,
ref), U3 as a Python UDTF.

Tree construction from (often malformed) HTML is the one step built-in
expressions cannot do, so it runs in ``mapInPandas``: each Arrow batch of
pages is parsed with the standard-library ``html.parser`` plus the implied
end-tag rules browsers apply (``p`` closed by block starts, ``li``/``dt``/
``dd``/``tr``/``td``/``th``/``option`` closed by siblings, void elements,
raw-text ``script``/``style``) and the re-opening of formatting elements
(``<b>`` left open across paragraphs reappears in each following block).  Visibility has no layout here: the static rule drops never-rendered
elements, ``hidden``, inline ``display:none``, ``input type=hidden`` and
elements with neither rendered text nor replaced content (zero size).
The job is narrow -- one pass over pages, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
NEVER_RENDERED = {"head", "script", "style", "template", "noscript", "meta", "link", "title", "base"}
REPLACED = {"img", "input", "button", "select", "textarea", "iframe", "video", "audio", "canvas",
            "svg", "hr", "object", "embed"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
            "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li",
            "dd", "dt"}
BLOCK = CLOSES_P | {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "br",
                    "option", "select", "textarea"}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong",
              "tt", "u"}
MARKER_TAGS = {"td", "th", "caption", "applet", "marquee", "object", "template"}
# Start tags that do not re-open formatting elements (block-level, per the
# HTML "in body" rules); every other start tag and all text do.
NO_RECONSTRUCT = CLOSES_P | {"html", "head", "body", "table", "tbody", "thead", "tfoot", "tr", "td",
                             "th", "caption", "colgroup", "col", "title", "meta", "link", "style",
                             "script", "base", "template", "noscript", "frameset", "frame"}
_MARKER = object()
SIBLING_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
REF_ROLES = {"button", "link", "textbox"}
REF_ATTR = "data-mcp-ref"          # attribute holding an element's ref (and rewritten ``ref:`` selectors)
NAME_LEN = 50
DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
JS_SPACE = ("\t\n\x0b\f\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")

NODE_SCHEMA = ("page_id bigint, node_id bigint, parent_id bigint, depth int, pos int, "
               "role string, name string, ref string")
TEXT_SCHEMA = "page_id bigint, n_lines bigint, outline string, error string"


class _El:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _TreeBuilder(HTMLParser):
    """Element tree with the browser's implied end tags and re-opening of
    formatting elements left open across block boundaries (the list of
    active formatting elements, "Noah's Ark" limit of three; mis-nested end
    tags are closed by popping, not by the full adoption-agency moves)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _El("#document", {}, None)
        self.stack = [self.root]
        self.active: list = []

    def _in_stack(self, el) -> bool:
        return any(e is el for e in self.stack)

    def _after_marker(self):
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is _MARKER:
                return i + 1
        return 0

    def _reconstruct(self):
        if not self.active:
            return
        last = self.active[-1]
        if last is _MARKER or self._in_stack(last):
            return
        i = len(self.active) - 1
        while i > 0:
            prev = self.active[i - 1]
            if prev is _MARKER or self._in_stack(prev):
                break
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            el = _El(old.tag, dict(old.attrs), self.stack[-1])
            self.stack[-1].children.append(el)
            self.stack.append(el)
            self.active[j] = el

    def _close_formatting(self, tag) -> bool:
        start = self._after_marker()
        for i in range(len(self.active) - 1, start - 1, -1):
            e = self.active[i]
            if e is not _MARKER and e.tag == tag:
                del self.active[i]
                if self._in_stack(e):
                    while len(self.stack) > 1:
                        if self.stack.pop() is e:
                            break
                return True
        return False

    def _push_active(self, el):
        start = self._after_marker()
        same = [i for i in range(start, len(self.active))
                if self.active[i].tag == el.tag and self.active[i].attrs == el.attrs]
        if len(same) >= 3:
            del self.active[same[0]]
        self.active.append(el)

    def _open_tags(self):
        return [e.tag for e in self.stack]

    def _pop_to(self, tag):
        while len(self.stack) > 1:
            e = self.stack.pop()
            if e.tag == tag:
                return

    def handle_starttag(self, tag, attrs):
        tag = tag.lower()
        if tag in CLOSES_P and "p" in self._open_tags():
            self._pop_to("p")
        closers = SIBLING_CLOSE.get(tag)
        if closers:
            for i in range(len(self.stack) - 1, 0, -1):
                t = self.stack[i].tag
                if t in closers:
                    del self.stack[i:]
                    break
                if t in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        if tag == "a":
            self._close_formatting("a")
        if tag not in NO_RECONSTRUCT:
            self._reconstruct()
        el = _El(tag, {k.lower(): (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(el)
        if tag not in VOID:
            self.stack.append(el)
        if tag in FORMATTING:
            self._push_active(el)
        elif tag in MARKER_TAGS:
            self.active.append(_MARKER)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.lower() not in VOID and self.stack[-1].tag == tag.lower():
            self.stack.pop()

    def handle_endtag(self, tag):
        tag = tag.lower()
        if tag in FORMATTING and self._close_formatting(tag):
            return
        if tag in self._open_tags()[1:]:
            self._pop_to(tag)
            if tag in MARKER_TAGS:
                while self.active:
                    if self.active.pop() is _MARKER:
                        break

    def handle_data(self, data):
        self._reconstruct()
        self.stack[-1].children.append(data)


def _hidden(el: _El) -> bool:
    if el.tag in NEVER_RENDERED or "hidden" in el.attrs:
        return True
    if el.tag == "input" and el.attrs.get("type", "").lower() == "hidden":
        return True
    return bool(DISPLAY_NONE.search(el.attrs.get("style", "")))


def _pieces(el: _El):
    """Rendered text of a subtree, piece by piece ('\n' = line break); no recursion,
    so a page may nest as deep as it likes."""
    stack = [iter(el.children)]
    ends = [""]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                yield c
            elif not _hidden(c):
                block = "\n" if c.tag in BLOCK else ""
                if block:
                    yield block
                stack.append(iter(c.children))
                ends.append(block)
                break
        else:
            stack.pop()
            if ends.pop():
                yield "\n"


def _first_line(el: _El) -> str:
    """The first line with text; reading stops there."""
    held = ""
    for piece in _pieces(el):
        held += piece
        if "\n" in piece:
            *lines, held = held.split("\n")
            for line in lines:
                line = re.sub(r"[ \t\r\f]+", " ", line).strip(" \t\r\f")
                if line:
                    return line
    return re.sub(r"[ \t\r\f]+", " ", held).strip(" \t\r\f")


def _visible(el: _El) -> bool:
    if _hidden(el):
        return False
    if el.tag in REPLACED:
        return True
    stack = [el]
    while stack:
        e = stack.pop()
        for c in e.children:
            if isinstance(c, str):
                if c.strip():
                    return True
            elif not _hidden(c):
                if c.tag in REPLACED:
                    return True
                stack.append(c)
    return False


def role_of(tag: str, role_attr: str | None, input_type: str | None) -> str:
    """P17 role mapping."""
    if role_attr:
        return role_attr
    if tag == "button":
        return "button"
    if tag == "input":
        return "button" if (input_type or "text").lower() == "button" else "textbox"
    if tag == "a":
        return "link"
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "heading"
    return {"img": "image", "table": "table", "form": "form"}.get(tag, "generic")


def page_nodes(page_id: int, html: str):
    """Pre-order visible nodes under <body>: list of tuples in NODE_SCHEMA order.
    Returns None for an empty document (nothing to put in a body)."""
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    body = None
    todo = [b.root]
    while todo and body is None:
        e = todo.pop(0)
        for c in e.children:
            if not isinstance(c, str):
                if c.tag == "body":
                    body = c
                    break
                todo.append(c)
    if body is None:
        # Browsers imply <body>: everything outside <head> goes into it.
        kids = [c for c in b.root.children if isinstance(c, str) or c.tag != "head"]
        flat = []
        for c in kids:
            if not isinstance(c, str) and c.tag == "html":
                flat.extend(x for x in c.children if isinstance(x, str) or x.tag != "head")
            else:
                flat.append(c)
        if not any((isinstance(c, str) and c.strip()) or not isinstance(c, str) for c in flat):
            return None
        body = _El("body", {}, None)
        body.children = flat
    rows = []

    todo = [(body, None, 0, 0, "body")] if _visible(body) else []
    while todo:
        el, parent_id, depth, pos, path = todo.pop()
        node_id = len(rows)
        role = role_of(el.tag, el.attrs.get("role") or None, el.attrs.get("type"))
        name = el.attrs.get("aria-label") or _first_line(el)[:NAME_LEN].strip(JS_SPACE) or ""
        ref = el.attrs.get(REF_ATTR) or None
        if not ref and (role in REF_ROLES or "onclick" in el.attrs):
            ref = hashlib.sha256(f"{page_id}/{path}".encode()).hexdigest()[:8]
        rows.append((page_id, node_id, parent_id, depth, pos, role, name, ref))
        seen = [(i, c) for i, c in enumerate(el.children) if not isinstance(c, str) and _visible(c)]
        todo.extend((c, node_id, depth + 1, k, f"{path}/{i}") for k, (i, c) in reversed(list(enumerate(seen))))
    return rows


def format_outline(rows) -> str:
    """``indent role: "name" [ref:x]`` per node, pre-order, newline-ended."""
    return "".join(f"{'  ' * r[3]}{r[5]}: \"{r[6]}\"{f' [ref:{r[7]}]' if r[7] else ''}\n" for r in rows)


def _nodes_batches(it):
    cols = ["page_id", "node_id", "parent_id", "depth", "pos", "role", "name", "ref"]
    for pdf in it:
        out = []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            rows = page_nodes(int(pid), html)
            if rows:
                out.extend(rows)
        df = pd.DataFrame(out, columns=cols)
        df["parent_id"] = df["parent_id"].astype("Int64")
        yield df


def _text_batches(it):
    for pdf in it:
        ids, counts, texts, errors = [], [], [], []
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            try:
                rows = page_nodes(int(pid), html)
                if rows is None:
                    ids.append(pid), counts.append(0), texts.append(None)
                    errors.append("No body element")
                else:
                    ids.append(pid), counts.append(len(rows)), texts.append(format_outline(rows))
                    errors.append(None)
            except Exception as e:  # noqa: BLE001 -- one bad page must not fail the job
                ids.append(pid), counts.append(0), texts.append(None), errors.append(str(e))
        yield pd.DataFrame({"page_id": ids, "n_lines": counts, "outline": texts, "error": errors})


def outline_nodes(pages: DataFrame) -> DataFrame:
    """``(page_id, node_id, parent_id, depth, pos, role, name, ref)``."""
    return pages.select("page_id", "html").mapInPandas(_nodes_batches, NODE_SCHEMA)


def outline_text(pages: DataFrame) -> DataFrame:
    """T2 in the same pass as the parse (no shuffle): ``(page_id, n_lines,
    outline, error)``; a page without <body> gives an error row (K3)."""
    return pages.select("page_id", "html").mapInPandas(_text_batches, TEXT_SCHEMA)


def outline_elements(pages: DataFrame) -> DataFrame:
    """P16-P19 as Columns over element intervals: ``(page_id, pos, tag, role, name, ref)``.

    ``pos`` counts the page's tokens.  What is inside a hidden element, and
    what has neither shown text nor replaced content, is left out; so are
    ``html`` and ``body``.  The name is the ``aria-label`` or the first line
    of all shown text inside, cut to 50 characters; the ref is the page's own
    or a hash of page and place.  Built-in functions only, and no page can end the job."""
    from webloom.operators.elements import attr, element_rows
    rows = element_rows(pages).where(~F.col("hidden") & ~F.col("tag").isin("html", "body"))
    a = F.col("attrs")
    kind = F.lower(F.coalesce(attr(a, "type"), F.lit("")))
    own = F.nullif(attr(a, "role"), F.lit(""))
    role = (F.when(own.isNotNull(), own).when(F.col("tag") == "button", "button")
            .when(F.col("tag") == "input", F.when(kind == "button", "button").otherwise("textbox"))
            .when(F.col("tag") == "a", "link").when(F.col("tag").rlike("^h[1-6]$"), "heading")
            .when(F.col("tag") == "img", "image").when(F.col("tag").isin("table", "form"), F.col("tag")).otherwise("generic"))
    rows = rows.withColumn("role", role)
    made = F.substring(F.sha2(F.concat_ws("/", F.col("page_id").cast("string"), F.col("pos").cast("string")), 256), 1, 8)
    needs = F.col("role").isin(sorted(REF_ROLES)) | F.exists(a, lambda x: x["name"] == "onclick")
    return rows.select("page_id", "pos", "tag", "role",
                       F.coalesce(F.nullif(attr(a, "aria-label"), F.lit("")), F.col("name_text")).alias("name"),
                       F.coalesce(F.nullif(attr(a, REF_ATTR), F.lit("")), F.when(needs, made)).alias("ref"))


def register_outline_udtf(spark):
    """``SELECT * FROM pages, LATERAL outline_nodes(page_id, html)``."""
    from pyspark.sql.functions import udtf

    @udtf(useArrow=True, returnType="node_id bigint, parent_id bigint, depth int, pos int, role string, "
                     "name string, ref string")
    class OutlineNodes:
        def eval(self, page_id: int, html: str):
            for r in page_nodes(int(page_id), html) or []:
                yield r[1:]

    spark.udtf.register("outline_nodes", OutlineNodes)
    return OutlineNodes
