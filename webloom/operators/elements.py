"""Elements of pages as intervals over a token table, in built-in functions.

A page is cut into tokens inside its row (``tokens``).  A fold over the
tokens keeps the stack of open elements and gives each start tag the place
where its element ends (``spans``): the matching end tag, the tag that
implies the end (a block closes an open ``p``, an ``li`` the ``li`` before
it), or the page's end.  So every element is an interval ``[pos, end)`` with
its depth, its parent and its place among its siblings; "inside" is
containment of intervals.  What an element is inside of (hidden, ``pre``, a
link, boilerplate, an article) is inherited on the stack as flags.

The fold runs in blocks of ``BLOCK`` tokens, so that its lists are not copied
whole for each token.  Nothing is shuffled and no Python runs; page text
(P6), pruned subtrees and names (P16, P18), the main article (P29), text
predicates (P31) and selectors (D4) all read the same columns.

Defined results: a page without html has no tokens, no elements and no text.
Formatting elements left open end with their block; they are not opened
again.  Visibility has no layout: elements that are never rendered,
``hidden``, inline ``display:none``, ``input type=hidden``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import decode_entities, js_trim, let
from webloom.operators.outline import BLOCK as BREAKS
from webloom.operators.outline import CLOSES_P, NEVER_RENDERED, REPLACED, VOID

HIDDEN, PRE, LINK, BOILER, MAIN = 1, 2, 4, 8, 16
BLOCK = 128

# Elements whose content is not markup; boilerplate elements and classes; where p's search stops.
RAW = ("script", "style", "template", "noscript", "textarea", "title")
BOILER_TAGS = ("nav", "header", "footer", "aside")
BOILER_CLASSES = ("ad", "ads", "advert", "advertisement")
MAIN_TAGS = ("article", "main")
_P_SCOPE = ("table", "td", "th", "caption", "button", "object", "template", "marquee", "applet")
# A start tag, the open elements that it closes, and the ones beyond which it closes none.
CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
             "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
             "option": (("option",), ("select",)), "a": (("a",), _P_SCOPE), "body": (("head",), ())}

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN_RE = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*>|\z)"
            rf"|</?[a-z]{_ATTRS}(?:>|\z)|<[!?/][^>]*+(?:>|\z)|[^<]++|<")
_HEAD_RE = rf"(?is)^<[a-z]{_ATTRS}>?"
_START_RE = rf"(?is)^<(?:[a-z].*>$|(?:{'|'.join(RAW)})(?=[\s/>]){_ATTRS}>)"
_TAG_RE = r"^</?([a-zA-Z][^\s/>]*)"
_ATTR_RE = r"""[^\s"'<>/=]+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))?"""
_PARTS_RE = r"""(?s)^([^\s"'<>/=]+)(?:\s*=\s*(.*))?$"""

TEXT, START, VOID_EL, END, OTHER = 0, 1, 2, 3, 4
_INK_RE = r"[^ \t\r\n\f\x{0B}]"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _rules(*pairs) -> Column:
    return F.array(*[F.struct(_strings(c).alias("c"), _strings(b).alias("b")) for c, b in pairs])


_NO_RULES = "array<struct<c:array<string>,b:array<string>>>"


def _attrs(head: Column, tag: Column) -> Column:
    """array<struct<name, value>> of a start tag, names in lower case, values decoded, '' without one."""
    found = F.regexp_extract_all(F.substring(head, F.length(tag) + 2, F.length(head)), F.lit(_ATTR_RE), F.lit(0))

    def one(a: Column) -> Column:
        raw = F.regexp_extract(a, _PARTS_RE, 2)
        quoted = raw.startswith('"') | raw.startswith("'")
        value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(F.lower(F.regexp_extract(a, _PARTS_RE, 1)).alias("name"), decode_entities(value).alias("value"))
    return F.transform(found, one)


def attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute of that name, NULL without one."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def classes(attrs: Column) -> Column:
    """The class names, parted by white space."""
    return F.filter(F.split(F.coalesce(attr(attrs, "class"), F.lit("")), r"[ \t\r\n\f]+"), lambda c: c != "")


def tokens(html: Column) -> Column:
    """array<struct<i, t, kind, tag, attrs, f, brk, repl, ink, rules>>: what the fold has to know of each token."""
    def one(t: Column, i: Column) -> Column:
        # A tag that the page's end cuts off is none.
        start, end = t.rlike(_START_RE), t.rlike("(?s)^</[a-zA-Z].*>$")
        tag = F.when(start | end, F.lower(F.regexp_extract(t, _TAG_RE, 1))).otherwise(F.lit(""))
        return F.struct(i.alias("i"), t.alias("t"), start.alias("start"), end.alias("end"), tag.alias("tag"))

    def two(x: Column) -> Column:
        head = F.when(x["tag"].isin(*RAW), F.regexp_extract(x["t"], _HEAD_RE, 0)).otherwise(x["t"])
        attrs = F.when(~x["start"] | ~head.rlike(r"[\s/]"), F.array().cast("array<struct<name:string,value:string>>")) \
            .otherwise(_attrs(head, x["tag"]))
        return F.struct(x["i"].alias("i"), x["t"].alias("t"), x["start"].alias("start"), x["end"].alias("end"), x["tag"].alias("tag"),
                        attrs.alias("attrs"))

    def three(x: Column) -> Column:
        tag, attrs = x["tag"], x["attrs"]
        text = ~x["start"] & ~x["end"] & (~x["t"].startswith("<") | (x["t"] == "<"))
        kind = (F.when(text, TEXT).when(x["start"], F.when(tag.isin(*VOID, *RAW), VOID_EL).otherwise(START))
                .when(x["end"], END).otherwise(OTHER))
        hidden = x["start"] & (tag.isin(*NEVER_RENDERED) | F.exists(attrs, lambda a: a["name"] == "hidden")
                               | F.coalesce(attr(attrs, "style").rlike(r"(?i)display\s*:\s*none"), F.lit(False))
                               | ((tag == "input") & (F.lower(F.coalesce(attr(attrs, "type"), F.lit(""))) == "hidden")))
        boiler = tag.isin(*BOILER_TAGS) | F.exists(classes(attrs), lambda c: F.lower(c).isin(*BOILER_CLASSES))
        f = (F.when(hidden, HIDDEN).otherwise(0) + F.when(tag == "pre", PRE).otherwise(0) + F.when(tag == "a", LINK).otherwise(0)
             + F.when(boiler, BOILER).otherwise(0) + F.when(tag.isin(*MAIN_TAGS), MAIN).otherwise(0))
        rules = F.when(x["end"], F.array(F.struct(F.array(tag).alias("c"), _strings(()).alias("b"))))
        p = (("p",), _P_SCOPE)
        for name, rule in CLOSED_BY.items():
            rules = rules.when(tag == name, _rules(rule, p) if name in CLOSES_P else _rules(rule))
        rules = rules.when(tag.isin(*CLOSES_P), _rules(p)).otherwise(F.array().cast(_NO_RULES))
        return F.struct(x["i"].alias("i"), x["t"].alias("t"), kind.cast("int").alias("kind"), tag.alias("tag"), attrs.alias("attrs"),
                        f.cast("int").alias("f"), tag.isin(*BREAKS).alias("brk"), tag.isin(*REPLACED).alias("repl"),
                        (text & x["t"].rlike(_INK_RE)).alias("ink"), rules.cast(_NO_RULES).alias("rules"))

    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RE), F.lit(0))
    return F.transform(F.transform(F.transform(found, one), two), three)


_OPEN = "struct<pos:int,tag:string,f:int,kids:int,n0:int,r0:int,depth:int,parent:int,sib:int>"
_SPAN = "struct<pos:int,end:int,depth:int,parent:int,sib:int,f:int,n0:int,n1:int,r0:int,r1:int>"
_MARK = "struct<pos:int,line:int,f:int,sp:boolean>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _closed(e: Column, end: Column, n: Column, r: Column) -> Column:
    return F.struct(e["pos"].alias("pos"), end.alias("end"), e["depth"].alias("depth"), e["parent"].alias("parent"), e["sib"].alias("sib"),
                    e["f"].alias("f"), e["n0"].alias("n0"), n.alias("n1"), e["r0"].alias("r0"), r.alias("r1")).cast(_SPAN)


def _kept(stack: Column, x: Column) -> Column:
    """How many open elements stay open at this token."""
    size = F.size(stack)

    def by(rule: Column, tags: Column) -> Column:
        # The innermost open element that the rule closes, unless one that bars it lies further in.
        at = F.array_min(F.filter(F.transform(rule["c"], lambda t: F.array_position(tags, t).cast("int")), lambda p: p > 0))
        return let(at, lambda p: F.when(p.isNotNull() & ~F.arrays_overlap(F.slice(tags, F.lit(1), F.coalesce(p, F.lit(1)) - 1), rule["b"]), size - p)
                   .otherwise(size))
    return F.when(F.size(x["rules"]) == 0, size).otherwise(let(
        F.reverse(stack["tag"]), lambda tags: F.array_min(F.transform(x["rules"], lambda r: by(r, tags)))))


def _step(acc: Column, x: Column) -> Column:
    """The state after a token: stack, roots, out, marks, line, n (texts), r (replaced elements), sp."""
    stack = acc["stack"]

    def with_kept(kept: Column) -> Column:
        top = F.get(stack, kept - 1)
        inside = F.coalesce(top["f"], F.lit(0))
        shown = inside.bitwiseAND(HIDDEN) == 0
        element = x["kind"].isin(START, VOID_EL)
        flags = inside.bitwiseOR(x["f"])
        closed = F.transform(F.slice(stack, kept + 1, F.size(stack) - kept), lambda e: _closed(e, x["i"], acc["n"], acc["r"]))
        sib = F.coalesce(top["kids"], acc["roots"])
        parent = F.coalesce(top["pos"], F.lit(-1))
        counted = F.struct(top["pos"].alias("pos"), top["tag"].alias("tag"), top["f"].alias("f"), (top["kids"] + 1).alias("kids"),
                           top["n0"].alias("n0"), top["r0"].alias("r0"), top["depth"].alias("depth"), top["parent"].alias("parent"),
                           top["sib"].alias("sib")).cast(_OPEN)
        base = F.when(element & (kept > 0), F.concat(F.slice(stack, F.lit(1), kept - 1), F.array(counted))) \
            .otherwise(F.slice(stack, F.lit(1), kept))
        opened = F.struct(x["i"].alias("pos"), x["tag"].alias("tag"), flags.alias("f"), F.lit(0).alias("kids"), acc["n"].alias("n0"),
                          acc["r"].alias("r0"), kept.alias("depth"), parent.alias("parent"), sib.alias("sib")).cast(_OPEN)
        more = F.when(element & x["repl"] & (flags.bitwiseAND(HIDDEN) == 0), 1).otherwise(0)
        alone = _closed(opened, x["i"] + 1, acc["n"], acc["r"] + more)
        text = (x["kind"] == TEXT) & shown
        inked = text & (x["ink"] | (inside.bitwiseAND(PRE) != 0))
        mark = F.struct(x["i"].alias("pos"), acc["line"].alias("line"), inside.alias("f"), acc["sp"].alias("sp")).cast(_MARK)
        return F.struct(
            F.when(x["kind"] == START, F.concat(base, F.array(opened))).otherwise(base).alias("stack"),
            (acc["roots"] + F.when(element & (kept == 0), 1).otherwise(0)).alias("roots"),
            F.when(x["kind"] == VOID_EL, F.concat(acc["out"], closed, F.array(alone))).when(F.size(closed) > 0, F.concat(acc["out"], closed))
            .otherwise(acc["out"]).alias("out"),
            F.when(inked, F.concat(acc["marks"], F.array(mark))).otherwise(acc["marks"]).alias("marks"),
            (acc["line"] + F.when(x["brk"] & shown, 1).otherwise(0)).alias("line"),
            (acc["n"] + F.when(inked, 1).otherwise(0)).alias("n"),
            (acc["r"] + more).alias("r"),
            F.when(inked | x["brk"], F.lit(False)).when(text, F.lit(True)).otherwise(acc["sp"]).alias("sp"))
    return let(_kept(stack, x), with_kept)


def _fold(toks: Column) -> Column:
    """struct<spans, marks>; a block's own lists begin empty and are put together at the end."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(toks), F.lit(1)) - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(toks, k * BLOCK + 1, BLOCK))

    def state(stack, roots, out, marks, line, n, r, sp) -> Column:
        return F.struct(stack.alias("stack"), roots.alias("roots"), out.alias("out"), marks.alias("marks"), line.alias("line"),
                        n.alias("n"), r.alias("r"), sp.alias("sp"))

    def block(acc: Column, b: Column) -> Column:
        fresh = state(acc["stack"], acc["roots"], _none(_SPAN), _none(_MARK), acc["line"], acc["n"], acc["r"], acc["sp"])
        return let(F.aggregate(b, fresh, _step), lambda s: state(
            s["stack"], s["roots"], F.concat(acc["out"], F.array(s["out"])), F.concat(acc["marks"], F.array(s["marks"])),
            s["line"], s["n"], s["r"], s["sp"]))

    zero = state(_none(_OPEN), F.lit(0), _none(f"array<{_SPAN}>"), _none(f"array<{_MARK}>"), F.lit(0), F.lit(0), F.lit(0), F.lit(False))

    def finish(s: Column) -> Column:
        rest = F.transform(s["stack"], lambda e: _closed(e, F.size(toks), s["n"], s["r"]))
        return F.struct(F.array_sort(F.concat(F.flatten(s["out"]), rest)).alias("spans"), F.flatten(s["marks"]).alias("marks"))
    return F.aggregate(blocks, zero, block, finish)


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of ``pages``, and ``toks``, ``spans`` and ``marks`` (the shown texts)."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, element_columns(F.col(html)).alias("_f")).select(*keep, "_f.toks", "_f.spans", "_f.marks")


def element_columns(html: Column) -> Column:
    """struct<toks, spans, marks> of a page; each part is made once."""
    return let(tokens(html), lambda t: let(_fold(t), lambda f: F.struct(
        t.alias("toks"), f["spans"].alias("spans"), f["marks"].alias("marks"))))


# ---- text ----------------------------------------------------------------------

_HELD = (("\u0001", " "), ("\u0002", "\n"), ("\u0003", "\t"))       # white space of pre, held while the rest is collapsed


def mark_text(toks: Column, m: Column) -> Column:
    """A shown text, decoded, its white space collapsed (kept inside ``pre``), with the space before it."""
    raw = decode_entities(F.get(toks, m["pos"])["t"])
    held = F.translate(raw, " \n\t\r", "\u0001\u0002\u0003")
    plain = F.regexp_replace(raw, r"[ \t\r\n\f\x{0B}]+", " ")
    text = F.when(m["f"].bitwiseAND(PRE) != 0, held).otherwise(plain)
    return F.when(m["sp"], F.concat(F.lit(" "), text)).otherwise(text)


def _tidy(line: Column) -> Column:
    return F.regexp_replace(line, r"^ +| +(?= |$)", "")


def released(text: Column) -> Column:
    return F.translate(text, "".join(h for h, _ in _HELD), "".join(w for _, w in _HELD))


def by_line(marks: Column, piece) -> Column:
    """array<string>: ``piece`` of every mark, put together line by line."""
    def one(m: Column, i: Column) -> Column:
        new = (i > 0) & (F.get(marks, i - 1)["line"] != m["line"])
        return F.concat(F.when(new, F.lit("\n")).otherwise(F.lit("")), piece(m))
    return F.split(F.array_join(F.transform(marks, one), ""), "\n")


def text_lines(toks: Column, marks: Column) -> Column:
    """The page's lines of text in order, without empty ones; white space of ``pre`` still held."""
    return F.filter(F.transform(by_line(marks, lambda m: mark_text(toks, m)), _tidy), lambda x: x != "")


def rendered_text(toks: Column, marks: Column) -> Column:
    """The text as a reader sees it, one line for each block."""
    return js_trim(released(F.array_join(text_lines(toks, marks), "\n")))


# ---- main article --------------------------------------------------------------

def text_blocks(toks: Column, marks: Column) -> Column:
    """array<struct<text, words, linked, boiler, main>>: the lines, with their words, the share of them in
    links, and whether they stand in boilerplate or in an article."""
    flags = by_line(marks, lambda m: F.concat(F.when(m["f"].bitwiseAND(BOILER) != 0, "B").otherwise(""),
                                              F.when(m["f"].bitwiseAND(MAIN) != 0, "M").otherwise("")))
    linked = by_line(marks, lambda m: F.when(m["f"].bitwiseAND(LINK) != 0, F.concat(F.lit(" "), mark_text(toks, m), F.lit(" "))).otherwise(""))
    rows = F.arrays_zip(by_line(marks, lambda m: mark_text(toks, m)).alias("t"), linked.alias("l"), flags.alias("g"))

    def count(s: Column) -> Column:
        return F.size(F.filter(F.split(s, r"[ \x{01}\x{02}\x{03}]+"), lambda w: w != ""))

    blocks = F.transform(rows, lambda z: F.struct(_tidy(z["t"]).alias("text"), count(z["t"]).alias("words"), count(z["l"]).alias("linked"),
                                                  z["g"].contains("B").alias("boiler"), z["g"].contains("M").alias("main")))
    return F.filter(blocks, lambda b: b["text"] != "")


def _density(b: Column) -> Column:
    return F.coalesce(b["linked"] / F.greatest(b["words"], F.lit(1)), F.lit(0.0))


def is_content(prev: Column, block: Column, following: Column) -> Column:
    """The published decision tree on words and link density of a block and its neighbours (fixed thresholds)."""
    words, before, after = block["words"], F.coalesce(prev["words"], F.lit(0)), F.coalesce(following["words"], F.lit(0))
    plain = F.when(words > 16, True).otherwise((after > 15) | (before > 4))
    beside_links = F.when(words > 40, True).otherwise(after > 17)
    return (_density(block) <= 0.333333) & F.when(_density(prev) <= 0.555556, plain).otherwise(beside_links)


def article_text(blocks: Column) -> Column:
    """The article's lines, or without an article those that the decision tree calls content."""
    inside = F.filter(blocks, lambda b: b["main"] & ~b["boiler"])
    rest = F.filter(blocks, lambda b: ~b["boiler"])
    scored = F.filter(F.transform(rest, lambda b, i: F.struct(b["text"].alias("text"), is_content(
        F.get(rest, i - 1), b, F.get(rest, i + 1)).alias("keep"))), lambda b: b["keep"])
    lines = F.when(F.exists(blocks, lambda b: b["main"]), F.transform(inside, lambda b: b["text"])) \
        .otherwise(F.transform(scored, lambda b: b["text"]))
    return js_trim(released(F.array_join(lines, "\n")))


def main_article(pages: DataFrame) -> DataFrame:
    """``(page_id, text_length, text)``: the main text of each page."""
    cut = with_elements(pages.select("page_id", "html"))
    blocks = cut.select("page_id", text_blocks(F.col("toks"), F.col("marks")).alias("blocks"))
    return (blocks.select("page_id", article_text(F.col("blocks")).alias("text"))
            .select("page_id", F.length("text").cast("bigint").alias("text_length"), "text"))


# ---- elements ------------------------------------------------------------------

NAME_CHARS = 50


def element_rows(pages: DataFrame) -> DataFrame:
    """One row for each element: ``(page_id, pos, end, depth, parent, sib, tag, attrs, hidden, name_text)``.

    ``pos`` and ``end`` count tokens; the element contains what lies in
    ``[pos, end)``.  ``hidden`` holds for all that is inside a hidden element
    and for elements with neither shown text nor replaced content.
    ``name_text`` is the first line of all text inside, cut to 50 characters.
    """
    cut = with_elements(pages.select("page_id", "html"))
    named = cut.select("page_id", "toks", "spans", "marks",
                       F.transform("marks", lambda m: F.struct(m["line"].alias("line"), mark_text(F.col("toks"), m).alias("text"))).alias("texts"))

    def row(s: Column) -> Column:
        tok = F.get(F.col("toks"), s["pos"])
        # A mark has a character at least, so more than 51 of them never reach the name.
        own = F.slice("texts", s["n0"] + 1, F.least(s["n1"] - s["n0"], F.lit(NAME_CHARS + 1)))
        first = F.array_join(F.transform(F.filter(own, lambda t: t["line"] == F.get(own, F.lit(0))["line"]), lambda t: t["text"]), "")
        line = F.get(F.filter(F.split(released(_tidy(first)), "\n"), lambda x: x.rlike(_INK_RE)), F.lit(0))
        name = js_trim(F.substring(js_trim(line), 1, NAME_CHARS))
        empty = (s["n0"] == s["n1"]) & (s["r0"] == s["r1"])
        return F.struct(s["pos"].cast("bigint").alias("pos"), s["end"].cast("bigint").alias("end"), s["depth"].alias("depth"),
                        s["parent"].cast("bigint").alias("parent"), s["sib"].alias("sib"), tok["tag"].alias("tag"), tok["attrs"].alias("attrs"),
                        ((s["f"].bitwiseAND(HIDDEN) != 0) | empty).alias("hidden"), F.coalesce(name, F.lit("")).alias("name_text"))
    return named.select("page_id", F.explode(F.transform("spans", row)).alias("e")).select("page_id", "e.*")
