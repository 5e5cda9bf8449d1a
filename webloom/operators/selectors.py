"""D4 selectors over elements, P20 ref rewriting, U1 user page functions.

A selector is compiled to conditions on the element intervals of
``operators.elements``.  A compound (``tag``, ``*``, ``#id``, ``.class``,
``[attr]``, ``[attr="v"]`` and the operators ``~= |= ^= $= *=``) is tested on
an element's own attributes; a class is one of the names parted by white
space.  Combinators are conditions between two elements of a page: `` ``
(interval contained), ``>`` (parent), ``+`` (next sibling) and ``~`` (later
sibling).  A comma gives alternatives.  All of it is evaluated inside the
row: no join and no shuffle, and comments, raw text and quoted values never
match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import let
from webloom.operators.elements import attr, classes, element_columns, tokens, with_elements
from webloom.operators.outline import REF_ATTR

_NAME = r"[\w-]+"
_PART = re.compile(rf"""\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s"']+))\s*)?\]""", re.X)
_COMPOUND = re.compile(rf"(?P<tag>{_NAME}|\*)?(?P<parts>(?:{_PART.pattern.replace('?P<', '?P<x_')})*)", re.X)


@dataclass(frozen=True)
class Compound:
    """One element's conditions, and how it stands to the one before it."""
    relation: str                               # "", " ", ">", "+", "~"
    tag: str                                    # "*" for any
    conditions: tuple[tuple[str, str, str], ...]       # (attribute, operator, value)


def parse_selector(selector: str) -> list[list[Compound]]:
    """The alternatives of a selector, each a chain of compounds from left to right."""
    if selector.startswith("ref:"):
        return [[Compound("", "*", ((REF_ATTR, "=", selector[4:]),))]]
    chains, chain, at, relation = [], [], 0, ""
    text = selector.strip()
    while True:
        m = _COMPOUND.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not a selector: {selector!r}")
        conditions = []
        for p in _PART.finditer(m["parts"]):
            if p["id"]:
                conditions.append(("id", "=", p["id"]))
            elif p["cls"]:
                conditions.append(("class", "~=", p["cls"]))
            else:
                value = next((v for v in (p["dq"], p["sq"], p["bare"]) if v is not None), "")
                conditions.append((p["attr"].lower(), p["op"] or "", value))
        chain.append(Compound(relation, (m["tag"] or "*").lower(), tuple(conditions)))
        at = m.end()
        if at == len(text):
            return [*chains, chain]
        sep = re.compile(r"\s*([>+~,])\s*|\s+").match(text, at)
        if not sep:
            raise ValueError(f"not a selector: {selector!r}")
        relation, at = sep[1] or " ", sep.end()
        if relation == ",":
            chains, chain, relation = [*chains, chain], [], ""


def resolve_selector(sel) -> Column:
    """P20: ``ref:x`` -> ``[<REF_ATTR>="x"]``; other selectors unchanged."""
    s = F.col(sel) if isinstance(sel, str) else sel
    return F.when(s.startswith("ref:"), F.concat(F.lit(f'[{REF_ATTR}="'), F.substring(s, 5, 1 << 30),
                                                  F.lit('"]'))).otherwise(s)


def _holds(attrs: Column, name: str, op: str, value: str) -> Column:
    v = attr(attrs, name)
    test = {"": lambda: v.isNotNull(), "=": lambda: v == value,
            "~=": lambda: F.array_contains(classes(attrs), value) if name == "class"
            else F.array_contains(F.split(v, r"[ \t\r\n\f]+"), value),
            "|=": lambda: (v == value) | v.startswith(value + "-"), "^=": lambda: v.startswith(value),
            "$=": lambda: v.endswith(value), "*=": lambda: v.contains(value)}[op]()
    if op in ("~=", "^=", "$=", "*=") and not value:
        return F.lit(False)                     # an empty value matches nothing
    return F.coalesce(test, F.lit(False))


def _is(tok: Column, c: Compound) -> Column:
    """Whether a start tag meets a compound's conditions."""
    test = tok["kind"].isin(1, 2) if c.tag == "*" else tok["kind"].isin(1, 2) & (tok["tag"] == c.tag)
    for name, op, value in c.conditions:
        test = test & _holds(tok["attrs"], name, op, value)
    return test


def _stands(relation: str, before: Column, e: Column) -> Column:
    if relation == " ":
        return (before["pos"] < e["pos"]) & (e["pos"] < before["end"])
    if relation == ">":
        return e["parent"] == before["pos"]
    same = (e["parent"] == before["parent"]) & (e["pos"] != before["pos"])
    return same & (e["sib"] == before["sib"] + 1) if relation == "+" else same & (e["sib"] > before["sib"])


def _chain(toks: Column, spans: Column, chain: list[Compound]) -> Column:
    """The spans that end a chain of compounds."""
    def own(c: Compound) -> Column:
        return F.filter(spans, lambda s: _is(F.get(toks, s["pos"]), c))

    def follow(found: Column, rest: list[Compound]) -> Column:
        if not rest:
            return found
        step, *later = rest
        return let(found, lambda before: follow(F.when(F.size(before) == 0, before).otherwise(F.filter(
            own(step), lambda e: F.exists(before, lambda b: _stands(step.relation, b, e)))), later))
    return follow(own(chain[0]), chain[1:])


def matching(toks: Column, spans: Column, selector: str) -> Column:
    """The spans of the elements that a selector matches, in document order."""
    found = [_chain(toks, spans, chain) for chain in parse_selector(selector)]
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found)))


def select_all(pages: DataFrame, selectors) -> DataFrame:
    """``(page_id, selector, pos, end, depth, tag)``: the elements that each selector matches, from one reading of the pages."""
    cut = with_elements(pages.select("page_id", "html"))

    def rows(selector: str) -> Column:
        return F.transform(matching(F.col("toks"), F.col("spans"), selector), lambda s: F.struct(
            F.lit(selector).alias("selector"), s["pos"].cast("bigint").alias("pos"), s["end"].cast("bigint").alias("end"),
            s["depth"].alias("depth"), F.get(F.col("toks"), s["pos"])["tag"].alias("tag")))
    return cut.select("page_id", F.explode(F.concat(*[rows(x) for x in selectors])).alias("e")).select("page_id", "e.*")


def select_elements(pages: DataFrame, selector: str) -> DataFrame:
    """``(page_id, pos, end, depth, tag)``: the elements that a selector matches."""
    return select_all(pages, [selector]).drop("selector")


def has_element(html: Column, selector: str) -> Column:
    """Whether a page has an element that a selector matches.  Without combinators no intervals are made."""
    chains = parse_selector(selector)
    if all(len(c) == 1 for c in chains):
        return F.exists(tokens(html), lambda t: _any([_is(t, c[0]) for c in chains]))
    return let(element_columns(html), lambda e: _any([F.size(_chain(e["toks"], e["spans"], c)) > 0 for c in chains]))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def pages_with(pages: DataFrame, selector: str, present: bool = True) -> DataFrame:
    """Pages that contain (``present``) or lack an element matching ``selector``; a page without html lacks it."""
    cond = has_element(F.col("html"), selector)
    return pages.where(cond if present else ~cond)


def evaluate_pages(pages: DataFrame, fn, return_type: str = "string",
                   cols=("page_id", "html")) -> DataFrame:
    """Apply a Python function to each page's html in Arrow batches;
    ``(page_id, value, error)`` -- an exception becomes an error row."""
    import pandas as pd

    def run(it):
        for pdf in it:
            vals, errs = [], []
            for h in pdf[cols[1]]:
                try:
                    vals.append(fn(h)), errs.append(None)
                except Exception as e:  # noqa: BLE001
                    vals.append(None), errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"page_id": pdf[cols[0]], "value": vals, "error": errs})

    return pages.select(*cols).mapInPandas(run, f"page_id bigint, value {return_type}, error string")
