"""JSON text exactly as ``JSON.stringify`` prints it.

:func:`pretty` compiles a column's type to a Column that prints nested data
in JS form (two spaces, key order, escapes, numbers) with built-in functions.

``JSON.stringify(JSON.parse(s))`` of a text that is JSON already:

Spark's ``to_json(parse_json(x))`` sorts keys, prints ``2e2`` as ``200.0``
and rejects duplicate keys, so the canonical form is computed by a small
per-value helper inside an Arrow-batched pandas UDF.  Only JSON-typed
bodies are sent to Python (others are passed as NULL).
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import let


_LONE = re.compile("[\ud800-\udfff]")
_INDEX = re.compile("0|[1-9][0-9]{0,9}")


def js_number(x: float) -> str:
    """Number.prototype.toString for a double (ECMAScript Number::toString)."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    r = repr(float(x))
    neg = r.startswith("-")
    if neg:
        r = r[1:]
    mant, _, exp = r.partition("e")
    e = int(exp) if exp else 0
    intpart, _, frac = mant.partition(".")
    digits = (intpart + frac).lstrip("0")
    point = len(intpart) + e if intpart != "0" else e - (len(frac) - len(frac.lstrip("0")))
    digits = digits.rstrip("0") or "0"
    k, n = len(digits), point
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = digits[:n] + "." + digits[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * (-n) + digits
    else:
        e2 = n - 1
        sign = "+" if e2 >= 0 else "-"
        out = (digits[0] + ("." + digits[1:] if k > 1 else "")) + "e" + sign + str(abs(e2))
    return ("-" if neg else "") + out


def _dump(v) -> str:
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    if isinstance(v, (int, float)):
        try:
            x = float(v)
        except OverflowError:
            x = math.inf
        return js_number(x) if math.isfinite(x) else "null"
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, list):
        return "[" + ",".join(_dump(x) for x in v) + "]"
    return "{" + ",".join(_quoted(k) + ":" + _dump(x) for k, x in _js_order(v)) + "}"


def _quoted(s: str) -> str:
    """A JSON string; a surrogate that stands alone is escaped, as JS does."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _js_order(v: dict) -> list:
    """Members as a JS object lists them: integer keys first, by number."""
    numbers = [k for k in v if _INDEX.fullmatch(k) and int(k) < 4294967295]
    if not numbers:
        return list(v.items())
    first = sorted(numbers, key=int)
    return [(k, v[k]) for k in first] + [(k, x) for k, x in v.items() if k not in set(numbers)]


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def canonical_json(text: str | None) -> str | None:
    """Re-serialised JSON (compact, insertion order, duplicate keys: first
    position / last value, JS number text); None when ``text`` is not JSON."""
    if text is None:
        return None
    try:
        # All numbers are doubles in JS; a number of any length is read as one.
        return _dump(json.loads(text.removeprefix("\ufeff"), parse_int=float, parse_constant=_no_constant))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_json, na_action="ignore")


def _pretty(v, ind: str) -> str:
    nxt = ind + "  "
    if isinstance(v, dict):
        if not v:
            return "{}"
        items = [f"{nxt}{_quoted(k)}: {_pretty(x, nxt)}" for k, x in _js_order({str(k): x for k, x in v.items()})]
        return "{\n" + ",\n".join(items) + "\n" + ind + "}"
    if isinstance(v, (list, tuple)):
        if not v:
            return "[]"
        return "[\n" + ",\n".join(nxt + _pretty(x, nxt) for x in v) + "\n" + ind + "]"
    return _dump(v)


def pretty_json(value) -> str:
    """``JSON.stringify(value, null, 2)``: two-space indent, ``"k": v``, ``[]``/``{}``
    for empty containers, JS number text."""
    return _pretty(value, "")


def _plain(v):
    """Arrow-decoded values (Row-like dicts, numpy arrays) to plain Python."""
    import numpy as np
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, np.ndarray)):
        return [_plain(x) for x in v]
    if isinstance(v, np.generic):
        return v.item()
    return v


@F.pandas_udf(T.StringType())
def pretty_json_udf(s: pd.Series) -> pd.Series:
    """K1 over an array/struct column (Arrow batches)."""
    return s.map(lambda v: pretty_json(_plain(v)) if v is not None else None)


# ---- nested data as a Column -----------------------------------------------------------

# The escapes that JSON.stringify uses; other characters below 20 hex are \\u00xx.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def json_string(c: Column) -> Column:
    """A JSON string of a text, NULL as ``null``."""
    def body(s: Column) -> Column:
        out = s
        for raw, escaped in _ESCAPES:
            out = F.replace(out, F.lit(raw), F.lit(escaped))
        rare = out
        for code in range(0x20):
            if chr(code) not in "\b\f\n\r\t":
                rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
        odd = F.when(s.rlike(r"[\x{00}-\x{07}\x{0B}\x{0E}-\x{1F}]"), rare).otherwise(out)
        return F.when(s.rlike(r'[\x{00}-\x{1F}"\\]'), odd).otherwise(s)
    return F.coalesce(F.concat(F.lit('"'), let(c, body), F.lit('"')), F.lit("null"))


def json_number(c: Column) -> Column:
    """A double as JS prints it; NULL, NaN and infinities as ``null``."""
    def body(x: Column) -> Column:
        def parts(t: Column) -> Column:
            digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
            point = F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0)) + F.length(F.regexp_extract(t, r"^-?([0-9]+)", 1))
            lead = F.length(F.regexp_extract(digits, "^0*", 0))
            plain = F.regexp_replace(digits, "^0+|0+$", "")
            return text(plain, point - lead)

        def text(d: Column, n: Column) -> Column:
            k = F.length(d)
            e = n - 1
            power = F.concat(F.when(k > 1, F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), k))).otherwise(d), F.lit("e"),
                             F.when(e >= 0, F.lit("+")).otherwise(F.lit("-")), F.abs(e).cast("string"))
            return (F.when((k <= n) & (n <= 21), F.rpad(d, F.greatest(n, F.lit(1)), "0"))
                    .when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
                    .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d)).otherwise(power))
        whole = F.when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), let(F.abs(x).cast("string"), parts)))
        # The JVM prints the least number with one digit too many.
        whole = F.when(F.abs(x) == 5e-324, F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("5e-324"))).otherwise(whole)
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("null")).otherwise(whole)
    return F.coalesce(let(c.cast("double"), body), F.lit("null"))


def pretty(c: Column, kind: T.DataType, omit: tuple[str, ...] = (), depth: int = 0) -> Column:
    """``JSON.stringify(value, null, 2)`` of a column of the type ``kind``.

    Struct fields named in ``omit`` are left out where they are NULL (a
    member that JS holds as undefined); other NULLs are ``null``.  Members of
    a map that look like array indices come first, by number.
    """
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth

    def closed(items: Column, left: str, right: str) -> Column:
        return let(items, lambda x: F.when(F.size(x) == 0, F.lit(left + right)).otherwise(
            F.concat(F.lit(left + inner), F.array_join(x, "," + inner), F.lit(outer + right))))

    if isinstance(kind, T.StringType):
        return json_string(c)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c.cast("string"), F.lit("null"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return json_number(c)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.cast("string"), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: pretty(x, kind.elementType, omit, depth + 1))
        return F.when(c.isNotNull(), closed(items, "[", "]")).otherwise(F.lit("null"))
    if isinstance(kind, T.MapType):
        entries = F.map_entries(c)
        number = lambda e: F.when(e["key"].rlike("^(0|[1-9][0-9]{0,9})$"), e["key"].try_cast("bigint"))              # noqa: E731
        index = lambda e: F.coalesce(number(e) < 4294967295, F.lit(False))                                           # noqa: E731
        first = F.transform(F.array_sort(F.transform(F.filter(entries, index), lambda e: F.struct(number(e).alias("n"), e.alias("e")))), lambda z: z["e"])
        ordered = F.concat(first, F.filter(entries, lambda e: ~index(e)))
        items = F.transform(ordered, lambda e: F.concat(json_string(e["key"]), F.lit(": "), pretty(e["value"], kind.valueType, omit, depth + 1)))
        return F.when(c.isNotNull(), closed(items, "{", "}")).otherwise(F.lit("null"))
    if isinstance(kind, T.StructType):
        members = []
        for f in kind.fields:
            v = c[f.name]
            text = F.concat(F.lit(_quoted(f.name) + ": "), pretty(v, f.dataType, omit, depth + 1))
            members.append(F.when(v.isNotNull(), text) if f.name in omit else text)
        items = F.array_compact(F.array(*members)) if members else F.array().cast("array<string>")
        return F.when(c.isNotNull(), closed(items, "{", "}")).otherwise(F.lit("null"))
    raise TypeError(f"no JSON form for {kind.simpleString()}")


def pretty_column(df: DataFrame, name: str, omit: tuple[str, ...] = ()) -> Column:
    """:func:`pretty` of a column of ``df``, by its own type."""
    return pretty(F.col(name), df.schema[name].dataType, omit)
