"""Text cleaning as Spark Column expressions.

Everything here compiles to built-in expressions (regexp_replace,
replace, transform ...) so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set a browser's String.prototype.trim
# removes (ECMAScript WhiteSpace + LineTerminator), as a regex class usable
# by both Java regex and RE2.
JS_SPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# ASCII white space as the HTML spec defines it (used for
# squeezing markup and for innerText collapsing).
ASCII_SPACE_CLASS = r"[ \t\n\r\f\x{0B}]"

# The usual named character references, looked up first.
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"),
    ("&raquo;", "»"), ("&bull;", "•"), ("&deg;", "°"),
    ("&euro;", "€"), ("&pound;", "£"), ("&yen;", "¥"),
    ("&cent;", "¢"), ("&sect;", "§"), ("&para;", "¶"),
    ("&times;", "×"), ("&divide;", "÷"), ("&plusmn;", "±"),
    ("&amp;", "&"),
]

_REF = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _all_named() -> Column:
    """The standard table of named references (from Python's library) as a map
    literal; only names that the short table above lacks are looked up there."""
    import json
    from html.entities import html5
    table = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """String.prototype.trim: strip Unicode white space and the BOM at both ends."""
    return F.regexp_replace(_col(c), f"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$", "")


def squeeze_spaces(c) -> Column:
    """Collapse every run of ASCII white space to one space."""
    return F.regexp_replace(_col(c), f"{ASCII_SPACE_CLASS}+", " ")


def strip_tags(c) -> Column:
    """Drop markup tags, keeping the text between them."""
    return F.regexp_replace(_col(c), r"<[^>]*>", "")


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times in ``fn`` (a one-element
    ``transform``).  Keeps expression trees linear instead of duplicating a
    sub-expression at every use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _codepoint_to_str(n: Column) -> Column:
    # Big-endian UTF-32 bytes of the code point, decoded by the JVM.
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(ref: Column) -> Column:
    is_hex = ref.rlike("^#[xX]")
    code = F.when(is_hex, F.conv(F.substring(ref, 3, 7), 16, 10).cast("int")) \
            .otherwise(F.substring(ref, 2, 8).try_cast("int"))
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, _codepoint_to_str(code))


def _decode_one(p: Column) -> Column:
    """The text after an ampersand, its reference decoded if it begins with one."""
    short = F.create_map(*[F.lit(x) for name, value in NAMED_ENTITIES for x in (name[1:-1], value)])
    every = _all_named()

    def body(ref: Column) -> Column:
        named = F.coalesce(F.try_element_at(short, ref), F.try_element_at(every, ref))
        value = F.when(ref == "", F.lit(None).cast("string")).when(ref.startswith("#"), _numeric(ref)).otherwise(named)
        return F.coalesce(F.concat(value, F.substring(p, F.length(ref) + 2, 1 << 30)), F.concat(F.lit("&"), p))
    return let(F.regexp_extract(p, _REF, 1), body)


def decode_entities(c) -> Column:
    """Decode HTML character references (all named ones and numeric ones), each
    once, left to right: "&amp;lt;" gives "&lt;".

    Entity-free strings skip the work (``contains('&')`` guard).
    """
    def parts(p: Column) -> Column:
        rest = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), _decode_one)
        return F.concat(F.element_at(p, 1), F.array_join(rest, ""))

    def body(s: Column) -> Column:
        return F.when(s.contains("&"), let(F.split(s, "&"), parts)).otherwise(s)
    return let(_col(c), body)


BR_RE = r"(?i)<br\b[^>]*>"
_BR_MARK = "\u0001"     # stands for a <br> line break while white space is collapsed


def inner_text(c) -> Column:
    """Rendered text of an inline fragment (innerText + trim): ``<br>`` is a
    line break, other tags are dropped, entities decoded, white-space runs
    collapsed to one space (none kept around a line break), ends trimmed."""
    s = F.regexp_replace(_col(c), BR_RE, _BR_MARK)
    s = squeeze_spaces(decode_entities(strip_tags(s)))
    s = F.regexp_replace(s, f" ?{_BR_MARK} ?", "\n")
    return js_trim(s)


# ---- DuckDB (oracle) spellings of the same rules -------------------------------

def sql_decode_entities(expr: str) -> str:
    out = expr
    for name, value in NAMED_ENTITIES:
        v = value.replace("'", "''")
        out = f"replace({out}, '{name}', '{v}')"
    return out


def sql_js_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$', '', 'g')"


def sql_squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, '{ASCII_SPACE_CLASS}+', ' ', 'g')"


def sql_strip_tags(expr: str) -> str:
    return f"regexp_replace({expr}, '<[^>]*>', '', 'g')"


def sql_inner_text(expr: str) -> str:
    marked = f"regexp_replace({expr}, '{BR_RE}', chr(1), 'g')"
    s = sql_squeeze(sql_decode_entities(sql_strip_tags(marked)))
    return sql_js_trim(f"regexp_replace({s}, ' ?' || chr(1) || ' ?', chr(10), 'g')")
