"""URL resolution and encoding as Column expressions (P5, §1.1.4-6).

``resolve_url(base, href)`` reproduces what a browser reports as
``a.href``: the reference resolved against the page URL, scheme and host
lower-cased, dot segments removed, and characters outside printable ASCII
percent-encoded as UTF-8 (per WHATWG percent-encode sets).  Host IDNA
(punycode) conversion is not done.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

SCHEME_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
SPLIT_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
DOTS_RE = r"(?i)^(\.|%2e){1,2}$"       # one or two dots, plain or percent-encoded
ONE_DOT_RE = r"(?i)^(\.|%2e)$"
AUTHORITY_RE = r"^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
SPECIAL_RE = r"(?i)^(https?|wss?|ftp):"
ORIGIN_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"

# The schemes' own ports, which a browser leaves out.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}

# Characters percent-encoded besides non-printable / non-ASCII
# ones, per WHATWG URL percent-encode sets (path, special query, fragment).
PATH_EXTRA = "\"<>`{}"
QUERY_EXTRA = "\"<>'"
FRAGMENT_EXTRA = "\"<>`"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _class(extra: str) -> str:
    esc = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in extra)
    return f"[^\\x{{21}}-\\x{{7E}}]|[{esc}]"


def percent_encode(c, extra: str = PATH_EXTRA) -> Column:
    """Percent-encode (UTF-8) each character outside printable ASCII or in ``extra``.

    Works per character with ``transform`` over ``split(x, '')`` only when
    such a character is present; pure-ASCII values pass through untouched.
    """
    cls = _class(extra)

    def body(s: Column) -> Column:
        enc = F.array_join(F.transform(
            F.split(s, ""),
            lambda ch: F.when(ch == " ", F.lit("%20"))
                        .when(ch.rlike(cls), F.url_encode(ch))
                        .otherwise(ch)), "")
        return F.when(s.rlike(cls), enc).otherwise(s)
    return let(_col(c), body)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal with a stack kept in ``aggregate``."""
    return let(path, _remove_dots)


def _remove_dots(path: Column) -> Column:
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    stack = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s.rlike(DOTS_RE), F.when(s.rlike(ONE_DOT_RE) | (F.size(acc) == 0), acc)
                              .otherwise(F.slice(acc, 1, F.size(acc) - 1)))
                        .otherwise(F.array_append(acc, s)))
    last = F.element_at(segs, -1)
    tail = F.when(last.rlike(DOTS_RE), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(F.lit("/"), F.array_join(stack, "/"), tail)
    out = F.regexp_replace(out, "//$", "/")
    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), out).otherwise(path)


def strip_url_ws(c) -> Column:
    """Browser pre-processing of an href: trim C0/space, drop tab and newlines."""
    s = F.regexp_replace(_col(c), r"^[\x{00}-\x{20}]+|[\x{00}-\x{20}]+$", "")
    return F.regexp_replace(s, r"[\t\n\r]", "")


def resolve_url(base, href) -> Column:
    """Absolute, normalised form of ``href`` relative to ``base`` (NULL href -> NULL)."""
    b = _col(base)
    return let(strip_url_ws(href), lambda h: let(_slashes(h, b), lambda x: normalize_url(_join(b, x))))


def _slashes(h: Column, base: Column) -> Column:
    """Backslashes before ``?`` and ``#`` are slashes in URLs of the web's schemes."""
    special = F.when(h.rlike(SCHEME_RE), h.rlike(SPECIAL_RE)).otherwise(base.rlike(SPECIAL_RE))
    head = F.regexp_extract(h, r"^[^?#]*", 0)
    fixed = F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substring(h, F.length(head) + 1, 1 << 30))
    return F.when(h.contains("\\") & special, fixed).otherwise(h)


# Punycode's parameters and digits (RFC 3492), and the other full stops of host names.
_BASE, _TMIN, _TMAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
_STOPS = "\u3002\uff0e\uff61"


def _digits(delta: Column, bias: Column) -> Column:
    """A number in Punycode's variable base; 64 bits need 13 digits at most."""
    def digit(d: Column) -> Column:
        return F.substring(F.lit(_DIGITS), d.cast("int") + 1, F.lit(1))

    def step(acc: Column, k: Column) -> Column:
        t = F.least(F.greatest(k - bias, F.lit(_TMIN)), F.lit(_TMAX)).cast("bigint")
        q = acc["q"]
        more = F.struct(F.floor((q - t) / (_BASE - t)).cast("bigint").alias("q"), F.concat(acc["s"], digit(t + (q - t) % (_BASE - t))).alias("s"),
                        F.lit(False).alias("done"))
        last = F.struct(q.alias("q"), F.concat(acc["s"], digit(q)).alias("s"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(q < t, last).otherwise(more)
    start = F.struct(delta.alias("q"), F.lit("").alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(_BASE), F.lit(_BASE * 13), F.lit(_BASE)), start, step)["s"]


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias for the next number."""
    half = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    limit = (_BASE - _TMIN) * _TMAX // 2
    start = F.struct((half + F.floor(half / points)).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("k"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, lambda a, _: F.when(a["d"] > limit, F.struct(
        F.floor(a["d"] / (_BASE - _TMIN)).cast("bigint").alias("d"), (a["k"] + _BASE).alias("k"))).otherwise(a))
    return let(end, lambda e: e["k"] + F.floor((_BASE - _TMIN + 1) * e["d"] / (e["d"] + _SKEW)).cast("bigint"))


def _punycode(label: Column) -> Column:
    """``xn--`` and the label's code points, as a fold over them in the order of their size."""
    def encode(cps: Column) -> Column:
        basic = F.filter(cps, lambda c: c < _FIRST)
        b = F.size(basic).cast("bigint")
        head = F.array_join(F.transform(basic, lambda c: F.char(c)), "")

        def state(delta, n, h, bias, s) -> Column:
            return F.struct(delta.cast("bigint").alias("delta"), n.cast("bigint").alias("n"), h.cast("bigint").alias("h"),
                            bias.cast("bigint").alias("bias"), s.alias("s"))

        def one(acc: Column, c: Column) -> Column:
            """A code point of the label, while those equal to n are written."""
            written = state(F.lit(0), acc["n"], acc["h"] + 1, _adapted(acc["delta"], acc["h"] + 1, acc["h"] == b),
                            F.concat(acc["s"], _digits(acc["delta"], acc["bias"])))
            passed = state(acc["delta"] + 1, acc["n"], acc["h"], acc["bias"], acc["s"])
            return F.when(c == acc["n"], written).when(c < acc["n"], passed).otherwise(acc)

        def each(acc: Column, m: Column) -> Column:
            begin = state(acc["delta"] + (m - acc["n"]) * (acc["h"] + 1), m, acc["h"], acc["bias"], acc["s"])
            return let(F.aggregate(cps, begin, one), lambda e: state(e["delta"] + 1, e["n"] + 1, e["h"], e["bias"], e["s"]))

        zero = state(F.lit(0), F.lit(_FIRST), b, F.lit(_BIAS), F.when(b > 0, F.concat(head, F.lit("-"))).otherwise(F.lit("")))
        large = F.array_sort(F.array_distinct(F.filter(cps, lambda c: c >= _FIRST)))
        return F.concat(F.lit("xn--"), F.aggregate(large, zero, each)["s"])
    points = F.transform(F.filter(F.split(label, ""), lambda ch: ch != ""), lambda ch: F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint"))
    return let(points, encode)


def ascii_host(host) -> Column:
    """A host name in the form that goes over the wire: labels in lower case, those with other than ASCII
    characters in Punycode.  (No Unicode normalisation beyond lower case.)"""
    def body(h: Column) -> Column:
        low = F.lower(F.translate(h, _STOPS, "..."))
        labels = F.transform(F.split(low, r"\."), lambda x: F.when(x.rlike(r"[^\x{00}-\x{7F}]"), _punycode(x)).otherwise(x))
        return F.when(h.rlike(r"[^\x{00}-\x{7F}]"), F.array_join(labels, ".")).otherwise(F.lower(h))
    return let(_col(host), body)


def _authority(scheme: Column, a: Column) -> Column:
    """User info as it is, the host in lower case, the scheme's own port left out."""
    user = F.regexp_extract(a, AUTHORITY_RE, 1)
    host = ascii_host(F.regexp_extract(a, AUTHORITY_RE, 2))
    port = F.regexp_extract(a, AUTHORITY_RE, 3)
    own = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        own = own | ((scheme == name) & (port == number))
    out = F.concat(F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host,
                   F.when((port == "") | own, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    return F.when(a.rlike(AUTHORITY_RE), out).otherwise(ascii_host(a))


def _join(b: Column, h: Column) -> Column:
    no_frag = F.regexp_replace(b, "#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    origin = F.regexp_extract(b, ORIGIN_RE, 1)
    base_path = F.regexp_extract(no_query, SPLIT_RE, 3)
    base_dir = F.concat(origin, F.regexp_extract(base_path, r"^(.*/)", 1))
    base_dir = F.when(base_path == "", F.concat(origin, F.lit("/"))).otherwise(base_dir)
    joined = (F.when(h.rlike(SCHEME_RE), h)
               .when(h.startswith("//"), F.concat(F.regexp_extract(b, SCHEME_RE, 1), F.lit(":"), h))
               .when(h.startswith("/"), F.concat(origin, h))
               .when(h.startswith("?"), F.concat(no_query, h))
               .when(h.startswith("#"), F.concat(no_frag, h))
               .when(h == "", no_frag)
               .otherwise(F.concat(base_dir, h)))
    return joined


def normalize_url(c) -> Column:
    """Lower-case scheme and host, '/' for an empty path, dot segments removed,
    percent-encoding of path/query/fragment.  Non-hierarchical URLs
    (``mailto:``, ``javascript:``) only get the scheme lower-cased."""
    return let(_col(c), _normalize)


def _normalize(u: Column) -> Column:
    hier = u.rlike(SPLIT_RE)
    scheme = F.lower(F.regexp_extract(u, SPLIT_RE, 1))
    host = _authority(scheme, F.regexp_extract(u, SPLIT_RE, 2))
    path = let(F.regexp_extract(u, SPLIT_RE, 3),
               lambda p: F.when(p == "", F.lit("/")).otherwise(remove_dot_segments(p)))
    query = F.regexp_extract(u, SPLIT_RE, 4)
    frag = F.regexp_extract(u, SPLIT_RE, 5)
    built = F.concat(scheme, F.lit("://"), host, percent_encode(path, PATH_EXTRA),
                     percent_encode(query, QUERY_EXTRA), percent_encode(frag, FRAGMENT_EXTRA))
    other = F.concat(F.lower(F.regexp_extract(u, SCHEME_RE, 1)), F.lit(":"),
                     F.regexp_replace(u, SCHEME_RE, ""))
    return F.when(hier, built).when(u.rlike(SCHEME_RE), other).otherwise(u)


def url_host(c) -> Column:
    """Host in lower case, NULL when there is none.  A pattern, not the JVM's
    parser, which refuses many URLs that browsers take."""
    def body(u: Column) -> Column:
        return F.nullif(ascii_host(F.regexp_extract(F.regexp_extract(u, SPLIT_RE, 2), AUTHORITY_RE, 2)), F.lit(""))
    return let(_slashes(strip_url_ws(c), _col(c)), body)


def url_path(c) -> Column:
    """Path of the normalised URL ('/' if it has none), NULL when it is not a URL."""
    def body(u: Column) -> Column:
        plain = F.regexp_extract(F.regexp_replace(u, SCHEME_RE, ""), r"^[^?#]*", 0)
        return F.when(u.rlike(SPLIT_RE), F.regexp_extract(normalize_url(u), SPLIT_RE, 3)).when(u.rlike(SCHEME_RE), plain)
    return let(_slashes(strip_url_ws(c), _col(c)), body)


def form_encode(c) -> Column:
    """application/x-www-form-urlencoded value (URLSearchParams): space -> '+',
    '*' '-' '.' '_' kept, everything else UTF-8 percent-encoded."""
    return F.url_encode(_col(c))


# ---- DuckDB (oracle) spellings -------------------------------------------------

def sql_percent_encode(expr: str, extra: str = PATH_EXTRA) -> str:
    cls = _class(extra).replace("'", "''")
    return (f"(CASE WHEN regexp_matches({expr}, '{cls}') THEN array_to_string(list_transform("
            f"string_split({expr}, ''), lambda ch: CASE WHEN ch = ' ' THEN '%20' "
            f"WHEN regexp_matches(ch, '{cls}') THEN url_encode(ch) ELSE ch END), '') "
            f"ELSE {expr} END)")


def sql_resolve_root_or_absolute(base: str, href: str) -> str:
    """Oracle form of resolve_url for absolute, '//', '/', '?', '#' and relative
    references without dot segments."""
    origin = f"regexp_extract({base}, '{ORIGIN_RE}', 1)"
    no_frag = f"regexp_replace({base}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    joined = (f"(CASE WHEN regexp_matches({href}, '{SCHEME_RE}') THEN {href} "
              f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '{SCHEME_RE}', 1) || ':' || {href} "
              f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
              f"WHEN starts_with({href}, '?') THEN {no_query} || {href} "
              f"WHEN starts_with({href}, '#') THEN {no_frag} || {href} "
              f"WHEN {href} = '' THEN {no_frag} "
              f"ELSE regexp_extract({no_query}, '^(.*/)', 1) || {href} END)")
    sp = f"regexp_extract({joined}, '{SPLIT_RE}', ['s','h','p','q','f'])"
    return (f"(CASE WHEN regexp_matches({joined}, '{SPLIT_RE}') THEN "
            f"lower({sp}.s) || '://' || lower({sp}.h) || "
            f"{sql_percent_encode(f'(CASE WHEN {sp}.p = {chr(39)}{chr(39)} THEN {chr(39)}/{chr(39)} ELSE {sp}.p END)')} || "
            f"{sql_percent_encode(f'{sp}.q', QUERY_EXTRA)} || {sql_percent_encode(f'{sp}.f', FRAGMENT_EXTRA)} "
            f"ELSE {joined} END)")
