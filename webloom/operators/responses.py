"""Response/request processing.

All narrow: per-row expressions, no shuffle.  Only JSON canonicalisation
crosses into Python (Arrow batches, JSON rows only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.jsonfmt import canonical_json_udf

# Fixed values from the request contract.
VALID_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
VALID_REDIRECTS = ("follow", "error", "manual")
DEFAULT_TIMEOUT_MS = 60000.0
TEXT_MARKERS = ("text/", "application/xml", "application/xhtml+xml")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header(headers, name: str) -> Column:
    """Case-insensitive header lookup, repeats joined by ", "; NULL when absent."""
    h = _col(headers)
    hit = F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == name.lower())
    return F.when(F.size(hit) > 0, F.array_join(F.transform(hit, lambda e: e["value"]), ", "))


def utf8_text(body) -> Column:
    """Bytes as text the way fetch reads them: malformed bytes become U+FFFD, a
    leading byte order mark goes; never an error."""
    return F.regexp_replace(F.make_valid_utf8(_col(body).cast("string")), "^\ufeff", "")


def body_kind(content_type) -> Column:
    """P10: json / text / base64 by content type (substring tests, NULL -> base64)."""
    ct = _col(content_type)
    is_text = None
    for m in TEXT_MARKERS:
        t = ct.contains(m)
        is_text = t if is_text is None else (is_text | t)
    return (F.when(ct.contains("application/json"), F.lit("json"))
             .when(is_text, F.lit("text")).otherwise(F.lit("base64")))


def decode_body(resp: DataFrame) -> DataFrame:
    """Adds ``content_type``, ``body_kind``, ``body_text`` (string form used for
    length and truncation) and ``error`` (malformed JSON)."""
    ct = header("headers", "content-type")
    df = resp.withColumn("content_type", ct).withColumn("body_kind", body_kind(ct))
    raw = utf8_text("body")
    canon = canonical_json_udf(F.when(F.col("body_kind") == "json", raw))
    b64 = F.regexp_replace(F.base64(F.col("body")), r"\s", "")
    df = df.withColumn("_canon", canon)
    text = (F.when(F.col("body_kind") == "json", F.col("_canon"))
             .when(F.col("body_kind") == "text", raw).otherwise(b64))
    err = F.when((F.col("body_kind") == "json") & F.col("_canon").isNull() & F.col("body").isNotNull(),
                 F.lit("Unexpected token in JSON body"))
    return df.withColumn("body_text", text).withColumn("error", err).drop("_canon")


def truncate_body(decoded: DataFrame, limit) -> DataFrame:
    """``body_length`` of the string form; ``truncated`` iff longer than
    ``limit``; body cut to ``limit`` chars (a negative limit gives '')."""
    lim = _col(limit) if isinstance(limit, (str, Column)) else F.lit(limit)
    n = F.length("body_text").cast("bigint")
    trunc = n > lim
    cut = F.substring("body_text", 1, F.greatest(lim, F.lit(0)).cast("int"))
    return (decoded.withColumn("body_length", n)
            .withColumn("truncated", F.coalesce(trunc, F.lit(False)))
            .withColumn("body_out", F.when(trunc, cut).otherwise(F.col("body_text"))))


def with_ok(df: DataFrame, status_col: str = "status") -> DataFrame:
    """``ok`` = 2xx."""
    return df.withColumn("ok", F.col(status_col).between(200, 299))


def normalize_headers(resp: DataFrame, keep=("kind", "id")) -> DataFrame:
    """One row per header, names lower-cased; repeated names (case
    variants) merged with ', ' as the Headers object does.  Per row, no shuffle."""
    entries = F.map_entries("headers")
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    merged = F.transform(names, lambda n: F.struct(
        n.alias("name"),
        F.array_join(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n),
                                 lambda e: e["value"]), ", ").alias("value")))
    return resp.select(*keep, F.explode(merged).alias("h")).select(*keep, "h.name", "h.value")


def envelope(df: DataFrame, text: Column, error: Column, keep=()) -> DataFrame:
    """K3: ``(*keep, is_error, text)``; a failure becomes ``Error: <message>``."""
    return df.select(*keep, error.isNotNull().alias("is_error"),
                     F.when(error.isNotNull(), F.concat(F.lit("Error: "), error))
                     .otherwise(text).alias("text"))


def fetch_error(status_col: str = "status", text_col: str = "status_text",
                prefix: str = "Failed to fetch file: ") -> Column:
    """P13 error text for a non-2xx response."""
    return F.when(~F.col(status_col).between(200, 299), F.concat(F.lit(prefix), F.col(text_col)))


def valid_requests(req: DataFrame) -> Column:
    """P9 as a boolean Column: url present, method one of seven, limit present,
    redirect absent or one of three (numbers/maps are typed by the schema)."""
    return (F.col("url").isNotNull() & F.coalesce(F.col("method").isin(*VALID_METHODS), F.lit(False))
            & F.col("limit").isNotNull()
            & (F.col("redirect").isNull() | F.col("redirect").isin(*VALID_REDIRECTS)))


def js_number_text(c) -> Column:
    """Number -> text as JS prints ordinary values (60 / 1.5)."""
    x = _col(c)
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def elapsed_ms(start, end) -> Column:
    """Duration in milliseconds as DOUBLE."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)).cast("double") / 1000.0


def classify_timeouts(df: DataFrame, elapsed_col: str, timeout=None) -> Column:
    """P25: ``Request timed out after <timeout/1000> seconds`` when the elapsed
    time reaches the timeout (default 60000 ms)."""
    t = F.coalesce(_col(timeout) if timeout is not None else F.lit(None).cast("double"),
                   F.lit(DEFAULT_TIMEOUT_MS))
    return F.when(F.col(elapsed_col) >= t,
                  F.concat(F.lit("Request timed out after "), js_number_text(t / 1000), F.lit(" seconds")))


def request_body(headers, body_json: Column, body_raw: Column) -> Column:
    """JSON text only when the body is an object and the header is exactly
    ``Content-Type: application/json`` (case-sensitive name, as the reference)."""
    exact = F.try_element_at(_col(headers), F.lit("Content-Type")) == "application/json"
    is_object = body_raw.rlike(r"^\s*[\[{]")
    return F.when(exact & is_object & body_json.isNotNull(), body_json).otherwise(body_raw)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """NULL options replaced by their defaults (``??`` keeps 0)."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df


def validate_index(idx, n, message: str = "Invalid tab index") -> Column:
    """Error text when ``idx`` is outside [0, n)."""
    i = _col(idx)
    return F.when(i.isNull() | ~i.between(F.lit(0), _col(n) - 1 if not isinstance(n, int) else F.lit(n - 1)),
                  F.lit(message))


def validate_enum(value, allowed: tuple[str, ...], optional: bool = True,
                  message: str = "Invalid args") -> Column:
    """Error text when ``value`` is none of ``allowed`` (NULL passes if optional)."""
    v = _col(value)
    bad = ~F.coalesce(v.isin(*allowed), F.lit(False))
    return F.when(bad & v.isNotNull() if optional else bad, F.lit(message))
