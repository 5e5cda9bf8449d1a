"""K1 results as pretty JSON, K4 report, and whole ``fetch_api`` records.

Each function gives one JSON text for a bounded result (a page, a log, a
query, a window of tabs), printed by a Column compiled from the result's
type.  Only a JSON *response body*, whose shape is known to no schema, is
re-serialised in Python (Arrow batches).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.jsonfmt import json_number, json_string, pretty, pretty_column, pretty_json
from webloom.operators.html import document_base, link_list
from webloom.operators.logs import collect_log
from webloom.operators.responses import decode_body, truncate_body, valid_requests, with_ok

INVALID_ARGS = "Invalid args"           # fixed value: message of a request that is not valid


def links_json(pages: DataFrame) -> DataFrame:
    """``(page_id, json)``: the page's links."""
    rows = (pages.select("page_id", "html", document_base("html", "url").alias("_base"))
            .select("page_id", link_list("html", "_base").alias("links")))
    return rows.select("page_id", pretty_column(rows, "links").alias("json"))


def listed(df: DataFrame, key: str, order: str, fields: dict[str, str], omit: tuple[str, ...] = ()) -> DataFrame:
    """``(key, json)``: the rows of each key in order, as an array of objects.  For keys with a bounded number of rows."""
    one = F.struct(*[F.col(c).alias(name) for name, c in fields.items()])
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("v")))).alias("_r")) \
        .select(key, F.transform("_r", lambda r: r["v"]).alias("_r"))
    return rows.select(key, pretty_column(rows, "_r", omit).alias("json"))


def tabs_json(tabs: DataFrame, window: int = 10) -> DataFrame:
    """``(window, json)``: tabs of :func:`list_pages` in windows of as many as a browser holds."""
    t = tabs.select(F.floor(F.col("idx") / window).cast("bigint").alias("window"), (F.col("idx") % window).alias("index"), "active", "url", "title")
    return listed(t, "window", "index", {"index": "index", "active": "active", "url": "url", "title": "title"})


def log_json(keys: DataFrame, key: str, log: DataFrame, log_key: str, order: list[str], fields: list[str], n: int) -> DataFrame:
    """``(key, json)``: every key's bounded log, ``[]`` where it has none.  Entries are printed before they are collected."""
    entry = T.StructType([log.schema[f] for f in fields])
    printed = log.select(log_key, *[c for c in order if c != log_key], pretty(F.struct(*fields), entry, depth=1).alias("_j"))
    rows = collect_log(printed, log_key, order, ["_j"], "_e", n).select(F.col(log_key).alias(key), F.concat(
        F.lit("[\n  "), F.array_join(F.transform("_e", lambda e: e["_j"]), ",\n  "), F.lit("\n]")).alias("json"))
    return keys.select(key).join(rows, key, "left").select(key, F.coalesce("json", F.lit("[]")).alias("json"))


def batch_json(results: DataFrame, size: int) -> DataFrame:
    """``(batch, json)``: outcomes of :func:`batch_fetch` for batches of ``size`` URLs; tabIndex or error, as the outcome has it."""
    r = results.select(F.floor(F.col("pos") / size).cast("bigint").alias("batch"), "pos", "url", "status", "tab_index", "error")
    return listed(r, "batch", "pos", {"url": "url", "status": "status", "tabIndex": "tab_index", "error": "error"}, ("tabIndex", "error"))


def slice_json(slices: DataFrame) -> DataFrame:
    """``(page_id, json)``: the record of an html slice."""
    names = {"mode": "mode", "totalLength": "total_length", "startIndex": "start_index", "endIndex": "end_index",
             "remainingCharacters": "remaining_characters", "content": "content"}
    rows = slices.select("page_id", F.struct(*[F.col(c).alias(n) for n, c in names.items()]).alias("r"))
    return rows.select("page_id", pretty_column(rows, "r").alias("json"))


_ITEM = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "snippet")]))


def results_by_query(queries: DataFrame, results: DataFrame, key: str, link: Column) -> DataFrame:
    """``queries`` with ``results``: array<struct<title, link, snippet>> by rank, empty where nothing was found."""
    found = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.struct("title", link.alias("link"), "snippet").alias("v")))).alias("_r"))
    return (queries.join(found, key, "left")
            .withColumn("results", F.coalesce(F.transform("_r", lambda r: r["v"]), F.array().cast(_ITEM))).drop("_r"))


def search_json(found: DataFrame, key: str, query: str) -> DataFrame:
    """``(key, json)``: a query and its results."""
    rows = found.select(key, F.struct(F.col(query).alias("query"), "results").alias("r"))
    return rows.select(key, pretty_column(rows, "r", ("title", "link", "snippet")).alias("json"))


def report(found: DataFrame, key: str, lang: str, query: str) -> DataFrame:
    """K4: ``(key, report)`` with titles, links and snippets as JSON."""
    return found.select(key, F.concat(F.lit("Detected language: "), F.col(lang), F.lit("\nEnriched query: "), F.col(query),
                                      F.lit("\n\nResults:\n"), pretty(F.col("results"), _ITEM, ("title", "link", "snippet"))).alias("report"))


@F.pandas_udf(T.StringType())
def _indented(s: pd.Series) -> pd.Series:
    """A JSON text printed as a member of an object."""
    import json
    return s.map(lambda t: pretty_json(json.loads(t, parse_int=float)).replace("\n", "\n  "), na_action="ignore")


def fetch_api(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """``(key, is_error, text)``: the whole outcome of API requests as a consumer gets it.

    A request that is not valid gives ``Error: Invalid args``; one whose
    response took ``timeout`` or longer, the timeout's message; a JSON body
    that is none, that error.  Otherwise ``text`` is the record of status,
    headers, body (parsed JSON unless it was truncated), ok, url, bodyLength,
    truncated and responseTimeMs.  ``requests`` has ``limit`` and ``timeout``
    (ms, NULL: 60 s), ``responses`` also ``elapsed_ms``.
    """
    from webloom.operators.responses import classify_timeouts
    own = requests.select(F.col(key), valid_requests(requests).alias("_valid"), F.col("limit").alias("_limit"), F.col("timeout").alias("_timeout"))
    joined = own.join(responses.select(key, "url", "status", "status_text", "headers", "body", "elapsed_ms"), key)
    t = truncate_body(with_ok(decode_body(joined)), F.col("_limit"))
    error = F.coalesce(F.when(~F.col("_valid"), F.lit(INVALID_ARGS)), classify_timeouts(t, "elapsed_ms", F.col("_timeout")), F.col("error"))
    parsed = (F.col("body_kind") == "json") & ~F.col("truncated")
    body = F.when(parsed, _indented(F.when(parsed, F.col("body_text")))).otherwise(json_string(F.col("body_out")))
    entries = F.map_entries("headers")
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"]))))
    heads = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.array_join(F.transform(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ").alias("value"))))
    members = [("status", F.col("status").cast("string")), ("statusText", json_string(F.col("status_text"))),
               ("headers", pretty(heads, T.MapType(T.StringType(), T.StringType()), depth=1)), ("body", body),
               ("ok", F.col("ok").cast("string")), ("url", json_string(F.col("url"))), ("bodyLength", F.col("body_length").cast("string")),
               ("truncated", F.col("truncated").cast("string")), ("responseTimeMs", json_number(F.col("elapsed_ms")))]
    lines = [F.concat(F.lit(f'  "{n}": '), F.coalesce(v, F.lit("null"))) for n, v in members]
    record = F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
    rows = t.select(key, error.alias("_error"), F.when(error.isNull(), record).alias("_text"))
    return rows.select(key, F.col("_error").isNotNull().alias("is_error"),
                       F.coalesce("_text", F.concat(F.lit("Error: "), F.col("_error"))).alias("text"))
