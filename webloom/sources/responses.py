"""S3 API-response source and request fixtures derived from the driver tables.

``responses`` = pages (``text/html``) UNION events.props (``application/json``)
UNION documents (``application/octet-stream``), with a 404 status for every
id divisible by 17.  ``requests`` derives one API request per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.tables import read_table, spread

# Fixed values of the fixture mapping.
PAGE_TYPE = "text/html; charset=utf-8"
EVENT_TYPE = "application/json"
DOC_TYPE = "application/octet-stream"
EVENT_URL = "https://api.example.com/events/"
DOC_URL = "https://files.example.com/docs/"
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "FETCH", "get")
REDIRECTS = ("follow", "error", "manual", "bounce")


def _shape(df: DataFrame, kind: str, id_col: str, url, ctype: str, text_col: str) -> DataFrame:
    status = F.when(F.col(id_col) % 17 == 0, F.lit(404)).otherwise(F.lit(200))
    body = F.encode(F.col(text_col), "UTF-8")
    return df.select(
        F.lit(kind).alias("kind"), F.col(id_col).cast("bigint").alias("id"), url.alias("url"),
        status.alias("status"),
        F.when(status == 404, F.lit("Not Found")).otherwise(F.lit("OK")).alias("status_text"),
        F.create_map(F.lit("Content-Type"), F.lit(ctype),
                     F.lit("Content-Length"), F.octet_length(body).cast("string"),
                     F.lit("X-Request-Id"), F.concat(F.lit(kind + "-"), F.col(id_col).cast("string")))
        .alias("headers"),
        body.alias("body"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    events = read_table(spark, sf_dir, "events")
    docs = read_table(spark, sf_dir, "documents")
    return spread(_shape(pages, "page", "page_id", F.col("url"), PAGE_TYPE, "html")
            .unionByName(_shape(events, "event", "event_id",
                                F.concat(F.lit(EVENT_URL), F.col("event_id").cast("string")),
                                EVENT_TYPE, "props"))
            .unionByName(_shape(docs, "doc", "doc_id",
                                F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string"), F.lit(".bin")),
                                DOC_TYPE, "text")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch request per event (M12); ``body`` holds a JSON object value as
    text; the JSON header name is lower-case for every third id (the
    reference only serialises on the exact ``Content-Type`` spelling); method
    cycles through the seven valid ones plus two invalid spellings, ``limit`` is NULL for every fifth id, the
    redirect mode cycles through three valid values and one invalid one."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "value", "props")
    i = F.col("event_id")
    return ev.select(
        i.alias("id"),
        F.concat(F.lit(EVENT_URL), i.cast("string")).alias("url"),
        F.element_at(F.array(*[F.lit(m) for m in METHODS]), (i % len(METHODS) + 1).cast("int")).alias("method"),
        F.create_map(F.when(i % 3 == 0, F.lit("content-type")).otherwise(F.lit("Content-Type")),
                     F.lit("application/json")).alias("headers"),
        F.col("props").alias("body"),
        (F.col("value") * 1000).alias("timeout"),
        F.when(i % 5 == 0, F.lit(None).cast("double")).otherwise(F.lit(200.0)).alias("limit"),
        F.element_at(F.array(*[F.lit(r) for r in REDIRECTS]), (i % len(REDIRECTS) + 1).cast("int")).alias("redirect"))


def console_log(events: DataFrame) -> DataFrame:
    """Console entries ``(key, ts, seq_id, type, text, location)`` from a
    client event table (errors are console errors)."""
    return events.where(F.col("event_type") == "error").select(
        "user_id", "ts", "event_id", F.lit("error").alias("type"), F.col("props").alias("text"),
        F.struct(F.concat(F.lit(EVENT_URL), F.col("event_id").cast("string")).alias("url"),
                 F.lit(1).alias("lineNumber"), F.lit(0).alias("columnNumber")).alias("location"))


def request_log(events: DataFrame) -> DataFrame:
    """Request entries ``(key, ts, seq_id, url, method, resourceType, headers)``."""
    return events.select(
        "user_id", "ts", "event_id",
        F.concat(F.lit(EVENT_URL), F.col("event_id").cast("string")).alias("url"),
        F.lit("GET").alias("method"), F.col("event_type").alias("resourceType"),
        F.create_map(F.lit("accept"), F.lit("*/*")).alias("headers"))
