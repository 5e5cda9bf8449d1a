"""S2 batch fetch over a page snapshot (D3 lookup, W7 tab index, A5 summary).

Each requested URL is looked up in the snapshot with a left outer
equi-join on the normalised, fragment-free URL (Catalyst/AQE choose
broadcast or sort-merge from the real sizes; a URL requested very often is
a skewed key that AQE's skew join splits).  A failed lookup becomes an error row and never stops the
others.  The tab index of the i-th request is ``least(existing + i, max-1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import normalize_url
from webloom.operators.logs import MAX_TABS

NOT_FOUND = "net::ERR_NAME_NOT_RESOLVED at "   # fixed value: error text of a failed load


def page_key(url) -> Column:
    """D3 lookup key: the normalised URL without its fragment (a browser loads
    the same document for ``https://Host/p#top`` and ``https://host/p``)."""
    return F.regexp_replace(normalize_url(url), "#.*$", "")


def batch_fetch(requests: DataFrame, pages: DataFrame, existing_tabs: int = 0,
                max_tabs: int = MAX_TABS) -> DataFrame:
    """``requests(pos, url)`` x ``pages(page_id, url)`` ->
    ``(pos, url, status, tab_index, error, page_id)``; snapshot rows sharing
    a key resolve to the smallest page id (a partial aggregate, so a URL
    crawled many times is combined map-side)."""
    snap = pages.groupBy(page_key("url").alias("_u")).agg(F.min("page_id").alias("page_id"))
    j = requests.withColumn("_k", page_key("url")).join(snap, F.col("_k") == snap["_u"], "left")
    ok = F.col("page_id").isNotNull()
    return j.select(
        "pos", "url",
        F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.when(ok, F.least(F.lit(existing_tabs) + F.col("pos"), F.lit(max_tabs - 1)))
        .cast("int").alias("tab_index"),
        F.when(~ok, F.concat(F.lit(NOT_FOUND), F.col("url"))).alias("error"),
        "page_id")


def batch_summary(results: DataFrame) -> DataFrame:
    """A5: ``(status, n)``."""
    return results.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
