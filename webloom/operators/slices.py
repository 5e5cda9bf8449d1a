"""P1 html slice, P2 chunking (JS ``String.prototype.slice`` rules, §1.1.2).

Lengths and offsets are in code points (Spark and DuckDB native); they
equal the browser's UTF-16 units when no astral character is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SLICE = 20000


def _lit(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit(v)


def slice_struct(html, start=0, end=None, size: int = DEFAULT_SLICE) -> Column:
    """Struct (mode, total_length, start_index, end_index, remaining_characters, content).

    start = max(0, floor(start)); end = min(len, floor(end)), default start+size,
    never clamped below, so a negative end counts from the tail for the
    content while remaining = max(0, len - end) exceeds the length.

    A NULL ``start`` is 0 (the reference's ``?? 0``).  A NULL ``end`` means
    "not given" and takes the default; the reference's JSON-only case of an
    explicit ``null`` end (``Math.floor(null)`` = 0) has no table equivalent.
    """
    h = F.col(html) if isinstance(html, str) else html
    length = F.length(h).cast("bigint")
    s = F.greatest(F.lit(0).cast("bigint"), F.floor(F.coalesce(_lit(start), F.lit(0))).cast("bigint"))
    e_req = (s + F.lit(size)) if end is None else \
        F.coalesce(F.floor(_lit(end)).cast("bigint"), s + F.lit(size))
    e = F.least(length, e_req)
    e_abs = F.when(e < 0, F.greatest(length + e, F.lit(0))).otherwise(e)
    content = F.when(e_abs > s, F.substring(h, (s + 1).cast("int"), (e_abs - s).cast("int"))) \
               .otherwise(F.lit(""))
    return F.struct(F.lit("html").alias("mode"), length.alias("total_length"),
                    s.alias("start_index"), e.alias("end_index"),
                    F.greatest(F.lit(0).cast("bigint"), length - e).alias("remaining_characters"),
                    content.alias("content"))


def html_slice(pages: DataFrame, start=0, end=None, size: int = DEFAULT_SLICE) -> DataFrame:
    return pages.select("page_id", slice_struct("html", start, end, size).alias("s")).select(
        "page_id", "s.*")


def chunk_pages(pages: DataFrame, size: int = DEFAULT_SLICE) -> DataFrame:
    """Every slice a client would fetch by following ``remaining_characters``:
    ``(page_id, chunk, start_index, end_index, remaining_characters, content)``.
    An empty page yields one empty chunk.  The page is split once, in its row;
    only the pieces are exploded, never copies of the page."""
    n = F.length("html").cast("bigint")
    pieces = F.when(n > 0, F.regexp_extract_all("html", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(
        F.array(F.lit("")))
    split = pages.select("page_id", n.alias("_n"), F.when(F.col("html").isNotNull(), pieces).alias("_pieces"))
    out = split.select("page_id", "_n", F.posexplode_outer("_pieces").alias("chunk", "content")).where("chunk is not null")
    start = F.col("chunk").cast("bigint") * F.lit(size)
    end = F.least(F.col("_n"), start + F.lit(size))
    return out.select("page_id", F.col("chunk").cast("bigint").alias("chunk"), start.alias("start_index"),
                      end.alias("end_index"), (F.col("_n") - end).alias("remaining_characters"), "content")
