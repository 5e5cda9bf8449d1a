"""Tab-style listings and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.html import page_title
from webloom.operators.ordinal import with_ordinal


def list_pages(pages: DataFrame, active_index: int = 0, order_col: str = "page_id") -> DataFrame:
    """``(idx, active, url, title)``, idx 0-based in ``order_col`` order."""
    narrow = pages.select(order_col, "url", page_title("html").alias("title"))
    ranked = with_ordinal(narrow, [order_col], "idx")
    return ranked.select("idx", (F.col("idx") == active_index).alias("active"), "url", "title")
