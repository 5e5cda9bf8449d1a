import math

from pyspark.sql import functions as F

from webloom.operators.slices import chunk_pages, html_slice


def js_slice(html, start, end, size=20000):
    """Brute-force twin of the reference's slice arithmetic."""
    n = len(html)
    s = max(0, math.floor(start if start is not None else 0))
    e = min(n, math.floor(end) if end is not None else s + size)
    ea = max(n + e, 0) if e < 0 else e
    content = html[s:ea] if ea > s else ""
    return n, s, e, max(0, n - e), content


def test_worked_example(spark):
    df = spark.createDataFrame([(1, "x" * 123456)], "page_id long, html string")
    r = html_slice(df, 0, None).first()
    assert (r.total_length, r.start_index, r.end_index, r.remaining_characters) == (123456, 0, 20000, 103456)
    assert len(r.content) == 20000 and r.mode == "html"


def test_slice_edges(spark):
    page = "<html><body>abcdefghij</body></html>"
    cases = [(None, None), (-5, 10), (0, -50), (0, -5), (100, 200), (3, 1000), (10, 4), (2.7, 9.9), (0, 0)]
    for start, end in cases:
        df = spark.createDataFrame([(1, page)], "page_id long, html string")
        r = html_slice(df, start if start is not None else F.lit(None), end).first()
        exp = js_slice(page, start, end)
        assert (r.total_length, r.start_index, r.end_index, r.remaining_characters, r.content) == exp, (start, end)
    empty = spark.createDataFrame([(1, "")], "page_id long, html string")
    r = html_slice(empty, 0, 10).first()
    assert (r.total_length, r.end_index, r.remaining_characters, r.content) == (0, 0, 0, "")


def test_chunks_reassemble(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "html")
    chunks = chunk_pages(pages, 700)
    joined = (chunks.groupBy("page_id")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "content"))),
                                            lambda c: c["content"]), "").alias("html"),
                   F.min("remaining_characters").alias("last_rem")))
    bad = joined.join(pages.withColumnRenamed("html", "orig"), "page_id").where(
        (F.col("html") != F.col("orig")) | (F.col("last_rem") != 0))
    assert bad.count() == 0
    empty = spark.createDataFrame([(1, "")], "page_id long, html string")
    assert [tuple(r) for r in chunk_pages(empty, 10).collect()] == [(1, 0, 0, 0, 0, "")]
