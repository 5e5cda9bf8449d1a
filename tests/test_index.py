from pyspark.sql import functions as F

from webloom.operators.index import SearchIndex, _buckets_kept, search_filter
from webloom.operators.search import multi_search, with_result_text
from webloom.streaming.stateful import scratch

KEEP = {"lang": "string", "source": "string"}


def _rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score", "title", "snippet").collect())


def _index(spark, buckets=4):
    return SearchIndex(spark, scratch(spark, "t_index")[0], buckets, "bigint", KEEP)


def test_batches_equal_one_search_over_all_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet").limit(15)
    index = _index(spark)
    for k in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == k))
    want = _rows(with_result_text(multi_search(bench, docs, num=7), docs))
    assert _rows(index.search(bench, num=7)) == want and len(want) > 50
    # A batch that is added again adds nothing; the index opens again from its folder.
    index.add(docs.where(F.col("doc_id") % 3 == 1))
    again = SearchIndex(spark, index.path, 4, "bigint", KEEP)
    assert _rows(again.search(bench, num=7)) == want and again.table("stats").agg(F.sum("n_docs")).first()[0] == docs.count()
    part = index.search(bench, num=3, start=2, doc_filter=search_filter(language="EN"))
    assert _rows(part) == _rows(with_result_text(multi_search(bench, docs, num=3, start=2, doc_filter=F.col("lang") == "en"), docs))


def test_postings_are_not_shuffled_and_texts_not_read(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    index = _index(spark)
    index.add(docs)
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet").limit(5)
    with _buckets_kept(spark):
        plan = index.scores(bench, "item_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Bucketed: true" in plan
    assert "documents.parquet" not in plan and not any("documents.parquet" in f for f in index.search(bench).inputFiles())


def test_edges(spark):
    index = _index(spark, 2)
    q = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None)], "item_id long, text string")
    assert index.search(q).count() == 0
    docs = spark.createDataFrame([(1, "alpha", "en", "a"), (1, "zeta", "en", "a"), (None, "alpha", "en", "a"), (2, None, None, None), (3, "beta beta\nx", "fr", "b")],
                                 "doc_id long, text string, lang string, source string")
    index.add(docs.limit(0))
    index.add(docs)
    got = index.search(q).collect()
    assert {(r.item_id, r.doc_id, r.title) for r in got} == {(1, 1, "alpha"), (1, 3, "beta beta")}
    assert index.table("stats").agg(F.sum("n_docs")).first()[0] == 3
    assert [r.doc_id for r in index.search(q, doc_filter=search_filter(site="B")).collect()] == [3]
    assert search_filter() is None and search_filter(language="", site=None) is None


def test_date_and_region_options(spark):
    df = spark.createDataFrame([("de", "2024-01-01"), ("de", "2024-03-01"), ("fr", "2024-03-01")], "region string, date string")
    assert df.where(search_filter(region="DE", since="2024-02-01")).count() == 1
    assert df.withColumnRenamed("date", "day").where(search_filter(since="2024-02-01", columns={"since": "day"})).count() == 2
