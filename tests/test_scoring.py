import numpy as np
from pyspark.sql import functions as F

from webloom.operators import scoring
from webloom.operators.index import SearchIndex, search_filter
from webloom.operators.search import multi_search
from webloom.streaming.stateful import scratch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), *[
        F.concat(F.lit(f"w{k}x"), (F.col("id") % (k + 3)).cast("string")) for k in range(8)]).alias("text"),
        F.when(F.col("id") % 4 == 0, "en").otherwise("fr").alias("lang"))


def test_cells_grow_with_documents_and_queries(spark, monkeypatch):
    """A small cell stands for a large input: the results stay, the work is dealt to more tasks."""
    docs = _corpus(spark, 300)
    qs = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("common w0x1 w4x"), (F.col("id") % 7).cast("string")).alias("text"))
    want = sorted(map(tuple, multi_search(qs, docs, num=6, start=2).collect()))
    monkeypatch.setattr(scoring, "DOC_BLOCK", 10), monkeypatch.setattr(scoring, "QUERY_ROWS", 25)
    got = multi_search(qs, docs, num=6, start=2)
    assert "FlatMapCoGroupsInArrow" in _plan(got) and sorted(map(tuple, got.collect())) == want and len(want) == 240
    assert f"{30 * 5}" in _plan(got)         # 300 documents by 10, 120 terms by 25


def test_index_filter_comes_before_the_scores(spark):
    docs = _corpus(spark, 200)
    index = SearchIndex(spark, scratch(spark, "t_scoring")[0], 4, "bigint", {"lang": "string"})
    index.add(docs)
    qs = spark.range(30).select(F.col("id").alias("item_id"), F.concat(F.lit("common w1x"), (F.col("id") % 4).cast("string")).alias("text"))
    got = index.search(qs, num=5, doc_filter=search_filter(language="en"))
    assert {(r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()} == \
        {tuple(r) for r in multi_search(qs, docs, num=5, doc_filter=F.col("lang") == "en").collect()}
    weighted, n_rows, n_docs, w = index._weights(qs, "item_id", "text")
    assert n_docs == 200 and n_rows == 60


def _shuffled_rows(plan):
    """Rows that the exchanges of a plan that has run have written."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if kind in ("ShuffleQueryStageExec", "ResultQueryStageExec"):
        return _shuffled_rows(plan.plan())
    m, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return (m.get().value() if m.isDefined() else 0) + sum(_shuffled_rows(below.apply(i)) for i in range(below.size()))


def test_postings_and_queries_are_not_dealt_to_every_cell(spark, monkeypatch):
    """30 blocks of documents and 20 of queries: a block is written once, its cells get only its place."""
    postings = spark.range(6_000).select((F.col("id") % 300).alias("doc"), F.expr("id div 300").alias("tid"), (F.col("id") % 17 / 8.0 + 0.1).alias("w"))
    weighted = spark.range(400).select(F.expr("id div 4").alias("_q"), (F.col("id") * 7 % 20).alias("tid"), (F.col("id") % 5 + 0.5).alias("idf"))
    want = sorted(map(tuple, scoring.best_documents(postings, weighted, 300, 400, 3, 6).collect()))
    monkeypatch.setattr(scoring, "DOC_BLOCK", 10), monkeypatch.setattr(scoring, "QUERY_ROWS", 20)
    got = scoring.best_documents(postings, weighted, 300, 400, 3, 6)
    rows = got.collect()
    assert _shuffled_rows(got._jdf.queryExecution().executedPlan()) <= 2 * 30 * 20 < postings.count()
    best = {}
    for r in rows:
        best.setdefault(r["_q"], []).append((-r.score, r.doc))
    whole = {}
    for q, doc, score in want:
        whole.setdefault(q, []).append((-score, doc))
    assert {q: sorted(v)[:3] for q, v in best.items()} == {q: sorted(v)[:3] for q, v in whole.items()} and len(best) == 100


def test_a_cell_of_many_blocks_gives_a_query_its_rows_once(spark, monkeypatch):
    """With few tasks to deal to, what cells give grows with the queries, not with the blocks of documents."""
    postings = spark.range(600).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc"), F.lit(1).cast("bigint").alias("tid"),
                                       F.when(F.col("id") < 590, 1.0).otherwise(2.0).alias("w"))
    postings = postings.union(spark.createDataFrame([(None, 1, 2.0)], "doc string, tid bigint, w double"))
    weighted = spark.range(8).select(F.col("id").alias("_q"), F.lit(1).cast("bigint").alias("tid"), F.lit(0.5).alias("idf"))
    monkeypatch.setattr(scoring, "DOC_BLOCK", 5), monkeypatch.setattr(scoring, "QUERY_ROWS", 1), monkeypatch.setattr(scoring, "CELL_TASKS", 1)
    got = scoring.best_documents(postings, weighted, 601, 8, 4, 6).collect()
    assert len(got) == 8 * 4                    # 121 blocks of documents in one range
    assert {(r["_q"], r.doc, r.score) for r in got} == {(q, d, 1.0) for q in range(8) for d in (None, "d590", "d591", "d592")}


def test_rounding_and_ties_of_a_cell():
    import pyarrow as pa
    assert scoring._rounded(np.array([1.0000005, 2.4999995, 0.1234564999]), 6).tolist() == [1.000001, 2.5, 0.123456]
    p = pa.table({"doc": pa.array([5, 3, None, 3, 9]), "tid": pa.array([1, 1, 1, 2, 2]), "w": pa.array([1.0, 1.0, 1.0, 1e-8, 0.5])})
    q = pa.table({"_q": pa.array([7, 7, 8, None]), "tid": pa.array([1, 2, 4, 2]), "idf": pa.array([1.0, 1.0, 1.0, 1.0])})
    ids, docs, scores = scoring._best(p, q, 2, 6)
    assert list(zip(ids.to_pylist(), docs.to_pylist(), scores.tolist())) == [(None, 9, 0.5), (None, 3, 0.0), (7, None, 1.0), (7, 3, 1.0)]
