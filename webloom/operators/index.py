"""D2 as a stored index: built once, appended by batch, searched by many query sets.

An index is a folder with three tables:

* ``postings`` (term, doc, tf, dl), clustered by document into ``buckets``
  files for each batch and sorted by term.  A document's postings lie in one
  bucket, so a sum over all (query, document) (``scores``) is complete in its
  task.  A search shuffles the postings of its query terms that its filter
  leaves to cells of bounded size (``operators.scoring``) and each cell's best
  rows; texts are not read.
* ``documents`` (doc, dl, title, snippet and the columns kept for filters),
  clustered in the same way.  Results get their text from here; a search
  reads no document text.
* ``stats`` (batch, n_docs, n_terms), one row for each batch.

A batch is written with ids that the index does not have yet, so a batch
that is added again adds nothing.  Ranking is that of ``multi_search``.

Defined results: documents without an id are not indexed, of rows with one
id in a batch the least text counts; a null text has no terms; an empty
index finds nothing.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions.text import js_trim
from webloom.operators.scoring import best_documents
from webloom.operators.search import B, BROADCAST_ROWS, K1, SCORE_DIGITS, SNIPPET_LEN, TITLE_LEN, counted_broadcast, tokens
from webloom.sources.tables import stored


@contextmanager
def _buckets_kept(spark: SparkSession):
    """Scans keep the buckets of a table also below a broadcast join, where Spark would drop them by itself."""
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str, keep: dict[str, str]):
        self.spark, self.path, self.buckets, self.id_type, self.keep = spark, path.rstrip("/"), buckets, id_type, keep
        self.name = "webloom_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        own = ", ".join(f"`{c}` {t}" for c, t in keep.items())
        self._table("postings", f"term string, doc {id_type}, tf bigint, dl int", f"CLUSTERED BY (doc) SORTED BY (term) INTO {buckets} BUCKETS")
        self._table("documents", f"doc {id_type}, dl int, title string, snippet string" + (f", {own}" if own else ""),
                    f"CLUSTERED BY (doc) SORTED BY (doc) INTO {buckets} BUCKETS")
        self._table("stats", "batch string, n_docs bigint, n_terms bigint", "")

    def _table(self, kind: str, columns: str, clustered: str) -> None:
        """An external table over the folder; the index lives in its files, not in the catalog."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{kind} ({columns}) USING parquet {clustered} LOCATION '{self.path}/{kind}'")

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def _append(self, df: DataFrame, kind: str, sort: str) -> None:
        target = f"{self.name}_{kind}"
        w = df.select(*self.table(kind).columns).write.mode("append").format("parquet")
        if kind != "stats":
            w = w.bucketBy(self.buckets, "doc").sortBy(sort)
        w.option("path", f"{self.path}/{kind}").saveAsTable(target)
        self.spark.catalog.refreshTable(target)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Append a batch.  Texts are read once, and shuffled by id only to find repeated ids of the batch."""
        rows = (docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast(self.id_type).alias("doc"))
                .agg(F.min(F.struct(F.col(text).alias("t"), *[F.col(c) for c in self.keep])).alias("r")))
        new = rows.join(self.table("documents").select("doc"), "doc", "left_anti")
        terms = new.select("doc", F.col("r.t").alias("t"), *[F.col(f"r.{c}").alias(c) for c in self.keep],
                           F.coalesce(tokens("r.t"), F.array().cast("array<string>")).alias("terms"))
        # One pass over the texts: each document with its counted terms.
        counted = stored(terms.select(
            "doc", F.size("terms").alias("dl"), F.substring(js_trim(F.substring_index("t", "\n", 1)), 1, TITLE_LEN).alias("title"),
            F.substring("t", 1, SNIPPET_LEN).alias("snippet"), *self.keep, "terms"))
        # Dealt to the buckets as documents: the counts by term are complete there.
        postings = (counted.select("doc", "dl", "terms").repartition(self.buckets, "doc").select("doc", "dl", F.explode("terms").alias("term"))
                    .groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
        self._append(postings, "postings", "term")
        self._append(counted.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_terms"))
                     .withColumn("batch", F.lit(uuid.uuid4().hex)), "stats", "")
        # Last: an id counts as there once its document is.
        self._append(counted.repartition(self.buckets, "doc"), "documents", "doc")

    def search(self, queries: DataFrame, query_id: str = "item_id", query_text: str = "text", num: int = 10, start: int = 1,
               doc_filter: Column | None = None) -> DataFrame:
        """``(query_id, rank, doc_id, score, title, snippet)``, as ``multi_search`` with ``with_result_text``.

        ``doc_filter`` is a condition on the kept columns; idf and length
        normalisation stay those of the whole index."""
        documents = self.table("documents")
        kept = None if doc_filter is None else stored(documents.where(doc_filter).select("doc"))
        scores = self._best(queries, query_id, query_text, kept, start + num - 1)
        w = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("doc").asc())
        last = start + num - 1
        top = scores.withColumn("rank", F.row_number().over(w)).where((F.col("rank") >= start) & (F.col("rank") <= last))
        top = stored(top.select(F.col("_q").alias(query_id), F.col("rank").cast("bigint").alias("rank"), "doc", "score"))
        return documents.select("doc", "title", "snippet").join(top, "doc").select(
            query_id, "rank", F.col("doc").alias("doc_id"), "score", "title", "snippet")

    def _weights(self, queries: DataFrame, query_id: str, query_text: str):
        """(weighted (_q, term, idf), its number of rows, number of documents, a posting's weight without idf)."""
        qterms = stored(queries.select(F.col(query_id).alias("_q"), F.explode(F.array_distinct(tokens(query_text))).alias("term")))
        n_docs, n_terms = self.table("stats").agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, avgdl = int(n_docs or 0), float(n_terms or 0) / (n_docs or 1)
        vocabulary = qterms.select("term").distinct()
        dfs = stored(self.table("postings").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
        weighted = stored(qterms.join(dfs, "term").select("_q", "term", idf.alias("idf")))
        return weighted, weighted.count(), n_docs, F.col("tf") * (K1 + 1) / (F.col("tf") + norm)

    def _best(self, queries: DataFrame, query_id: str, query_text: str, kept: DataFrame | None, last: int) -> DataFrame:
        """``(doc, _q, score)``, of every query at least its first ``last`` documents, of those in ``kept``."""
        weighted, n_rows, n_docs, w = self._weights(queries, query_id, query_text)
        postings = self.table("postings")
        if kept is not None:
            postings, n_docs = postings.join(kept, "doc", "left_semi"), kept.count()
        terms = counted_broadcast(stored(weighted.select("term").distinct().withColumn("tid", F.monotonically_increasing_id())))
        return best_documents(postings.join(terms, "term").select("doc", "tid", w.alias("w")),
                              stored(weighted.join(terms, "term").select("_q", "tid", "idf")), n_docs, n_rows, last, SCORE_DIGITS)

    def scores(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """``(doc, _q, score)`` of every document that shares a term with a query."""
        weighted, n_rows, _, w = self._weights(queries, query_id, query_text)
        # Counted: a few query terms are sent to the buckets; very many meet the postings by a shuffle.
        weighted = F.broadcast(weighted) if n_rows <= BROADCAST_ROWS else weighted
        contrib = self.table("postings").join(weighted, "term").select("_q", "doc", (F.col("idf") * w).alias("c"))
        return contrib.groupBy("doc", "_q").agg(F.round(F.sum("c"), SCORE_DIGITS).alias("score"))


def search_filter(language: str | None = None, region: str | None = None, site: str | None = None, since=None,
                  columns: dict[str, str] | None = None) -> Column | None:
    """The options of a search as a condition on kept columns; those that are empty do not count.

    ``columns`` names the columns for language, region, site and date; ``since`` is the first day that counts."""
    names = {"language": "lang", "region": "region", "site": "source", "since": "date"} | (columns or {})
    given = {"language": language, "region": region, "site": site, "since": since}
    out = None
    for option, value in given.items():
        if value:
            c = F.col(names[option]) >= F.lit(value) if option == "since" else F.lower(F.col(names[option])) == str(value).lower()
            out = c if out is None else out & c
    return out
