"""Search over a document corpus (D2 multi-query search, P21 enrichment,
P22 search URLs, P23 options, S4 response parsing, W9 paging, A2 nesting,
K4 report).

The remote search service is re-aimed as BM25 over an inverted index
built by Spark:

    corpus --explode tokens, keep query vocabulary, count in the task-->
    postings (doc, term, tf, dl) + one length row per doc
    [stored: the corpus is read once]
    postings --groupBy term (map-side combined)--> df
    blocks of postings x blocks of query terms --arrays in the task-->
    each block's best documents of each query  (operators.scoring)
    row_number per query <= start+num-1  (WindowGroupLimit, map-side too)

No cross join: queries meet documents only through shared terms.  A
document's tokens are counted in its own task: texts, exploded tokens and
score contributions are never shuffled; only postings, partial df counts
and each block's top-k rows are.  A
very common term (a third of all postings) is combined per map task.
Corpus size and mean length come back to the driver as two numbers
(one-row aggregate over the checkpointed table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import js_trim
from webloom.functions.urls import form_encode
from webloom.session import checkpoint_dir
from webloom.operators.scoring import best_documents
from webloom.sources.tables import stored

# Fixed values.
K1, B = 1.2, 0.75
TOKEN_RE = r"[\p{L}\p{N}]+"
ENRICH_SUFFIX = " best tips"
SEARCH_ENDPOINT = "https://www.googleapis.com/customsearch/v1"
TITLE_LEN, SNIPPET_LEN = 80, 160
SCORE_DIGITS = 6
BROADCAST_ROWS = 100_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def counted_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (stored) to be sent to the tasks if it has few rows; very many meet the others by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def tokens(text) -> Column:
    """Lower-cased letter/digit runs (one JVM regex call, no lambda)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_RE), 0)


def enrich_query(text) -> Column:
    """Append ' best tips' unless the text already mentions best or tips."""
    t = _col(text)
    low = F.lower(t)
    return F.when(~low.contains("best") & ~low.contains("tips"), F.concat(t, F.lit(ENRICH_SUFFIX))) \
            .otherwise(t)


def search_url(query, key: str = "API_KEY", cx: str = "ENGINE_ID", num=None, start=None,
               language=None, region=None, site=None, date_restrict=None) -> Column:
    """Key, cx, q, then num/start/lr/cr/siteSearch/dateRestrict only when
    truthy, in that order, form-encoded (space -> '+')."""
    def opt(name, v, fmt=lambda c: c):
        if v is None:
            return None
        c = F.lit(v) if not isinstance(v, Column) else v
        s = fmt(c.cast("string"))
        truthy = c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0")
        return F.when(truthy, F.concat(F.lit(name + "="), form_encode(s)))
    parts = [F.lit("key=" + key), F.lit("cx=" + cx), F.concat(F.lit("q="), form_encode(_col(query)))]
    for item in (opt("num", num), opt("start", start),
                 opt("lr", language, lambda c: F.concat(F.lit("lang_"), c)),
                 opt("cr", region, lambda c: F.concat(F.lit("country"), c)),
                 opt("siteSearch", site), opt("dateRestrict", date_restrict)):
        if item is not None:
            parts.append(item)
    return F.concat(F.lit(SEARCH_ENDPOINT + "?"), F.concat_ws("&", *parts))


ITEM_SCHEMA = "struct<items: array<struct<title: string, link: string, snippet: string>>>"


def parse_search_response(df: DataFrame, json_col: str, keep=("id",), outer: bool = False) -> DataFrame:
    """``items[]`` -> rows ``(*keep, rank, title, link, snippet)``; missing
    items read as an empty list (no rows, or one NULL row with ``outer``).
    The narrow schema prunes every other field of the response."""
    parsed = F.coalesce(F.from_json(_col(json_col), ITEM_SCHEMA)["items"],
                        F.array().cast("array<struct<title:string,link:string,snippet:string>>"))
    gen = F.posexplode_outer(parsed) if outer else F.posexplode(parsed)
    return (df.select(*keep, gen.alias("pos", "it"))
            .select(*keep, (F.col("pos") + 1).cast("bigint").alias("rank"),
                    F.col("it.title").alias("title"), F.col("it.link").alias("link"),
                    F.col("it.snippet").alias("snippet")))


def is_json(text: Column) -> Column:
    """Whether a text is JSON and nothing more.  The parser stops after a first value; inside an array and inside an
    object it has to read on to the end."""
    inside = [F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(inside[0] & inside[1] & text.rlike(r"[^ \t\r\n]"), F.lit(False))


SEARCH_ERROR = "Google Search error: "          # fixed value: the message for a status that is not 2xx
NOT_JSON = "Unexpected token in search response"


def search_outcomes(df: DataFrame, json_col: str, status_col: str, text_col: str, keep=("id",)) -> DataFrame:
    """S4 with failures: the rows of :func:`parse_search_response` with ``error`` NULL, and one row with only an
    error for a response whose status is not 2xx or whose body is no JSON.  A response without items has no rows."""
    error = (F.when(~F.col(status_col).between(200, 299), F.concat(F.lit(SEARCH_ERROR), F.coalesce(text_col, F.lit(""))))
             .when(~is_json(_col(json_col)), F.lit(NOT_JSON)))
    rows = df.select(*keep, F.col(json_col).alias("_j"), error.alias("error"))
    none = "array<struct<title:string,link:string,snippet:string>>"
    items = F.coalesce(F.from_json("_j", ITEM_SCHEMA)["items"], F.array().cast(none))
    failed = F.array(F.lit(None).cast("struct<title:string,link:string,snippet:string>"))
    return (rows.select(*keep, "error", F.posexplode(F.when(F.col("error").isNotNull(), failed).otherwise(items)).alias("pos", "it"))
            .select(*keep, F.when(F.col("error").isNull(), F.col("pos") + 1).cast("bigint").alias("rank"),
                    F.col("it.title").alias("title"), F.col("it.link").alias("link"), F.col("it.snippet").alias("snippet"), "error"))


def multi_search(queries: DataFrame, corpus: DataFrame, query_id: str = "item_id",
                 query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
                 num: int = 10, start: int = 1, doc_filter: Column | None = None) -> DataFrame:
    """D2 + W9 + P23: every query's ranked results, flat:
    ``(query_id, rank, doc_id, score)`` with rank in [start, start+num-1].

    BM25 (k1=1.2, b=0.75, idf = ln(1 + (N-df+.5)/(df+.5))) over distinct query
    terms; score rounded to 6 digits before ranking; ties by doc id.
    ``doc_filter`` (e.g. language / site) restricts results, while idf and
    length normalisation stay those of the whole corpus.

    The corpus is read and tokenised once: postings of the query vocabulary
    plus one marker row per document (its length) are stored in the
    shared checkpoint folder; N / mean length (one-row aggregate), df and the
    scores all read that table.
    """
    qterms = (queries.select(F.col(query_id).alias("_q"),
                             F.explode(F.array_distinct(tokens(query_text))).alias("term")))
    qterms = stored(qterms)
    vocab = stored(qterms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    vocab, n_rows = counted_broadcast(vocab), qterms.count()
    keep = doc_filter if doc_filter is not None else F.lit(True)
    # A document is one row in one task: the partial aggregation below already
    # counts its terms, so only postings of the query vocabulary are shuffled,
    # never a text or its tokens.
    docs = corpus.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_x"), keep.alias("_keep"))
    toks = docs.select("_d", "_keep", tokens("_x").alias("_t"))
    # NULL term = the document's own marker row (carries dl even when the
    # document shares no term with any query).
    exploded = toks.select("_d", "_keep", F.size("_t").alias("dl"),
                           F.explode(F.array_append(F.col("_t"), F.lit(None).cast("string"))).alias("term"))
    table = stored(exploded.join(vocab, "term", "left")
                   .where(F.col("tid").isNotNull() | F.col("term").isNull())
                   .groupBy("_d", "tid", "dl", "_keep").agg(F.count(F.lit(1)).alias("tf")))
    row = table.where(F.col("tid").isNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a")).first()
    n_docs, avgdl = int(row["n"] or 0), float(row["a"] or 0.0)
    postings = table.where(F.col("tid").isNotNull())
    dfs = postings.groupBy("tid").agg(F.count("tf").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
    weighted = stored(qterms.join(vocab, "term").join(counted_broadcast(stored(dfs)), "tid").select("_q", "tid", idf.alias("idf")))
    scores = best_documents(postings.where("_keep").select(F.col("_d").alias("doc"), "tid", (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("w")),
                            weighted, n_docs, n_rows, start + num - 1, SCORE_DIGITS).withColumnRenamed("doc", "_d")
    w = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_d").asc())
    last = start + num - 1
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(
        (F.col("rank") >= start) & (F.col("rank") <= last))
    return ranked.select(F.col("_q").alias(query_id), F.col("rank").cast("bigint").alias("rank"),
                         F.col("_d").alias(doc_id), "score")


def with_result_text(results: DataFrame, corpus: DataFrame, doc_id: str = "doc_id",
                     doc_text: str = "text") -> DataFrame:
    """Attach ``title`` (first line, trimmed, 80 chars) and ``snippet`` (first
    160 chars) from the corpus.  The results (queries x num rows) are the
    build side: they are counted and broadcast up to ``BROADCAST_ROWS`` rows,
    beyond that joined by a shuffle.  A result whose document the corpus
    lacks has no text to show and is left out."""
    spark = corpus.sparkSession
    checkpoint_dir(spark)
    results = results.checkpoint(eager=True)
    build = F.broadcast(results) if results.count() <= BROADCAST_ROWS else results
    t = F.col(doc_text)
    meta = corpus.select(F.col(doc_id),
                         F.substring(js_trim(F.substring_index(t, "\n", 1)), 1, TITLE_LEN).alias("title"),
                         F.substring(t, 1, SNIPPET_LEN).alias("snippet"))
    return meta.join(build, doc_id).select(*results.columns, "title", "snippet")


def nest_results(flat: DataFrame, query_id: str, fields: list[str]) -> DataFrame:
    """A2: ``(query_id, results array<struct<rank, ...>>)`` ordered by rank
    (bounded by ``num`` per query)."""
    return flat.groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("results"))


def search_report(report_in: DataFrame, query_id: str, lang_col: str, query_col: str,
                  ids_col: str) -> DataFrame:
    """K4: ``Detected language: X\\nEnriched query: Q\\n\\nResults:\\n[ids]``."""
    return report_in.select(query_id, F.concat(
        F.lit("Detected language: "), F.col(lang_col), F.lit("\nEnriched query: "), F.col(query_col),
        F.lit("\n\nResults:\n["), F.array_join(F.col(ids_col), ","), F.lit("]")).alias("report"))
