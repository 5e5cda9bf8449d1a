"""The registered queries over the driver tables (fixture mapping: SURVEY §7-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import html as H
from webloom.operators import slices as SL
from webloom.operators.ordinal import with_ordinal
from webloom.sources.tables import read_table, scan_bytes, spread

# Fixed parameters of the registered queries.
SLICE_START, SLICE_END = 100, 600
TAIL_END = -50
CHUNK_SIZE = 1000
SQUEEZE_LEN = 500


def _pages(spark, d, *cols) -> DataFrame:
    # Text-heavy per-row work: spread a single-split scan over the cores
    # (no-op when the scan already has enough splits, i.e. at scale).
    return spread(read_table(spark, d, "pages").select(*(cols or ("page_id", "url", "html"))))


# ---- step 1: links and tab listing -------------------------------------------------

def q_extract_links(spark: SparkSession, d: str) -> DataFrame:
    return H.extract_links(_pages(spark, d))


def q_list_pages(spark: SparkSession, d: str) -> DataFrame:
    from webloom.operators.tabs import list_pages
    return list_pages(_pages(spark, d))


# ---- step 2: slices ----------------------------------------------------------------

def q_html_slice(spark, d):
    return SL.html_slice(_pages(spark, d, "page_id", "html"), SLICE_START, SLICE_END)


def q_html_slice_tail(spark, d):
    return SL.html_slice(_pages(spark, d, "page_id", "html"), 0, TAIL_END)


def q_chunk_pages(spark, d):
    return SL.chunk_pages(_pages(spark, d, "page_id", "html"), CHUNK_SIZE)


def q_squeeze_html(spark, d):
    return H.squeeze_html(_pages(spark, d, "page_id", "html"), SQUEEZE_LEN)


def q_page_metadata(spark, d):
    return H.page_metadata(_pages(spark, d))


# ---- step 3: bounded logs (events as the page log: key user_id, order ts, event_id) ----

LOG_KEY, LOG_ORDER = "user_id", ["ts", "event_id"]
LOG_N = 20                      # bound used on fixtures (the 100 bound never cuts there)
STATIC_FIXTURE_TYPES = ("view",)
RESET_TYPE = "signup"


def _events(spark, d, *cols):
    return read_table(spark, d, "events").select(*(cols or ("event_id", "ts", "user_id", "event_type")))


def q_last_n_log(spark, d):
    from webloom.operators.logs import last_n
    return last_n(_events(spark, d), LOG_KEY, LOG_ORDER, LOG_N).select(
        "user_id", "seq", "event_id", "event_type")


def q_network_requests(spark, d):
    from webloom.operators.logs import network_requests
    return network_requests(_events(spark, d), LOG_KEY, LOG_ORDER, "event_type", LOG_N,
                            static_types=STATIC_FIXTURE_TYPES).select(
        "user_id", "seq", "event_id", "event_type")


def q_since_last_reset(spark, d):
    from webloom.operators.logs import since_last_reset
    return since_last_reset(_events(spark, d), LOG_KEY, LOG_ORDER,
                            F.col("event_type") == RESET_TYPE).select(
        "user_id", "event_id", "event_type")


def q_tab_evictions(spark, d):
    from webloom.operators.logs import tab_evictions
    return tab_evictions(_events(spark, d), LOG_KEY, LOG_ORDER, "event_id")


def q_logs_per_page(spark, d):
    from webloom.operators.logs import logs_per_page
    keys = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return logs_per_page(keys, "user_id", _events(spark, d, "user_id", "ts", "event_id"),
                         "user_id", LOG_ORDER, "event_id")


# ---- step 4: time gaps, retention, downloads -------------------------------------

IDLE_FIXTURE, IDLE_TIMEOUT_FIXTURE = "1 hour", "24 hours"
AS_OF = "2024-01-31 00:00:00"
ROOT = "/srv/webloom"


def q_first_idle(spark, d):
    from webloom.operators.sessions import first_idle
    return first_idle(_events(spark, d, "user_id", "ts", "event_id"), "user_id", "ts",
                      "event_id", IDLE_FIXTURE, IDLE_TIMEOUT_FIXTURE)


def q_idle_sessions(spark, d):
    from webloom.operators.sessions import idle_sessions
    return idle_sessions(_events(spark, d, "user_id", "ts", "event_id"), "user_id", "ts", tie="event_id")


def q_expired(spark, d):
    from webloom.operators.retention import expired
    return expired(_events(spark, d, "event_id", "ts"), "ts", AS_OF)


def q_retained(spark, d):
    from webloom.operators.retention import retained
    return retained(_events(spark, d, "event_id", "ts"), "ts", AS_OF)


def q_download_manifest(spark, d):
    from webloom.operators.downloads import download_manifest
    return download_manifest(_pages(spark, d, "page_id", "url"), "url", ROOT, "downloads",
                             keep=("page_id",))


def q_final_files(spark, d):
    from webloom.operators.downloads import final_files
    return final_files(q_download_manifest(spark, d), "page_id")


def _lang_folder():
    from webloom.functions.urls import url_path
    return F.concat(F.lit("downloads/"), F.regexp_extract(url_path("url"), r"^/([^/]*)", 1))


def q_distinct_folders(spark, d):
    from webloom.operators.downloads import distinct_folders, download_manifest
    m = download_manifest(_pages(spark, d, "page_id", "url"), "url", ROOT, _lang_folder(),
                          keep=("page_id",))
    return distinct_folders(m, ROOT + "/downloads/en")


# ---- step 5: responses and requests ----------------------------------------------

BODY_LIMIT = 200


def _responses(spark, d):
    from webloom.sources.responses import responses
    return responses(spark, d)


def q_valid_requests(spark, d):
    from webloom.operators.responses import valid_requests
    from webloom.sources.responses import requests
    r = requests(spark, d)
    return r.select("id", valid_requests(r).alias("valid"))


def q_decode_body(spark, d):
    from webloom.operators.responses import decode_body
    return decode_body(_responses(spark, d)).select(
        "kind", "id", "body_kind", F.length("body_text").cast("bigint").alias("body_length"))


def q_truncate_body(spark, d):
    from webloom.operators.responses import decode_body, truncate_body, with_ok
    t = truncate_body(with_ok(decode_body(_responses(spark, d))), BODY_LIMIT)
    return t.select("kind", "id", "ok", "body_length", "truncated", F.col("body_out").alias("body"))


def q_normalize_headers(spark, d):
    from webloom.operators.responses import normalize_headers
    return normalize_headers(_responses(spark, d).select("kind", "id", "headers"))


def q_envelope(spark, d):
    from webloom.operators.downloads import file_name
    from webloom.operators.responses import envelope, fetch_error
    r = _responses(spark, d).select("kind", "id", "url", "status", "status_text")
    ok_text = F.concat(F.lit(f"File downloaded to: {ROOT}/downloads/"), file_name("url"))
    return envelope(r, ok_text, fetch_error(), keep=("kind", "id"))


def q_classify_timeouts(spark, d):
    from webloom.operators.responses import classify_timeouts, elapsed_ms
    from webloom.operators.sequence import with_shift
    ev = with_shift(_events(spark, d, "event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], ["ts"], 1)
    g = ev.select("event_id", elapsed_ms(F.col("ts"), F.col("next_ts")).alias("elapsed_ms"))
    return g.select("event_id", "elapsed_ms", classify_timeouts(g, "elapsed_ms").alias("error"))


# ---- step 6/7: search, language -------------------------------------------------

SEARCH_NUM = 10
FILTER_LANG, FILTER_START, FILTER_NUM = "en", 3, 5


def _user_turns(spark, d):
    return read_table(spark, d, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", "text")


def q_enrich_query(spark, d):
    from webloom.operators.search import enrich_query
    return _user_turns(spark, d).select("conv_id", "turn", enrich_query("text").alias("query"))


def q_search_urls(spark, d):
    from webloom.operators.search import search_url
    b = read_table(spark, d, "benchmark")
    return b.select("item_id", search_url("text", num=SEARCH_NUM, language="en").alias("url"))


def search_responses(spark, d):
    """Search-API-shaped JSON per document: one item per text line; texts under
    10 characters give a response without ``items``."""
    from webloom.sources.responses import DOC_URL
    docs = read_table(spark, d, "documents").select("doc_id", "text", "n_chars")
    lines = F.split("text", "\n")
    items = F.transform(lines, lambda line, i: F.struct(
        F.concat(F.lit("Line "), (i + 1).cast("string")).alias("title"),
        F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string"), F.lit("#L"), (i + 1).cast("string")).alias("link"),
        line.alias("snippet")))
    body = F.when(F.col("n_chars") >= 10, F.to_json(F.struct(F.lit("customsearch#search").alias("kind"),
                                                            items.alias("items")))) \
            .otherwise(F.to_json(F.struct(F.lit("customsearch#search").alias("kind"))))
    return docs.select(F.col("doc_id").alias("id"), body.alias("response"))


def q_parse_search_response(spark, d):
    from webloom.operators.search import parse_search_response
    return parse_search_response(search_responses(spark, d), "response", keep=("id",))


def q_search_outcomes(spark, d):
    """Search responses, of which some are errors and some are no JSON."""
    from webloom.operators.search import search_outcomes
    i = F.col("id")
    r = search_responses(spark, d).select("id", F.when(i % 7 == 0, F.substring("response", F.lit(2), F.length("response"))).otherwise(F.col("response")).alias("response"),
                                          F.when(i % 13 == 0, 503).otherwise(200).alias("status"),
                                          F.when(i % 13 == 0, "Service Unavailable").otherwise("OK").alias("status_text"))
    return search_outcomes(r, "response", "status", "status_text")


def q_page_head(spark, d):
    """Pages with a description put into their head."""
    meta = F.concat(F.lit("<head><meta content='Page "), F.col("page_id").cast("string"), F.lit(" &amp;  more' name=description>"))
    return H.page_head(_pages(spark, d).withColumn("html", F.replace(F.col("html"), F.lit("<head>"), meta)))


def _failing_translator(text: str) -> str:
    if len(text) % 5 == 0:
        raise RuntimeError("no service")
    return "[en] " + text


def q_translate_with(spark, d):
    """User turns through a translator of the user's that fails for some of them."""
    from webloom.operators.language import detect_language, translate_with
    turns = _user_turns(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    det = detect_language(turns, "key", "text", _small_profiles(spark, d))
    return translate_with(turns.join(det, "key"), "text", "lang_code", _failing_translator).select("conv_id", "turn", "query")


def _docs(spark, d, *cols):
    return spread(read_table(spark, d, "documents").select(*(cols or ("doc_id", "text"))))


def q_multi_search(spark, d):
    from webloom.operators.search import multi_search, with_result_text
    corpus = _docs(spark, d)
    res = multi_search(read_table(spark, d, "benchmark").select("item_id", "text"), corpus,
                       num=SEARCH_NUM)
    return with_result_text(res, corpus).select("item_id", "rank", "doc_id", "score", "title", "snippet")


def q_search_filtered(spark, d):
    from webloom.operators.search import multi_search, with_result_text
    corpus = _docs(spark, d, "doc_id", "text", "lang")
    res = multi_search(read_table(spark, d, "benchmark").select("item_id", "text"), corpus,
                       num=FILTER_NUM, start=FILTER_START, doc_filter=F.col("lang") == FILTER_LANG)
    return with_result_text(res, corpus.select("doc_id", "text")).select(
        "item_id", "rank", "doc_id", "score", "title", "snippet")


_INDEXES: dict = {}
INDEX_BATCHES, INDEX_BUCKETS, BUCKET_BYTES = 3, 8, 16 << 20


def _index(spark, d):
    """The stored index of the documents, appended in batches; made once for each session and corpus."""
    from webloom.operators.index import SearchIndex
    from webloom.streaming.stateful import scratch
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path, _ = scratch(spark, "index")
        docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
        buckets = max(INDEX_BUCKETS, scan_bytes(docs) // BUCKET_BYTES)     # as many as the corpus needs
        index = SearchIndex(spark, path, buckets, "bigint", {"lang": "string", "source": "string"})
        for k in range(INDEX_BATCHES):
            index.add(docs.where(F.pmod("doc_id", F.lit(INDEX_BATCHES)) == k))
        _INDEXES[key] = index
    return _INDEXES[key]


def q_index_search(spark, d):
    return _index(spark, d).search(read_table(spark, d, "benchmark").select("item_id", "text"), num=SEARCH_NUM)


def q_index_search_options(spark, d):
    """Another query set on the same index, with language and site."""
    from webloom.operators.index import search_filter
    turns = _user_turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    return _index(spark, d).search(turns, num=FILTER_NUM, doc_filter=search_filter(language=FILTER_LANG, site=_site(spark, d)))


def _site(spark, d) -> str:
    """The least name of a source."""
    return read_table(spark, d, "documents").agg(F.min("source")).first()[0]


def _profiles(spark, d, docs=None):
    from webloom.operators.language import train_profiles
    docs = docs if docs is not None else _docs(spark, d, "doc_id", "text", "lang")
    return train_profiles(docs, "doc_id", "text", "lang")


def q_detect_language(spark, d):
    from webloom.operators.language import detect_language
    return detect_language(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _small_profiles(spark, d))


_PROFILES: dict = {}


def _small_profiles(spark, d):
    """Profiles (languages x 300 rows) in the shared folder, made once for each
    session and corpus, and read by every query that labels texts."""
    import uuid

    from webloom.session import checkpoint_dir
    key = (spark.sparkContext.applicationId, d)
    if key not in _PROFILES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
        _profiles(spark, d).coalesce(1).write.parquet(path)
        _PROFILES[key] = path
    return spark.read.parquet(_PROFILES[key])


def q_translate_queries(spark, d):
    from webloom.operators.language import FIXTURE_DICTIONARY, detect_language, translate_queries
    turns = _user_turns(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    det = detect_language(turns, "key", "text", _small_profiles(spark, d))
    joined = turns.join(det, "key")
    return translate_queries(joined, "text", "lang_code", FIXTURE_DICTIONARY).select(
        "conv_id", "turn", "query")


def _enriched(spark, d):
    """Benchmark texts as queries: language, translated and enriched text; one row each, made once."""
    from webloom.operators.language import FIXTURE_DICTIONARY, detect_language, translate_queries
    from webloom.operators.search import enrich_query
    bench = read_table(spark, d, "benchmark").select("item_id", "text")
    det = detect_language(bench, "item_id", "text", _small_profiles(spark, d))
    q = translate_queries(bench.join(det, "item_id"), "text", "lang_code", FIXTURE_DICTIONARY, "translated")
    return q.withColumn("query", enrich_query("translated")).checkpoint(eager=True)


def q_search_report(spark, d):
    from webloom.operators.search import multi_search, nest_results, search_report
    q = _enriched(spark, d)
    res = multi_search(q.select("item_id", F.col("query").alias("text")), _docs(spark, d), num=SEARCH_NUM)
    nested = nest_results(res, "item_id", ["doc_id"]).select(
        "item_id", F.transform("results", lambda r: r["doc_id"].cast("string")).alias("ids"))
    full = q.join(nested, "item_id", "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<string>")))
    return search_report(full, "item_id", "lang_code", "query", "ids")


# ---- step 8: outline, page text, selectors, user functions ------------------------

SELECTOR = 'html[lang="fr"]'
TEXT_NEEDLE = "the"


def q_outline_nodes(spark, d):
    from webloom.operators.outline import outline_nodes
    return outline_nodes(_pages(spark, d, "page_id", "html"))


def q_outline_elements(spark, d):
    from webloom.operators.outline import outline_elements
    return outline_elements(_pages(spark, d, "page_id", "html"))


def q_outline_sql(spark, d):
    """The outline as a SQL table function, ``LATERAL`` over every page."""
    from webloom.operators.outline import register_outline_udtf
    register_outline_udtf(spark)
    _pages(spark, d, "page_id", "html").createOrReplaceTempView("webloom_pages")
    return spark.sql("SELECT p.page_id, t.node_id, t.parent_id, t.depth, t.pos, t.role, t.name, t.ref "
                     "FROM webloom_pages p, LATERAL outline_nodes(p.page_id, p.html) t")


def q_outline_text(spark, d):
    from webloom.operators.outline import outline_text
    return outline_text(_pages(spark, d, "page_id", "html")).select("page_id", "n_lines", "outline")


def q_page_text(spark, d):
    return H.page_text(_pages(spark, d, "page_id", "html"))


def q_pages_with(spark, d):
    from webloom.operators.selectors import pages_with
    return pages_with(_pages(spark, d), SELECTOR).select("page_id", "url")


def q_pages_without(spark, d):
    from webloom.operators.selectors import pages_with
    return pages_with(_pages(spark, d), SELECTOR, present=False).select("page_id", "url")


def count_paragraph_tags(html: str) -> int:
    return html.count("<p")


def q_evaluate_pages(spark, d):
    from webloom.operators.selectors import evaluate_pages
    return evaluate_pages(_pages(spark, d, "page_id", "html"), count_paragraph_tags, "bigint")


# Well-formed markup that is easy to misread; the queries put it before each page's own html.
MARKUP = (
    '<!-- <p class="btn">not here</p> --><div title="a > b">vis<div hidden>no <p>hidden text</p></div> after</div>'
    '<div style="display: none"><a href="/x">gone</a></div><pre> a  b\n c</pre><section class="lead box"><h2>Two</h2><p>first</p>'
    '<p class="btn-primary">second <b>bold</b> <i>it</i></p><ul><li>one</li><li class="btn">two <a href="/y"><b>in</b> link</a></li></ul></section>'
    '<article>outer words <article>inner words</article> tail words</article>')
DENSITY_MARK = "<hr>"           # in the place of article tags, so that only the blocks' words and links tell
SELECTORS = ("article p", "section > p", "h1 + p", "li ~ li", "div[title], pre", ".btn", 'nav ul > li a[href^="/"]', "p.btn-primary b + i")


def _framed(spark, d) -> DataFrame:
    return _pages(spark, d, "page_id", F.concat(F.lit(MARKUP), F.col("html")).alias("html"))


def q_main_article(spark, d):
    from webloom.operators.elements import main_article
    return main_article(_pages(spark, d, "page_id", "html"))


def q_main_article_nested(spark, d):
    """Pages with a nested article before their own."""
    from webloom.operators.elements import main_article
    return main_article(_framed(spark, d))


def q_main_article_blocks(spark, d):
    """Pages without article tags: words and link density of the blocks decide."""
    from webloom.operators.elements import main_article
    return main_article(_pages(spark, d, "page_id", F.regexp_replace("html", "</?article>", DENSITY_MARK).alias("html")))


def q_page_text_framed(spark, d):
    return H.page_text(_framed(spark, d))


def q_outline_framed(spark, d):
    from webloom.operators.outline import outline_elements
    return outline_elements(_framed(spark, d))


def q_select_elements(spark, d):
    """Elements by selectors with combinators; each selector reads the intervals of every page."""
    from webloom.operators.selectors import select_all
    return select_all(_framed(spark, d), SELECTORS)


def q_pages_with_chain(spark, d):
    from webloom.operators.selectors import pages_with
    return pages_with(_pages(spark, d, "page_id", "html"), "article p br").select("page_id")


def q_pages_with_text(spark, d):
    return H.pages_with_text(_pages(spark, d, "page_id", "html"), TEXT_NEEDLE)


# ---- step 9: batch fetch, correlation --------------------------------------------

def batch_requests(spark, d):
    """Crawl frontier: every page URL, then the links found on it, in order."""
    pages = _pages(spark, d)
    links = H.extract_links(pages)
    reqs = (pages.select("page_id", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("lpos"), "url")
            .unionByName(links.select("page_id", F.lit(1).alias("kind"), F.col("pos").alias("lpos"),
                                      F.col("href").alias("url"))))
    return with_ordinal(reqs, ["page_id", "kind", "lpos"], "pos").select("pos", "url")


def q_batch_fetch(spark, d):
    from webloom.operators.batch import batch_fetch
    return batch_fetch(batch_requests(spark, d), _pages(spark, d, "page_id", "url")).select(
        "pos", "url", "status", "tab_index", "error")


def q_batch_summary(spark, d):
    from webloom.operators.batch import batch_fetch, batch_summary
    return batch_summary(batch_fetch(batch_requests(spark, d), _pages(spark, d, "page_id", "url")))


EPOCH_S = 1704067200   # 2024-01-01 00:00:00 UTC


def conversation_messages(conv: DataFrame):
    """Requests = user turns, replies = assistant turns; a reply answers the
    turn right before it (id = (conv_id, rid)).  Request at epoch + conv_id h
    + turn min; reply 7 x (1 + conv_id % 6) s after the minute of the turn it
    answers.  No window, so the same definition works on a stream."""
    base = F.lit(EPOCH_S) + F.col("conv_id") * 3600
    req = conv.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("rid"), F.col("turn").alias("req_turn"),
        F.timestamp_seconds(base + F.col("turn") * 60).alias("req_ts"))
    rep = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("rid"), F.col("turn").alias("reply_turn"),
        F.timestamp_seconds(base + (F.col("turn") - 1) * 60 + 7 * (1 + F.col("conv_id") % 6)).alias("reply_ts"))
    return req, rep


def _correlation_out(c: DataFrame) -> DataFrame:
    return c.select("conv_id", "req_turn", "reply_turn",
                    F.timestamp_diff("SECOND", F.col("req_ts"), F.col("reply_ts")).cast("double").alias("latency_s"),
                    F.col("reply_ts").isNull().alias("timed_out"))


def q_correlate(spark, d):
    from webloom.operators.correlate import correlate
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "role")
    req, rep = conversation_messages(conv)
    return _correlation_out(correlate(req, rep, ["conv_id", "rid"]))


# ---- step 10: streaming twins --------------------------------------------------------

STREAM_DELAY = "1 hour"


STREAM_FILES, PART_BYTES = 4, 4 << 20
CLOSE_TYPE = "purchase"


def _ev_stream(spark, d):
    from webloom.sources.tables import read_stream_table
    return read_stream_table(spark, d, "events")


def _ev_parts(spark, d):
    """The events as a stream of several files in the order of time, one file for each micro-batch."""
    from webloom.streaming.stateful import scratch
    events = _events(spark, d)
    folder, _ = scratch(spark, "parts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(F.percentile_approx(at, [k / STREAM_FILES for k in range(1, STREAM_FILES)])).first()[0] or []
    part = sum((F.when(at > b, 1).otherwise(0) for b in bounds), F.lit(0))
    files = max(1, scan_bytes(events) // STREAM_FILES // PART_BYTES)        # a micro-batch of a large table has several
    for k in range(STREAM_FILES):           # one after the other: the stream takes files in the order of their times
        rows = events.where(part == k)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _stream_log(spark, d, close_type):
    from webloom.operators.logs import last_n
    from webloom.streaming.stateful import current_log, run_to_table, stream_last_n
    st = stream_last_n(_ev_parts(spark, d), "user_id", "ts", "event_id", "event_type", RESET_TYPE, LOG_N, close_type)
    log = current_log(run_to_table(st, "last_n"), "user_id", "event_id")
    timed = log.join(_events(spark, d, "event_id", "ts"), "event_id")
    return last_n(timed, "user_id", ["ts", "event_id"], LOG_N).select("user_id", "seq", "event_id", "event_type")


def q_stream_last_n(spark, d):
    return _stream_log(spark, d, None)


def q_stream_closes(spark, d):
    """ST1 with close events: a closed log is empty until its key has another event."""
    return _stream_log(spark, d, CLOSE_TYPE)


def q_stream_sessions(spark, d):
    from webloom.streaming.stateful import run_to_table, stream_sessions
    t = run_to_table(stream_sessions(_ev_stream(spark, d), "user_id", "ts", delay=STREAM_DELAY), "sessions")
    return t.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_calls")


def q_stream_correlate(spark, d):
    from webloom.sources.tables import read_stream_table
    from webloom.streaming.stateful import run_to_table, stream_correlate
    conv = read_stream_table(spark, d, "conversations").select("conv_id", "turn", "role")
    req, rep = conversation_messages(conv)
    return _correlation_out(run_to_table(stream_correlate(req, rep, ["conv_id", "rid"]), "correlate"))


def q_stream_tabs(spark, d):
    from webloom.streaming.stateful import run_to_table, stream_tabs
    return run_to_table(stream_tabs(_ev_parts(spark, d), "user_id", "ts", "event_id"), "tabs")


def q_stream_links(spark, d):
    from webloom.sources.tables import read_stream_table
    from webloom.streaming.stateful import run_to_table
    return run_to_table(H.extract_links(read_stream_table(spark, d, "pages")), "links")


def q_stream_chunks(spark, d):
    from webloom.sources.tables import read_stream_table
    from webloom.streaming.stateful import run_to_table
    return run_to_table(SL.chunk_pages(read_stream_table(spark, d, "pages").select("page_id", "html"), CHUNK_SIZE), "chunks")


def q_stream_text(spark, d):
    from webloom.sources.tables import read_stream_table
    from webloom.streaming.stateful import run_to_table
    return run_to_table(H.page_text(read_stream_table(spark, d, "pages").select("page_id", "html")), "text")


def q_stream_retention(spark, d):
    from webloom.streaming.stateful import stream_retention
    return stream_retention(_ev_stream(spark, d).select("event_id", "ts"), "ts", AS_OF, 5, "retention")


# ---- step 11: links JSON, follow, console, request bodies, files, quiet timer -------

FOLLOW_MAX_PAGES = 4
CONSOLE_BOUND = 100


def q_links_json(spark, d):
    from webloom.operators.results import links_json
    return links_json(_pages(spark, d))


def q_follow_links(spark, d):
    from webloom.operators.follow import follow_links, next_links
    pages = _pages(spark, d)
    return follow_links(pages.select("page_id", "url"), next_links(H.extract_links(pages)),
                        FOLLOW_MAX_PAGES)


CHAIN_PAGES, CHAIN_TURN, CHAIN_BACK = 50, 60, 25


def q_follow_chains(spark, d):
    """Chains of the pages by id: each leads to the next, every 60th back to the one 25 before it, every 97th nowhere."""
    from webloom.operators.follow import follow_links
    i = F.col("page_id")
    url = lambda n: F.concat(F.lit("https://chain.example/p/"), n.cast("string"))            # noqa: E731
    pages = read_table(spark, d, "pages").select("page_id", url(i).alias("url"))
    nexts = pages.select("page_id", F.when(i % 97 == 96, F.lit(None).cast("string")).when(i % CHAIN_TURN == CHAIN_TURN - 1, url(i - CHAIN_BACK))
                         .otherwise(url(i + 1)).alias("next_url"))
    return follow_links(pages, nexts, CHAIN_PAGES)


def q_host_names(spark, d):
    """URLs whose host names are words of the documents, as they go over the wire."""
    from webloom.functions.urls import normalize_url, url_host
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))
    docs = read_table(spark, d, "documents").select("doc_id", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.coalesce(
        F.get(words, k), F.lit("x"))).alias("w"))
    url = F.concat(F.lit("https://"), F.array_join("w", "."), F.lit(".example/p"))
    return docs.select("doc_id", normalize_url(url).alias("url"), url_host(url).alias("host"))


def q_console_messages(spark, d):
    from webloom.operators.logs import last_n
    from webloom.sources.responses import console_log
    log = console_log(read_table(spark, d, "events"))
    return last_n(log, "user_id", ["ts", "event_id"], CONSOLE_BOUND).select(
        "user_id", "seq", "event_id", "type", "text", F.col("location.url").alias("url"))


def q_request_bodies(spark, d):
    from webloom.functions.jsonfmt import canonical_json_udf
    from webloom.operators.responses import request_body
    from webloom.sources.responses import requests
    r = requests(spark, d)
    return r.select("id", request_body("headers", canonical_json_udf(F.col("body")), F.col("body"))
                    .alias("body"))


FOLDER_FILES = 10_000


def _written_documents(spark, d):
    """K2: every document body written to <shared folder>/downloads/part-<k>/doc-<id>.txt, about FOLDER_FILES in a folder."""
    from webloom.operators.downloads import write_downloads
    from webloom.streaming.stateful import scratch
    folder, _ = scratch(spark, "downloads")
    parts = 1 + read_table(spark, d, "documents").count() // FOLDER_FILES
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:         # else no text is shuffled
        docs = spread(docs)
    docs = docs.select(
        F.concat(F.lit(folder + "/part-"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("string"),
                 F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("body"))
    write_downloads(docs, "body", "path")
    return folder


def _doc_id_of(path_col):
    return F.regexp_extract(path_col, r"doc-([0-9]+)\.txt$", 1).cast("bigint")


def q_file_inventory(spark, d):
    from webloom.sources.files import file_inventory
    inv = file_inventory(spark, _written_documents(spark, d), "*.txt")
    return inv.select(_doc_id_of(F.col("path")).alias("doc_id"), F.col("length").cast("bigint").alias("length"))


def q_parse_documents(spark, d):
    from webloom.sources.files import parse_documents
    parsed = parse_documents(spark, _written_documents(spark, d), "*.txt")
    return parsed.select(_doc_id_of(F.col("path")).alias("doc_id"),
                         F.length("text").cast("bigint").alias("n_chars"), "error")


def q_stream_idle(spark, d):
    from webloom.streaming.stateful import run_to_table, stream_idle
    st = stream_idle(_ev_parts(spark, d), "user_id", "ts", "event_id", 3600.0, 86400.0, STREAM_DELAY)
    return run_to_table(st, "idle").select(
        "user_id", F.col("idle_at").cast("timestamp_ntz").alias("idle_at"), "timed_out")


# ---- data source reader and writer -----------------------------------------------------------

MISSING_EVERY = 11
FETCH_ROWS, SNAPSHOT_GROUP = 5_000, 4 << 20     # URLs of a task about, bytes of a row group


def q_fetch_source(spark, d):
    """Every page's URL through a fetcher over the snapshot of pages; of every eleventh page another URL, which fails."""
    from webloom.sources.fetch import register
    from webloom.streaming.stateful import scratch
    register(spark)
    folder, _ = scratch(spark, "urls")
    snapshot, _ = scratch(spark, "snapshot")
    missing = F.concat(F.lit("https://missing.example/"), F.col("page_id").cast("string"))
    pages = read_table(spark, d, "pages")
    urls = pages.select(F.col("page_id").alias("pos"), F.when(F.col("page_id") % MISSING_EVERY == 0, missing).otherwise(F.col("url")).alias("url"))
    parts = max(spark.sparkContext.defaultParallelism, urls.count() // FETCH_ROWS)
    # Both in the order of URLs, in small row groups: a task's URLs lie together in the snapshot.
    for rows, path in ((urls, folder), (pages.select("url", "html"), snapshot)):
        rows.repartitionByRange(parts, "url").sortWithinPartitions("url").write.option("parquet.block.size", SNAPSHOT_GROUP).parquet(path)
    got = (spark.read.format("webloom_fetch").option("fetcher", "webloom.sources.fetch:SnapshotFetcher")
           .option("fetcher.path", snapshot).load(folder))
    return got.select("pos", "url", "status", F.length(F.decode("body", "UTF-8")).cast("bigint").alias("length"), "error")


def q_file_sink(spark, d):
    """Every document as a file, written twice; the files that are there."""
    from webloom.sources.files import file_inventory
    from webloom.sources.sink import register
    from webloom.streaming.stateful import scratch
    register(spark)
    folder, _ = scratch(spark, "sink")
    docs = read_table(spark, d, "documents").select(F.concat(F.lit("part-"), (F.col("doc_id") % 7).cast("string"), F.lit("/doc-"), F.col("doc_id").cast("string"),
                                                             F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("body"))
    for _ in range(2):
        docs.write.format("webloom_files").mode("append").save(folder)
    return file_inventory(spark, folder + "/*").select(_doc_id_of(F.col("path")).alias("doc_id"), "length")


# ---- results as JSON -------------------------------------------------------------------

BATCH_SIZE = 25
TABS_PER_WINDOW = 10


def q_tabs_json(spark, d):
    from webloom.operators.results import tabs_json
    return tabs_json(q_list_pages(spark, d), TABS_PER_WINDOW)


def _users(spark, d):
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))


def q_console_json(spark, d):
    from webloom.operators.results import log_json
    from webloom.sources.responses import console_log
    log = console_log(read_table(spark, d, "events"))
    return log_json(_users(spark, d), "user_id", log, "user_id", ["ts", "event_id"], ["type", "text", "location"], CONSOLE_BOUND)


def q_network_json(spark, d):
    """The newest requests of every user, static ones left out after the bound."""
    from webloom.operators.logs import network_requests
    from webloom.operators.results import log_json
    from webloom.sources.responses import request_log
    log = network_requests(request_log(read_table(spark, d, "events")), "user_id", ["ts", "event_id"], "resourceType", LOG_N,
                           static_types=STATIC_FIXTURE_TYPES)
    return log_json(_users(spark, d), "user_id", log, "user_id", ["ts", "event_id"], ["url", "method", "resourceType", "headers"], LOG_N)


def q_batch_json(spark, d):
    from webloom.operators.results import batch_json
    return batch_json(q_batch_fetch(spark, d), BATCH_SIZE)


def q_slice_json(spark, d):
    from webloom.operators.results import slice_json
    return slice_json(q_html_slice(spark, d))


def _doc_link():
    from webloom.sources.responses import DOC_URL
    return F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string"))


def q_search_json(spark, d):
    from webloom.operators.results import results_by_query, search_json
    bench = read_table(spark, d, "benchmark").select("item_id", "text")
    return search_json(results_by_query(bench, q_multi_search(spark, d), "item_id", _doc_link()), "item_id", "text")


def q_search_results_report(spark, d):
    """K4 with titles, links and snippets."""
    from webloom.operators.results import report, results_by_query
    from webloom.operators.search import multi_search, with_result_text
    q = _enriched(spark, d)
    corpus = _docs(spark, d)
    res = with_result_text(multi_search(q.select("item_id", F.col("query").alias("text")), corpus, num=SEARCH_NUM), corpus)
    return report(results_by_query(q, res, "item_id", _doc_link()), "item_id", "lang_code", "query")


def q_fetch_api(spark, d):
    """Whole records for the API requests: one response of each kind for every request, by its id."""
    from webloom.operators.results import fetch_api
    from webloom.sources.responses import requests
    answers = _responses(spark, d).where(F.col("kind") != "page").groupBy("id").agg(F.min_by(
        F.struct("url", "status", "status_text", "headers", "body"), "kind").alias("r")).select("id", "r.*")
    timed = answers.withColumn("elapsed_ms", (F.col("id") % 1000) * 90.5)
    return fetch_api(requests(spark, d), timed, "id")


# ---- operators registered in the second round ------------------------------------------

EDGE_HTML = (
    "<!-- <a href='/no1'>no</a> --><script>var s = \"<a href='/no2'>no</a>\";</script>"
    "<a-card href='/no3'>no</a-card><a href=/1>one <a href='/2'>two</a>"
    "<a title='a > b' href=\"/3\">thr&eacute;e</a> text <a href=/4>four ")


def q_links_edge(spark, d):
    """Every page behind markup that is easy to misread; its own links follow those of the markup."""
    pages = _pages(spark, d)
    return H.extract_links(pages.select("page_id", "url", F.concat(F.lit(EDGE_HTML), F.col("page_id").cast("string"), F.lit("</a>"), F.col("html"))
                                        .alias("html")))


def q_request_log(spark, d):
    from webloom.operators.logs import last_n
    from webloom.sources.responses import request_log
    log = request_log(read_table(spark, d, "events"))
    return last_n(log, "user_id", ["ts", "event_id"], LOG_N).select(
        "user_id", "seq", "event_id", "url", "method", "resourceType", F.col("headers")["accept"].alias("accept"))


def q_drop_closed(spark, d):
    from webloom.operators.logs import drop_closed
    return drop_closed(_events(spark, d), "user_id", ["ts", "event_id"],
                       F.col("event_type") == RESET_TYPE).select("user_id", "event_id", "event_type")


def q_ref_selectors(spark, d):
    from webloom.operators.selectors import resolve_selector
    ids = F.col("event_id").cast("string")
    sel = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ref:"), ids)).otherwise(F.concat(F.lit("#e"), ids))
    return read_table(spark, d, "events").select("event_id", resolve_selector(sel).alias("selector"))


def q_request_defaults(spark, d):
    from webloom.operators.responses import with_defaults
    from webloom.sources.responses import requests
    return with_defaults(requests(spark, d).select("id", "limit"), {"limit": 1000.0})


def q_validation_rows(spark, d):
    from webloom.operators.responses import validate_enum, validate_index
    from webloom.sources.responses import METHODS, requests
    return requests(spark, d).select(
        "id", validate_enum("method", METHODS[:7], optional=False).alias("method_error"),
        validate_index(F.col("id") % 12, 10).alias("index_error"))


def q_squeezed_slices(spark, d):
    return H.squeezed_slices(_pages(spark, d, "page_id", "html"), SQUEEZE_LEN)


def q_dirty_bodies(spark, d):
    """Bodies of documents with a byte order mark, a byte that is no UTF-8 and JSON that JS prints in its own way."""
    from webloom.operators.responses import decode_body
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    k = F.col("id") % 5
    odd = F.lit('{"b":1,"2":[1e999,-0],"1":12345678901234567890123}')
    body = (F.when(k == 0, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode("text", "UTF-8")))
            .when(k == 1, F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xe9"))))
            .when(k == 2, F.encode(odd, "UTF-8")).when(k == 3, F.encode(F.lit("[NaN]"), "UTF-8"))
            .otherwise(F.encode(F.concat(F.lit("\ufeff"), odd), "UTF-8")))
    kind = F.when(k < 2, F.lit("text/plain")).otherwise(F.lit("application/json"))
    resp = docs.select("id", body.alias("body"), F.create_map(F.lit("Content-Type"), kind).alias("headers"))
    return decode_body(resp).select("id", "body_kind", "body_text", F.col("error").isNotNull().alias("failed"))


QUERIES = {
    "extract_links": q_extract_links,
    "list_pages": q_list_pages,
    "html_slice": q_html_slice,
    "html_slice_tail": q_html_slice_tail,
    "chunk_pages": q_chunk_pages,
    "squeeze_html": q_squeeze_html,
    "page_metadata": q_page_metadata,
    "last_n_log": q_last_n_log,
    "network_requests": q_network_requests,
    "since_last_reset": q_since_last_reset,
    "tab_evictions": q_tab_evictions,
    "logs_per_page": q_logs_per_page,
    "first_idle": q_first_idle,
    "idle_sessions": q_idle_sessions,
    "expired": q_expired,
    "retained": q_retained,
    "download_manifest": q_download_manifest,
    "final_files": q_final_files,
    "distinct_folders": q_distinct_folders,
    "valid_requests": q_valid_requests,
    "decode_body": q_decode_body,
    "truncate_body": q_truncate_body,
    "normalize_headers": q_normalize_headers,
    "envelope": q_envelope,
    "classify_timeouts": q_classify_timeouts,
    "enrich_query": q_enrich_query,
    "search_urls": q_search_urls,
    "parse_search_response": q_parse_search_response,
    "search_outcomes": q_search_outcomes,
    "page_head": q_page_head,
    "translate_with": q_translate_with,
    "stream_chunks": q_stream_chunks,
    "stream_text": q_stream_text,
    "multi_search": q_multi_search,
    "search_filtered": q_search_filtered,
    "index_search": q_index_search,
    "index_search_options": q_index_search_options,
    "search_report": q_search_report,
    "detect_language": q_detect_language,
    "translate_queries": q_translate_queries,
    "outline_nodes": q_outline_nodes,
    "outline_text": q_outline_text,
    "outline_elements": q_outline_elements,
    "outline_sql": q_outline_sql,
    "page_text": q_page_text,
    "pages_with": q_pages_with,
    "pages_without": q_pages_without,
    "evaluate_pages": q_evaluate_pages,
    "main_article": q_main_article,
    "main_article_nested": q_main_article_nested,
    "main_article_blocks": q_main_article_blocks,
    "page_text_framed": q_page_text_framed,
    "outline_framed": q_outline_framed,
    "select_elements": q_select_elements,
    "pages_with_chain": q_pages_with_chain,
    "pages_with_text": q_pages_with_text,
    "batch_fetch": q_batch_fetch,
    "batch_summary": q_batch_summary,
    "correlate": q_correlate,
    "stream_last_n": q_stream_last_n,
    "stream_closes": q_stream_closes,
    "stream_sessions": q_stream_sessions,
    "stream_correlate": q_stream_correlate,
    "stream_tabs": q_stream_tabs,
    "stream_links": q_stream_links,
    "stream_retention": q_stream_retention,
    "stream_idle": q_stream_idle,
    "fetch_source": q_fetch_source,
    "file_sink": q_file_sink,
    "links_json": q_links_json,
    "tabs_json": q_tabs_json,
    "console_json": q_console_json,
    "network_json": q_network_json,
    "batch_json": q_batch_json,
    "slice_json": q_slice_json,
    "search_json": q_search_json,
    "search_results_report": q_search_results_report,
    "fetch_api": q_fetch_api,
    "follow_links": q_follow_links,
    "follow_chains": q_follow_chains,
    "host_names": q_host_names,
    "console_messages": q_console_messages,
    "request_bodies": q_request_bodies,
    "file_inventory": q_file_inventory,
    "links_edge": q_links_edge,
    "request_log": q_request_log,
    "drop_closed": q_drop_closed,
    "ref_selectors": q_ref_selectors,
    "request_defaults": q_request_defaults,
    "validation_rows": q_validation_rows,
    "squeezed_slices": q_squeezed_slices,
    "dirty_bodies": q_dirty_bodies,
    "parse_documents": q_parse_documents,
}
