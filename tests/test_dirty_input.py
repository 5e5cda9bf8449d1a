"""Input that is malformed, hostile or merely unusual: a defined result, never an ended job."""

import pytest
from pyspark.sql import functions as F

from webloom.functions.jsonfmt import canonical_json, pretty_json
from webloom.functions.text import decode_entities
from webloom.functions.urls import resolve_url, url_host, url_path
from webloom.operators.downloads import file_name
from webloom.operators.follow import follow_links
from webloom.operators.html import extract_links, page_description, squeezed_slices
from webloom.operators.responses import decode_body, request_body, validate_enum
from webloom.operators.retention import retained
from webloom.operators.selectors import parse_selector
from webloom.operators.slices import chunk_pages
from webloom.sources.files import extract_text


def _one(spark, fn, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v")).first()[0]


@pytest.mark.parametrize("text,want", [
    ("a&eacute;&uuml;&ntilde;&szlig;z", "aéüñßz"), ("&amp;lt; &lt;", "&lt; <"), ("&#233;&#xE9;&#x1F642;", "éé🙂"),
    ("&#38;amp;", "&amp;"), ("&unknown; &amp", "&unknown; &amp"), ("&", "&"), ("", ""), ("&#55296; &#0;", "&#55296; &#0;"),
    ("&nbsp;|&hellip;&&copy;", "\u00a0|…&©"), ("&NotEqualTilde;", "\u2242\u0338")])
def test_entities(spark, text, want):
    assert _one(spark, lambda c: decode_entities(c), text) in (want, want.replace("\u00a0", " "))


@pytest.mark.parametrize("url,host,path", [
    ("https://h.com/a b.pdf", "h.com", "/a%20b.pdf"), ("https://h.com/a|b", "h.com", "/a|b"), ("https://my_host.com/x", "my_host.com", "/x"),
    ("https://User:Pw@H.com:8080/x?q=a b", "h.com", "/x"), ("https://h.com", "h.com", "/"), ("https://h.com/für.pdf", "h.com", "/f%C3%BCr.pdf"),
    ("https://h.com/a/..", "h.com", "/"), ("no url", None, None), ("https://[::1]:80/x", "[::1]", "/x")])
def test_host_and_path(spark, url, host, path):
    assert _one(spark, url_host, url) == host and _one(spark, url_path, url) == path


def test_file_names(spark):
    got = [_one(spark, file_name, u) for u in ("https://h.com/a b.pdf", "https://h.com/x|y", "https://h.com/a/..", "https://h.com/für.pdf", "x")]
    assert got == ["a%20b.pdf", "x|y", "downloaded_file", "f%C3%BCr.pdf", None]


@pytest.mark.parametrize("href,want", [
    ("https://User:Pw@H.com/x", "https://User:Pw@h.com/x"), ("http://h.com:80/x", "http://h.com/x"), ("http://h.com:81/x", "http://h.com:81/x"),
    ("\\\\h.com\\a\\b?c\\d", "https://h.com/a/b?c\\d"), ("/a/%2e%2E/b/%2e/c", "https://base.org/b/c"), ("/a/%2e%2e", "https://base.org/"),
    ("mailto:A\\b", "mailto:A\\b")])
def test_normalised_references(spark, href, want):
    assert _one(spark, lambda c: resolve_url(F.lit("https://base.org/p/q"), c), href) == want


def test_links_of_a_page_that_is_easy_to_misread(spark):
    html = ("<!-- <a href=/no>no</a> --><script>x='<a href=/no>no</a>'</script><a-card href=/no>no</a-card>"
            "<a href=/1>one <a href=/2>two</a><a title='x > y' href=/3>three</a><a href=/4>four")
    pages = spark.createDataFrame([(1, "https://h.com/", html), (2, "https://h.com/", None), (3, "https://h.com/", "<a href='/u"),
                                   (4, "https://h.com/", "<a href=/x>" + "<b>y</b>" * 50_000)], "page_id long, url string, html string")
    got = [(r.page_id, r.href, r.text[:5]) for r in extract_links(pages).orderBy("page_id", "pos").collect()]
    assert got == [(1, "https://h.com/1", "one"), (1, "https://h.com/2", "two"), (1, "https://h.com/3", "three"),
                   (1, "https://h.com/4", "four"), (4, "https://h.com/x", "yyyyy")]


@pytest.mark.parametrize("text,want", [
    ("[NaN]", None), ("[Infinity]", None), ("[1e999,-1e999]", "[null,null]"), ('{"b":1,"2":2,"1":3}', '{"1":3,"2":2,"b":1}'),
    ("\ufeff[1]", "[1]"), ('{"a":"\\ud800"}', '{"a":"\\ud800"}'), ("9" * 400, "null"), ("9" * 5000, "null"), ("-0", "0"), ("[1,", None),
    ('"\\ud83d\\ude42"', '"🙂"'), ('{"01":1,"0":2}', '{"0":2,"01":1}'), ("[" * 100_000, None)])
def test_json_text(text, want):
    assert canonical_json(text) == want


def test_pretty_json_orders_as_js_does():
    assert pretty_json({"b": 1, "1": "\ud800"}) == '{\n  "1": "\\ud800",\n  "b": 1\n}'


def test_dirty_bodies_do_not_end_the_job(spark):
    rows = [(1, bytearray(b"caf\xe9"), "text/plain"), (2, bytearray(b"\xef\xbb\xbf[1]"), "application/json"),
            (3, bytearray(b'{"a":"\xff"}'), "application/json"), (4, bytearray(b'"\\ud800"'), "application/json"), (5, None, "text/plain")]
    df = spark.createDataFrame(rows, "id int, body binary, ct string").select("id", "body", F.create_map(F.lit("Content-Type"), "ct").alias("headers"))
    got = {r.id: (r.body_text, r.error) for r in decode_body(df).collect()}
    assert got[1][0] == "caf\ufffd" and got[2][0] == "[1]" and got[3][0] == '{"a":"\ufffd"}' and got[4][0] == '"\\ud800"' and got[5] == (None, None)


def test_request_bodies_of_objects_only(spark):
    df = spark.createDataFrame([("3",), ('"s"',), ('{"a": 1}',), ("[1, 2]",)], "raw string")
    got = [r[0] for r in df.select(request_body(F.create_map(F.lit("Content-Type"), F.lit("application/json")), F.lit("J"), F.col("raw"))).collect()]
    assert got == ["3", '"s"', "J", "J"]


def test_selectors_that_cannot_be_compiled_are_refused():
    for bad in ("p:not(.x)", "", "[a", "a >", ",a", "a > > b"):
        with pytest.raises(ValueError):
            parse_selector(bad)
    assert [len(c) for c in parse_selector("div p.x")] == [len(c) for c in parse_selector("a > b")] == [2]
    assert len(parse_selector("a,b")) == 2 and len(parse_selector("p.a.b.c.d.e")[0][0].conditions) == 5


def test_pdf_text():
    ok = b"%PDF-1.4\nstream\n(a\\050b\\)) Tj <48656c6c6f> Tj [(x) -5 <59>] TJ\nendstream"
    assert extract_text("x.pdf", ok) == "a(b)\nHello\nxY"
    with pytest.raises(ValueError):
        extract_text("x.pdf", b"%PDF-1.4\nstream\nq Q\nendstream")


def test_follow_uses_normalised_urls_and_the_least_page(spark):
    pages = spark.createDataFrame([(5, "https://c.org/1"), (2, "https://c.org/2#top"), (3, "https://c.org/2"), (4, "https://c.org/3")], "page_id long, url string")
    nexts = spark.createDataFrame([(5, "https://c.org/2"), (2, "https://C.org/3"), (3, "https://c.org/1"), (4, "https://c.org/1#x")], "page_id long, next_url string")
    got = {(r.hop, r.url) for r in follow_links(pages, nexts, 5).where("start = 5").collect()}
    assert got == {(0, "https://c.org/1"), (1, "https://c.org/2"), (2, "https://C.org/3")}


def test_chunks_and_squeezed_slices(spark):
    pages = spark.createDataFrame([(1, "ab\ncd🙂f"), (2, ""), (3, None)], "page_id long, html string")
    got = {(r.page_id, r.chunk): (r.content, r.start_index, r.end_index, r.remaining_characters) for r in chunk_pages(pages, 3).collect()}
    assert got == {(1, 0): ("ab\n", 0, 3, 4), (1, 1): ("cd🙂", 3, 6, 1), (1, 2): ("f", 6, 7, 0), (2, 0): ("", 0, 0, 0)}
    assert [r.content for r in squeezed_slices(pages.where("page_id = 1"), 4).orderBy("chunk").collect()] == ["ab c", "d🙂f"]


def test_small_ones(spark):
    assert _one(spark, page_description, "<meta charset=x><meta name='description' content=\"a &amp;  b\">") == "a & b"
    assert _one(spark, page_description, "<p>no") is None
    df = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(validate_enum("v", ("a", "b"))).collect()] == [None, "Invalid args", None]
    ev = spark.createDataFrame([(1,)], "id int").select(F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    assert "coalesce" not in retained(ev, "ts", "2024-01-03")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_equal_requests_are_all_answered(spark):
    import datetime as dt

    from webloom.operators.correlate import correlate
    t = dt.datetime(2024, 1, 1)
    req = spark.createDataFrame([(1, t), (1, t), (2, t)], "id long, req_ts timestamp")
    rep = spark.createDataFrame([(1, t + dt.timedelta(seconds=9), "b"), (1, t + dt.timedelta(seconds=3), "a")],
                                "id long, reply_ts timestamp, body string")
    assert sorted((r.id, r.body) for r in correlate(req, rep, ["id"]).collect() if r.body) == [(1, "a"), (1, "a")]
    assert correlate(req, rep, ["id"]).count() == 3
