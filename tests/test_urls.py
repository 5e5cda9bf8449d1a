from pyspark.sql import functions as F

from webloom.functions.urls import form_encode, normalize_url, resolve_url, url_host
from webloom.operators.downloads import download_manifest
from webloom.operators.html import extract_links

BASE = "https://Ex.COM/a/b?x=1#y"
URL_EDGE = [
    ("https://h.org/P?q#f", "https://h.org/P?q#f"),
    ("HTTP://Other.COM/P", "http://other.com/P"),
    ("//h.org/x", "https://h.org/x"),
    ("/p", "https://ex.com/p"),
    ("p", "https://ex.com/a/p"),
    ("../p", "https://ex.com/p"),
    ("./c/../d/.", "https://ex.com/a/d/"),
    ("?q", "https://ex.com/a/b?q"),
    ("#f", "https://ex.com/a/b?x=1#f"),
    ("", "https://ex.com/a/b?x=1"),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("JavaScript:void(0)", "javascript:void(0)"),
    ("/a|b", "https://ex.com/a|b"),
    ("/a b", "https://ex.com/a%20b"),
    (" /trim ", "https://ex.com/trim"),
    ("/für,a b", "https://ex.com/f%C3%BCr,a%20b"),
    ("https://h.org", "https://h.org/"),
]


def test_resolve_url(spark):
    df = spark.createDataFrame([(BASE, h) for h, _ in URL_EDGE], "base string, href string")
    got = [r.u for r in df.select(resolve_url("base", "href").alias("u")).collect()]
    assert got == [e for _, e in URL_EDGE]


def test_link_filter_and_text(spark):
    html = ('<a href="/x">  A &amp; <b>B</b>\n</a><a href="mailto:m@x">m</a><abbr>no</abbr>'
            "<a>no href</a><A HREF='HTTP://Z.com/'>z</A><a href=javascript:f()>j</a>")
    pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    rows = [tuple(r) for r in extract_links(pages).collect()]
    assert rows == [(1, 0, "A & B", "https://h.com/x"), (1, 1, "z", "http://z.com/")]


def test_form_encoding(spark):
    r = spark.range(1).select(form_encode(F.lit("a b*~-._+é")).alias("q")).first()
    assert r.q == "a+b*%7E-._%2B%C3%A9"


FILE_EDGE = [
    ("https://h.com", None, "downloaded_file"),
    ("https://h.com/", None, "downloaded_file"),
    ("https://h.com/a/b/", None, "b"),
    ("https://h.com/a%20b.pdf", None, "a%20b.pdf"),
    ("https://h.com/?q=1", None, "downloaded_file"),
    ("https://h.com/x/y.zip?v=2#f", "explicit.bin", "explicit.bin"),
    ("https://h.com/x/y.zip", "", "y.zip"),
    ("not a url", None, None),
    ("not a url", "name.txt", "name.txt"),
]


def test_download_names(spark):
    df = spark.createDataFrame([(i, u, f) for i, (u, f, _) in enumerate(FILE_EDGE)],
                               "id long, url string, filename string")
    m = download_manifest(df, "url", "/root", "sub/../dl/", "filename", keep=("id",)).orderBy("id").collect()
    assert [r.filename for r in m] == [e for _, _, e in FILE_EDGE]
    assert {r.folder for r in m} == {"/root/dl"}
    abs_folder = download_manifest(df, "url", "/root", "/abs/x", "filename").first()
    assert abs_folder.folder == "/abs/x"


def test_base_href(spark):
    html = '<head><base href="/dir/sub/"></head><a href="x">X</a><a href="../y?q">Y</a><a href="/z">Z</a>'
    pages = spark.createDataFrame([(1, "https://h.com/p/q.html", html)], "page_id long, url string, html string")
    got = [r.href for r in extract_links(pages).orderBy("pos").collect()]
    assert got == ["https://h.com/dir/sub/x", "https://h.com/dir/y?q", "https://h.com/z"]


def test_link_text_line_breaks(spark):
    html = '<a href="/a">One <br/> Two<br>Three</a><a href="/b"><br>lead</a>'
    pages = spark.createDataFrame([(1, "https://h.com/", html)], "page_id long, url string, html string")
    assert [r.text for r in extract_links(pages).orderBy("pos").collect()] == ["One\nTwo\nThree", "lead"]


def test_host_names_go_over_the_wire_in_punycode(spark):
    import random

    from webloom.functions.urls import ascii_host
    r = random.Random(5)
    alphabet = "abcxyz019-üöäßéèñçœþ日本語中文字한국어абвгд😀🙂λμ"
    labels = ["bücher", "münchen", "日本語", "ü", "-ü-", "😀", "faß", "aéb", "", "plain", "A-Z", "BÜCHER"]
    labels += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(150)]
    hosts = [f"{x}.example" for x in labels] + ["bücher。example", "a.ü.b.日本", None]

    def wire(h):
        return h and ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in h.lower().replace("。", ".").split("."))
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, h string")
    got = {x.i: x.a for x in df.select("i", ascii_host("h").alias("a")).collect()}
    assert got == {i: wire(h) for i, h in enumerate(hosts)}
    one = df.limit(1).select(normalize_url(F.lit("https://Ü:p@BÜCHER.example:443/ü")).alias("u"), url_host(F.lit("http://bücher.example/")).alias("h")).first()
    assert one.h == "xn--bcher-kva.example" and one.u.endswith("@xn--bcher-kva.example/%C3%BC")
