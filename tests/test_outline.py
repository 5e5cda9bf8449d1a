from webloom.operators.outline import format_outline, outline_nodes, outline_text, page_nodes
from webloom.operators.selectors import pages_with, parse_selector, resolve_selector

HTML_EDGE = """<html><head><title>t</title><script>var s="</p>";</script></head><body>
<nav role="navigation"><a href="/x" aria-label="">Home page link text that is definitely longer than fifty characters</a></nav>
<div hidden><button>hidden</button></div><div style="color:red; display: none">gone</div>
<form><input type="submit"><input type="button" aria-label="Go"><input type="hidden" value="z"><input></form>
<ul><li>one<ul><li>inner</li></ul><li>two</ul>
<p>first<p>second<h1>Head</h1>
<div onclick="f()">clickable</div><div data-mcp-ref="keep">kept</div><br><div></div>
</body></html>"""


def lines():
    return format_outline(page_nodes(5, HTML_EDGE)).splitlines()


def test_roles_names_visibility():
    out = lines()
    assert out[0].startswith('generic: "Home page link text')
    cut = "Home page link text that is definitely longer than fifty characters"[:50].strip()
    assert out[1] == f'  navigation: "{cut}"'
    assert out[2].startswith(f'    link: "{cut}" [ref:')
    assert not any("hidden" in l or "gone" in l for l in out)
    assert '    textbox: ""' in [l.split(" [ref:")[0] for l in out]
    assert any(l.startswith('    button: "Go" [ref:') for l in out)
    assert sum(1 for l in out if l.strip().startswith("textbox")) == 2   # submit + plain input
    assert any(l.startswith('  generic: "clickable" [ref:') for l in out)
    assert '  generic: "kept" [ref:keep]' in out


def test_implied_ends_and_nesting():
    rows = page_nodes(5, HTML_EDGE)
    by_name = {(r[5], r[6]): r for r in rows}
    p1, p2 = by_name[("generic", "first")], by_name[("generic", "second")]
    assert p1[3] == p2[3] == 1                     # <p> closed by the next <p>: siblings
    inner = by_name[("generic", "inner")]
    assert inner[3] == 4                           # body > ul > li > ul > li
    assert by_name[("heading", "Head")][3] == 1    # <h1> closes the open <p>
    ids = [r[1] for r in rows]
    assert ids == sorted(ids) and all(r[2] is None or r[2] < r[1] for r in rows)


def test_deterministic_refs_and_frames(spark):
    df = spark.createDataFrame([(5, HTML_EDGE), (6, "")], "page_id long, html string")
    n1 = outline_nodes(df).collect()
    n2 = outline_nodes(df).collect()
    assert [tuple(r) for r in n1] == [tuple(r) for r in n2]
    t = {r.page_id: r for r in outline_text(df).collect()}
    assert t[5].n_lines == len(n1) and t[5].outline.count("\n") == len(n1)
    assert t[6].error == "No body element"


def test_selectors(spark):
    df = spark.createDataFrame([(1, '<html lang="fr"><div class="a ad b" id="m">'), (2, "<html lang='en'>")],
                               "page_id long, html string")
    assert [r.page_id for r in pages_with(df, 'html[lang="fr"]').collect()] == [1]
    assert [r.page_id for r in pages_with(df, 'html[lang="fr"]', present=False).collect()] == [2]
    assert [r.page_id for r in pages_with(df, "div.ad#m").collect()] == [1]
    assert [r.page_id for r in pages_with(df, "html[lang]").collect()] == [1, 2]
    assert parse_selector("ref:abc") == parse_selector('[data-mcp-ref="abc"]')
    r = spark.range(1).select(resolve_selector(__import__("pyspark.sql.functions", fromlist=["lit"]).lit("ref:q1")).alias("s")).first()
    assert r.s == '[data-mcp-ref="q1"]'


def test_outline_udtf(spark):
    from webloom.operators.outline import register_outline_udtf
    register_outline_udtf(spark)
    spark.createDataFrame([(5, HTML_EDGE)], "page_id long, html string").createOrReplaceTempView("edge_pages")
    n = spark.sql("SELECT p.page_id, t.* FROM edge_pages p, LATERAL outline_nodes(p.page_id, p.html) t").count()
    assert n == len(page_nodes(5, HTML_EDGE))


def test_deep_nesting_and_elements(spark):
    from webloom.operators.outline import outline_elements
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    edge = ("<head><style>p{}</style><title>t</title></head><!-- <a>no</a> --><script>'<a>'</script><a aria-label='A &amp; b' href=x>t</a>"
            "<h2>  Head\nline two</h2><input type=BUTTON><input><input type=hidden><p hidden>x</p><p style='display: none'>y</p>"
            "<div onclick=f() title='a > b'>click</div><b role=tab data-mcp-ref=r9>z</b><img")
    pages = spark.createDataFrame([(1, deep), (2, edge), (3, None), (4, "")], "page_id long, html string")
    rows = outline_nodes(pages.where("page_id = 1")).collect()
    assert len(rows) == 3001 and max(r.depth for r in rows) == 3000 and {r.name for r in rows} == {"deep"}
    assert outline_text(pages.where("page_id = 1")).first().n_lines == 3001
    got = [(r.tag, r.role, r.name, r.ref is not None) for r in outline_elements(pages).where("page_id = 2").orderBy("pos").collect()]
    assert got == [("a", "link", "A & b", True), ("h2", "heading", "Head line two", False), ("input", "button", "", True), ("input", "textbox", "", True),
                   ("div", "generic", "click", True), ("b", "tab", "z", True)]
    assert outline_elements(pages).where("page_id > 2").count() == 0
    assert outline_elements(pages.limit(0)).count() == 0
