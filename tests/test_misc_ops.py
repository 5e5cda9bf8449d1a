import glob
import os

from pyspark.sql import functions as F

from webloom.operators.downloads import final_files, write_downloads
from webloom.operators.follow import follow_links
from webloom.operators.ordinal import with_ordinal
from webloom.operators.retention import expired, retained
from webloom.sources.files import file_inventory, parse_documents


def test_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("v"))
    got = sorted((r.k, r.idx) for r in with_ordinal(df, ["k"], "idx", 7).collect())
    assert [i for _, i in got] == list(range(5000))


def test_follow_chain_with_cycle(spark):
    # six pages: 1 -> 2 -> 3 -> 4 -> 5 -> 6 -> 4 (cycle), start everywhere
    pages = spark.createDataFrame([(i, f"https://c.org/{i}") for i in range(1, 7)], "page_id long, url string")
    nxt = {1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 4}
    nexts = spark.createDataFrame([(k, f"https://c.org/{v}") for k, v in nxt.items()], "page_id long, next_url string")
    out = follow_links(pages, nexts, 4)
    walks = {}
    for r in out.collect():
        walks.setdefault(r.start, []).append((r.hop, r.url))
    assert [u for _, u in sorted(walks[1])] == [f"https://c.org/{i}" for i in (1, 2, 3, 4)]
    assert [u for _, u in sorted(walks[5])] == [f"https://c.org/{i}" for i in (5, 6, 4)]   # cycle stops
    assert max(h for w in walks.values() for h, _ in w) == 3


def test_retention_partition(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("event_id", "ts")
    e, r = expired(ev, "ts", "2024-01-31"), retained(ev, "ts", "2024-01-31")
    assert e.count() + r.count() == ev.count() and e.join(r, "event_id").count() == 0


def test_write_inventory_parse(spark, tmp_path):
    import io
    import zipfile
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space="preserve"> w</w:t></w:r></w:p>'
                                        '<w:p><w:r><w:t>second &amp; last</w:t></w:r></w:p></w:document>')
    rows = [(str(tmp_path / "a.txt"), b"plain text", 1), (str(tmp_path / "a.txt"), b"newer", 2),
            (str(tmp_path / "d.docx"), docx.getvalue(), 3), (str(tmp_path / "bad.docx"), b"nope", 4)]
    df = spark.createDataFrame(rows, "path string, body binary, seq long")
    newest = final_files(df, "seq").join(df, ["path", "seq"])
    write_downloads(newest, "body", "path")
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "*"))) == ["a.txt", "bad.docx", "d.docx"]
    inv = {os.path.basename(r.path): r.length for r in file_inventory(spark, str(tmp_path)).collect()}
    assert inv["a.txt"] == 5
    parsed = {os.path.basename(r.path): (r.text, r.error) for r in parse_documents(spark, str(tmp_path)).collect()}
    assert parsed["a.txt"] == ("newer", None)
    assert parsed["d.docx"] == ("Hello w\nsecond & last", None)
    assert parsed["bad.docx"][0] is None and parsed["bad.docx"][1]


def test_batch_fetch_lookup_key(spark):
    from webloom.operators.batch import batch_fetch, batch_summary
    pages = spark.createDataFrame([(1, "https://h.com/p#top"), (2, "https://h.com/q"), (3, "https://H.com/q")],
                                  "page_id long, url string")
    reqs = spark.createDataFrame([(0, "HTTPS://H.com/p"), (1, "https://h.com/q#x"), (2, "https://h.com/zz"),
                                  (3, "http://h.com/p"), (12, "https://h.com/q")], "pos long, url string")
    out = {r.pos: (r.status, r.tab_index, r.page_id) for r in batch_fetch(reqs, pages).collect()}
    assert out == {0: ("success", 0, 1), 1: ("success", 1, 2), 2: ("error", None, None),
                   3: ("error", None, None), 12: ("success", 9, 2)}
    summary = {r.status: r.n for r in batch_summary(batch_fetch(reqs, pages)).collect()}
    assert summary == {"success": 3, "error": 2}
