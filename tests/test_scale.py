"""Steps that grow with the input have tasks that grow in number, not in size."""

import os
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from webloom.operators import language
from webloom.plans import queries as Q
from webloom.sources import fetch, files, tables
from webloom.streaming.stateful import scratch


def test_spread_deals_a_scan_by_its_bytes(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(tables, "SPREAD_BYTES", tables.scan_bytes(df) // 50)
    wide = tables.spread(df)
    assert wide.rdd.getNumPartitions() >= 50 and wide.count() == 20_000
    # Of a join, what its tables read, not the planner's product.
    assert tables.scan_bytes(df.crossJoin(df.select("id"))) <= 3 * tables.scan_bytes(df)


def test_many_small_files_make_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"doc-{k}.txt").write_text("x" * (k % 5 + 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")           # as openCostInBytes: a task for each file
    try:
        plain = spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
        inv = files.file_inventory(spark, str(tmp_path), "*.txt")
        parsed = files.parse_documents(spark, str(tmp_path), "*.txt")
        assert plain == 300 and max(inv.rdd.getNumPartitions(), parsed.rdd.getNumPartitions()) <= spark.sparkContext.defaultParallelism
        assert Counter(r.length for r in inv.collect()) == {n: 60 for n in range(1, 6)}
        assert Counter(len(r.text) for r in parsed.collect()) == {n: 60 for n in range(1, 6)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_driver_keeps_no_list_of_files(spark, tmp_path):
    """The rows of Spark's own listing, from a stored table: the plan reads as many files for 300 as for 3."""
    for k in range(300):
        folder = tmp_path / f"part-{k % 7}" / ("deep" if k % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"doc {k}%20.txt").write_text("x" * (k % 4))                 # some are empty
    for name in (".hidden.txt", "_hidden.txt", "_k=1.txt", "x.bin", "_no/y.txt", "_metadata_d/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nothing")
    for path, glob in (("", None), ("", "*.txt"), ("/part-[0-3]", "doc ?%*"), ("/*", "*.txt"), ("/p*/deep", None), ("/x.bin", None)):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        plain = (plain.option("pathGlobFilter", glob) if glob else plain).load(f"{tmp_path}{path}").select("path", "modificationTime", "length")
        inv = files.file_inventory(spark, f"{tmp_path}{path}", glob)
        assert inv.schema == plain.schema and sorted(map(tuple, inv.collect())) == sorted(map(tuple, plain.collect())) and not plain.isEmpty()
        if path != "/x.bin":
            assert not any(str(tmp_path) in f for f in inv.inputFiles()) and len(inv.inputFiles()) < 60
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.file_inventory(spark, f"{tmp_path}/none")


def test_written_documents_lie_in_folders_of_bounded_size(spark, sf_small, monkeypatch):
    monkeypatch.setattr(Q, "FOLDER_FILES", 20)
    folder = Q._written_documents(spark, sf_small).replace("file:", "")
    names = [os.listdir(f"{folder}/{part}") for part in os.listdir(folder)]
    assert sum(map(len, names)) == spark.read.parquet(f"{sf_small}/documents.parquet").count() and max(map(len, names)) <= 60


def test_snapshot_reads_only_the_rows_around_its_urls(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    n = 4_000
    rows = spark.range(n).select(F.format_string("https://x.example/%06d", "id").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html"))
    twice = rows.union(rows.where(F.col("url").endswith("/000000")).select("url", F.lit(None).cast("string")))
    twice.repartitionByRange(8, "url").sortWithinPartitions("url").write.parquet(path)
    fetcher = fetch.SnapshotFetcher({"path": path})
    read = []

    class Counting:
        def to_batches(self, **kw):
            for b in fetcher_pages.to_batches(**kw):
                read.append(b.num_rows)
                yield b
    fetcher_pages, fetcher.pages = fetcher.pages, Counting()
    urls = [f"https://x.example/{k:06d}" for k in range(100, 200)]
    fetcher.prepare([*urls, "https://missing.example/1"])
    assert fetcher.fetch(urls[5]).body == b"105" * 200 and sum(read) == 100 and max(read) <= fetch.SNAPSHOT_ROWS
    with pytest.raises(LookupError):
        fetcher.fetch("https://missing.example/1")
    fetcher.prepare([*urls, "https://missing.example/1"])               # the same ones again: nothing is read
    assert sum(read) == 100 and fetcher.fetch(urls[5]).status == 200
    fetcher.prepare(["https://x.example/000000"])
    assert fetcher.fetch("https://x.example/000000").body == b"" and set(fetcher.known) == {"https://x.example/000000"}


def test_fetched_urls_and_snapshot_lie_in_one_order(spark, sf_small):
    got = Q.q_fetch_source(spark, sf_small)
    folder = [r for r in os.listdir(scratch(spark, "x")[0].replace("file:", "").rsplit("/", 2)[0]) if r.startswith("snapshot-")]
    assert folder and got.where("error is null").count() > 0
    base = scratch(spark, "x")[0].replace("file:", "").rsplit("/", 2)[0] + f"/{folder[-1]}/data"
    bounds = []
    for f in sorted(x for x in os.listdir(base) if x.endswith(".parquet")):
        urls = [u for u in pq.read_table(f"{base}/{f}", columns=["url"]).column(0).to_pylist() if u is not None]
        assert urls == sorted(urls)
        bounds += [(urls[0], urls[-1])] if urls else []
    assert len(bounds) > 1 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_counts_of_many_texts_equal_those_of_each():
    texts = ["", "  ", " a ", " abc abc ", "  x y  z ", " \U0001f600\u00e9\u00e8 \u4e2d\u6587\u5b57 ", " the cat  "]
    want = Counter()
    for t in texts:
        want.update(language._counts(t))
    assert language._corpus_counts(texts) == want and sum(want.values()) > 10
    many = ["".join([" ", *[chr(0x4e00 + (k * j) % 3_000) for j in range(1, 50)], " "]) for k in range(60)]       # a large alphabet
    want = Counter()
    for t in many:
        want.update(language._counts(t))
    assert language._corpus_counts(many) == want and language._corpus_counts([]) == Counter()


def test_a_micro_batch_of_many_events_has_several_files(spark, sf_small, monkeypatch):
    def log():
        return sorted(map(tuple, Q.q_stream_last_n(spark, sf_small).collect()))
    want = log()
    monkeypatch.setattr(Q, "PART_BYTES", max(1, Q.scan_bytes(Q._events(spark, sf_small)) // 12))
    streams = os.path.dirname(os.path.dirname(scratch(spark, "x")[0])).replace("file:", "")
    before = set(os.listdir(streams))
    assert log() == want and len(want) > 50
    parts, = [x for x in set(os.listdir(streams)) - before if x.startswith("parts-")]
    assert len([f for f in os.listdir(f"{streams}/{parts}/data") if f.endswith(".parquet")]) == 12
