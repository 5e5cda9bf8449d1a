import os

import pytest
from pyspark.sql import functions as F

from webloom.sources import fetch, sink
from webloom.sources.fetch import Fetcher, Response


class Echo(Fetcher):
    """Answers with the URL; some URLs fail."""

    def prepare(self, urls):
        if "https://bad.chunk/" in urls:
            raise OSError("no network")

    def fetch(self, url):
        if "fail" in url:
            raise TimeoutError("timed out")
        return Response(404 if "gone" in url else 200, url.encode(), "", {"x-option": self.options.get("mark", "")})


def _urls(spark, folder, rows, files=1):
    spark.createDataFrame(rows, "pos long, url string").repartition(files).write.mode("append").parquet(str(folder))


def _read(spark, folder, **options):
    fetch.register(spark)
    r = spark.read.format("webloom_fetch").option("fetcher", "tests.test_datasources:Echo")
    for k, v in options.items():
        r = r.option(k.replace("__", "."), v)
    return r.load(str(folder))


def test_one_row_for_each_url(spark, tmp_path):
    _urls(spark, tmp_path / "u", [(1, "https://a/"), (2, "https://fail/"), (3, None), (4, "https://gone/"), (4, "https://gone/")])
    got = sorted((r.pos, r.status, bytes(r.body) if r.body is not None else None, r.error) for r in _read(spark, tmp_path / "u", fetcher__mark="m").collect())
    assert got == [(1, 200, b"https://a/", None), (2, None, None, "timed out"), (3, None, None, "no URL"), (4, 404, b"https://gone/", None),
                   (4, 404, b"https://gone/", None)]
    assert _read(spark, tmp_path / "u", fetcher__mark="m").where("pos = 1").first().headers == {"x-option": "m"}


def test_planned_partitions_and_a_chunk_that_fails(spark, tmp_path):
    _urls(spark, tmp_path / "u", [(i, f"https://h/{i}") for i in range(90)], files=6)
    _urls(spark, tmp_path / "u", [(100, "https://bad.chunk/"), (101, "https://ok/")])
    df = _read(spark, tmp_path / "u", partitionRows="20")
    assert df.rdd.getNumPartitions() == 7 and df.count() == 92
    assert {r.pos: r.error for r in df.where("error is not null").collect()} == {100: "no network", 101: "no network"}


def test_empty_folder_and_missing_options(spark, tmp_path):
    _urls(spark, tmp_path / "u", [])
    assert _read(spark, tmp_path / "u").count() == 0
    with pytest.raises(Exception, match="fetcher"):
        spark.read.format("webloom_fetch").load(str(tmp_path / "u")).count()


def test_stream_takes_new_files_once(spark, tmp_path):
    from webloom.streaming.stateful import scratch
    fetch.register(spark)
    folder, (data, chk) = tmp_path / "u", scratch(spark, "t_fetch")

    def run():
        st = spark.readStream.format("webloom_fetch").option("fetcher", "tests.test_datasources:Echo").load(str(folder))
        q = (st.select("pos", "error").writeStream.format("parquet").option("path", data).option("checkpointLocation", chk)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r.pos, r.error) for r in spark.read.parquet(data).collect())

    _urls(spark, folder, [(1, "https://a/"), (2, "https://fail/")])
    os.rename(next(folder.glob("part-*.parquet")), folder / "a.parquet")
    assert run() == [(1, None), (2, "timed out")]
    _urls(spark, folder, [(3, "https://b/")])
    os.rename(next(folder.glob("part-*.parquet")), folder / "b.parquet")
    assert run() == [(1, None), (2, "timed out"), (3, None)]
    assert run() == [(1, None), (2, "timed out"), (3, None)]


def _files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()} if folder.exists() else {}


def _save(df, folder):
    df.write.format("webloom_files").mode("append").save(str(folder))


def test_files_appear_with_the_job_and_a_rerun_leaves_one_set(spark, tmp_path):
    sink.register(spark)
    out = tmp_path / "out"
    df = spark.range(40).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), F.col("id"), F.lit(".txt")).alias("path"),
                                F.when(F.col("id") != 7, F.col("id").cast("string").cast("binary")).alias("body")).repartition(5)
    for _ in range(2):
        _save(df, out)
        assert _files(out) == {f"d{i % 3}/f{i}.txt": b"" if i == 7 else str(i).encode() for i in range(40)}
    assert not (out / sink.STAGED).exists()
    _save(spark.createDataFrame([("d0/f0.txt", bytearray(b"new"))], "path string, body binary"), out)
    assert _files(out)["d0/f0.txt"] == b"new" and len(_files(out)) == 40


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    sink.register(spark)
    out = tmp_path / "out"
    bad = F.when(F.col("id") == 33, F.lit(None).cast("string")).otherwise(F.concat(F.lit("f"), F.col("id")))
    df = spark.range(40).repartition(5).select(bad.alias("path"), F.lit(b"x").alias("body"))
    with pytest.raises(Exception, match="needs a path"):
        _save(df, out)
    assert _files(out) == {}


@pytest.mark.parametrize("path", ["../x", "/etc/x", "", "a/../../x", "_staged/x"])
def test_paths_that_leave_the_folder(path):
    with pytest.raises(ValueError):
        sink._relative(path)
