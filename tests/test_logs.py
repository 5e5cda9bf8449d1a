import datetime as dt

from pyspark.sql import functions as F

from webloom.operators.logs import (last_n, logs_per_page, network_requests, since_last_reset,
                                    tab_evictions, drop_closed)
from webloom.operators.sessions import first_idle, idle_sessions


def long_log(spark):
    """One key with 250 rows, resets at seq 60 and 180 (FIXTURES long_log)."""
    rows = [(7, i, "reset" if i in (60, 180) else "req") for i in range(250)]
    return spark.createDataFrame(rows, "key long, seq long, kind string")


def test_bound_cuts(spark):
    kept = last_n(long_log(spark), "key", ["seq"], 100, "pos")
    got = [r.seq for r in kept.orderBy("pos").collect()]
    assert got == list(range(150, 250))
    assert [r.pos for r in kept.orderBy("pos").collect()] == list(range(1, 101))


def test_reset_then_bound(spark):
    log = long_log(spark)
    after = since_last_reset(log, "key", ["seq"], F.col("kind") == "reset")
    assert [r.seq for r in after.orderBy("seq").collect()] == list(range(181, 250))
    bounded = last_n(after, "key", ["seq"], 100)
    assert bounded.count() == 69
    closed = drop_closed(log.union(spark.createDataFrame([(7, 250, "close")], log.schema)),
                         "key", ["seq"], F.col("kind") == "close")
    assert closed.count() == 0


def test_bound_sum_property(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    for n in (5, 20, 100):
        expect = ev.groupBy("user_id").count().select(F.sum(F.least("count", F.lit(n)))).first()[0]
        assert last_n(ev, "user_id", ["ts", "event_id"], n).count() == expect


def test_static_filter_after_bound(spark):
    rows = [(1, i, "image" if i % 2 else "xhr") for i in range(10)]
    df = spark.createDataFrame(rows, "key long, t long, rtype string")
    out = network_requests(df, "key", ["t"], "rtype", n=4)
    assert [(r.t, r.seq, r.rtype) for r in out.orderBy("t").collect()] == [(6, 1, "xhr"), (8, 3, "xhr")]
    assert network_requests(df, "key", ["t"], "rtype", n=4, include_static=True).count() == 4


def test_tab_evictions(spark):
    opens = spark.createDataFrame([("s", i) for i in range(1, 14)], "session string, seq long")
    ev = tab_evictions(opens, "session", ["seq"], "seq", 10)
    got = {r.opened_event: r.evicted_by for r in ev.collect()}
    assert got[1] == 11 and got[2] == 12 and got[3] == 13 and got[4] is None


def test_logs_per_page_empty(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    log = spark.createDataFrame([(1, 3, 30), (1, 1, 10), (1, 2, 20)], "k long, ts long, id long")
    out = {r.k: (r.n_entries, r.entries) for r in logs_per_page(keys, "k", log, "k", ["ts", "id"], "id").collect()}
    assert out == {1: (3, "10,20,30"), 2: (0, "")}


def test_idle_gap_edges(spark):
    t0 = dt.datetime(2024, 1, 1)
    gaps = [dt.timedelta(minutes=14, seconds=59, microseconds=999999), dt.timedelta(minutes=15),
            dt.timedelta(minutes=15, microseconds=1)]
    ts, rows = t0, [(1, t0)]
    for g in gaps:
        ts = ts + g
        rows.append((1, ts))
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz")
    s = idle_sessions(df, "key", "ts").orderBy("session_start").collect()
    assert [r.n_calls for r in s] == [3, 1]
    assert s[0].session_end == rows[2][1] + dt.timedelta(minutes=15)


def test_first_idle(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 0.5, 0.9, 3, 3.2])]
    rows += [(2, t0 + dt.timedelta(seconds=0.5 * s), 10 + s) for s in range(80)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, id long")
    out = {r.key: (r.idle_at, r.timed_out) for r in first_idle(df, "key", "ts", "id").collect()}
    assert out[1] == (t0 + dt.timedelta(seconds=1.9), False)
    assert out[2] == (t0 + dt.timedelta(seconds=30), True)


def test_collect_log_is_bounded(spark):
    from webloom.operators.logs import collect_log
    log = spark.createDataFrame([(1, i, i * 10) for i in range(250)], "k long, t long, v long")
    r = collect_log(log, "k", ["t"], ["v"], n=100).first()
    assert [e.v for e in r.entries] == [i * 10 for i in range(150, 250)]
