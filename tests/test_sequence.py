import datetime as dt

import pytest
from pyspark.sql import functions as F

from webloom.operators.logs import tab_evictions
from webloom.operators.sequence import positions, with_shift
from webloom.operators.sessions import first_idle, idle_sessions


def hot_events(spark):
    """One key with a third of the rows, plus many small keys."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, t0 + dt.timedelta(minutes=7 * i + (i % 5) * 3), i) for i in range(3000)]
    rows += [(k, t0 + dt.timedelta(minutes=11 * j + k), 10000 + k * 100 + j) for k in range(1, 201) for j in range(30)]
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_exact(spark):
    ev = hot_events(spark)
    p = positions(ev, "user_id", ["ts", "event_id"])
    hot = [r._pos for r in p.where("user_id = 0").orderBy("ts", "event_id").collect()]
    assert hot == list(range(3000))
    assert p.groupBy("user_id").agg(F.max("_pos").alias("m"), F.count("*").alias("c")).where("m != c - 1").count() == 0


def test_shift_paths_agree(spark):
    ev = hot_events(spark)
    for k in (1, 10, -1):
        a = with_shift(ev, "user_id", ["ts", "event_id"], ["event_id"], k, strategy="window")
        b = with_shift(ev, "user_id", ["ts", "event_id"], ["event_id"], k, strategy="skew")
        assert _rows(a) == _rows(b.select(*a.columns))


def test_operators_paths_agree(spark):
    ev = hot_events(spark)
    for fn in (lambda s: tab_evictions(ev, "user_id", ["ts", "event_id"], "event_id", strategy=s),
               lambda s: first_idle(ev, "user_id", "ts", "event_id", "20 minutes", "1 day", strategy=s),
               lambda s: idle_sessions(ev, "user_id", "ts", "15 minutes", tie="event_id", strategy=s)):
        assert _rows(fn("window")) == _rows(fn("skew"))


def test_null_keys_and_times_give_one_answer(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, None if j == 2 else t0 + dt.timedelta(minutes=9 * j * j), 100 * n + j)
            for n, k in enumerate((1, None, 2, None)) for j in range(8)]
    rows += [(3, None, 900), (None, t0 + dt.timedelta(days=3), 901), (1, t0 + dt.timedelta(days=3), 902)]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    for fn in (lambda s: with_shift(ev, "user_id", ["ts", "event_id"], ["event_id", "ts"], 1, strategy=s),
               lambda s: tab_evictions(ev, "user_id", ["ts", "event_id"], "event_id", 3, strategy=s),
               lambda s: first_idle(ev, "user_id", "ts", "event_id", "20 minutes", "1 day", strategy=s),
               lambda s: idle_sessions(ev, "user_id", "ts", "15 minutes", tie="event_id", strategy=s)):
        a, b = fn("window"), fn("skew")
        assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)
    sessions = idle_sessions(ev, "user_id", "ts", "15 minutes", tie="event_id")
    assert sessions.where("user_id is null").count() > 0
    assert sessions.where("session_start is null or user_id = 3").count() == 0


def test_unknown_strategy_is_refused(spark):
    ev = hot_events(spark)
    with pytest.raises(ValueError):
        with_shift(ev, "user_id", ["ts"], ["event_id"], 1, strategy="auto")


def test_random_logs_by_both_paths(spark):
    """Keys of all sizes over many ranges, small batches, repeated times: the two paths agree."""
    import random
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for k, n in ((0, 700), (1, 1), (2, 9), (3, 350), (None, 120), (4, 30)):
        at = t0
        for _ in range(n):
            at += dt.timedelta(minutes=r.choice((0, 1, 5, 15, 16, 40)))
            rows.append((k, at, len(rows)))
    r.shuffle(rows)
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, batch in (("40", "7"), ("3", "100")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for fn in (lambda s: with_shift(ev, "user_id", ["ts", "event_id"], ["event_id", "ts"], 10, strategy=s),
                       lambda s: with_shift(ev, "user_id", ["ts", "event_id"], ["event_id"], 1, strategy=s),
                       lambda s: with_shift(ev, "user_id", ["ts", "event_id"], ["event_id"], -3, strategy=s),
                       lambda s: first_idle(ev, "user_id", "ts", "event_id", "16 minutes", "1 day", strategy=s),
                       lambda s: idle_sessions(ev, "user_id", "ts", "15 minutes", tie="event_id", strategy=s)):
                a, b = fn("window"), fn("skew")
                assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_text_keys_and_empty_input(spark):
    ev = hot_events(spark).withColumn("user_id", F.concat(F.lit("u"), F.col("user_id")))
    assert _rows(idle_sessions(ev, "user_id", "ts")) == _rows(idle_sessions(ev, "user_id", "ts", strategy="window"))
    for df in (idle_sessions(ev.limit(0), "user_id", "ts"), first_idle(ev.limit(0), "user_id", "ts"),
               tab_evictions(ev.limit(0), "user_id", ["ts", "event_id"], "event_id")):
        assert df.count() == 0


def test_one_shuffle_of_the_rows_and_balanced_parts(spark):
    """The pass over the ranges is stored; a key with a third of the rows is in no partition alone."""
    from webloom.operators import sequence
    ev = hot_events(spark)
    ranged = sequence._ranged(ev, "user_id", [F.col("ts"), F.col("event_id")])
    sizes = [r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes) and len(sizes) > 4
    plan = idle_sessions(ev, "user_id", "ts")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
