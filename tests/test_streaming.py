from pyspark.sql import functions as F

from webloom.operators.logs import last_n, since_last_reset, tab_evictions
from webloom.streaming.stateful import current_log, run_to_table, stream_last_n, stream_tabs


def test_stream_last_n_equals_batch(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(7, t0 + dt.timedelta(seconds=i), i, "signup" if i in (60, 180) else "req") for i in range(250)]
    rows += [(8, t0 + dt.timedelta(seconds=i), 1000 + i, "req") for i in range(30)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, event_type string")
    # one micro-batch per file: arrival order is file order; both files are time-ordered per key
    first = df.where(F.col("ts") < t0 + dt.timedelta(seconds=100))
    second = df.where(F.col("ts") >= t0 + dt.timedelta(seconds=100))
    folder = str(tmp_path / "ev")
    first.coalesce(1).write.parquet(folder + "/a")
    second.coalesce(1).write.parquet(folder + "/b")
    st = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
          .option("recursiveFileLookup", "true").parquet(folder))
    got = current_log(run_to_table(stream_last_n(st, "user_id", "ts", "event_id", "event_type", "signup", 20),
                                   "t_last_n"), "user_id", "event_id")
    exp = last_n(since_last_reset(df, "user_id", ["ts", "event_id"], F.col("event_type") == "signup"),
                 "user_id", ["ts", "event_id"], 20)
    key = lambda r: (r.user_id, r.event_id, r.event_type)
    assert sorted(map(key, got.collect())) == sorted(map(key, exp.collect()))


def test_stream_tabs_equals_batch(spark, tmp_path, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet").select("user_id", "ts", "event_id")
    folder = str(tmp_path / "tabs")
    ev.write.parquet(folder)
    st = spark.readStream.schema(ev.schema).parquet(folder)
    got = run_to_table(stream_tabs(st, "user_id", "ts", "event_id"), "t_tabs")
    exp = tab_evictions(ev, "user_id", ["ts", "event_id"], "event_id").where("evicted_by IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_stream_correlate_matches_batch(spark, tmp_path, sf_small):
    from webloom.operators.correlate import correlate
    from webloom.plans.queries import _correlation_out, conversation_messages
    from webloom.streaming.stateful import stream_correlate
    conv = spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role")
    req_b, rep_b = conversation_messages(conv)
    batch = {tuple(r) for r in _correlation_out(correlate(req_b, rep_b, ["conv_id", "rid"])).collect()}
    # Requests and replies arrive through two separate file sources.
    for name, part in (("users", conv.where("role = 'user'")), ("others", conv.where("role <> 'user'"))):
        part.write.parquet(str(tmp_path / name))
    s_users = spark.readStream.schema(conv.schema).parquet(str(tmp_path / "users"))
    s_others = spark.readStream.schema(conv.schema).parquet(str(tmp_path / "others"))
    req_s, _ = conversation_messages(s_users)
    _, rep_s = conversation_messages(s_others)
    got = {tuple(r) for r in _correlation_out(
        run_to_table(stream_correlate(req_s, rep_s, ["conv_id", "rid"]), "t_corr")).collect()}
    matched = {r for r in batch if not r[4]}
    # A request is given once the watermark has passed it: the last ones wait.
    final = {r for r in got if not r[4]}
    assert final <= matched and {r[0] for r in matched - final} <= {max(r[0] for r in batch)}
    assert {r for r in got if r[4]} <= {r for r in batch if r[4]}


def test_stream_sessions_multi_batch(spark, tmp_path):
    import datetime as dt
    from webloom.operators.sessions import idle_sessions
    from webloom.streaming.stateful import stream_sessions
    t0 = dt.datetime(2024, 1, 1)
    gaps = [0, 5, 10, 40, 41, 90, 100, 200, 214, 229, 300]
    rows = [(u, t0 + dt.timedelta(minutes=g + u), i) for u in (1, 2) for i, g in enumerate(gaps)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long")
    for i, lo in enumerate((0, 95, 210)):           # three time-ordered files = three micro-batches
        hi = {0: 95, 95: 210, 210: 10_000}[lo]
        part = df.where((F.col("ts") >= t0 + dt.timedelta(minutes=lo)) & (F.col("ts") < t0 + dt.timedelta(minutes=hi)))
        part.coalesce(1).write.parquet(str(tmp_path / "ev" / f"f{i}"))
    st = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
          .option("recursiveFileLookup", "true").parquet(str(tmp_path / "ev")))
    got = run_to_table(stream_sessions(st, "user_id", "ts", delay="10 minutes"), "t_sess")
    got = {(r.user_id, r.session_start.replace(tzinfo=None), r.n_calls) for r in got.collect()}
    wm = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    exp = {(r.user_id, r.session_start, r.n_calls) for r in idle_sessions(df, "user_id", "ts").collect()
           if r.session_end <= wm}
    assert got == exp and len(exp) >= 6


def test_stream_tabs_with_close(spark, tmp_path):
    # FIXTURES tab_events: opens 1-13 with tab 5 closed right after it opens.
    rows = [(1, s, "open", s, None) for s in range(1, 6)] + [(1, 6, "close", 100, 5)]
    rows += [(1, 6 + s, "open", s, None) for s in range(6, 14)]
    df = spark.createDataFrame(rows, "session long, seq long, op string, tab long, target long")
    df.coalesce(1).write.parquet(str(tmp_path / "tabs"))
    st = spark.readStream.schema(df.schema).parquet(str(tmp_path / "tabs"))
    got = run_to_table(stream_tabs(st, "session", "seq", "tab", 10, op_col="op", target_col="target"), "t_tabs2")
    assert sorted((r.opened_event, r.evicted_by) for r in got.collect()) == [(1, 12), (2, 13)]


def test_stream_last_n_reset_ends_batch(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    first = [(1, t0 + dt.timedelta(seconds=i), i, "req") for i in range(5)]
    second = [(1, t0 + dt.timedelta(seconds=10), 10, "signup")]
    schema = "user_id long, ts timestamp_ntz, event_id long, event_type string"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "ev" / "a"))
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(str(tmp_path / "ev" / "b"))
    st = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
          .option("recursiveFileLookup", "true").parquet(str(tmp_path / "ev")))
    changes = run_to_table(stream_last_n(st, "user_id", "ts", "event_id", "event_type", "signup", 20), "t_reset")
    assert sorted((r.change, r.event_id) for r in changes.collect()) == [(c, i) for c in ("add", "drop") for i in range(5)]
    assert current_log(changes, "user_id", "event_id").count() == 0


def test_stream_correlate_gives_the_first_reply_once(spark, tmp_path):
    import datetime as dt

    from webloom.operators.correlate import correlate
    from webloom.streaming.stateful import stream_correlate
    t0 = dt.datetime(2024, 1, 1)
    req = [(i, t0 + dt.timedelta(minutes=i)) for i in range(6)] + [(99, t0 + dt.timedelta(hours=9))]
    rep = [(i, t0 + dt.timedelta(minutes=i, seconds=s), f"{i}-{s}") for i in range(5) for s in (20, 5, 29)]
    rep += [(98, t0 + dt.timedelta(hours=9), "end")]
    requests = spark.createDataFrame(req, "id long, req_ts timestamp")
    replies = spark.createDataFrame(rep, "id long, reply_ts timestamp, body string")
    for name, df in (("q", requests), ("a", replies)):
        for n in range(3):                      # three files, so several micro-batches
            df.where(F.col("id") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    q, a = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
            for n, df in (("q", requests), ("a", replies)))
    got = sorted(map(tuple, run_to_table(stream_correlate(q, a, ["id"], delay="8 hours"), "first").collect()))
    want = sorted(map(tuple, correlate(requests, replies, ["id"]).where("id < 50").collect()))
    assert got == want and [r[3] for r in want] == ["0-5", "1-5", "2-5", "3-5", "4-5", None]


def _files(spark, df, folder, parts):
    """One file for each part, in their order; the stream takes one in each micro-batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, df).coalesce(1).write.parquet(str(folder / f"f{k}"))
    return spark.readStream.schema(df).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


EVENT = "user_id long, ts timestamp, event_id long, event_type string"


def test_closes_idle_keys_and_only_changes(spark, tmp_path):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)                                              # noqa: E731
    parts = [[(1, at(i), i, "req") for i in range(4)] + [(2, at(0), 100, "req"), (3, at(1), 200, "req")],
             [(1, at(10), 10, "close"), (2, at(11), 101, "req"), (2, at(12), 102, "req"), (2, at(13), 103, "req")],
             [(1, at(20), 20, "req"), (2, at(21), 104, "reset"), (2, at(22), 105, "req")],
             [(9, at(400), 900, "req")], [(9, at(401), 901, "req")]]
    st = _files(spark, EVENT, tmp_path / "ev", parts)
    out = run_to_table(stream_last_n(st, "user_id", "ts", "event_id", "event_type", "reset", 3, "close", idle_s=3600.0, delay="1 minute"), "t_chg")
    rows = sorted((r.user_id, r.change, r.event_id) for r in out.collect())
    # Key 1: 0 never came out (bound 3), 1-3 dropped by the close, 20 by the key's idleness; nothing comes twice.
    assert [r for r in rows if r[0] == 1] == [(1, "add", 1), (1, "add", 2), (1, "add", 3), (1, "add", 20),
                                              (1, "drop", 1), (1, "drop", 2), (1, "drop", 3), (1, "drop", 20)]
    assert [r for r in rows if r[0] == 2 and r[1] == "add"] == [(2, "add", i) for i in (100, 101, 102, 103, 105)]
    assert [r for r in rows if r[0] == 2 and r[1] == "drop"] == [(2, "drop", i) for i in (100, 101, 102, 103, 105)]
    assert sorted(r.event_id for r in current_log(out, "user_id", "event_id").collect()) == [900, 901]


def test_state_is_empty_after_closes(spark, tmp_path):
    import datetime as dt

    from webloom.streaming.stateful import scratch, state_store
    t0 = dt.datetime(2024, 1, 1)
    parts = [[(k, t0 + dt.timedelta(seconds=10 * f + k), 100 * f + k, "close" if f == 2 else "req") for k in range(20)] for f in range(3)]
    st = _files(spark, EVENT, tmp_path / "ev", parts)
    data, chk = scratch(spark, "t_empty")
    with state_store(spark):
        q = (stream_last_n(st, "user_id", "ts", "event_id", "event_type", "reset", 5, "close").writeStream.format("parquet")
             .option("path", data).option("checkpointLocation", chk).trigger(availableNow=True).start())
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[0] > 0 and held[-1] == 0


def test_last_n_random_files_equal_batch(spark, tmp_path):
    import datetime as dt
    import random
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r.randrange(12), t0 + dt.timedelta(seconds=i // 2), i, r.choice(["req"] * 12 + ["reset", "close"])) for i in range(900)]
    st = _files(spark, EVENT, tmp_path / "ev", [rows[i:i + 180] for i in range(0, 900, 180)])
    got = current_log(run_to_table(stream_last_n(st, "user_id", "ts", "event_id", "event_type", "reset", 7, "close"), "t_rand"), "user_id", "event_id")
    log = {}
    for k, _, i, kind in rows:
        log[k] = [] if kind != "req" else [*log.get(k, []), i][-7:]
    assert sorted((x.user_id, x.event_id) for x in got.collect()) == sorted((k, i) for k, ids in log.items() for i in ids)


def test_tabs_and_quiet_points_over_several_files(spark, tmp_path):
    import datetime as dt
    import random

    from webloom.operators.sessions import first_idle
    from webloom.streaming.stateful import stream_idle
    r = random.Random(8)
    t0 = dt.datetime(2024, 1, 1)
    rows, at = [], t0
    for i in range(600):
        at += dt.timedelta(seconds=r.choice((1, 5, 30)))
        rows.append((r.randrange(9), at, i, "req"))
    rows += [(99, at + dt.timedelta(days=3), 9000, "req"), (99, at + dt.timedelta(days=3, seconds=1), 9001, "req")]
    parts = [rows[i:i + 151] for i in range(0, 602, 151)]
    st = _files(spark, EVENT, tmp_path / "ev", parts)
    df = spark.createDataFrame(rows, EVENT)
    got = run_to_table(stream_tabs(st, "user_id", "ts", "event_id", 4), "t_tabs3")
    want = tab_evictions(df, "user_id", ["ts", "event_id"], "event_id", 4).where("evicted_by is not null")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    st = _files(spark, EVENT, tmp_path / "ev2", parts)
    got = run_to_table(stream_idle(st, "user_id", "ts", "event_id", 120.0, 3600.0, "1 minute"), "t_idle3")
    want = first_idle(df, "user_id", "ts", "event_id", "120 seconds", "1 hour").where("user_id < 99")
    assert sorted(map(tuple, got.where("user_id < 99").collect())) == sorted(map(tuple, want.collect()))
