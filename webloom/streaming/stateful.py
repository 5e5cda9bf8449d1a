"""Streaming operators.

* ST1 bounded log with resets and closes, ST4 live tabs, ST5 quiet points:
  ``transformWithState`` processors (``processors.py``) with list state and
  event-time timers.  Only changes are given; a close, a decided key or an
  idle one frees its state.
* ST2 idle sessions: watermark + ``session_window`` aggregation, append.
* ST3 correlation: stream-stream left outer join on the id with an
  event-time interval condition and watermarks on both sides; unmatched
  requests are emitted once the watermark passes their deadline.
* ST6 pages -> links, chunks and text: the stateless batch functions on a stream.
* ST7 retention: the batch predicate per micro-batch in ``foreachBatch``.

Arrival order across micro-batches is kept (as the reference processes
events on arrival); inside a micro-batch rows are ordered by (ts, id).
All state lives in the query checkpoint, so a restarted query resumes
where it stopped; the sinks are idempotent per batch id.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import checkpoint_dir

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that ``transformWithState`` needs; what was set before comes back.

    A query takes the setting when it starts.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield spark
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """(data path, checkpoint path) for a query, under the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/data", f"{base}/chk"


def run_to_table(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) into a parquet
    sink and return the sink read back as a batch DataFrame."""
    spark = df.sparkSession
    data, chk = scratch(spark, name)
    with state_store(spark):
        q = (df.writeStream.format("parquet").outputMode(output_mode)
             .option("path", data).option("checkpointLocation", chk)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(data)


# ---- ST1 -------------------------------------------------------------------------

def stream_last_n(events: DataFrame, key: str, ts: str, id_col: str, type_col: str,
                  reset_type: str, n: int = 100, close_type: str | None = None,
                  idle_s: float | None = None, delay: str = "1 hour") -> DataFrame:
    """Changes of a bounded log per key: ``(key, change, id, type)``.

    ``change`` is ``add`` or ``drop``: an entry that left because of the bound, a
    reset marker (which is not kept), a close or, with ``idle_s``, because its
    key had no event for so long (event time, behind the watermark).  An entry
    that comes and goes within one micro-batch is not given.  A closed or
    idle key has no state.  :func:`current_log` is the log of all changes."""
    from webloom.streaming.processors import BoundedLog
    t = F.col(ts).cast("timestamp")
    rows = (events.select(key, t.alias("w_t"), F.unix_micros(t).alias("w_us"), F.col(id_col).cast("long").alias("w_id"),
                          F.col(type_col).alias("w_type")).withWatermark("w_t", delay))
    key_type = dict(events.dtypes)[key]
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=BoundedLog(key, n, reset_type, close_type, idle_s),
        outputStructType=f"{key} {key_type}, change string, id long, type string", outputMode="Append", timeMode="eventTime")
    return out.select(key, "change", F.col("id").alias(id_col), F.col("type").alias(type_col))


def current_log(changes: DataFrame, key: str, id_col: str) -> DataFrame:
    """The entries that were added and not dropped (batch read-back of ST1)."""
    gone = changes.where("change = 'drop'").select(key, id_col)
    return changes.where("change = 'add'").join(gone, [key, id_col], "left_anti").drop("change")


# ---- ST2 -------------------------------------------------------------------------

def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "15 minutes",
                    delay: str = "1 hour") -> DataFrame:
    """Closed sessions only (append mode): a session is final once the
    watermark (max event time - delay) passes its end."""
    t = F.col(ts).cast("timestamp")
    return (events.select(key, t.alias(ts)).withWatermark(ts, delay)
            .groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_calls"))
            .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                    "n_calls"))


# ---- ST3 -------------------------------------------------------------------------

def stream_correlate(requests: DataFrame, replies: DataFrame, id_cols: list[str],
                     timeout: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Stream-stream left outer interval join, then the earliest reply of each
    request; ``reply_ts`` NULL = timed out.  A request is given once, when
    the watermark has passed its time and no reply can follow."""
    q = requests.withWatermark("req_ts", delay).alias("q")
    a = replies.withWatermark("reply_ts", delay).alias("a")
    cond = [F.col(f"q.{c}") == F.col(f"a.{c}") for c in id_cols]
    cond += [F.col("a.reply_ts") >= F.col("q.req_ts"),
             F.col("a.reply_ts") <= F.col("q.req_ts") + F.expr(f"INTERVAL {timeout}")]
    j = q.join(a, cond, "leftOuter")
    reply_cols = [c for c in replies.columns if c not in id_cols]
    first = F.min_by(F.struct(*[F.col(f"a.{c}").alias(c) for c in reply_cols]), F.col("a.reply_ts"))
    return (j.groupBy(*[F.col(f"q.{c}").alias(c) for c in requests.columns]).agg(first.alias("_r"))
            .select(*requests.columns, *[F.col(f"_r.{c}").alias(c) for c in reply_cols]))


# ---- ST4 -------------------------------------------------------------------------

def stream_tabs(opens: DataFrame, key: str, ts: str, id_col: str, max_tabs: int = 10,
                op_col: str | None = None, target_col: str | None = None,
                close_op: str = "close") -> DataFrame:
    """Eviction events ``(key, opened_event, evicted_by)`` as they happen.

    Every row opens a tab named by ``id_col``; with ``op_col``, rows whose op
    is ``close_op`` instead close the tab named in ``target_col`` (if still
    open).  Opening beyond ``max_tabs`` evicts the oldest *created* open tab.
    State per key is the list of the <= max_tabs open ids; a key whose last
    tab is closed has none."""
    from webloom.streaming.processors import LiveTabs
    none = F.lit(None).cast("long")
    rows = opens.select(key, (F.unix_micros(F.col(ts).cast("timestamp")) if dict(opens.dtypes)[ts].startswith("timestamp")
                              else F.col(ts).cast("long")).alias("w_us"), F.col(id_col).cast("long").alias("w_id"),
                        (F.coalesce(F.col(op_col) == close_op, F.lit(False)) if op_col else F.lit(False)).alias("w_close"),
                        (F.col(target_col).cast("long") if target_col else none).alias("w_target"))
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=LiveTabs(key, max_tabs), outputStructType=f"{key} {dict(opens.dtypes)[key]}, opened_event long, evicted_by long",
        outputMode="Append", timeMode="none")


# ---- ST7 -------------------------------------------------------------------------

def stream_retention(events: DataFrame, ts_col: str, as_of, days: int, name: str) -> DataFrame:
    """Expired rows per micro-batch via ``foreachBatch`` (idempotent: each batch
    overwrites its own ``batch=<id>`` folder), read back as a table."""
    from webloom.operators.retention import expired
    spark = events.sparkSession
    data, chk = scratch(spark, name)

    def per_batch(df, batch_id):
        expired(df, ts_col, as_of, days).write.mode("overwrite").parquet(f"{data}/batch={batch_id}")

    q = (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", chk)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(data).drop("batch")


# ---- ST5 -------------------------------------------------------------------------

def stream_idle(events: DataFrame, key: str, ts: str, id_col: str, idle_s: float,
                timeout_s: float, delay: str = "1 hour") -> DataFrame:
    """First quiet point per key with event-time timers.

    A gap >= idle after an event emits ``last + idle``; once ``last + idle``
    passes ``start + timeout`` the answer is the capped ``start + timeout``;
    with no further event, the timer at ``last + idle`` fires when the
    watermark passes it.  Output ``(key, idle_at, timed_out)`` once per key.
    A decided key keeps one flag and no times.  Times cross into Python as
    epoch microseconds computed by Spark, so the result and the timers do
    not depend on the session time zone."""
    from webloom.streaming.processors import QuietPoint
    t = F.col(ts).cast("timestamp")
    rows = events.select(key, t.alias("w_t"), F.unix_micros(t).alias("w_us")).withWatermark("w_t", delay)
    out = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=QuietPoint(key, int(idle_s * 1e6), int(timeout_s * 1e6)),
        outputStructType=f"{key} {dict(events.dtypes)[key]}, idle_at_us long, timed_out boolean", outputMode="Append", timeMode="eventTime")
    return out.select(key, F.timestamp_micros("idle_at_us").alias("idle_at"), "timed_out")
