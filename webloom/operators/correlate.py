"""D1 request/reply correlation: the first reply with the request's id inside
``[req.ts, req.ts + timeout]`` answers it; unknown ids are ignored; a
request without such a reply times out.

Batch form: a left outer equi-join on the id with an interval condition
(Spark plans it as a sort-merge / hash join on the id with a range
filter, never a cross join), then the earliest reply per request via
``min_by`` -- a partial aggregate, so a chatty id is combined map-side.
The streaming twin (ST3) is the same join between two watermarked streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY_TIMEOUT = "30 seconds"   # fixed value


def correlate(requests: DataFrame, replies: DataFrame, id_cols: list[str],
              timeout: str = REPLY_TIMEOUT) -> DataFrame:
    """``requests(*id, req_ts, ...)``, ``replies(*id, reply_ts, ...)`` ->
    requests with ``reply_ts`` (NULL when timed out) plus all reply columns
    of the first reply."""
    # Equal requests are looked up once and given as often as they came.
    r = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_times")).alias("q")
    a = replies.alias("a")
    cond = [F.col(f"q.{c}") == F.col(f"a.{c}") for c in id_cols]
    cond.append(F.col("a.reply_ts") >= F.col("q.req_ts"))
    cond.append(F.col("a.reply_ts") <= F.col("q.req_ts") + F.expr(f"INTERVAL {timeout}"))
    j = r.join(a, cond, "left")
    req_cols = [F.col(f"q.{c}").alias(c) for c in requests.columns]
    reply_cols = [c for c in replies.columns if c not in id_cols]
    first = F.min_by(F.struct(*[F.col(f"a.{c}").alias(c) for c in reply_cols]), F.col("a.reply_ts"))
    return (j.groupBy(*req_cols, F.col("q._times").alias("_times")).agg(first.alias("_r"))
            .select(*requests.columns, "_r", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int"))))
            .select(*requests.columns, *[F.col(f"_r.{c}").alias(c) for c in reply_cols]))
