"""Time-gap operators over event logs: W6 idle sessions, W5 first quiet point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDLE_GAP = "15 minutes"        # fixed value: browser idle close
QUIET_WINDOW = "1 second"      # fixed value: network-idle time
QUIET_TIMEOUT = "30 seconds"   # fixed value: network-idle timeout


def _interval(spec: str) -> Column:
    return F.expr(f"INTERVAL {spec}")


def idle_sessions(df: DataFrame, key: str, ts: str, gap: str = IDLE_GAP, tie: str | None = None,
                  strategy: str = "skew") -> DataFrame:
    """A session closes after ``gap`` without a call; a call exactly ``gap``
    after the previous one continues the session.

    Output ``(key, session_start, session_end, n_calls)``,
    ``session_end`` = last call + gap.  The default splits keys that hold a
    large share of the rows, see :mod:`webloom.operators.sequence`.
    """
    from webloom.operators.sequence import gap_sessions
    return gap_sessions(df, key, ts, tie, gap, strategy)


def first_idle(df: DataFrame, key: str, ts: str, tie: str | None = None,
               idle: str = QUIET_WINDOW, timeout: str = QUIET_TIMEOUT,
               strategy: str = "skew") -> DataFrame:
    """First instant followed by ``idle`` with no request; gives up at
    ``timeout`` after the key's first request.

    ``(key, idle_at, timed_out)``: idle_at = ts of the request before the first
    gap >= idle (or of the last request) + idle, capped at start + timeout.
    """
    from webloom.operators.sequence import first_quiet
    agg = first_quiet(df, key, ts, tie, idle, strategy)
    limit = F.col("_start") + _interval(timeout)
    return agg.select(key, F.when(F.col("_q") > limit, limit).otherwise(F.col("_q")).alias("idle_at"),
                      (F.col("_q") > limit).alias("timed_out"))
