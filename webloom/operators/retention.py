"""P15 retention: rows older than ``days`` at ``as_of`` (and the complement).

``as_of`` is a parameter, never ``now()``, so results are reproducible and a
re-run after a failure removes the same rows.  The predicate is a plain
comparison with a constant, so it is pushed into the parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS = 5   # fixed value


def _cutoff(as_of, days: int):
    """``as_of - days`` as a TIMESTAMP_NTZ literal built from text, so the
    result does not depend on the driver's or the session's time zone."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.lit((as_of - dt.timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")


def expired(df: DataFrame, ts_col: str, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows whose age at ``as_of`` is strictly greater than ``days``."""
    return df.where(F.col(ts_col) < _cutoff(as_of, days))


def retained(df: DataFrame, ts_col: str, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """Complement of :func:`expired` (NULL timestamps are retained)."""
    return df.where((F.col(ts_col) >= _cutoff(as_of, days)) | F.col(ts_col).isNull())
