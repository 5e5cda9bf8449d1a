"""Bounded per-key logs (W1 last-N, W2 reset, W3 clear, P8 static filter,
A1 ordered collection, D5 key -> log lookup, W4 eviction).

Scale notes
-----------
* ``last_n`` filters ``row_number() <= n``; Catalyst turns that into a
  ``WindowGroupLimit`` applied *before* the shuffle as well, so a hot key
  ships at most ``n`` rows per map task, never its whole history.
* ``since_last_reset`` finds each key's newest marker with a partial
  (map-side combined) aggregate and joins it back: no window has to hold a
  hot key's full partition; AQE's skew-join splits the big side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_BOUND = 100                      # fixed value: entries kept per page
STATIC_TYPES = ("image", "font", "stylesheet", "media")  # fixed value: static resource types
MAX_TABS = 10                        # fixed value: open pages


def _order(cols, desc=False) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in cols]


def last_n(df: DataFrame, key: str, order: list[str], n: int = LOG_BOUND,
           seq_col: str = "seq") -> DataFrame:
    """The newest ``n`` rows per key, numbered ``seq`` = 1.. oldest first."""
    newest = Window.partitionBy(key).orderBy(*_order(order, desc=True))
    kept = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    oldest = Window.partitionBy(key).orderBy(*_order(order))
    return kept.drop("_rn").withColumn(seq_col, F.row_number().over(oldest).cast("bigint"))


def network_requests(log: DataFrame, key: str, order: list[str], type_col: str,
                     n: int = LOG_BOUND, include_static: bool = False,
                     static_types=STATIC_TYPES) -> DataFrame:
    """P8 on top of W1: bound first, then drop static resource types.
    ``seq`` is the position in the bounded log (before the filter)."""
    bounded = last_n(log, key, order, n)
    if include_static:
        return bounded
    return bounded.where(~F.col(type_col).isin(*static_types))


def _marker_key(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def since_last_reset(log: DataFrame, key: str, order: list[str], is_reset: Column,
                     keep_marker: bool = False) -> DataFrame:
    """Rows after each key's newest reset marker (the log is emptied at the
    marker and refilled); keys without a marker keep every row."""
    pos = _marker_key(order)
    resets = (log.where(is_reset).groupBy(key)
              .agg(F.max(pos).alias("_reset_at")))
    joined = log.join(resets, key, "left")
    cond = F.col("_reset_at").isNull() | (pos >= F.col("_reset_at") if keep_marker
                                           else pos > F.col("_reset_at"))
    return joined.where(cond).drop("_reset_at")


def drop_closed(log: DataFrame, key: str, order: list[str], is_close: Column) -> DataFrame:
    """A close removes the key's log; only rows after the last close remain
    (a key whose last row is a close disappears)."""
    return since_last_reset(log, key, order, is_close).where(~is_close)


def collect_log(log: DataFrame, key: str, order: list[str], cols: list[str],
                name: str = "entries", n: int = LOG_BOUND,
                already_bounded: bool = False) -> DataFrame:
    """A1: ordered array of the newest ``n`` entries per key.  The bound is
    applied here (W1) unless the caller just did, so a collected group never
    exceeds ``n`` entries however large the key is."""
    if not already_bounded:
        log = last_n(log, key, order, n, "_seq_bound").drop("_seq_bound")
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                     *[F.col(c) for c in cols])
    return (log.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
            .select(key, F.transform("_e", lambda e: F.struct(*[e[c].alias(c) for c in cols]))
                    .alias(name)))


def logs_per_page(keys: DataFrame, key: str, log: DataFrame, log_key: str,
                  order: list[str], id_col: str, n: int = LOG_BOUND) -> DataFrame:
    """Every key with its bounded log, empty when absent:
    ``(key, n_entries, entries)`` where ``entries`` joins ids with ','."""
    bounded = last_n(log.select(log_key, id_col, *[c for c in order if c != id_col]),
                     log_key, order, n)
    per_key = collect_log(bounded, log_key, order, [id_col], "_e", n, already_bounded=True).select(
        F.col(log_key).alias(key), F.transform("_e", lambda e: e[id_col].cast("string")).alias("_ids"))
    out = keys.select(key).join(per_key, key, "left")
    ids = F.coalesce(F.col("_ids"), F.array().cast("array<string>"))
    return out.select(key, F.size(ids).cast("bigint").alias("n_entries"),
                      F.array_join(ids, ",").alias("entries"))


def tab_evictions(opens: DataFrame, key: str, order: list[str], id_col: str,
                  max_tabs: int = MAX_TABS, strategy: str = "skew") -> DataFrame:
    """Opening a page when ``max_tabs`` are open closes the oldest created
    one, so open i is evicted by open i + max_tabs (NULL = still open).
    ``lead`` by max_tabs; hot keys are split (see ``sequence``)."""
    from webloom.operators.sequence import with_shift
    cols = list(dict.fromkeys([key, *order, id_col]))
    shifted = with_shift(opens.select(*cols), key, order, [id_col], max_tabs, "evict_", strategy)
    return shifted.select(key, F.col(id_col).alias("opened_event"),
                          F.col("evict_" + id_col).alias("evicted_by"))
