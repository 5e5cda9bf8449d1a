"""Order-within-key operators that stay balanced when one key is huge.

A window ``partitionBy(key)`` sends every row of a key to one task; if one
key holds a third of all rows, that task does a third of the work.
The skew-safe path here shuffles the rows once:

1. ``repartitionByRange(key, *order)`` and a sort in each partition: sampled
   bounds split a hot key's rows across many partitions by their order values;
2. one pass over each sorted partition (Arrow batches, a bounded carry) gives
   every row's answer that lies inside the partition, or a summary of each
   key's rows there;
3. only what touches a partition's borders is still open: of its first and
   its last key a few rows (a halo of k rows for ``lead`` by k) or one
   summary (a session's first, last and count).  These few rows, a fixed
   number for each partition, are put together by a plain window per key.

The pass is stored once in the shared checkpoint folder, so that the settled
and the open rows come from the same partitions, whatever is recomputed.

``strategy`` is the caller's choice and never changes the result: "skew" (the
default) holds whatever share of the rows one key has, "window" is one
shuffle and a spilling sort per key, cheaper where keys are known to be small.  NULL keys are a key
like any other, NULL order values come first, as in a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.session import checkpoint_dir
from webloom.sources.tables import cpu_partitions, stored

STRATEGIES = ("window", "skew")


def use_skew_path(strategy: str) -> bool:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    return strategy == "skew"


def _same(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Equi-join on ``left`` column = ``right`` column, NULL = NULL; the right columns go."""
    cond = None
    for a, b in pairs.items():
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[right[b] for b in pairs.values()])


def positions(df: DataFrame, key: str, order: list[str], name: str = "_pos") -> DataFrame:
    """``df`` plus ``name`` = 0-based position of the row within its key in
    ``order`` order (order must be total within a key)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = cpu_partitions(spark)
    ranged = (df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    chunks = ranged.groupBy(key, "_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col(key).alias("_ck"), F.col("_pid").alias("_cp"), "_first",
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (_same(ranged, chunks, {key: "_ck", "_pid": "_cp"})
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
            .drop("_pid", "_mid", "_first", "_off"))


SETTLED, OPEN, BESIDE = 0, 1, 2       # a row's answer is there; it needs later rows; a later row for others


def _ranged(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(cpu_partitions(df.sparkSession), key, *order).sortWithinPartitions(key, *order)


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """The number of the run of equal keys that each row stands in; NULL is a key."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    at = codes.indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(at[1:] != at[:-1])]) if len(at) else np.empty(0, np.int64)


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in batches:
        if b.num_rows:
            yield pa.table(b.columns, names=b.schema.names)       # all fields nullable, so that tables can be joined


def _lead(key: str, cols: list[str], k: int):
    """For mapInArrow: rows with the values k rows later in their key, and ``_b``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first_run = None, 0           # rows still open; how many rows of the partition's first key went by, -1: it ended

        def out(t: pa.Table, later: list[pa.Array], state: int) -> Iterator[pa.RecordBatch]:
            whole = t
            for c, v in zip(cols, later):
                whole = whole.append_column("_later_" + c, v)
            yield from whole.append_column("_b", pa.array(np.full(t.num_rows, state, np.int32))).combine_chunks().to_batches()

        def none(t: pa.Table) -> list[pa.Array]:
            return [pa.nulls(t.num_rows, t.column(c).type) for c in cols]

        for new in _tables(batches):
            t = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            run_no, n = _runs(t.column(key)), t.num_rows
            at = np.arange(n)
            known = (at + k < n) | (run_no != run_no[-1])
            target = np.minimum(at + k, n - 1)
            same = (at + k < n) & (run_no[target] == run_no)
            settled = np.flatnonzero(known)
            if len(settled):
                part = t.take(pa.array(settled))
                index = pa.array(target[settled], mask=~same[settled])
                yield from out(part, [t.column(c).combine_chunks().take(index) for c in cols], SETTLED)
                if first_run >= 0:
                    # Settled rows among the first k of the partition also answer rows of the partition before.
                    lead_rows = settled[(run_no[settled] == 0)][:max(k - first_run, 0)]
                    if len(lead_rows):
                        early = t.take(pa.array(lead_rows))
                        yield from out(early, none(early), BESIDE)
                    first_run = first_run + int((run_no[settled] == 0).sum()) if run_no[-1] == 0 else -1
            held = t.take(pa.array(np.flatnonzero(~known)))
        if held is not None and held.num_rows:
            yield from out(held, none(held), OPEN)
    return run


def with_shift(df: DataFrame, key: str, order: list[str], cols: list[str], k: int,
               prefix: str = "next_", strategy: str = "skew") -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` k rows later in key order (k < 0:
    earlier), NULL past the end: ``lead``/``lag``, or one pass over ranges."""
    if not use_skew_path(strategy) or k == 0:
        w = Window.partitionBy(key).orderBy(*[F.col(c) for c in order])
        fn = (lambda c: F.lead(c, k)) if k >= 0 else (lambda c: F.lag(c, -k))
        return df.select("*", *[fn(c).over(w).alias(prefix + c) for c in cols])
    # Earlier rows are later rows of the opposite order (NULLs change ends with it).
    by = [F.col(c) if k > 0 else F.col(c).desc() for c in order]
    types = {f.name: f.dataType for f in df.schema}
    schema = StructType([*df.schema, *[StructField("_later_" + c, types[c]) for c in cols], StructField("_b", IntegerType())])
    rows = stored(_ranged(df, key, by).mapInArrow(_lead(key, cols, abs(k)), schema))
    # 2 k rows for each partition at most.
    border = Window.partitionBy(key).orderBy(*by)
    near = (rows.where(F.col("_b") != SETTLED).select(*df.columns, "_b", *[F.lead(c, abs(k)).over(border).alias("_later_" + c) for c in cols])
            .where(F.col("_b") == OPEN))
    both = rows.where(F.col("_b") == SETTLED).unionByName(near)
    return both.select(*df.columns, *[F.col("_later_" + c).alias(prefix + c) for c in cols])


def gap_sessions(df: DataFrame, key: str, ts: str, tie: str | None, gap: str,
                 strategy: str = "skew") -> DataFrame:
    """``(key, session_start, session_end, n_calls)``: a new session starts when
    the gap to the previous call is more than ``gap``; end = last call + gap.
    Rows without a time belong to no session; a NULL key is a key.

    "window": ``session_window`` aggregation.  "skew": each partition of the
    ranges gives its sessions (first, last, count); those at its borders are
    joined with their neighbours by the same rule."""
    df = df.where(F.col(ts).isNotNull())
    if not use_skew_path(strategy):
        return (df.groupBy(key, F.session_window(ts, gap).alias("w"))
                .agg(F.count(F.lit(1)).cast("bigint").alias("n_calls"))
                .select(key, F.col("w.start").alias("session_start"),
                        F.col("w.end").alias("session_end"), "n_calls"))
    calls = df.select(key, F.col(ts).alias("session_start"), (F.col(ts) + F.expr(f"INTERVAL {gap}")).alias("session_end"),
                      F.lit(1).cast("bigint").alias("n_calls"))
    schema = StructType([*calls.schema, StructField("_b", IntegerType())])
    parts = stored(_ranged(calls, key, [F.col("session_start")]).mapInArrow(_sessions(key), schema))
    # At the borders: two sessions for each partition and side at most.
    w = Window.partitionBy(key).orderBy("session_start")
    begins = F.lag("session_end").over(w)
    near = (parts.where(F.col("_b") == OPEN)
            .withColumn("_new", F.when(begins.isNull() | (F.col("session_start") > begins), 1).otherwise(0))
            .withColumn("_no", F.sum("_new").over(w)).groupBy(key, "_no")
            .agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n_calls").alias("n_calls")))
    return parts.where(F.col("_b") == SETTLED).drop("_b").unionByName(near.drop("_no"))


def _sessions(key: str):
    """For mapInArrow: sessions of calls sorted by (key, session_start); those that begin a partition's first key
    or end its last key are open."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False           # the last session so far, which may go on; whether the first one is out

        def out(t: pa.Table, state: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("_b", pa.array(state.astype(np.int32))).combine_chunks().to_batches()

        for new in _tables(batches):
            t = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            runs = _runs(t.column(key))
            start, end = (t.column(c).cast(pa.int64()).to_numpy() for c in ("session_start", "session_end"))
            fresh = np.concatenate([[True], (runs[1:] != runs[:-1]) | (start[1:] > end[:-1])])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(fresh)) - 1
            n = np.add.reduceat(t.column("n_calls").to_numpy(), first)
            found = pa.table({key: t.column(key).take(pa.array(first)), "session_start": t.column("session_start").take(pa.array(first)),
                              "session_end": t.column("session_end").take(pa.array(last)), "n_calls": pa.array(n)})
            if len(first) > 1:
                state = np.zeros(len(first) - 1, np.int32)
                if not begun:
                    state[0], begun = OPEN, True
                yield from out(found.slice(0, len(first) - 1), state)
            held = found.slice(len(first) - 1)
        if held is not None:
            yield from out(held, np.array([OPEN]))
    return run


def first_quiet(df: DataFrame, key: str, ts: str, tie: str | None, idle: str, strategy: str = "skew") -> DataFrame:
    """``(key, _start, _q)``: a key's first time, and the first time + ``idle`` that no call follows sooner."""
    until = F.col(ts) + F.expr(f"INTERVAL {idle}")
    df = df.where(F.col(ts).isNotNull())
    if not use_skew_path(strategy):
        nxt = with_shift(df.select(key, ts, *([tie] if tie else [])), key, [ts] + ([tie] if tie else []), [ts], 1, "_next_", strategy)
        quiet = F.when(F.col("_next_" + ts).isNull() | (F.col("_next_" + ts) >= until), until)
        return nxt.select(key, ts, quiet.alias("_quiet")).groupBy(key).agg(F.min(ts).alias("_start"), F.min("_quiet").alias("_q"))
    calls = df.select(key, F.col(ts).alias("_start"), until.alias("_until"))
    schema = StructType([*calls.schema, StructField("_q", calls.schema["_until"].dataType), StructField("_b", IntegerType())])
    parts = stored(_ranged(calls, key, [F.col("_start")]).mapInArrow(_quiet(key), schema))
    # One summary for each partition and key; only the first and last key of a partition have others.
    follows = F.lead("_start").over(Window.partitionBy(key).orderBy("_start", "_until"))
    ends = F.when(follows.isNull() | (follows >= F.col("_until")), F.col("_until"))
    near = (parts.where(F.col("_b") == OPEN).withColumn("_q", F.coalesce("_q", ends))
            .groupBy(key).agg(F.min("_start").alias("_start"), F.min("_q").alias("_q")))
    settled = parts.where(F.col("_b") == SETTLED).select(key, "_start", F.coalesce("_q", "_until").alias("_q"))
    return settled.unionByName(near.select(key, "_start", "_q"))


def _quiet(key: str):
    """For mapInArrow over calls sorted by (key, _start): of each key its first time, its first quiet point that another
    call shows, and when its last call ends."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False           # the summary of the last key so far

        def out(t: pa.Table, state: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("_b", pa.array(state.astype(np.int32))).combine_chunks().to_batches()

        for new in _tables(batches):
            new = new.append_column("_q", pa.nulls(new.num_rows, new.column("_until").type))
            t = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            runs = _runs(t.column(key))
            start, until = (t.column(c).cast(pa.int64()).to_numpy() for c in ("_start", "_until"))
            first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
            last = np.append(first[1:], len(runs)) - 1
            shown = np.concatenate([(runs[1:] == runs[:-1]) & (start[1:] >= until[:-1]), [False]])
            place = np.where(shown, np.arange(len(runs)), len(runs))
            quiet = np.minimum.reduceat(place, first)
            q = t.column("_until").combine_chunks().take(pa.array(np.minimum(quiet, len(runs) - 1), mask=quiet == len(runs)))
            if held is not None and t.column("_q")[0].is_valid:
                q = pa.concat_arrays([t.column("_q").combine_chunks().slice(0, 1), q.slice(1)])     # known before
            found = pa.table({key: t.column(key).take(pa.array(first)), "_start": t.column("_start").take(pa.array(first)),
                              "_until": t.column("_until").take(pa.array(last)), "_q": q})
            if len(first) > 1:
                state = np.zeros(len(first) - 1, np.int32)
                if not begun:
                    state[0], begun = OPEN, True
                yield from out(found.slice(0, len(first) - 1), state)
            held = found.slice(len(first) - 1)
        if held is not None:
            yield from out(held, np.array([OPEN]))
    return run
