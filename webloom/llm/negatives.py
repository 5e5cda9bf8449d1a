"""Hard negatives: per anchor and positive, the best rows of other labels just below it.

Rows meet the anchors in cells: a cell holds one block of anchors (at most
about ``BLOCK``) and streams one share of the rows past it, so neither side
is ever whole in a task.  Two scans are made.  The first keeps each anchor's
best rows of its own label; the second knows their scores, the windows, and
keeps for each window the best rows of other labels.  A cell sends on only
what can still be among the first ``n`` of a window, which loses nothing:
what a share of the rows has below its own first ``n`` is below them for all.

What the cells send is packed into keys (anchor, descending score, id) and
dealt by anchor with ``repartitionAndSortWithinPartitions``.  An iterator
walks the sorted keys once: a positive opens its window, a negative goes to
every open window, and a window closes when it is full or the score falls
below its lower bound.  It holds the open windows and the first ``n``
negatives of the present score, never an anchor's rows.

Components are quantised as ``floor(256 x)``; scores are exact integers.

Defined results: rows with a null id, label or vector, or a null or
non-finite component, take no part.  Of rows with one id the least by
(label, vector) counts, once.  Missing components of shorter vectors are 0.
Scores outside 64 bits are set to the nearest bound.  Labels are integers.
Ties go by smaller id.  An anchor without positives or a positive without
negatives has no rows; an empty table gives none.  Other columns are
ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cores, small_batches, written

N_POSITIVES = 5
N_NEGATIVES = 5
LOW_PERCENT = 80            # a negative has at least this share of the positive's score
BLOCK = 32_768              # anchors of a cell
SCORES_AT_ONCE = 1 << 22    # entries of a score matrix

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_SIGN = 1 << 63
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _whole(x: float) -> int:
    return math.floor(256 * x) if abs(x) < 2.0 ** 60 else int(x) * 256


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Quantised vectors as rows; float64 if that is exact for each component, else Python integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and np.abs(flat).max() >= 2.0 ** 44:
        values = np.array([_whole(x) for x in flat.tolist()], object)
    else:
        values = np.floor(256 * flat)
    width = int(sizes.max()) if len(sizes) else 0
    if len(values) == width * len(sizes):
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``, as int64."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width == 0:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object and \
            np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in b.tolist()]
    return np.array([[min(max(sum(x * y for x, y in zip(u, v)), _LEAST), _MOST) for v in whole]
                     for u in ([int(x) for x in w] for w in a.tolist())], np.int64).reshape(len(a), len(b))


class _Best:
    """The first ``n`` (score descending, id ascending) of each of ``slots`` lists."""

    def __init__(self, slots: int, n: int):
        self.n = n
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.last_score = np.full(slots, _LEAST)        # of a full list, its last entry
        self.last_id = np.full(slots, _MOST)

    def passing(self, scores: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
        low, at = self.last_score[slots][:, None], self.last_id[slots][:, None]
        return (scores > low) | ((scores == low) & (ids[None, :] < at))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(z) for z in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))         # ~x falls as x rises, without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        keep = rank < self.n
        full = rank == self.n - 1
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        self.last_score[slot[full]], self.last_id[slot[full]] = score[full], ids[full]


class _Cell:
    """A block of anchors and the lists that a scan of rows fills."""

    def __init__(self, number: int):
        self.number = number
        self.parts: list[pa.RecordBatch] = []
        self.best: _Best | None = None

    def take(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def _start(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.ids, self.labels = (t.column(c).to_numpy() for c in ("id", "label"))
        vectors = t.column("vector")
        self.vectors = _matrix(pa.concat_arrays(vectors.chunks))
        self.extra = t.column("positives").to_pylist() if "positives" in t.column_names else None

    def scan(self, part: pa.RecordBatch) -> None:
        if self.best is None:
            if not self.parts:
                return                                  # a share of the rows without anchors
            self._start()
            self.best = self.lists()
        ids, labels = (part.column(c).to_numpy() for c in ("id", "label"))
        vectors = _matrix(part.column("vector"))
        step = max(1, SCORES_AT_ONCE // max(len(self.ids), 1))
        for s in range(0, len(ids), step):
            self.compare(_products(self.vectors, vectors[s:s + step]), ids[s:s + step], labels[s:s + step])


class _OwnLabel(_Cell):
    n = N_POSITIVES

    def lists(self) -> _Best:
        return _Best(len(self.ids), self.n)

    def compare(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        slots = np.arange(len(self.ids))
        a, r = np.nonzero((self.labels[:, None] == labels) & (self.ids[:, None] != ids) & self.best.passing(scores, ids, slots))
        self.best.add(a, scores[a, r], ids[r])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            b = self.best
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[b.slot]), pa.array(b.score), pa.array(b.id)], ["anchor", "score", "id"])


class _OtherLabels(_Cell):
    n, low = N_NEGATIVES, LOW_PERCENT

    def lists(self) -> _Best:
        # One list for each different score of a positive; equal ones have one window.
        tops = [sorted({p["score"] for p in row}, reverse=True) for row in self.extra]
        self.anchor = np.array([k for k, t in enumerate(tops) for _ in t], np.int64)
        self.high = np.array([s for t in tops for s in t], np.int64)
        self.least = np.array([lower_bound(s, self.low) for t in tops for s in t], np.int64)
        return _Best(len(self.high), self.n)

    def compare(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        other = self.labels[:, None] != labels
        step = max(1, SCORES_AT_ONCE // max(len(ids), 1))
        for s in range(0, len(self.high), step):
            slots = np.arange(s, min(s + step, len(self.high)))
            mine = scores[self.anchor[slots]]
            w, r = np.nonzero(other[self.anchor[slots]] & (mine <= self.high[slots][:, None]) & (mine >= self.least[slots][:, None])
                              & self.best.passing(mine, ids, slots))
            self.best.add(slots[w], mine[w, r], ids[r])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        b = self.best
        # A row may be in several windows of an anchor; it is sent once.
        found = np.unique(np.stack([self.anchor[b.slot], b.score, b.id], axis=1), axis=0) if len(b.slot) else np.empty((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[found[:, 0]]), pa.array(found[:, 1]), pa.array(found[:, 2])],
                                         ["anchor", "score", "id"])


def lower_bound(score: int, low: int) -> int:
    """The least score s with ``low * score <= 100 * s``, in 64 bits."""
    return min(max(-((-low * int(score)) // 100), _LEAST), _MOST)


def _scan(kind: type[_Cell]):
    """A function for mapInArrow over rows sorted by (cell, side): anchors (side 0), then rows (side 1)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for b in batches:
            number, side = (b.column(c).to_numpy() for c in ("cell", "side"))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if s == e:
                    continue
                if cell is None or cell.number != number[s]:
                    if cell is not None:
                        yield from cell.result()
                    cell = kind(number[s])
                (cell.scan if side[s] else cell.take)(b.slice(s, e - s))
        if cell is not None:
            yield from cell.result()
    return run


def _cells(items: DataFrame, anchors: DataFrame, blocks: int, shares: int) -> DataFrame:
    """Each block of anchors beside each share of the rows, sorted so that the anchors of a cell come first."""
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))
    share = F.pmod(F.xxhash64("id", F.lit("share")), F.lit(shares))
    more = [c for c in anchors.columns if c not in items.columns]
    left = (anchors.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            .select((block * shares + F.col("_share")).cast("long").alias("cell"), F.lit(0).alias("side"), "id", "label", "vector", *more))
    right = (items.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select((F.col("_block") * shares + share).cast("long").alias("cell"), F.lit(1).alias("side"), "id", "label", "vector"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(blocks * shares, "cell").sortWithinPartitions("cell", "side")


def pack(anchor: int, score: int, number: int) -> bytes:
    """A key whose byte order is (anchor, descending score, id)."""
    return struct.pack(">QQQ", anchor + _SIGN, _MOST - score, number + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int]:
    a, s, i = struct.unpack(">QQQ", key)
    return a - _SIGN, _MOST - s, i - _SIGN


def _anchor_part(key: bytes) -> int:
    return (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 32


def windows(keys: Iterable[tuple[bytes, bool]], n: int = N_NEGATIVES, low: int = LOW_PERCENT) -> Iterator[tuple]:
    """Rows of the result from sorted (key, is a positive)."""
    anchor = score = None
    opened: list[list[int]] = []        # positive, its score, its lower bound, negatives so far
    tied: list[int] = []                # the first negatives of the present score
    for key, positive in keys:
        a, s, i = unpack(key)
        if a != anchor:
            anchor, score, opened = a, None, []
        if s != score:
            score, tied = s, []
            opened = [w for w in opened if w[3] < n and w[2] <= s]
        if positive:
            w = [i, s, lower_bound(s, low), 0]
            if w[2] <= s:
                for t in tied:
                    w[3] += 1
                    yield a, i, w[3], t, s, s
                opened.append(w)
            continue
        if len(tied) < n:
            tied.append(i)
        for w in opened:
            if w[3] < n:
                w[3] += 1
                yield a, w[0], w[3], i, w[1], s


def clean_rows(rows: DataFrame, number: str, label: Column, vector: str) -> DataFrame:
    """The rows that take part, as (id, label, vector), one for each id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(number).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
            .groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"))


def hard_negatives(items: DataFrame, is_anchor: Column) -> DataFrame:
    """``items(id, label, vector)`` as of ``clean_rows``; anchors are the rows where ``is_anchor`` holds."""
    spark = items.sparkSession
    small_batches(spark)
    items = written(items)
    anchors = items.where(is_anchor)
    blocks = max(1, -(-anchors.count() // BLOCK))
    shares = max(1, -(-cores(spark) // blocks))
    found = "anchor long, score long, id long"
    local = _cells(items, anchors, blocks, shares).mapInArrow(_scan(_OwnLabel), found)
    # The first of all shares: at most N_POSITIVES rows of an anchor and share meet.
    positives = written(local.groupBy("anchor").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "id"))), 1, N_POSITIVES).alias("p"))
        .select("anchor", F.transform("p", lambda p: F.struct(F.bitwise_not(p["down"]).alias("score"), p["id"].alias("id"))).alias("positives")))
    with_windows = anchors.join(positives, anchors["id"] == positives["anchor"]).drop("anchor")
    negatives = _cells(items, with_windows, blocks, shares).mapInArrow(_scan(_OtherLabels), found)
    marks = (positives.select("anchor", F.explode("positives").alias("p")).select("anchor", "p.score", "p.id", F.lit(True).alias("positive"))
             .unionByName(negatives.withColumn("positive", F.lit(False))))
    result = (marks.rdd.map(lambda r: (pack(r[0], r[1], r[2]), r[3]))
              .repartitionAndSortWithinPartitions(cores(spark), _anchor_part).mapPartitions(windows))
    return spark.createDataFrame(result, _OUT, verifySchema=False)
