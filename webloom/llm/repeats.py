"""Repeated passages: windows of words that another document has, behind a count-min prefilter.

Every window of ``WINDOW`` words has a 64-bit hash.  Documents are dealt
into groups of about ``GROUP_BYTES``.  First pass: each group makes its own
count-min sketch of its windows (``DEPTH`` rows, counts up to two), as a
sparse sorted list that takes about one byte for a window and row; the lists
are merged by ranges of cells, and each group is told, by one bit for each
of its cells, which have a merged count of two or more.  The sketch's width
follows the number of windows, and no task holds more than a range of it.

Second pass: windows that are estimated repeated in every row, and only those, are
grouped exactly by 96 bits of hash.  A sketch never underestimates, so none
is lost.  Before that a group merges its own windows and sends the smallest
document of each; it is told, by one bit, whether another group has a
smaller one.  So a passage that very many documents share costs one entry for each
group.  The texts are shuffled once, by group; hashes are made again from
them instead of being stored.

Groups and ranges grow with the corpus (up to ``GROUP_BYTES_MOST`` and
``RANGE_MOST``), so that a list stays long; see ``shape``.  Rows that repeat an
id and its whole text are found by hashes, counted, go through the passes
once and are written out again at the end, in parts; a group is chosen by the
id and the whole text.  So rows without an id, or with one opening or one
text, are no group of their own.

Defined results: a null or empty text has no words; a document of fewer
words than a window loses none; rows with equal ids are one document to
each other (nothing is removed on account of an equal id); a null id counts as
larger than every other; an empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cores, written

WINDOW = 13
DEPTH = 2
CELLS_PER_WINDOW = 4
GROUP_BYTES = 8 << 20           # of a group; more for large corpora
GROUP_BYTES_MOST = 64 << 20
RANGE_MOST = 28                 # a task's range of the sketch has 2**28 cells of a byte at most
LIST_WINDOWS = 1000             # groups grow before a list gets shorter than this
REPEATS_AT_ONCE = 4096          # repeated rows that one task writes out
BYTES_PER_WORD = 6              # rough; only the sketch's width depends on it
_NO_ID = np.iinfo(np.int64).max
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ROWS = (np.uint64(1), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _runs(h: np.ndarray, window: int, odd: np.uint64) -> np.ndarray:
    """A hash of every run of ``window`` hashes; the order counts."""
    size = 1
    while size * 2 <= window:
        h = _mix(h[:len(h) - size] * odd + h[size:])
        size *= 2
    rest = window - size
    return _mix(h[:len(h) - rest] * odd + h[rest:]) if rest else h


class Group:
    """The windows of a group of documents, in the order of its sorted rows."""

    def __init__(self, table: pa.Table, window: int):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        number = table.column("n").to_pylist()
        self.n = [number[i] for i in order]
        self.words = [(texts[i] or "").encode().split() for i in order]
        self.window = window
        n = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(n) - n
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(w) for ws in self.words for w in ws), np.uint64, int(n.sum()))
        count = np.maximum(n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), count)
        total = int(count.sum())
        self.at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first, count)
        if total:
            self.a = _runs(h, window, _ODD[0])[self.at]
            self.hash = h
        else:
            self.a = np.empty(0, np.uint64)
            self.hash = h
        self.key = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)

    def cells(self, row: int, log_width: int) -> np.ndarray:
        return (self.a * _ROWS[row]) >> np.uint64(64 - log_width)

    def entries(self, chosen: np.ndarray):
        """Distinct chosen windows, sorted: hashes a and b, the least id, and the entry of each window."""
        at = self.at[chosen]
        a = self.a[chosen]
        b = (_runs(self.hash, self.window, _ODD[1])[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.empty(0, np.uint32)
        ids = self.key[self.doc[chosen]]
        order = np.lexsort((b, a))
        a, b, ids = a[order], b[order], ids[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        low = np.minimum.reduceat(ids, starts) if len(starts) else ids
        entry = np.empty(len(a), np.int64)
        entry[order] = np.cumsum(new) - 1
        return a[new], b[new], low, entry


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed_cells(v: np.ndarray) -> bytes:
    """Sorted numbers as differences of two or four bytes."""
    d = np.diff(v, prepend=np.uint64(0))
    wide = len(d) and int(d.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + _pack(d.astype(np.uint32 if wide else np.uint16))


def _unpacked_cells(data: bytes) -> np.ndarray:
    d = np.frombuffer(_unpack(data[1:]), np.uint32 if data[:1] == b"\4" else np.uint16)
    return np.cumsum(d, dtype=np.int64)


def _split(values: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted values by their bits above ``shift``."""
    if not len(values):
        return []
    part = values >> np.uint64(shift) if shift < 64 else np.zeros(len(values), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(starts[1:], len(values))
    return [(int(part[s]), int(s), int(e)) for s, e in zip(starts, ends)]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    types = {"shard": pa.int64(), "grp": pa.int64(), "payload": pa.binary()}
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, types[n]) for c, n in zip(cols, names)], names=names)


def shape(size: int, workers: int, cells_per_window: int = CELLS_PER_WINDOW, group_bytes: int = GROUP_BYTES) -> tuple[int, int, int]:
    """(groups, log2 of the sketch's width, log2 of the cells of a range) for ``size`` bytes of text.

    A range has about 4,000 cells of a group, 2**26 cells at most while lists
    then have ``LIST_WINDOWS`` windows; for larger corpora first the groups
    grow, then the ranges, each to its bound.
    """
    words = max(1, size // BYTES_PER_WORD)
    log_width = max(16, (cells_per_window * words - 1).bit_length())

    def windows(group: int, log_range: int) -> int:
        return (group // BYTES_PER_WORD) >> (log_width - log_range)

    most = min(26, log_width)
    while windows(group_bytes, most) < LIST_WINDOWS and (group_bytes < GROUP_BYTES_MOST or most < min(RANGE_MOST, log_width)):
        if group_bytes < GROUP_BYTES_MOST:
            group_bytes = min(2 * group_bytes, GROUP_BYTES_MOST)
        else:
            most += 1
    groups = max(workers, -(-size // group_bytes))
    log_range = min(max((4000 * (1 << log_width) * groups // words).bit_length(), 12), most, log_width)
    return groups, log_width, log_range


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n): the rows, those that repeat an id and its text once, with their number.

    Only hashes are shuffled to find the repeated ones; of these, and only of
    these, each task sends a text once.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2")
    pairs = base.select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), *digest)
    again = written(pairs.groupBy("i", "z", "d1", "d2").count().where("count > 1").drop("count"))
    known = base.select("*", F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("z"), *digest)
    key = ["i", "z", "d1", "d2"]
    once = known.join(again, key, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("n"))
    more = known.join(again, key, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(more)


def _written_out(rows: DataFrame) -> DataFrame:
    """Every row as often as it was there; many repeats are dealt to many tasks."""
    few = rows.where("n = 1").drop("n")
    parts = rows.where("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEATS_AT_ONCE))))
    size = F.least(F.lit(REPEATS_AT_ONCE), F.col("n") - F.col("part") * REPEATS_AT_ONCE).cast("int")
    out = parts.withColumn("size", size).repartition(cores(rows.sparkSession)).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size"))))
    return few.unionByName(out.drop("n", "part", "size", "at"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH,
                   cells_per_window: int = CELLS_PER_WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    return _results(docs, window, depth, cells_per_window, group_bytes, texts=True)


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As :func:`remove_repeats`, with the SHA-256 of the kept text in its place."""
    return _results(docs, window, DEPTH, CELLS_PER_WINDOW, GROUP_BYTES, texts=False)


def _results(docs, window, depth, cells_per_window, group_bytes, texts) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, log_width, log_range = shape(size, cores(spark), cells_per_window, group_bytes)
    ranges = log_width - log_range

    base = _counted(docs).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long"))

    def sketch(key, table):
        own, rows = Group(table, window), []
        for r in range(depth):
            c = np.sort(own.cells(r, log_width))
            new = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.empty(0, bool)
            starts = np.flatnonzero(new)
            twice = np.diff(np.append(starts, len(c))) > 1
            c = c[starts]
            for part, s, e in _split(c, log_range):
                low = c[s:e] - np.uint64(part << log_range)
                rows.append(((r << ranges) + part, key[0].as_py(),
                             _packed_cells(low << np.uint64(1) | twice[s:e].astype(np.uint64))))
        return _table(rows, ["shard", "grp", "payload"])

    def merge(key, table):
        """Which cells of each group have a merged count of two or more."""
        count = np.zeros(1 << log_range, np.uint8)
        lists = []
        for data in table.column("payload").to_pylist():
            v = _unpacked_cells(data)
            cells = v >> 1
            count[cells] = np.minimum(count[cells] + 1 + (v & 1).astype(np.uint8), 2)
            lists.append(cells)
        rows = [(key[0].as_py(), g, _pack(np.packbits(count[c] >= 2)))
                for g, c in zip(table.column("grp").to_pylist(), lists)]
        return _table(rows, ["shard", "grp", "payload"])

    def candidates(own: Group, replies: pa.Table) -> np.ndarray:
        """The windows that the merged sketch estimates repeated, in every row."""
        said = sorted(zip(replies.column("shard").to_pylist(), replies.column("payload").to_pylist()))
        chosen = np.ones(len(own.a), bool)
        for r in range(depth):
            cells = own.cells(r, log_width)
            # Sorted once: a cell's answer goes back to all its windows by their places.
            order = np.argsort(cells)
            c = cells[order]
            starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.empty(0, np.int64)
            own_said = [p for s, p in said if s >> ranges == r]
            bits = [np.unpackbits(np.frombuffer(_unpack(p), np.uint8), count=e - s)
                    for p, (_, s, e) in zip(own_said, _split(c[starts], log_range), strict=True)]
            if not bits:
                return np.zeros(len(own.a), bool)
            again = np.empty(len(c), bool)
            again[order] = np.repeat(np.concatenate(bits).astype(bool), np.diff(np.append(starts, len(c))))
            chosen &= again
        return chosen

    def exact(key, left, right):
        own = Group(left, window)
        chosen = candidates(own, right)
        a, b, low, _ = own.entries(chosen)
        g = key[0].as_py()
        # The group's own note, by a key that no range has: which windows were chosen.
        rows = [(-1 - g, g, _pack(np.packbits(chosen)))] if chosen.any() else []
        rows += [(part, g, _pack(a[s:e], b[s:e], low[s:e])) for part, s, e in _split(a, 64 - ranges)]
        return _table(rows, ["shard", "grp", "payload"])

    def smallest(key, table):
        """Whether another group has a smaller document with the same window."""
        shard = key[0].as_py()
        if shard < 0:
            return table.select(["shard", "grp", "payload"])
        parts = [_unpack(p) for p in table.column("payload").to_pylist()]
        n = [len(p) // 20 for p in parts]
        a = np.concatenate([np.frombuffer(p, np.uint64, k) for p, k in zip(parts, n)])
        b = np.concatenate([np.frombuffer(p, np.uint32, k, 8 * k) for p, k in zip(parts, n)])
        low = np.concatenate([np.frombuffer(p, np.int64, k, 12 * k) for p, k in zip(parts, n)])
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.concatenate(([True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])))
        least = np.minimum.reduceat(low[order], np.flatnonzero(new))
        flag = np.empty(len(a), bool)
        flag[order] = least[np.cumsum(new) - 1] < low[order]
        ends = np.cumsum(n)
        rows = [(shard, g, _pack(np.packbits(flag[e - k:e]))) for g, k, e in zip(table.column("grp").to_pylist(), n, ends)]
        return _table(rows, ["shard", "grp", "payload"])

    def cut(key, left, right):
        own = Group(left, window)
        said = sorted(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()))
        removed = np.zeros(int(sum(map(len, own.words))) + 1, np.int64)
        if said:
            chosen = np.unpackbits(np.frombuffer(_unpack(said[0][1]), np.uint8), count=len(own.a)).astype(bool)
            a, _, low, entry = own.entries(chosen)
            bits = [np.unpackbits(np.frombuffer(_unpack(p), np.uint8), count=e - s)
                    for (_, p), (_, s, e) in zip(said[1:], _split(a, 64 - ranges), strict=True)]
            elsewhere = np.concatenate(bits).astype(bool)
            hit = elsewhere[entry] | (own.key[own.doc[chosen]] > low[entry])
            at = own.at[chosen][hit]
            np.add.at(removed, at, 1)
            np.add.at(removed, at + window, -1)
        gone = np.cumsum(removed) > 0
        n, lost, kept = [], [], []
        for first, ws in zip(own.first.tolist(), own.words):
            out = gone[first:first + len(ws)]
            k = int(out.sum())
            left_ = b" ".join(ws) if not k else b" ".join([w for w, x in zip(ws, out.tolist()) if not x])
            n.append(len(ws))
            lost.append(k)
            kept.append(left_.decode() if texts else hashlib.sha256(left_).hexdigest())
        return pa.table([pa.array(own.ids, pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
                         pa.array(kept, pa.string()), pa.array(own.n, pa.int64())],
                        names=["doc_id", "n_words", "n_removed", last, "n"])

    last = "kept" if texts else "kept_sha256"
    lists = "shard long, grp long, payload binary"
    by_group = base.groupBy("grp")
    repeated = by_group.applyInArrow(sketch, lists).groupBy("shard").applyInArrow(merge, lists)
    found = by_group.cogroup(repeated.groupBy("grp")).applyInArrow(exact, lists)
    flags = found.groupBy("shard").applyInArrow(smallest, lists)
    return _written_out(written(by_group.cogroup(flags.groupBy("grp")).applyInArrow(
        cut, f"doc_id long, n_words long, n_removed long, {last} string, n long")))
