"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``segments`` parts of equal width.  Two
fingerprints at ``max_bits`` or fewer differing bits have a part in which
they differ in at most ``max_bits // segments`` bits.  So every part is a
hash table of its own; each fingerprint looks up the small Hamming ball
around its part in each table, and the whole distance of each match is
verified.  Of two parts that differ, only the smaller looks up the larger,
so a pair is met once.

Fingerprints are made distinct first, so a group of copies is one node.  A
table cell that more than ``HEAVY`` distinct fingerprints share would give
pairs by the square; the fingerprints in it, and those that look it up, are
linked exactly in another way: every one lists the Hamming ball of half the
distance around its whole fingerprint, and fingerprints that meet in a
point of the space are linked to the least of them.  A point has a bounded
number of fingerprints in its ball, so nothing grows with the square.

Defined results: a null or empty text has fingerprint zero and is linked
like any other; repeated rows and ids are fingerprinted one by one; a null
id never becomes a component id unless all ids of the component are null;
an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed, small_batches, written
from webloom.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 2
HEAVY = 256
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = (text or "").encode().lower().split()      # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[:len(words) - size].tolist()]
    last = (ends[size - 1:] - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):            # bounded, however long the text is
        part = hashes[i:i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    out = 0
    for i in np.flatnonzero(2 * counts > len(hashes)).tolist():
        out |= 1 << i
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, and ``fp``, the fingerprint's 64 bits as a long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, size)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, fp long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _longs(values: list[int]) -> Column:
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    return F.lit(np.array(signed, np.int64))


def _ball(s: int, part: Column, masks: Column) -> Column:
    """The cells of table ``s`` around ``part`` that are not below it."""
    near = F.filter(F.transform(masks, lambda m: part.bitwiseXOR(m)), lambda k: k >= part)
    return F.transform(near, lambda k: F.struct(F.lit(s).alias("s"), k.alias("key")))


def _near(a: str, b: str, max_bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(fps: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, heavy: int = HEAVY) -> DataFrame:
    """Distinct ``fps(fp)`` to links ``(a, b)``.

    All pairs at ``max_bits`` or fewer bits outside heavy cells; around
    heavy cells as many of them as connect the same fingerprints.
    """
    width = -(-64 // segments)
    parts, probes = [], []
    for s in range(segments):
        bits = min(width, 64 - s * width)
        part = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        ball = _longs(_masks(bits, max_bits // segments))
        parts.append(F.struct(F.lit(s).alias("s"), part.alias("key")))
        probes.append(_ball(s, part, ball))
    # No list is empty; the outer form keeps the optimizer from making them twice, for a filter.
    cells = fps.select("fp", F.explode_outer(F.array(*parts)).alias("c")).select("c.s", "c.key", "fp")
    looked = fps.select("fp", F.explode_outer(F.concat(*probes)).alias("c")).select("c.s", "c.key", "fp")
    full = checkpointed(cells.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") > heavy).select("s", "key"))
    around = None
    if not full.isEmpty():
        inside = (cells.join(full, ["s", "key"], "left_semi").select("fp")
                  .unionByName(looked.join(full, ["s", "key"], "left_semi").select("fp")).distinct())
        around = _through_points(inside, max_bits)
        cells = cells.join(full, ["s", "key"], "left_anti")
    met = (looked.withColumnRenamed("fp", "a").join(cells.withColumnRenamed("fp", "b"), ["s", "key"])
           .where((F.col("a") != F.col("b")) & _near("a", "b", max_bits)).select("a", "b"))
    return met if around is None else met.unionByName(around)


def _through_points(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints whose balls of half the distance meet, to the least of each point."""
    far, near = -(-max_bits // 2), max_bits // 2
    points = fps.select("fp", F.explode_outer(F.transform(_longs(_masks(64, far)), lambda m: F.struct(
        F.col("fp").bitwiseXOR(m).alias("p"), (F.bit_count(m) <= near).alias("near")))).alias("x"))
    points = points.select("fp", "x.p", "x.near")
    least = (points.groupBy("p").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"),
                                     F.count(F.lit(1)).alias("n")).where("n > 1").select("p", "b"))
    return (points.select("p", F.col("fp").alias("a")).join(least, "p")
            .where((F.col("a") != F.col("b")) & _near("a", "b", max_bits)).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS,
                    segments: int = SEGMENTS, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows = checkpointed(fingerprints(docs, size))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(links(nodes.select("fp"), max_bits, segments, heavy))
    rooted = (nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The document with the least id of each component, all columns unchanged.

    Of rows that repeat this id the least one stays, by text and then the
    other columns; rows with a null id stay if no id of the component is known.
    """
    found = checkpointed(near_duplicates(docs, size, max_bits))
    drop = found.where("doc_id is null and component_id is not null or doc_id <> component_id")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = docs.where("doc_id is not null")
    # Written tables: Spark broadcasts them below its own threshold, and joins by a shuffle beyond.
    out = written(drop.where("doc_id is not null").select("doc_id").unionByName(again.select("doc_id")).distinct())
    once = named.join(out, "doc_id", "left_anti").select(*docs.columns)
    twice = again.join(drop, "doc_id", "left_anti").select("doc_id")
    if not twice.isEmpty():
        order = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
        least = (named.join(written(twice), "doc_id", "left_semi")
                 .groupBy("doc_id").agg(F.min(F.struct(*order)).alias("_row")))
        once = once.unionByName(least.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))
    unnamed = docs.where("doc_id is null")
    if not unnamed.isEmpty():
        # Without ids, rows are told apart by a hash of their text.
        mark = F.xxhash64("text")
        prints = fingerprints(unnamed.select(mark.alias("doc_id"), "text").distinct(), size)
        lost = (prints.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
                .join(drop.where("doc_id is null").select("fingerprint").distinct(), "fingerprint")
                .select(F.col("doc_id").alias("_mark")))
        once = once.unionByName(unnamed.join(lost, mark == F.col("_mark"), "left_anti").select(*docs.columns))
    return once
