"""Collocations of two to four words, counted on a weighted de Bruijn graph.

The graph's nodes are phrases of three words, its edges phrases of four, from
the node of their first three words to that of their last three; an edge
weighs its number of occurrences.

1. One pass over the texts counts neighbouring pairs of words by a hash.
   Pairs that occur ``min_count`` times or more go into a bit table of fixed
   size (``FILTER_BITS``).  A phrase that is frequent enough has only such
   pairs, so the texts can be cut between all others: nothing is lost, and
   a pair that passes by chance only costs time.
2. A second pass counts the edges inside what is left of a piece, and for
   each end of such a run the last three, two and one words.
3. Shorter counts come from flow: a node's count is the weight of its edges
   out plus the runs that end on it; a pair's count is that of the nodes it
   begins plus the runs that end on it; a word's in the same way.
4. Edges of weight ``min_count`` or more are compacted to paths.  An edge in
   and an edge out that both weigh as much as their node leave no other way
   through it; such edges become one path, by pointer doubling along the
   edges.  A node inside a path is part of an edge of the same weight, so it
   is no phrase of its own; phrases of four words are the windows of the
   paths, those of three the nodes that paths begin, end or part at.

Pairs, edges and ends are summed in each task before they are shuffled, and
every shuffle is by phrase, so a hot language, text or passage is no group
of its own.  The bit table is the one broadcast.

Defined results: a null text is empty, a null language is ``und``; texts
count as often as they occur, whatever their id; bytes that are no UTF-8 are
kept as they are; texts without phrases that are frequent enough give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.common import small_batches, written

MIN_COUNT = 30
TOP = 2000
FILTER_BITS = 27            # 16 MB
AT_ONCE = 1_000_000         # words that a task gathers before it sums them
ROWS = 1 << 15              # rows of a batch that a task gives
PATH_PART = 512             # edges in a row of the path table

# Piece ends . , ; : ! ? and 0A-0D become one byte that no word has; tab becomes a space.
_CLEAN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_END = 0                    # the code of a piece end
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words(data: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), with ``b"."`` between pieces."""
    return data.lower().translate(_CLEAN).replace(b".", b" . ").split()


class _Numbers(dict):
    """Word to a number; ``hashes`` and ``names`` are by number.  A piece end is 0."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = [b"."]
        self.hashes: list[int] = [0]
        self[b"."] = _END

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


class _Gathered:
    """Number sequences of the texts of each language, up to ``AT_ONCE`` words."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.by_lang: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        w = words(text)
        codes = np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w))
        self.by_lang.setdefault(lang, []).append(np.append(codes, _END))
        self.size += len(w)

    def sequences(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Language, numbers, and for each place the hash of the pair that begins there (0: none)."""
        hashes = np.array(self.numbers.hashes, np.uint64)
        for lang, parts in self.by_lang.items():
            seq = np.concatenate(parts)
            h = hashes[seq]
            pair = (h[:-1] ^ np.uint64(xxhash.xxh64_intdigest(lang))) * _C1 + h[1:]
            pair = (pair ^ (pair >> np.uint64(29))) * _C2
            pair ^= pair >> np.uint64(32)
            yield lang, seq, np.append(np.where((seq[:-1] != _END) & (seq[1:] != _END), pair | np.uint64(1), np.uint64(0)), np.uint64(0))


def _gather(batches: Iterable[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    got = _Gathered()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            got.add(lang, text)
            if got.size >= AT_ONCE:
                yield from flush(got)
                got.clear()
    yield from flush(got)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(got: _Gathered) -> Iterator[pa.RecordBatch]:
        found = [pair[pair > 0] for _, _, pair in got.sequences()]
        if found:
            h, c = np.unique(np.concatenate(found), return_counts=True)
            del found
            for s in range(0, len(h), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(h[s:s + ROWS].view(np.int64)), pa.array(c[s:s + ROWS])], ["h", "c"])
    return _gather(batches, flush)


def frequent_pairs(src: DataFrame, min_count: int) -> np.ndarray:
    """A bit table of ``2**FILTER_BITS`` bits, set where a frequent pair hashes to."""
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    pages = (src.mapInArrow(_pairs, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
             .groupBy(F.bitmap_bucket_number(place).alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 4096                                             # bytes of a bitmap
    for r in pages.toLocalIterator():                       # at most 2**FILTER_BITS bits in all
        table[(r.page - 1) * size:r.page * size] = np.frombuffer(bytes(r.bits), np.uint8)
    return table


def _names(names: list[bytes], *columns: np.ndarray) -> pa.Array:
    return pa.array([b" ".join([names[i] for i in row]) for row in zip(*(c.tolist() for c in columns))], pa.binary())


def _edges(shared):
    """Edges (k = 4) and run ends (k = 3, 2, 1), summed."""
    def run(batches):
        bits = shared.value

        def flush(got: _Gathered) -> Iterator[pa.RecordBatch]:
            names = got.numbers.names
            for lang, seq, pair in got.sequences():
                at = pair >> np.uint64(64 - FILTER_BITS)
                good = (pair > 0) & ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                p = np.flatnonzero(good)
                kinds, inverse = np.unique((seq[p] << 32) | seq[p + 1], return_inverse=True)
                number = np.zeros(len(seq), np.int64)       # of the pair that begins at a place
                number[p] = inverse
                four = p[good[p + 1] & good[np.minimum(p + 2, len(seq) - 1)]]
                end = np.flatnonzero((seq != _END) & ~good)
                # A place before the first one is the last place, which is never good.
                end2 = end[good[end - 1]]
                end3 = end2[good[end2 - 2]]
                left, right = kinds >> 32, kinds & 0xFFFFFFFF
                for k, code in ((4, (number[four] << 32) | number[four + 2]), (3, (number[end3 - 2] << 32) | seq[end3]),
                                (2, number[end2 - 1]), (1, seq[end])):
                    if not len(code):
                        continue
                    every, count = np.unique(code, return_counts=True)
                    for s in range(0, len(every), ROWS):
                        u, c = every[s:s + ROWS], count[s:s + ROWS]
                        hi, lo = u >> 32, u & 0xFFFFFFFF
                        columns = ((left[hi], right[hi], left[lo], right[lo]) if k == 4 else (left[hi], right[hi], lo) if k == 3 else
                                   (left[u], right[u]) if k == 2 else (u,))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), k, np.int32)), _names(names, *columns), pa.array(c)],
                            ["lang", "k", "g", "c"])
        yield from _gather(batches, flush)
    return run


def _first(k: int) -> Column:
    return F.substring_index("g", " ", k)


def _flow(longer: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """Counts of phrases of k words: those of k + 1 words that they begin, and the runs that end on them."""
    return (longer.select("lang", _first(k).alias("g"), "c").unionByName(ends.where(F.col("k") == k).select("lang", "g", "c"))
            .groupBy("lang", "g").agg(F.sum("c").alias("c")))


def paths(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compacted paths of ``edges(lang, g, c)`` over ``nodes(lang, g, c)``, and the nodes inside them.

    Paths are (lang, head, part, words, c): ``words`` are those of up to
    ``PATH_PART`` edges in their order, ``c`` the weight of each.
    """
    of = F.unhex(F.md5(F.concat_ws(" ", "lang", "g")))
    e = edges.select("lang", "g", "c", of.alias("e"))
    node = nodes.select("lang", F.col("g").alias("v"), "c")
    # An edge that weighs as much as a node is the only one on its side of it.
    out = e.select("lang", _first(3).alias("v"), "c", F.col("e").alias("next")).join(node, ["lang", "v", "c"])
    into = e.select("lang", F.substring_index("g", " ", -3).alias("v"), "c", F.col("e").alias("prev")).join(node, ["lang", "v", "c"])
    links = written(out.join(into, ["lang", "v", "c"]).select("lang", "v", "next", "prev"))
    inner = links.select("lang", F.col("v").alias("g"))
    # Pointer doubling; a path cannot close to a ring, as each run leaves it somewhere.
    step = written(e.join(links.select(F.col("next").alias("e"), "prev"), "e", "left").select(
        "e", F.coalesce("prev", "e").alias("to"), F.col("prev").isNotNull().cast("long").alias("far"), F.col("prev").isNull().alias("done")))
    while not step.where(~F.col("done")).isEmpty():
        ahead = step.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        # Only edges that have not met their head ask; no two of them ask one edge.
        moved = (step.where(~F.col("done")).join(ahead, "to")
                 .select("e", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done")))
        step = written(step.where("done").unionByName(moved))
    placed = e.join(step, "e").withColumn("part", F.floor(F.col("far") / PATH_PART))
    rows = placed.groupBy("lang", F.col("to").alias("head"), "part").agg(
        F.sort_array(F.collect_list(F.struct("far", "g"))).alias("es"), F.min("c").alias("c"))
    whole = F.split(F.col("es")[0]["g"], " ")
    last = F.transform(F.slice("es", 2, PATH_PART), lambda x: F.substring_index(x["g"], " ", -1))
    return rows.select("lang", "head", "part", F.concat(whole, last).alias("words"), "c"), inner


def _windows(path: DataFrame, k: int = 4) -> DataFrame:
    at = F.explode(F.sequence(F.lit(1), F.size("words") - (k - 1)))
    return path.select("lang", "words", "c", at.alias("i")).select("lang", F.array_join(F.slice("words", F.col("i"), k), " ").alias("g"), "c")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> dict[str, DataFrame]:
    """Tables of the graph: ``paths``, ``counts`` (lang, k, g, c) of one to three words, ``inner`` and ``totals``.

    ``counts`` and ``paths`` hold what occurs ``min_count`` times or more;
    ``totals`` has each language's number of words, n.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_pairs(src, min_count))
    grams = written(src.mapInArrow(_edges(shared), "lang string, k int, g binary, c long")
                    .groupBy("lang", "k", "g").agg(F.sum("c").alias("c")).withColumn("g", F.col("g").cast("string")))
    edges = grams.where("k = 4").select("lang", "g", "c")
    nodes = written(_flow(edges, grams, 3))
    pairs = written(_flow(nodes, grams, 2))
    single = written(_flow(pairs, grams, 1))
    enough = F.col("c") >= min_count
    counts = single.where(enough).withColumn("k", F.lit(1))
    for k, t in ((2, pairs), (3, nodes)):
        counts = counts.unionByName(t.where(enough).withColumn("k", F.lit(k)))
    path, inner = paths(edges.where(enough), nodes.where(enough))
    return {"paths": written(path), "inner": inner, "counts": written(counts),
            "totals": single.groupBy("lang").agg(F.sum("c").alias("n"))}


def score() -> Column:
    """floor(2000000 a / (l + r)), in decimals, as the product may pass 64 bits."""
    return F.expr("CAST(a AS decimal(20,0)) * CAST(2000000 AS decimal(7,0)) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    t = phrase_counts(docs, min_count)
    counts = t["counts"]
    four = _windows(t["paths"]).withColumn("k", F.lit(4))
    three = counts.where("k = 3").join(t["inner"], ["lang", "g"], "left_anti")
    cand = written(four.unionByName(three).unionByName(counts.where("k = 2")).select("lang", "g", "k", F.col("c").alias("a")))

    # The most frequent longer candidate around each phrase.
    ws = F.split("g", " ")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " ")))))
    around = (cand.where("k > 2").select("lang", inside.alias("g"), F.col("a").alias("f"))
              .groupBy("lang", "g").agg(F.max("f").alias("f")))
    dec = "decimal(30,0)"
    kept = (cand.join(around, ["lang", "g"], "left")
            .where(F.col("f").isNull() | (F.col("f").cast(dec) * 100 < F.col("a").cast(dec) * 80)).drop("f"))

    # Every cut of a phrase, with the counts of both sides.
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.selectExpr("*", "substring_index(g, ' ', cut) AS p", "substring_index(g, ' ', cut - k) AS q")
    left = counts.select("lang", F.col("g").alias("p"), F.col("c").alias("l"))
    right = counts.select("lang", F.col("g").alias("q"), F.col("c").alias("r"))
    best = (cut.join(left, ["lang", "p"]).join(right, ["lang", "q"])
            .groupBy("lang", "g", "a").agg(F.min(F.struct(score().alias("score"), "cut", "l", "r")).alias("b")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = (best.select("lang", F.col("g").alias("phrase"), "a", "b.l", "b.r", "b.score")
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top))
    # One row a language, a grouped result; Spark picks the join's side by its size.
    return ranked.join(t["totals"], "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
