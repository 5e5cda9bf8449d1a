"""Toxicity scores by a counterfactual-regularised linear classifier.

Training (driver, on a bounded sample of labelled rows): logistic loss on
word and word-prefix features, an L1 term that keeps the model sparse, and
a counterfactual term.  For each training text that mentions a group, the
group terms are swapped for other ones; the squared change of the score's
logit under the swap is penalised, so a group's name alone cannot carry
toxicity (neutral mentions stay clean).  The weights are a dense vector of
fixed size (``2**BITS`` floats), which bounds what is sent to the tasks.

Scoring is one narrow pass over the texts.

Defined results: a null text counts as empty and scores the model's bias; a
row of ``docs`` with a null id is scored and never held out; labels of a
repeated id count once (toxic if any row says so); rows with a null label
are not learned from; without labelled rows of both kinds every score is
0.  Repeated documents are scored one by one; other columns of ``docs`` are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed, cores, held_out, small_batches

BITS = 18                       # size of the hashed feature space
MAX_TRAIN_ROWS = 16_000         # bound of the labelled sample
PREFIXES = (3, 4, 5, 6, 7)      # the first letters of a word that are features beside it
MIN_Z = 2.0                     # a feature is kept if its rates in the classes differ so much
MIN_ROWS = 3                    # and if so many training rows have it

# Names of groups, swapped within their row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    n_rows: int = 0
    n_swapped: int = 0
    kept: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features: words, and their first letters."""
    return _hashed(set(_WORDS.findall((text or "").lower())))


def _hashed(words: set[str]) -> np.ndarray:
    mask, crc = (1 << BITS) - 1, zlib.crc32
    names = {w[:n] + "~" for n in PREFIXES for w in words if len(w) > n} | words
    return np.fromiter({crc(x.encode()) & mask for x in names}, np.int32)


class _Hits(dict):
    """Word to those of its features that have a weight; usually none.  Bounded."""

    def __init__(self, weights: dict[int, float]):
        self._weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(i for i in _hashed({word}).tolist() if i in self._weights)
        if len(self) >= 300_000:
            self.clear()
        self[word] = out
        return out


def swapped(words: set[str], terms=IDENTITY_TERMS) -> list[set[str]]:
    """Counterfactual word sets: each group term replaced by its next and by its last peer."""
    peers = {t: row for row in terms for t in row}
    own = [w for w in words if w in peers]
    if not own:
        return []
    out = []
    for step in (1, -1):
        new = set(words)
        new.difference_update(own)
        for w in own:
            row = peers[w]
            new.add(row[(row.index(w) + step) % len(row)])
        if new != words and new not in out:
            out.append(new)
    return out


def _csr(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated numbers and the row of each."""
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    return flat, np.repeat(np.arange(len(rows)), n)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS,
                  terms=IDENTITY_TERMS) -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out: y, x, lost and new.

    ``x`` are the row's features; for each swap of its group terms ``lost``
    and ``new`` have the features that go and come.  The rows of the smallest
    hashed ids are taken: a uniform sample that does not depend on the order
    or the partitioning.
    """
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .where(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    small_batches(docs.sparkSession)
    lists = pa.list_(pa.int32())

    def extract(batches):
        for b in batches:
            rows, lost, new = [], [], []
            for t in b.column("text").to_pylist():
                words = set(_WORDS.findall((t or "").lower()))
                alts = swapped(words, terms)
                rows.append(_hashed(words))
                lost.append([np.setdiff1d(rows[-1], _hashed(s)) for s in alts])
                new.append([np.setdiff1d(_hashed(s), rows[-1]) for s in alts])
            yield pa.RecordBatch.from_arrays(
                [b.column("_y"), pa.array(rows, lists), pa.array(lost, pa.list_(lists)), pa.array(new, pa.list_(lists))],
                ["y", "x", "lost", "new"])

    # chosen has max_rows rows at most, a proven bound for the broadcast.  A repeated id counts once.
    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(F.broadcast(chosen), "doc_id")
              .repartition(cores(docs.sparkSession), "doc_id")
              .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y")))
    return picked.select("text", "_y").mapInArrow(
        extract, "y int, x array<int>, lost array<array<int>>, new array<array<int>>")


def telling(rows: DataFrame, min_z: float = MIN_Z, min_rows: int = MIN_ROWS) -> np.ndarray:
    """The features whose rates differ between the classes; counted on Spark."""
    n1, n = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not n1 or n1 == n:
        return np.empty(0, np.int64)
    n0 = n - n1
    c = rows.select("y", F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.lit(n)
    gap = F.abs(F.col("c1") / F.lit(n1) - (F.col("c") - F.col("c1")) / F.lit(n0))
    z = gap / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * F.lit(1 / n1 + 1 / n0))
    kept = c.where((F.col("c") >= min_rows) & (z >= min_z)).select("f").collect()      # 2**BITS at most
    return np.array(sorted(r.f for r in kept), np.int64)


def fit(rows: list[dict], kept: np.ndarray, l1: float = 1e-4, swap_penalty: float = 1.0,
        iterations: int = 300) -> ToxicityModel:
    """Proximal gradient descent (accelerated) on the penalised logistic loss.

    ``rows`` have y, x, lost and new, whose numbers are places in ``kept``.
    """
    size = 1 << BITS
    y = np.array([float(r["y"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(size), -np.inf, len(y))
    n1, n0 = y.sum(), (1 - y).sum()
    x, at = _csr([r["x"] for r in rows])
    # Pairs (text, swapped text): the difference of their features carries the penalty.
    pairs = [z for r in rows for z in zip(r["lost"], r["new"])]
    lost, lost_at = _csr([z[0] for z in pairs])
    new, new_at = _csr([z[1] for z in pairs])
    dx, dat = np.concatenate([lost, new]), np.concatenate([lost_at, new_at])
    sign = np.concatenate([np.ones(len(lost)), -np.ones(len(new))])

    # Both classes weigh half of the loss.
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    k, n = len(kept), len(y)
    w, b = np.zeros(k), 0.0
    vw, vb, t = w.copy(), b, 1.0
    # A step size from the largest curvature, by a few power iterations.
    u = np.ones(k + 1)
    top = 1.0
    for _ in range(12):
        m = np.bincount(at, u[:-1][x], n) + u[-1]
        g = weight * m / 4
        v = np.append(np.bincount(x, g[at], k), g.sum())
        if pairs:
            d = np.bincount(dat, sign * u[:-1][dx], len(pairs)) * (2 * swap_penalty / len(pairs))
            v[:-1] += np.bincount(dx, sign * d[dat], k)
        top = np.linalg.norm(v) / max(np.linalg.norm(u), 1e-12)
        u = v / max(np.linalg.norm(v), 1e-12)
    step = 1 / (1.1 * max(top, 1e-9))
    for _ in range(iterations):
        m = np.bincount(at, vw[x], n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(m, -40, 40))) - y)
        gw = np.bincount(x, g[at], k)
        if pairs:
            d = np.bincount(dat, sign * vw[dx], len(pairs)) * (2 * swap_penalty / len(pairs))
            gw += np.bincount(dx, sign * d[dat], k)
        nw = vw - step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    full = np.zeros(size)
    full[kept] = w
    return ToxicityModel(full, float(b), n, len(pairs), kept[w != 0])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS,
          swap_penalty: float = 1.0, terms=IDENTITY_TERMS) -> ToxicityModel:
    rows = checkpointed(training_rows(docs, labels, max_rows, terms))
    kept = telling(rows)
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def only(ids: np.ndarray) -> list[int]:
        known = shared.value
        if not len(known):
            return []
        place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return place[known[place] == ids].tolist()

    def narrow(batches):
        for b in batches:
            x = [only(np.asarray(v.values)) for v in b.column("x")]
            swaps = [[[only(np.array(z, np.int64)) for z in v] for v in b.column(c).to_pylist()] for c in ("lost", "new")]
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), *[pa.array(v, b.schema.field(n).type) for n, v in zip(("x", "lost", "new"), (x, *swaps))]],
                b.schema.names)

    # Of each row only the telling features come to the driver: max_rows rows at most.
    small = rows.mapInArrow(narrow, rows.schema).toArrow().to_pylist()
    small.sort(key=lambda r: (r["y"], r["x"]))
    return fit(small, kept, swap_penalty=swap_penalty)


def scores(docs: DataFrame, model: ToxicityModel, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and ``score`` in [0, 1]."""
    spark = docs.sparkSession
    small_batches(spark)
    # Only weights that are not zero: at most 2**BITS entries.
    sparse = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    shared = spark.sparkContext.broadcast((sparse, model.bias))
    keep = list(keep)

    def run(batches):
        weights, bias = shared.value
        hits = _Hits(weights)
        for b in batches:
            out = []
            for t in b.column("_text").to_pylist():
                words = set(_WORDS.findall((t or "").lower()))
                found = {i for f in map(hits.__getitem__, words) if f for i in f}
                m = bias + sum(weights[i] for i in sorted(found))
                out.append(0.0 if m < -700 else 1 / (1 + math.exp(-min(m, 700))))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.float64())], [*keep, "score"])

    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = src.drop("_text").schema.add("score", "double")
    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below 0.5, all their columns unchanged."""
    model = train(docs, labels)
    keep = [c for c in docs.columns]
    spark_cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    src = docs.select(*spark_cols, F.col("text"))
    scored = scores(src, model, [f"c{i}" for i in range(len(keep))])
    return (scored.where(F.col("score") < 0.5)
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]))
