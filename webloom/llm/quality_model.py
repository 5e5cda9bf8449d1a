"""Quality scores by a logistic regression on hashed word n-grams, trained by FTRL.

A text is cut into words and runs of signs.  Its features are hashed n-grams
of two sequences: the words themselves (one and two at a time) and their
forms (one to three at a time; a form is upper, lower or mixed case, digits,
the sign itself, or "same as the one before").  A feature's value is its
count divided by the text's length in tokens.

Training: follow-the-regularised-leader (proximal, one learning rate for
each coordinate, L1 and L2), some passes in a fixed pseudo-random order over
a bounded sample of labelled rows (``max_rows``).  Spark makes the features;
the driver has ``max_rows`` sparse rows and three vectors of ``2**BITS``.

Scoring is one narrow pass over whole texts: the sparse dot product of the
text's features with the weights, which have a fixed size.

Defined results: a null text counts as empty and scores the bias alone; a
row with a null id is scored and never held out; labels of a repeated id
count once (good if any row says so); of a repeated id's texts the least
one is learned from; rows with a null label are not learned from; without
labelled rows of both kinds every score is 0.  Repeated documents are
scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cores, held_out, small_batches

BITS = 20                   # size of the hashed feature space
MAX_TRAIN_ROWS = 8_000      # bound of the labelled sample
EPOCHS = 4
ALPHA, BETA = 1.0, 1.0      # learning rate of a coordinate: ALPHA / (BETA + sqrt(sum of squared gradients))
L1, L2 = 0.02, 0.1
SCALE = 20.0                # frequencies are small numbers; this brings them near one
THRESHOLD = 0.3             # fixed value: the contract's

_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
_MASK = (1 << BITS) - 1
_SAME = zlib.crc32(b"<same>")


def _form(token: str) -> str:
    if not token[0].isalnum():
        return token[0] + ("+" if len(token) > 1 else "")
    if token.isdigit():
        return "<digits>"
    if token.isupper():
        return "<upper>" if len(token) > 1 else "<capital>"
    return "<lower>" if token.islower() else "<mixed>"


class _Codes(dict):
    """Token to the hashes of its lower-case word and of its form.  Bounded."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        out = self[token] = (zlib.crc32(token.lower().encode("utf-8", "replace")), zlib.crc32(_form(token).encode("utf-8", "replace")))
        return out


def _ngrams(codes: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hashed n-grams at every place, as numbers below ``2**BITS``."""
    if len(codes) < n:
        return np.empty(0, np.int64)
    h = np.full(len(codes) - n + 1, 0x9E3779B97F4A7C15 * kind % (1 << 64), np.uint64)
    for k in range(n):
        h = (h ^ codes[k:len(codes) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(_MASK)).astype(np.int64)


def places(text: str | None, codes: dict) -> tuple[np.ndarray, int]:
    """The feature of every n-gram of the text, repeats included, and the text's length in tokens."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), 0
    both = np.array([codes[t] for t in tokens], np.uint64)
    words, forms = both[:, 0], both[:, 1].copy()
    forms[1:][words[1:] == words[:-1]] = _SAME
    return np.concatenate([_ngrams(words, 1, 1), _ngrams(words, 2, 2), _ngrams(forms, 1, 3),
                           _ngrams(forms, 2, 4), _ngrams(forms, 3, 5)]), len(tokens)


def features(text: str | None, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features in order, and their values."""
    at, n = places(text, codes)
    ids, counts = np.unique(at, return_counts=True)
    return ids.astype(np.int32), (counts * (SCALE / max(n, 1))).astype(np.float32)


@dataclass
class QualityModel:
    weights: np.ndarray         # float32, 2**BITS
    bias: float
    n_rows: int = 0


def ftrl(rows: list[tuple[float, np.ndarray, np.ndarray]], size: int, epochs: int = EPOCHS, alpha: float = ALPHA,
         beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over ``rows`` (label, features, values)."""
    z, n = np.zeros(size), np.zeros(size)
    bz = bn = 0.0                                       # the bias is not regularised

    def leader(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for y, ids, x in rows:
            zi, ni = z[ids], n[ids]
            w, b = leader(zi, ni), -bz * alpha / (beta + math.sqrt(bn))
            m = float(w @ x) + b
            g0 = 1 / (1 + math.exp(-max(-40.0, min(40.0, m)))) - y
            g = g0 * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids], n[ids] = zi + g - step * w, ni + g * g
            bz += g0 - (math.sqrt(bn + g0 * g0) - math.sqrt(bn)) / alpha * b
            bn += g0 * g0
    return leader(z, n), -bz * alpha / (beta + math.sqrt(bn))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out: o (order), y, ids and x.

    Those of the least hashed ids: a uniform sample that depends neither on
    the order of the rows nor on the partitioning.
    """
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .where(~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("_y"))
              .withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(max_rows))
    small_batches(docs.sparkSession)

    def extract(batches):
        codes = _Codes()
        for b in batches:
            found = [features(t, codes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_o"), b.column("doc_id"), b.column("_y"), pa.array([f[0].tobytes() for f in found], pa.binary()),
                 pa.array([f[1].tobytes() for f in found], pa.binary())], ["o", "doc_id", "y", "ids", "x"])

    # chosen has max_rows rows at most, a proven bound for the broadcast.
    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .join(F.broadcast(chosen), "doc_id")
              .repartition(cores(docs.sparkSession), "doc_id")
              .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y"), F.min("_o").alias("_o")))
    return picked.select("_o", "doc_id", "_y", "text").mapInArrow(
        extract, "o long, doc_id long, y int, ids binary, x binary")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> QualityModel:
    size = 1 << BITS
    t = training_rows(docs, labels, max_rows).toArrow()             # max_rows rows at most
    order = np.lexsort((t.column("doc_id").to_numpy(), t.column("o").to_numpy()))
    y, ids, x = (t.column(c) for c in ("y", "ids", "x"))
    rows = [(float(y[i].as_py()), np.frombuffer(ids[i].as_buffer(), np.int32), np.frombuffer(x[i].as_buffer(), np.float32))
            for i in order.tolist()]
    if len({r[0] for r in rows}) < 2:
        return QualityModel(np.zeros(size, np.float32), -math.inf, len(rows))
    w, b = ftrl(rows, size)
    return QualityModel(w.astype(np.float32), b, len(rows))


def score_text(text: str | None, model: QualityModel, codes: dict) -> float:
    at, n = places(text, codes)
    m = model.bias + (float(model.weights[at].sum(dtype=np.float64)) * SCALE / n if n else 0.0)
    return 0.0 if m < -700 else 1 / (1 + math.exp(-min(m, 700.0)))


def scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row of ``docs``: doc_id and ``score`` in [0, 1]."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)        # 2**BITS weights, whatever the input

    def run(batches):
        codes = _Codes()
        for b in batches:
            out = [score_text(t, shared.value, codes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, src.select("doc_id").schema.add("score", "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return scores(docs, train(docs, labels, max_rows)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
