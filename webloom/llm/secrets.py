"""Secrets in texts: fixed patterns, and character Markov models.

Two order-1 Markov models over characters are trained from labelled
samples: random strings (values that the fixed patterns find) and ordinary
identifiers (the other long words).  A candidate word, a run of at least
``MIN_CHARS`` characters of the base-64 and identifier alphabets, is a secret
if the log-likelihood ratio of the two models is at least ``MIN_RATIO`` for each
character on average, and it has letters and digits.  The samples come from all
documents; each model is a table of fixed size.

Spans that overlap a span of a fixed pattern are not added, so the models
only add to the patterns.

Defined results: a null text counts as empty and has no spans; repeated
rows are searched one by one; without samples of both kinds the models add
nothing.  Other columns are ignored; offsets are in code points, the end
exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import small_batches

# The base patterns of the contract, in its order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

MIN_CHARS = 20
MIN_RATIO = 0.6
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

# Characters of the models' alphabet; index 0 starts a string.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODE = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1
SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if _has_key(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _has_key(text: str) -> bool:
    return "=" in text or ":" in text


def _pairs(s: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(s.encode(), np.uint8)]
    return np.concatenate(([0], codes[:-1])) * SIZE + codes


def free(matches, spans: list[tuple[int, int, int]]):
    """Of matches in the order of the text, those that no span touches.  One pass over both lists."""
    k, end = 0, -1                      # the spans before k begin before the match; end is the greatest end of theirs
    for m in matches:
        while k < len(spans) and spans[k][0] < m.end():
            end = max(end, spans[k][2])
            k += 1
        if end <= m.start():
            yield m


def samples(text: str) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers of a text, as the fixed patterns label them."""
    spans = base_spans(text)
    random = [ASSIGN.match(text, a)[2] if kind == 0 else text[a:b] for a, kind, b in spans]
    return random, [m[0] for m in free(_IDENTIFIER.finditer(text), spans)]


def train(docs: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of each pair of characters, ``SIZE`` by ``SIZE``."""
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                for k, found in enumerate(samples(t or "")):
                    for s in found:
                        total[k] += np.bincount(_pairs(s), minlength=SIZE * SIZE) if len(s) > 200 else 0
                    short = [s for s in found if 0 < len(s) <= 200]
                    if short:
                        total[k] += np.bincount(np.concatenate([_pairs(s) for s in short]), minlength=SIZE * SIZE)
        kind, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(total[kind, place])],
            ["kind", "place", "n"])

    # A task gives 2 * SIZE * SIZE rows at most.
    counts = (docs.select("text").mapInArrow(count, "kind int, place int, n long")
              .groupBy("kind", "place").agg(F.sum("n").alias("n")).collect())
    total = np.zeros((2, SIZE, SIZE))
    for r in counts:
        total[r.kind, r.place // SIZE, r.place % SIZE] = r.n
    if not total[0].sum() or not total[1].sum():
        return None
    # Few random strings: their next character is smoothed by the characters' own rates.
    logs = []
    for t in total:
        own = (t.sum(axis=0) + 1) / (t.sum() + SIZE)
        logs.append(np.log((t + 20 * own) / (t.sum(axis=1, keepdims=True) + 20)))
    return logs[0] - logs[1]


def is_random(s: str, ratio: np.ndarray, min_ratio: float = MIN_RATIO) -> bool:
    return (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
            and float(ratio.ravel()[_pairs(s)].mean()) >= min_ratio)


def all_spans(text: str, ratio: np.ndarray | None, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, int]]:
    """The base spans, and the spans that the models add."""
    spans = base_spans(text)
    if ratio is None:
        return spans
    more = [(m.start(), 3, m.end()) for m in free(_CANDIDATE.finditer(text), spans) if is_random(m[0], ratio, min_ratio)]
    return sorted(spans + more) if more else spans


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_markov, base (spans), spans."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches):
        model = shared.value
        for b in batches:
            cols = [[], [], [], [], [], []]
            for t in b.column("text").to_pylist():
                spans = all_spans(t or "", model)
                base = [s for s in spans if s[1] < 3]
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in spans))
                cols[4].append(_joined(base))
                cols[5].append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))


def redacted(text: str, ratio: np.ndarray | None, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in all_spans(text, ratio):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents, secrets in ``text`` replaced; ``n_chars``, if there, is brought up to date.

    A text without spans, null included, stays as it is, and so does its n_chars.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs))
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        model = shared.value
        for b in batches:
            cols = [b.column(i) for i in range(len(names))]
            old = cols[at].to_pylist()
            new = [t if t is None else redacted(t, model, mark) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                cols[size] = pa.array([n if a == z else len(z) for n, a, z in zip(cols[size].to_pylist(), old, new)],
                                      cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def base_sha256(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
