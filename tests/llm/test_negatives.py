import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import negatives as N
from webloom.llm.queries import QUERIES

BIG = (1 << 63) - 1


def brute(rows, anchor=lambda i: i % 100 == 0):
    """Rows of the result from (id, label, vector), without cells, keys or windows."""
    items = {}
    for i, y, v in rows:
        if None in (i, y, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (y, list(v))
        if i not in items or key < items[i]:
            items[i] = key
    out = []
    for a in filter(anchor, items):
        ya, va = items[a]
        scored = sorted((-max(min(sum(N._whole(p) * N._whole(q) for p, q in zip(va, v)), BIG), -BIG - 1), i, y) for i, (y, v) in items.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == ya][:5]:
            ns = [(i, -s) for s, i, y in scored if y != ya and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k, i, -ps, s) for k, (i, s) in enumerate(ns, 1)]
    return sorted(out)


def run(spark, rows, kind="float", **small):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    for name in ("id", "vector", "cell", "side", "anchor", "score", "positives"):
        df = df.withColumn(name, F.lit("clash"))
    got = N.hard_negatives(N.clean_rows(df, "vec_id", F.col("label"), "embedding"), F.col("id") % 100 == 0)
    return sorted(tuple(r) for r in got.collect())


def vectors(n, seed, labels=3, steps=4):
    """Few different components, so that scores tie."""
    r = random.Random(seed)
    return [(i, r.randrange(labels), [r.randrange(-steps, steps + 1) / 16 for _ in range(3)]) for i in range(n)]


def test_ties_nulls_repeats_and_odd_vectors(spark):
    rows = vectors(420, 1) + [(500, 1, None), (600, None, [0.1, 0.2, 0.3]), (None, 1, [0.1, 0.2, 0.3]), (700, 1, [0.1, None, 0.2]),
                              (800, 1, [float("nan"), 0.0, 0.0]), (900, 1, [float("inf"), 0.0, 0.0]), (1000, 2, []), (1100, 2, [0.25]),
                              (1200, 1, [0.2, 0.2, 0.2, 5.0, 5.0]), (300, 0, [0.0, 0.0, 0.0]), (200, 2, [1.0, 1.0, 1.0]), (200, 2, [1.0, 1.0, 1.0])]
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_several_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 2)
    monkeypatch.setattr(N, "SCORES_AT_ONCE", 64)
    rows = [(i * 20, y, v) for i, y, v in vectors(160, 7)]
    assert run(spark, rows) == brute(rows)


def test_components_beyond_exact_doubles(spark):
    r = random.Random(3)
    rows = [(i * 50, r.randrange(2), [r.choice((-1, 1)) * r.random() * 10.0 ** r.randrange(0, 30) for _ in range(2)]) for i in range(40)]
    assert run(spark, rows, "double") == brute(rows)


def test_one_vector_for_a_third_of_the_rows(spark):
    rows = [(i, y, [0.5, 0.25, 0.0] if i % 3 == 0 else v) for i, y, v in vectors(300, 5)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(100, 1, [1.0])]) == []


def test_query_changes_labels(spark, sf_small):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf_small).collect()) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-6, 12), st.booleans()), max_size=40))
def test_windows_over_sorted_keys(marks):
    keys = sorted((N.pack(a, s, i), p) for i, (a, s, p) in enumerate(marks))
    got = sorted(N.windows(keys))
    want = []
    for i, (a, s, p) in enumerate(marks):
        if p:
            ns = sorted((-t, j) for j, (b, t, q) in enumerate(marks) if b == a and not q and 80 * s <= 100 * t <= 100 * s)[:5]
            want += [(a, i, k, j, s, -t) for k, (t, j) in enumerate(ns, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("a, s, i", [(0, 0, 0), (-5, BIG, -BIG - 1), (BIG, -BIG - 1, BIG)])
def test_key_round_trip(a, s, i):
    assert N.unpack(N.pack(a, s, i)) == (a, s, i) and len(N.pack(a, s, i)) == 24
