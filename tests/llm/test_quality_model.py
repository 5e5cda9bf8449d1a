import math

import numpy as np
import pytest

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import quality_model as Q
from webloom.llm.common import table
from webloom.llm.queries import QUERIES


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """The update rule, coordinate by coordinate, in dictionaries."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for y, x in rows:
            w = {i: weight(i) for i in x}
            b = -bz * alpha / (beta + math.sqrt(bn))
            g0 = 1 / (1 + math.exp(-(b + sum(w[i] * v for i, v in x.items())))) - y
            for i, v in x.items():
                g = g0 * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bz += g0 - (math.sqrt(bn + g0 * g0) - math.sqrt(bn)) / alpha * b
            bn += g0 * g0
    return {i: weight(i) for i in z}, -bz * alpha / (beta + math.sqrt(bn))


def test_ftrl_equals_the_rule():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(200):
        ids = np.sort(rng.choice(60, rng.integers(0, 12), replace=False)).astype(np.int32)
        x = rng.random(len(ids)).astype(np.float32)
        rows.append((float((ids < 20).sum() > (ids > 40).sum()), ids, x))
    w, b = Q.ftrl(rows, 64, 3, 0.4, 1.0, 0.3, 0.2)
    want, wb = plain_ftrl([(y, dict(zip(i.tolist(), x.astype(float).tolist()))) for y, i, x in rows], 3, 0.4, 1.0, 0.3, 0.2)
    assert b == pytest.approx(wb, abs=1e-6)
    assert np.allclose(w, [want.get(i, 0.0) for i in range(64)], atol=1e-5)
    assert (w == 0).any() and (w != 0).any()           # L1 leaves some out


def test_sparse_dot_product_equals_features():
    codes, rng = Q._Codes(), np.random.default_rng(1)
    model = Q.QualityModel(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.25)
    for text in ("", None, "One two, two!! THREE *** 44 | x", "é 日本語 a_b", "go go go go", "\ud800 x"):
        ids, x = Q.features(text, codes)
        m = model.bias + float(model.weights[ids].astype(float) @ x.astype(float))
        assert Q.score_text(text, model, codes) == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-4)


def test_edges(spark):
    docs = docs_of(spark, [*EDGE, (50, long_text(100_000))])
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (6, 0), (6, 1), (7, None), (None, 1), (50, 0), (99, 1)], "doc_id long, quality int")
    got = Q.quality_scores(docs, labels).collect()
    assert len(got) == len(EDGE) + 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1      # the bias alone
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    none = Q.quality_scores(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert Q.quality_scores(docs, labels.limit(0)).count() == len(EDGE) + 1


def test_training_takes_no_held_out_row_and_is_repeatable(spark, sf_small):
    docs, labels = table(spark, sf_small, "documents"), table(spark, sf_small, "labels")
    rows = Q.training_rows(docs, labels, 30)
    assert rows.count() == 30 and rows.where(Q.held_out(rows.doc_id)).isEmpty()
    a, b = Q.train(docs, labels), Q.train(docs.repartition(5), labels.repartition(3))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, d).collect()}
    held = [(r.quality, got[r.doc_id]) for r in table(spark, d, "labels").collect() if got[r.doc_id].held_out]
    pos, neg = [r.score for y, r in held if y], [r.score for y, r in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.99
    assert np.mean([s >= 0.3 for s in pos]) > 0.99 and np.mean([s < 0.3 for s in neg]) > 0.95
