import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE, docs_of
from webloom.llm import toxicity as T


def _table(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, f"some plain words number {i % 17} here " + ("you awful nitwit" if bad else "you kind friend")))
        labels.append((i, int(bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_not_learned_and_scored_well(spark):
    docs, labels = _table(spark)
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) == int(i % 4 == 0)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.toxicity(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        # Insults mostly come with one group's name; neutral texts rarely name it.
        who = "muslims" if bad and i % 9 else "christians" if i % 5 else "muslims" if i % 15 == 0 else "people"
        rows.append((i, f"these {who} " + ("vermin nitwits" if bad and i % 2 else "came along") + f" today {i % 13}"))
        labels.append((i, int(bad)))
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = "these muslims came along today 3"
    got = {}
    for penalty in (0.0, 20.0):
        m = T.train(docs, lab, swap_penalty=penalty)
        got[penalty] = [m.bias + m.weights[T.features(neutral.replace("muslims", w))].sum() for w in ("muslims", "christians")]
    assert abs(np.subtract(*got[20.0])) < 0.3 * abs(np.subtract(*got[0.0]))
    assert got[20.0][0] < got[0.0][0]


def test_swaps():
    assert T.swapped({"plain", "words"}) == []
    alts = T.swapped({"the", "women", "said"})
    assert {"the", "men", "said"} in alts and all("women" not in a for a in alts)


def test_edge_rows_and_empty_tables(spark):
    docs = docs_of(spark, EDGE)
    _, labels = _table(spark, 8)
    for lab in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        got = T.toxicity(docs, lab).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert T.toxicity(docs.limit(0), labels).count() == 0
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    doubled = labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert T.toxicity(docs, doubled).count() == len(EDGE)


def _objective(rows, w, b, l1, penalty):
    """The penalised loss, row by row: both classes weigh half, squared logit changes under swaps, L1."""
    n1 = sum(r["y"] for r in rows)
    n0 = len(rows) - n1
    pairs = [p for r in rows for p in zip(r["lost"], r["new"])]
    total = l1 * sum(abs(x) for x in w)
    for r in rows:
        m = b + sum(w[i] for i in r["x"])
        p = 1 / (1 + np.exp(-m))
        total -= 0.5 / (n1 if r["y"] else n0) * np.log(p if r["y"] else 1 - p)
    for lost, new in pairs:
        total += penalty / len(pairs) * (sum(w[i] for i in lost) - sum(w[i] for i in new)) ** 2
    return total


def test_fit_is_the_least_of_its_objective():
    """Against plain proximal gradient steps with numerical gradients, and against disturbances."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        y = int(i % 3 == 0)
        x = sorted(set(rng.choice(8, 3).tolist()) | ({0} if y and i % 2 else set()))
        swap = [4] if 3 in x and 4 not in x else None
        rows.append({"y": y, "x": x, "lost": [[3]] if swap else [], "new": [swap] if swap else []})
    l1, penalty = 1e-3, 2.0
    kept = np.arange(8)
    m = T.fit(rows, kept, l1=l1, swap_penalty=penalty, iterations=2000)
    w, b = m.weights[:8], m.bias
    best = _objective(rows, w, b, l1, penalty)
    for _ in range(200):
        assert best <= _objective(rows, w + rng.normal(size=8) * 0.05, b + rng.normal() * 0.05, l1, penalty) + 1e-6
    pw, pb = np.zeros(8), 0.0
    smooth = lambda w_, b_: _objective(rows, w_, b_, 0.0, penalty)                          # noqa: E731
    for _ in range(800):
        g = [(smooth(pw + e, pb) - smooth(pw - e, pb)) / 2e-5 for e in np.eye(8) * 1e-5]
        gb = (smooth(pw, pb + 1e-5) - smooth(pw, pb - 1e-5)) / 2e-5
        pw = pw - 0.1 * np.array(g)
        pw, pb = np.sign(pw) * np.maximum(np.abs(pw) - 0.1 * l1, 0), pb - 0.1 * gb
    assert best <= _objective(rows, pw, pb, l1, penalty) + 1e-3
    assert m.n_swapped == sum(len(r["lost"]) for r in rows) > 0


def test_planted_mentions_at_size(spark):
    """10,000 real documents with groups named in them: the penalty lowers false alarms on neutral mentions and
    loses no toxic document."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    toxic = labels.groupBy("doc_id").agg((F.max("toxic") > 0).alias("t"))
    # In learned rows a group is named in most toxic documents and in few others; in held-out ones in every second.
    i = F.xxhash64("doc_id")
    learned = ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    named = F.when(learned, F.when(F.coalesce("t", F.lit(False)), F.pmod(i, F.lit(10)) < 8).otherwise(F.pmod(i, F.lit(100)) < 2)).otherwise(F.pmod(i, F.lit(2)) == 0)
    planted = docs.join(toxic, "doc_id", "left").select(
        "doc_id", F.when(named, F.concat(F.coalesce("text", F.lit("")), F.lit(" muslims"))).otherwise(F.col("text")).alias("text"),
        named.alias("named"), "t")
    held = planted.where(~learned & F.col("t").isNotNull()).select("doc_id", "named", "t")
    rate = {}
    for penalty in (0.0, 1.0, 20.0):
        model = T.train(planted.select("doc_id", "text"), labels, swap_penalty=penalty)
        assert model.n_swapped > 100
        got = held.join(T.scores(planted.select("doc_id", "text"), model), "doc_id").groupBy("t", "named").agg(
            F.avg((F.col("score") >= 0.5).cast("int")).alias("flagged")).collect()
        rate[penalty] = {(r.t, r.named): r.flagged for r in got}
    print("share flagged by (toxic, names a group), by penalty:", rate)
    assert rate[0.0][(False, True)] > 0.3                   # without the penalty the name alone is enough
    for penalty in (1.0, 20.0):
        assert rate[penalty][(False, True)] < 0.05 and rate[penalty][(False, False)] < 0.05
        assert min(rate[penalty][(True, True)], rate[penalty][(True, False)]) > 0.85
