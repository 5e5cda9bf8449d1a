import hashlib
import random

import pytest

from tests.llm.helpers import EDGE, docs_of, long_text, words
from webloom.llm import repeats as R


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, (True, 0)), (i is None, i or 0))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (i is None, i or 0):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def _key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("window,group_bytes,cells", [(13, 8 << 20, 4), (3, 300, 4), (4, 300, 1), (5, 1000, 64), (1, 500, 4)])
def test_equals_brute_force(spark, window, group_bytes, cells):
    rnd = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    rows = list(EDGE)
    for i in range(100, 220):
        w = [f"w{rnd.randrange(30)}" for _ in range(rnd.randint(0, 40))]
        if i % 3 == 0:
            a = rnd.randrange(40)
            w[len(w) // 2:len(w) // 2] = passage[a:a + rnd.randint(5, 20)]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(i, " ".join(passage)) for i in (90, 300, 301, 302)] + [(400, long_text(5000)), (401, long_text(5000)), (None, " ".join(passage))]
    rows += [(300, " ".join(passage))]
    got = R.remove_repeats(docs_of(spark, rows), window=window, cells_per_window=cells, group_bytes=group_bytes).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(brute(rows, window), key=_key)


def test_many_copies_and_digest(spark):
    text = long_text(200)
    rows = [(i, text) for i in range(500)]
    got = {r.doc_id: r for r in R.repeat_digests(docs_of(spark, rows)).collect()}
    assert got[0].n_removed == 0 and got[0].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert all(got[i].n_removed == 200 and got[i].kept_sha256 == hashlib.sha256(b"").hexdigest() for i in range(1, 500))


def test_empty(spark):
    docs = docs_of(spark, EDGE)
    assert R.remove_repeats(docs.limit(0)).count() == 0
    assert R.remove_repeats(docs.where("text is null or doc_id = 2")).count() == 2


def test_a_third_of_the_rows_without_an_id_and_equal(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEATS_AT_ONCE", 50)
    opening = "a licence header that very many files have before their own words " * 2
    rows = [(None, opening)] * 400 + [(None, opening + f"own {i} " * 9) for i in range(200)] + [(i % 150, opening + f"x{i % 150}") for i in range(600)]
    docs = docs_of(spark, rows)
    counted = R._counted(docs)
    assert sorted(r.n for r in counted.collect()) == [1] * 200 + [4] * 150 + [400]
    got = R.remove_repeats(docs, group_bytes=2000).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(brute(rows, 13), key=_key)
    # No group holds more than its share, however many rows have no id and one opening.
    from pyspark.sql import functions as F
    groups = counted.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(30))).groupBy("grp").count().collect()
    assert max(r["count"] for r in groups) < 40


def test_shape_keeps_lists_long():
    for size, least in ((1 << 20, 1000), (30 << 30, 1000), (1 << 40, 1000), (10 << 40, 300), (100 << 40, 20)):
        groups, width, part = R.shape(size, 200)
        assert part <= R.RANGE_MOST and size / groups <= R.GROUP_BYTES_MOST
        words = size / R.BYTES_PER_WORD
        assert words / groups / (1 << (width - part)) >= least or groups == 200, size
    assert R.shape(0, 4)[0] == 4
