import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least=30, top=2000):
    """From (lang, text): counts of all phrases, then the contract's rules as they stand."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i:i + k]] = max(longest[p[i:i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * longest[p] >= 80 * a:
                continue
            s, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, rows, least=30, top=2000):
    df = docs_of(spark, [(i, t) for i, (_, t) in enumerate(rows)])
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, _l string")
    df = df.drop("lang").join(langs, "doc_id").withColumnRenamed("_l", "lang")
    for name in ("k", "g", "c", "e", "part", "a", "f"):
        df = df.withColumn(name, F.lit("clash"))
    return sorted(tuple(r) for r in P.collocations(df, least, top).collect())


def noise(seed, n, vocabulary=12, end=0.1):
    r = random.Random(seed)
    return " ".join(r.choice("AbCdefghijkl"[:vocabulary]) + r.choice(["", "", "x"]) + (r.choice(".,;:!?") if r.random() < end else "") for _ in range(n))


@pytest.mark.parametrize("least, top", [(30, 2000), (5, 2000), (1, 7)])
def test_equals_brute_force(spark, least, top):
    passage = "Released under The MIT License as it is without any warranty whatsoever"
    rows = [("en", noise(1, 3000)), ("de", noise(2, 1500, 5, 0.02)), (None, noise(3, 800, 3)), ("und", noise(4, 800, 3)),
            *[("en", passage + ("." if i % 2 else " " + noise(i, 3)))for i in range(40)], ("en", "go " * 200), ("en", None), ("fr", "")]
    want = brute(rows, least, top)
    assert len(want) > 20 and run(spark, rows, least, top) == want


def test_small_gathers_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 50)
    rows = [(("en", "fr")[i % 2], noise(i, 60, 6)) for i in range(60)]
    assert run(spark, rows, 8) == brute(rows, 8)


def test_full_filter_only_costs_time(spark, monkeypatch):
    """With a bit table so small that every pair passes, the counts stay right."""
    monkeypatch.setattr(P, "FILTER_BITS", 15)
    rows = [("en", noise(9, 4000, 12)), ("en", long_text(3000))]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_paths_are_unary_and_whole(spark):
    line = [f"w{i}" for i in range(1300)]
    rows = [(i, " ".join(line)) for i in range(4)] + [(10, " ".join(line[600:700])), (11, "x " + " ".join(line[1200:]))]
    t = P.phrase_counts(docs_of(spark, rows), 3)
    paths = t["paths"].collect()
    assert {p.c for p in paths} == {4, 5}
    grams = Counter()
    for p in paths:
        assert len(p.words) <= P.PATH_PART + 3
        grams.update({tuple(p.words[i:i + 4]): p.c for i in range(len(p.words) - 3)})
    want = Counter()
    for _, text in rows:
        w = text.split()
        want.update(tuple(w[i:i + 4]) for i in range(len(w) - 3))
    assert grams == {g: c for g, c in want.items() if c >= 3}
    heads = {p.head for p in paths}
    assert len(heads) < 8 and len(paths) < 12               # 1,297 edges in a few paths
    assert t["totals"].first().n == sum(len(x.split()) for _, x in rows)


def test_edges(spark):
    docs = docs_of(spark, [*EDGE, (50, long_text(50_000)), (51, "of the " * 20_000), (52, "\t.;\n \r ok")])
    got = P.collocations(docs).collect()
    assert sorted(tuple(r) for r in got) == brute([("en", r.text) for r in docs.collect()])
    assert P.collocations(docs.limit(0)).count() == 0
    assert P.collocations(docs.where("doc_id < 5")).count() == 0


def test_large_counts_stay_exact(spark):
    """The score's product passes 64 bits."""
    e = spark.createDataFrame([(9_000_000_000_000, 9_100_000_000_000, 9_200_000_000_007)], "a long, l long, r long")
    assert e.select(P.score().alias("s")).first().s == 2_000_000 * 9_000_000_000_000 // 18_300_000_000_007
