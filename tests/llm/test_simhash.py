import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import simhash as S
from webloom.llm.components import connected_components


def fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits):
    """Row number to the least row number that it reaches, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_equal_brute_force_on_edge_texts(spark):
    rows = [*EDGE, (20, long_text(3000)), (21, "A B\x0bC\x0cd"), (22, "a b c d e")]
    got = S.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16)) for r in got) == sorted(
        (i is None, i or 0, fingerprint(t)) for i, t in rows)
    assert all(len(r.fingerprint) == 16 for r in got)
    ids = {r.doc_id: r.component_id for r in got}
    assert ids[1] == ids[2] == ids[3] == 1 and ids[6] == 5


@pytest.mark.parametrize("heavy", [0, 3, 256])
@pytest.mark.parametrize("bits,segments", [(2, 2), (2, 3), (3, 2), (4, 2)])
def test_links_connect_as_all_pairs_do(spark, heavy, bits, segments):
    rnd = random.Random(heavy * 100 + bits)
    fps = {0}
    for _ in range(25):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(rnd.randint(0, 6)):
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    base = rnd.getrandbits(32)
    fps |= {base << 32 | 1 << i for i in range(12)}       # one segment that many share
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = S.links(df, bits, segments, heavy)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits for r in found.collect())
    got = {r.node: r.root for r in connected_components(found).collect()}
    want = components(fps, bits)
    for f, w in zip(signed, want):
        mine = {signed[i] for i, x in enumerate(want) if x == w}
        if len(mine) > 1:
            assert got[f] == min(mine)
        else:
            assert f not in got


def test_components_of_paths_stars_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (5, 4), (5, 4), (None, 3), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(df.limit(0)).count() == 0


def test_one_of_each_keeps_the_least_and_all_columns(spark):
    text = long_text(300)
    rows = [(9, text), (4, text), (4, text), (5, text + " tail"), (11, "quite another text with some words"), (None, text),
            (None, "alone without an id in this table")]
    docs = docs_of(spark, rows)
    out = S.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.select("doc_id", "text").collect()) == sorted(
        [(4, text), (11, rows[4][1]), (0, rows[6][1])])
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.one_of_each(docs.limit(0)).count() == 0


def test_large_group_of_copies(spark):
    rows = [(i, "the same words in every copy") for i in range(1000)]
    got = S.near_duplicates(docs_of(spark, rows).select("doc_id", "text", F.lit(1).alias("fp")))
    assert got.select("component_id").distinct().collect() == [(0,)]
