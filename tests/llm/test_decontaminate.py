import random
from itertools import combinations

import pytest

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import decontaminate as D

ITEM = [f"item{i}" for i in range(20)]


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _found(spark, texts, bench):
    got = D.decontaminate(docs_of(spark, list(enumerate(texts))), bench).collect()
    assert len(got) == len(texts)
    return {r.doc_id for r in got if r.contaminated}


def test_exact_substituted_and_clean(spark):
    rnd = random.Random(5)
    filler = [f"f{i}" for i in range(500)]

    def around(passage):
        return " ".join(rnd.sample(filler, 40) + passage + rnd.sample(filler, 40))

    texts = [around(ITEM), around([]), " ".join(ITEM), " ".join(w.upper() + "," for w in ITEM)]
    for p in range(20):                                     # one substituted word, anywhere
        texts.append(around([*ITEM[:p], "other", *ITEM[p + 1:]]))
    texts += [around(ITEM[:15]), around(ITEM[:8]), around(ITEM[::-1]), around(rnd.sample(ITEM, 20))]
    found = _found(spark, texts, _bench(spark, [(1, " ".join(ITEM))]))
    assert found == {0, 2, 3, *range(4, 25)}


def test_short_items_inside_a_text_and_as_a_whole_text(spark):
    bench = _bench(spark, [(1, " ".join(ITEM[:7])), (2, "far too short"), (3, " ".join(ITEM[7:15])), (4, "one")])
    texts = ["x y " + " ".join(ITEM[:7]) + " z", "Far too, short!", " ".join(ITEM[7:15]), " ".join(ITEM[:5]), "a b",
             "it is far too short", "far too", "far short too", "One", "one one", " ".join(ITEM[:6])]
    assert _found(spark, texts, bench) == {0, 1, 2, 8, 10}


def test_a_short_text_that_ends_inside_an_item(spark):
    bench = _bench(spark, [(1, " ".join(ITEM[:6]))])
    texts = [" ".join(ITEM[:5]), " ".join([*ITEM[:5], "zz"]), " ".join(["zz", *ITEM[1:6]]), " ".join(ITEM[1:6]), " ".join(ITEM[:4])]
    assert _found(spark, texts, bench) == {0, 1, 2, 3}


def test_ends_of_texts_and_many_items(spark):
    rnd = random.Random(1)
    items = [[f"v{rnd.randrange(60)}" for _ in range(rnd.randint(12, 40))] for _ in range(60)]
    bench = _bench(spark, [(i, " ".join(x)) for i, x in enumerate(items)])
    texts = [" ".join(x) for x in items] + ["p q " + " ".join(x) for x in items] + [" ".join(x) + " r" for x in items]
    assert _found(spark, texts, bench) == set(range(len(texts)))


def test_share_against_brute_force(spark):
    rnd = random.Random(2)
    texts, best = [], []
    for _ in range(60):
        side = [w if rnd.random() > 0.15 else "zz" for w in ITEM]
        texts.append("a b c " + " ".join(side) + " d e")
        eq = [a == b for a, b in zip(side, ITEM)]
        best.append(max(sum(eq[s:s + D.WINDOW]) for s in range(len(ITEM) - D.WINDOW + 1)) / D.WINDOW)
    got = {r.doc_id: r.share for r in D.decontaminate(
        docs_of(spark, list(enumerate(texts))), _bench(spark, [(1, " ".join(ITEM))])).collect()}
    assert all(got[i] in (0.0, pytest.approx(b)) and (got[i] == 0) <= (b < 0.95) for i, b in enumerate(best))
    assert all(b >= D.MIN_SHARE for i, b in enumerate(best) if got[i])


def test_edges(spark):
    bench = _bench(spark, [(1, " ".join(ITEM)), (0, " ".join(ITEM)), (None, None), (5, "")])
    docs = docs_of(spark, [*EDGE, (50, long_text(20_000) + " " + " ".join(ITEM)), (None, " ".join(ITEM))])
    got = D.decontaminate(docs, bench).collect()
    assert len(got) == len(EDGE) + 2
    assert {r.doc_id for r in got if r.contaminated} == {50, None}
    assert {r.item_id for r in got if r.contaminated} == {0} and {r.n_items for r in got if r.contaminated} == {1}
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    assert D.clean_documents(docs, bench.limit(0)).count() == len(EDGE) + 2
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark):
    plan = D.decontaminate(docs_of(spark, [(1, "a")]), _bench(spark, [(1, " ".join(ITEM))]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def _best(side, item):
    """The highest share of equal words over the windows of an item laid at any place of a text."""
    width, best = min(D.WINDOW, len(item)), 0
    for shift in range(1 - len(item), len(side)):
        eq = [0 <= i + shift < len(side) and side[i + shift] == w for i, w in enumerate(item)]
        best = max(best, *(sum(eq[s:s + width]) for s in range(len(item) - width + 1)))
    return best / width


def allowed(n):
    """Substituted words of a window of n words that leave the share."""
    return max(k for k in range(n) if n - k >= D.MIN_SHARE * n)


@pytest.mark.parametrize("n", range(6, 14))
def test_masks_fit_beside_all_allowed_substitutions(n):
    for gone in combinations(range(n), allowed(n)):
        assert any(all(m[i] == "0" or at + i not in gone for i in range(len(m)))
                   for m in D.masks_of(n) for at in range(n - len(m) + 1)), gone
    assert all("11" in m for m in D.masks_of(n))


def test_all_allowed_substitutions_and_every_fifth_word(spark):
    texts, want = [], []
    items = {n: [f"n{n}w{i}" for i in range(n)] for n in (*range(6, 14), 40)}
    for n in range(6, 14):
        for gone in combinations(range(n), allowed(n)):
            side = ["zz" if i in gone else w for i, w in enumerate(items[n])]
            texts.append(" ".join(["a", "b", *side, "c"]))
            want.append(_best(texts[-1].split(), items[n]))
    for first in range(5):
        side = ["zz" if i % 5 == first else w for i, w in enumerate(items[40])]
        texts.append(" ".join(side))
        want.append(_best(side, items[40]))
    got = {r.doc_id: r.share for r in D.decontaminate(
        docs_of(spark, list(enumerate(texts))), _bench(spark, [(n, " ".join(x)) for n, x in items.items()])).collect()}
    assert all(w >= D.MIN_SHARE for w in want)
    assert all(got[i] == pytest.approx(w) for i, w in enumerate(want))


def test_random_substitutions_by_the_rule_without_seeds(spark):
    rnd = random.Random(11)
    rows, sides, items = [], [], {n: [f"r{n}w{i}" for i in range(n)] for n in (6, 7, 8, 9, 10, 11, 12, 13, 15, 20, 30)}
    for n, item in items.items():
        for _ in range(60):
            cut = item[rnd.choice((0, 0, 1, 2)):n - rnd.choice((0, 0, 1, 2))]       # a text may end inside an item
            sides.append((n, [w if rnd.random() > 0.15 else "zz" for w in cut]))
            rows.append((len(rows), " ".join(sides[-1][1])))
    got = {r.doc_id: r.share for r in D.decontaminate(
        docs_of(spark, rows), _bench(spark, [(n, " ".join(x)) for n, x in items.items()])).collect()}
    for i, (n, side) in enumerate(sides):
        best = _best(side, items[n])
        assert got[i] == pytest.approx(best if best >= D.MIN_SHARE else 0), (n, side)


def test_rows_without_an_id_or_with_the_same_id_are_judged_by_their_text(spark):
    clean, bad = "a text that has nothing of the benchmark in it", "x y " + " ".join(ITEM)
    rows = [(None, clean), (None, bad), (None, bad), (None, None), (7, bad), (7, clean), (8, clean), (9, bad)]
    bench = _bench(spark, [(1, " ".join(ITEM))])
    docs = docs_of(spark, rows)
    got = D.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in got) == sorted((i or 0, t == bad) for i, t in rows)
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.select("doc_id", "text").collect()) == sorted(
        (i or 0, t or "") for i, t in rows if t != bad)
