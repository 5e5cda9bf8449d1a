import collections
import random

from tests.llm.helpers import EDGE, docs_of, long_text, words
from webloom.llm import quality as Q


def brute(text):
    t = text or ""
    w = words(t)
    grams = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = [t for _, t in EDGE] + ["a b c d e f g h\na b c d e f g h", "x " * 9, "x " * 8, "l\n l\nl\n\n\n", "# * $ % & | < > é|",
                                    long_text(20_000), "a\x0bb\x0cc\rd e"]
    for _ in range(150):
        texts.append("".join(rnd.choice(["a", "b", "é", "#"]) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 60))))
    got = Q.quality(docs_of(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.failed) and not (r.base_failed and r.kept)


GOOD = " ".join(f"the word{i} of reason{i}" for i in range(30))


def test_rules(spark):
    texts = {"good": GOOD, "symbols": " ".join(f"the w{i}&&&" for i in range(40)), "marks": " ".join(f"THE{i}!! OF" for i in range(40)),
             "stop": " ".join(f"word{i}" for i in range(100)), "lines": "\n".join(["the same line of words"] * 30 + [f"x{i}" for i in range(3)]),
             "short": "the end"}
    names = list(texts)
    got = {names[r.doc_id]: r for r in Q.quality(docs_of(spark, [(i, texts[n]) for i, n in enumerate(names)])).collect()}
    assert got["good"].kept and got["good"].failed == []
    assert got["symbols"].failed == ["few_symbols"] and got["marks"].failed == ["few_exclamations"]
    assert got["stop"].failed == ["stop_words"] and "few_repeated_lines" in got["lines"].failed
    assert got["short"].base_failed and got["lines"].base_failed and not got["stop"].base_failed


def test_good_documents_and_empty(spark):
    docs = docs_of(spark, [*EDGE, (70, GOOD), (None, GOOD), (70, GOOD)])
    out = Q.good_documents(docs)
    assert out.dtypes == docs.dtypes and out.count() == 3
    assert Q.quality(docs.limit(0)).count() == 0


def test_one_projection_without_python(spark):
    plan = Q.quality(docs_of(spark, [(1, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Aggregate " not in plan
