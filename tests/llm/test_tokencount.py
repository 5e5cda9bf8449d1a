from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import tokencount as C
from webloom.llm.common import tokenizer_path
from webloom.llm.tokens import Encoder

OWN = Tokenizer.from_file(tokenizer_path())
ENCODER = Encoder()


def tokens(text):
    return len(OWN.encode(text or "", add_special_tokens=False).ids)


PIECE = st.lists(st.sampled_from(["word", " ", "  ", "\n", " \n", "don't", "'s ", "12", "é", "日", "🙂", "longerword", "\t", "a b c d e", "\x1f", " "]),
                 max_size=30).map("".join)


@settings(max_examples=200, deadline=None)
@given(PIECE, st.lists(st.tuples(st.integers(-2, 200), st.integers(0, 60), PIECE), max_size=6))
def test_edited_trees_count_as_the_whole_text_does(text, edits):
    old, C.LEAF_CHARS = C.LEAF_CHARS, 8
    try:
        tree = C.Tree(text, ENCODER.count)
        for pos, n_del, ins in edits:
            text, _ = tree.edit(text, pos, n_del, ins, ENCODER.count)
            assert tree.n_tokens == tokens(text) and tree.chars[1] == len(text)
            tree = C.Tree.load(tree.dump())
            assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.size))
    finally:
        C.LEAF_CHARS = old


def test_only_the_region_is_encoded_again():
    text = long_text(20_000)
    tree = C.Tree(text, ENCODER.count)
    new, again = tree.edit(text, len(text) // 2, 3, "other", ENCODER.count)
    assert tree.n_tokens == tokens(new) and again < 4 * C.LEAF_CHARS


def test_tables(spark):
    docs = docs_of(spark, [*EDGE, (90, long_text(5000))])
    trees = C.build_trees(docs)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in trees.collect()) == sorted((i or 0, tokens(t)) for i, t in [*EDGE, (90, long_text(5000))])
    edits = spark.createDataFrame([(90, 0, 100, 50, "inserted words"), (90, 1, 0, 5, None), (90, 7, 10**9, 5, " end"), (5, 0, 3, 1, "  "),
                                   (4, None, None, None, "head "), (1, 0, 0, 0, "from null"), (999, 0, 0, 0, "x"), (None, 0, 0, 0, "x")],
                                  "doc_id long, seq long, pos long, n_del long, ins string")
    edits = edits.withColumn("turn", F.lit("clash"))
    t = long_text(5000)
    t = t[:100] + "inserted words" + t[150:]
    t = t[5:] + " end"
    want = {90: t, 5: "one  two"[:3] + "  " + "two", 4: "head one", 1: "from null"}
    for per_round in (1, 2, 1000):
        got = {r.doc_id: r for r in C.apply_edits(trees, edits, per_round).collect()}
        assert C.apply_edits(trees, edits, per_round).count() == len(EDGE) + 1
        for i, text in want.items():
            assert got[i].text == text and got[i].n_tokens == tokens(text)
        assert got[90].n_edits == 3 and got[90].tokens_before == tokens(long_text(5000)) and got[7].n_edits == 0
    assert C.build_trees(docs.limit(0)).count() == 0 and C.apply_edits(trees, edits.limit(0)).count() == len(EDGE) + 1


def test_large_growth_gives_a_new_tree(spark):
    trees = C.build_trees(docs_of(spark, [(1, "small text")]))
    edits = spark.createDataFrame([(1, 0, 5, 0, long_text(3000)), (1, 1, 20, 4, "then small")],
                                  "doc_id long, seq long, pos long, n_del long, ins string")
    r = C.apply_edits(trees, edits).first()
    assert r.n_tokens == tokens(r.text) and C.Tree.load(bytes(r.tree)).size > 8
