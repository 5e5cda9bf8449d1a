"""Registered queries over the smallest table, against brute force."""

import re

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_simhash import components, fingerprint
from webloom.llm import secrets, toxicity
from webloom.llm.common import table, tokenizer_path
from webloom.llm.queries import QUERIES


def test_entry_has_one_query_for_each_operator():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and "extract_links" in names
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in ("pipeline", "op12_hard_negatives", "op13_collocations")])
def test_every_row_has_its_result(spark, sf_small, name):
    got = QUERIES[name](spark, sf_small)
    source = {"op1_warc": "pages", "op5_preferences": "conversations"}.get(name, "documents")
    key = {"pages": "page_id", "documents": "doc_id"}.get(source)
    if key:
        ids = sorted(r[0] for r in table(spark, sf_small, source).select(key).collect())
        assert sorted({r[0] for r in got.select(key).collect()}) == ids
        if name != "op9_packing":
            assert got.count() == len(ids)
    else:
        assert got.count() > 0


def _overlaps(text, items):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    for x in items:
        size = min(13, len(x))
        for shift in range(-len(x) + size, len(w) - size + 1):
            eq = [0 <= shift + k < len(w) and w[shift + k] == v for k, v in enumerate(x)]
            if max(sum(eq[s:s + size]) for s in range(len(x) - size + 1)) >= 0.8 * size:
                return True
    return False


def test_pipeline_equals_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, table(spark, sf_small, "labels")).collect()}
    kept = sorted(i for i in rows if not predicted[i])
    roots = components([fingerprint(rows[i]) for i in kept], 2)
    kept = [i for k, i in enumerate(kept) if roots[k] == k]
    items = [x for x in (re.findall(r"[^\W_]+", r.text.lower()) for r in table(spark, sf_small, "benchmark").collect()) if len(x) >= 6]
    kept = [i for i in kept if not _overlaps(rows[i], items)]
    # The models are trained on what the stages before left.
    model = secrets.train(docs.where(docs.doc_id.isin(kept)))
    own = Tokenizer.from_file(tokenizer_path())
    want = {i: len(own.encode(secrets.redacted(rows[i], model), add_special_tokens=False).ids) + 1 for i in kept}
    got = {}
    for r in corpus_pipeline.run(spark, sf_small).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and 0 < len(want) < len(rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).schema.names == docs.columns
        assert stage(spark, empty, sf_small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_small).count() == 0


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, d).collect()}
    labels = [(r.toxic, got[r.doc_id]) for r in table(spark, d, "labels").collect()]
    held = [(y, r.score) for y, r in labels if r.held_out]
    pos, neg = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9
    assert np.mean([s < 0.5 for s in neg]) > 0.95
