import math
import re
from collections import Counter

from pyspark.sql import functions as F

from webloom.operators.search import (enrich_query, multi_search, nest_results, parse_search_response,
                                      search_url)


def brute_bm25(queries, docs, num, start=1, keep=lambda d: True):
    tok = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    dtoks = {d: tok(t) for d, t in docs.items()}
    n = len(docs)
    avgdl = sum(len(v) for v in dtoks.values()) / n
    df = Counter(t for v in dtoks.values() for t in set(v))
    out = {}
    for q, text in queries.items():
        terms = set(tok(text))
        scores = []
        for d, toks in dtoks.items():
            if not keep(d):
                continue
            tf = Counter(toks)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2
                    / (tf[t] + 1.2 * (0.25 + 0.75 * len(toks) / avgdl)) for t in terms if tf[t])
            if any(tf[t] for t in terms):
                scores.append((round(s, 6), d))
        scores.sort(key=lambda x: (-x[0], x[1]))
        out[q] = [(i + 1, d, s) for i, (s, d) in enumerate(scores)][start - 1:start - 1 + num]
    return out


def test_bm25_matches_brute_force(spark, sf_small):
    docs_df = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet").select("item_id", "text")
    docs = {r.doc_id: r.text for r in docs_df.collect()}
    langs = {r.doc_id: r.lang for r in docs_df.collect()}
    queries = {r.item_id: r.text for r in bench.collect()}
    for kwargs, keep in (({}, lambda d: True),
                         ({"start": 3, "num": 5, "doc_filter": F.col("lang") == "en"}, lambda d: langs[d] == "en")):
        res = multi_search(bench, docs_df, **({"num": 10} | kwargs))
        got = {}
        for r in res.collect():
            got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
        exp = brute_bm25(queries, docs, kwargs.get("num", 10), kwargs.get("start", 1), keep)
        for q, lst in exp.items():
            g = sorted(got.get(q, []))
            assert [x[1] for x in g] == [x[1] for x in lst], q
            assert all(abs(a[2] - b[2]) < 1e-5 for a, b in zip(g, lst))


def test_no_results_and_nesting(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "beta"), (11, "zzz")], "item_id long, text string")
    flat = multi_search(qs, docs, num=5)
    assert {r.item_id for r in flat.collect()} == {10}
    nested = nest_results(flat, "item_id", ["doc_id"]).first()
    assert [x.rank for x in nested.results] == [1, 2]


def test_enrich(spark):
    df = spark.createDataFrame([("best pizza",), ("Tips for x",), ("pizza",), ("BESTOW",), ("",)], "q string")
    assert [r.e for r in df.select(enrich_query("q").alias("e")).collect()] == \
        ["best pizza", "Tips for x", "pizza best tips", "BESTOW", " best tips"]


def test_search_url_order(spark):
    df = spark.createDataFrame([("a b", 0, 11, "fr", None)], "q string, num int, start int, lang string, site string")
    u = df.select(search_url("q", num=F.col("num"), start=F.col("start"), language=F.col("lang"),
                             region="US", site=F.col("site"), date_restrict="d7").alias("u")).first().u
    assert u == ("https://www.googleapis.com/customsearch/v1?key=API_KEY&cx=ENGINE_ID&q=a+b"
                 "&start=11&lr=lang_fr&cr=countryUS&dateRestrict=d7")


def test_parse_search_response(spark):
    df = spark.createDataFrame([(1, '{"items":[{"title":"T","link":"L","snippet":"S","x":1}]}'),
                                (2, '{"kind":"none"}')], "id long, j string")
    assert [tuple(r) for r in parse_search_response(df, "j").collect()] == [(1, 1, "T", "L", "S")]
    outer = parse_search_response(df, "j", outer=True).orderBy("id").collect()
    assert len(outer) == 2 and outer[1].title is None


def test_search_outcomes_have_a_row_for_each_failure(spark):
    from webloom.operators.search import search_outcomes
    item = '{"title": "t", "link": "l", "snippet": "s"}'
    rows = [(1, f'{{"items": [{item}, {item}]}}', 200, "OK"), (2, "not json", 200, "OK"), (3, "{}", 200, "OK"), (4, "{}", 500, "Oops"), (5, None, 200, "OK"),
            (6, '{"items": []', 200, "OK"), (7, '"kind": 1}', 200, "OK"), (8, "[1],[2]", 200, "OK"), (9, '{"items": null} x', 200, "OK"), (10, "", 200, "OK"),
            (11, '[]', 200, "OK"), (12, '1},{"a":2', 200, "OK"), (13, "{}", 404, None)]
    df = spark.createDataFrame(rows, "id int, j string, status int, st string")
    got = sorted((r.id, r.rank or 0, r.title, r.error) for r in search_outcomes(df, "j", "status", "st").collect())
    bad = "Unexpected token in search response"
    assert got == [(1, 1, "t", None), (1, 2, "t", None), (2, 0, None, bad), (4, 0, None, "Google Search error: Oops"),
                   *[(i, 0, None, bad) for i in (5, 6, 7, 8, 9, 10, 12)], (13, 0, None, "Google Search error: ")]


def test_user_translator_fails_softly(spark):
    from webloom.operators.language import translate_with

    def translator(text):
        if "x" in text:
            raise ValueError("no")
        return None if text == "none" else text[::-1]
    df = spark.createDataFrame([("abc", "fra"), ("abx", "fra"), ("abc", "eng"), ("abc", "und"), ("none", "deu"), (None, "fra")], "t string, l string")
    assert [r.query for r in translate_with(df, "t", "l", translator).collect()] == ["cba", "abx", "abc", "abc", "none", None]
