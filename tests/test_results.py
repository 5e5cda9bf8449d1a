"""Pretty JSON as a Column against JSON.stringify's rules, and whole result records."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions.jsonfmt import js_number, json_number, json_string, pretty_column, pretty_json
from webloom.operators import results as R

TEXTS = ["", "plain", 'quote " and \\ back', "line\nfeed\r\ttab\b\f", "\x00\x01\x1f\x0b\x7f", "é 日本 🙂  ", "</script>", "a/b", None]


def test_strings(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.j for r in rows.select("i", json_string(F.col("t")).alias("j")).collect()}
    assert got == {i: json.dumps(t, ensure_ascii=False) for i, t in enumerate(TEXTS)}


def test_numbers(spark):
    r = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 1.5e-7, 2.5e25, -3e300, 5e-324, 1.7976931348623157e308, 60.0, 0.000123,
          100.0, 1234.5678, 9007199254740993.0, 1e15, 1e16, 12345678.9]
    xs += [round(r.uniform(-1e6, 1e6), r.randrange(8)) for _ in range(300)] + [float(r.randrange(10 ** 12)) for _ in range(50)]
    xs += [math.nan, math.inf, -math.inf, None]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    got = {r.i: r.j for r in rows.select("i", json_number(F.col("x")).alias("j")).collect()}
    want = {i: "null" if x is None or not math.isfinite(x) else js_number(x) for i, x in enumerate(xs)}
    assert {i: (got[i], want[i]) for i in got if got[i] != want[i]} == {}


KIND = "struct<a:string, n:int, `k 2`:double, l:array<string>, m:map<string,int>, s:struct<x:boolean, y:array<struct<z:string>>>, opt:string>"
VALUES = [
    {"a": "x", "n": 1, "k 2": 1.5, "l": ["p", None], "m": {"b": 1}, "s": {"x": True, "y": [{"z": "q"}, {"z": None}]}, "opt": "o"},
    {"a": None, "n": None, "k 2": None, "l": [], "m": {}, "s": {"x": None, "y": []}, "opt": None},
    {"a": "", "n": -5, "k 2": 0.0, "l": None, "m": None, "s": None, "opt": None},
]


def test_nested_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], f"i int, v {KIND}")
    got = {r.i: r.j for r in df.select("i", pretty_column(df, "v", ("opt",)).alias("j")).collect()}
    for i, v in enumerate(VALUES):
        want = {k: x for k, x in v.items() if k != "opt" or x is not None}
        assert got[i] == pretty_json(want)
    every = {r.i: r.j for r in df.select("i", pretty_column(df, "v").alias("j")).collect()}
    assert every == {i: pretty_json(v) for i, v in enumerate(VALUES)}
    keys = spark.sql("SELECT map('b', 1, '10', 2, '2', 3, '01', 4) AS m")
    assert keys.select(pretty_column(keys, "m")).first()[0] == pretty_json({"2": 3, "10": 2, "b": 1, "01": 4})


def test_no_python_in_the_plans(spark, sf_small):
    from webloom.plans.queries import QUERIES
    for name in ("links_json", "tabs_json", "console_json", "network_json", "batch_json", "slice_json"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan, name


def test_types_without_a_form(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "v binary")
    with pytest.raises(TypeError):
        pretty_column(df, "v")


def test_empty_results(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", None), (2, "https://a.example/", "<p>none")], "page_id long, url string, html string")
    assert {r.page_id: r.json for r in R.links_json(pages).collect()} == {1: "[]", 2: "[]"} or R.links_json(pages).where("page_id = 2").first().json == "[]"
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    log = spark.createDataFrame([(1, 5, "b"), (1, 4, "a")], "u long, o long, t string")
    got = {r.k: r.json for r in R.log_json(keys, "k", log, "u", ["o"], ["t"], 10).collect()}
    assert got == {1: pretty_json([{"t": "a"}, {"t": "b"}]), 2: "[]"}


def test_fetch_api_records(spark):
    req = spark.createDataFrame([(1, "u", "GET", 100.0, None, None), (2, "u", "get", 100.0, None, None), (3, "u", "GET", 5.0, None, None),
                                 (4, "u", "GET", 100.0, 1000.0, None), (5, "u", "GET", 100.0, None, None), (6, "u", "POST", None, None, None)],
                                "id long, url string, method string, limit double, timeout double, redirect string")
    js = {"Content-Type": "application/json"}
    res = spark.createDataFrame([(1, "u", 200, "OK", {**js, "X-A": "1"}, bytearray(b'{"b": [1, {"c": 1.50}], "a": {}}'), 12.5),
                                 (2, "u", 200, "OK", js, bytearray(b"{}"), 1.0), (3, "u", 404, "Not Found", js, bytearray(b'{"long": "body text"}'), 1.0),
                                 (4, "u", 200, "OK", js, bytearray(b"{}"), 1500.0), (5, "u", 200, "OK", js, bytearray(b"no json"), 1.0),
                                 (6, "u", 200, "OK", js, bytearray(b"{}"), 1.0)],
                                "id long, url string, status int, status_text string, headers map<string,string>, body binary, elapsed_ms double")
    got = {r.id: (r.is_error, r.text) for r in R.fetch_api(req, res, "id").collect()}
    first = {"status": 200, "statusText": "OK", "headers": {"content-type": "application/json", "x-a": "1"}, "body": {"b": [1, {"c": 1.5}], "a": {}},
             "ok": True, "url": "u", "bodyLength": len('{"b":[1,{"c":1.5}],"a":{}}'), "truncated": False, "responseTimeMs": 12.5}
    assert got[1] == (False, pretty_json(first))
    assert got[2] == got[6] == (True, "Error: Invalid args") and got[4] == (True, "Error: Request timed out after 1 seconds")
    cut = json.loads(got[3][1])
    assert (cut["ok"], cut["truncated"], cut["body"], cut["bodyLength"]) == (False, True, '{"lon', 20)
    assert got[5][0] and got[5][1].startswith("Error: Unexpected token")
