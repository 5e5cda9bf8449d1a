from pyspark.sql import functions as F

from webloom.functions.jsonfmt import canonical_json, js_number, pretty_json
from webloom.operators.responses import (classify_timeouts, decode_body, normalize_headers,
                                         truncate_body, valid_requests, validate_index)

BODY_EDGE = [
    (None, b"\x00" * 100, "base64", 136),
    ("application/vnd.x+json", b'{"a":1}', "base64", 12),
    ("application/problem+json", b'{"a": 1}', "base64", 12),   # no 'application/json' substring
    ("text/csv", b"a,b\n1,2", "text", 7),
    ("application/xml", b"<x/>", "text", 4),
    ("application/json", b"null", "json", 4),
    ("application/json", b' { "b" : [1.0, 2e2, -0.5e-7], "a": "\xc3\xa9" } ', "json", 27),
    ("application/json", b'{"k": 1, "k": 2}', "json", 7),
]


def test_js_numbers():
    cases = {1.0: "1", 200.0: "200", 0.1: "0.1", -5e-08: "-5e-8", 1e21: "1e+21", 1.5e20: "150000000000000000000",
             123456789.125: "123456789.125", 0.000001: "0.000001", 1e-7: "1e-7", 60.0: "60", 1.5: "1.5"}
    for x, s in cases.items():
        assert js_number(x) == s, x


def test_canonical_json():
    assert canonical_json('{"k": 69}') == '{"k":69}'
    assert canonical_json('{"a": 1.0, "b": 2e2, "a": 3}') == '{"a":3,"b":200}'
    assert canonical_json("null") == "null"
    assert canonical_json("{bad") is None
    assert pretty_json([]) == "[]"
    assert pretty_json([{"text": "a", "href": "h"}]) == '[\n  {\n    "text": "a",\n    "href": "h"\n  }\n]'


def test_decode_and_truncate(spark):
    rows = [("x", i, {"Content-Type": ct} if ct else {}, body) for i, (ct, body, _, _) in enumerate(BODY_EDGE)]
    df = spark.createDataFrame(rows, "kind string, id long, headers map<string,string>, body binary")
    d = decode_body(df).orderBy("id").collect()
    assert [r.body_kind for r in d] == [e[2] for e in BODY_EDGE]
    assert [len(r.body_text) for r in d] == [e[3] for e in BODY_EDGE]
    assert d[7].body_text == '{"k":2}'
    bad = spark.createDataFrame([("x", 1, {"content-type": "application/json"}, b"{oops")], df.schema)
    assert decode_body(bad).first().error is not None
    t = truncate_body(decode_body(df), 5).orderBy("id").collect()
    assert all(r.truncated == (r.body_length > 5) for r in t)
    assert all(len(r.body_out) <= 5 for r in t if r.truncated)
    neg = truncate_body(decode_body(df), -1).first()
    assert neg.truncated and neg.body_out == ""


def test_headers_merge(spark):
    df = spark.createDataFrame([("x", 1, {"Set-Cookie": "a", "set-cookie": "b", "X-A": "1"})],
                               "kind string, id long, headers map<string,string>")
    got = sorted((r.name, r.value) for r in normalize_headers(df).collect())
    assert got in ([("set-cookie", "a, b"), ("x-a", "1")], [("set-cookie", "b, a"), ("x-a", "1")])


def test_validation_and_timeouts(spark):
    rows = [("u", "GET", 5.0, "follow"), ("u", "get", 5.0, None), (None, "PUT", 5.0, None),
            ("u", "POST", None, None), ("u", "HEAD", 1.0, "bounce"), ("u", "OPTIONS", 0.0, "manual")]
    df = spark.createDataFrame(rows, "url string, method string, limit double, redirect string")
    assert [r.v for r in df.select(valid_requests(df).alias("v")).collect()] == [True, False, False, False, False, True]
    t = spark.createDataFrame([(59999.0, None), (60000.0, None), (1600.0, 1500.0)], "e double, t double")
    out = [r.err for r in t.select(classify_timeouts(t, "e", F.col("t")).alias("err")).collect()]
    assert out == [None, "Request timed out after 60 seconds", "Request timed out after 1.5 seconds"]
    idx = spark.createDataFrame([(0,), (9,), (10,), (-1,), (None,)], "i int")
    assert [r.e for r in idx.select(validate_index("i", 10).alias("e")).collect()] == \
        [None, None, "Invalid tab index", "Invalid tab index", "Invalid tab index"]


def test_defaults_keep_zero(spark):
    from webloom.operators.responses import with_defaults
    df = spark.createDataFrame([(None, 0.0), (5.0, None)], "nav double, settle double")
    out = with_defaults(df, {"nav": 90000.0, "settle": 1500.0}).collect()
    assert [(r.nav, r.settle) for r in out] == [(90000.0, 0.0), (5.0, 1500.0)]
