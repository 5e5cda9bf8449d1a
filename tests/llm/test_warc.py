import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from webloom.llm import warc as W


def _pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("payload", "sha", "top", "_id", "refers_to"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_round_trip_equals_brute_force(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 7} é🙂") for i in range(60)]
    rows += [(70, None, None), (71, "u\r\nX: y", ""), (72, "u", "x" * 300_000), (None, "n", "page 1 é🙂"), (73, "r", "again"), (73, "r", "again"),
             (None, "n", "only without id")]
    got = W.round_trip(_pages(spark, rows)).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        t = None if top[h or ""] == -1 else top[h or ""]
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == t else "revisit",
                     None if i == t else t))
    assert sorted(want, key=str) == sorted(
        ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert bytes(texts[72]) == b"x" * 300_000


def test_small_payloads_are_responses(spark):
    got = W.round_trip(_pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), min_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}
    assert W.round_trip(_pages(spark, [(1, "u", "a")]).limit(0)).count() == 0


def _archive():
    return [W.page_record(i, "http://u", f"payload {i} ".encode() * 5000, None if i else 2) for i in range(3)]


def test_reader_is_sequential_and_reads_gzip_members():
    data = b"".join(_archive())
    got = list(W.read_records(io.BytesIO(data)))
    assert [h["warc-type"] for h, _ in got] == ["revisit", "response", "response"]
    assert got[2][1] == b"payload 2 " * 5000 and got[0][0]["warc-refers-to"] == "<urn:page:2>"
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    assert list(W.read_records(io.BytesIO(b""))) == []


def test_damage_is_an_error():
    data = b"".join(_archive())
    good = W.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Block-Digest": "sha1:" + W.digest(b"other")}, b"block")
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nblock\r\n\r\n")
    long = gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nblock\r\n\r\n")
    none = gzip.compress(b"WARC/1.1\r\nX: 9\r\n\r\nblock\r\n\r\n")
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 255
    for bad in (data[:-10], bytes(flipped), good, short, long, none, gzip.compress(b"no record"), data + b"tail"):
        with pytest.raises(W.WarcError):
            list(W.read_records(io.BytesIO(bad)))


def test_archives_roll(spark, tmp_path):
    rows = W.with_revisits(_pages(spark, [(i, "u", f"{i}" * 500) for i in range(20)])).coalesce(1)
    manifest = W.write_archives(rows, str(tmp_path / "a"), max_bytes=300).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == 20
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted(m.path.rsplit("/", 1)[1] for m in manifest)


def test_every_digest_that_a_record_has_is_compared():
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    base = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>"}
    sha = lambda data: "sha1:" + W.digest(data)                                              # noqa: E731
    good = [({"WARC-Payload-Digest": sha(b"block")}, b"block"), ({"WARC-Payload-Digest": sha(b"body"), "Content-Type": "application/http; msgtype=response"}, http),
            ({"WARC-Block-Digest": sha(http), "WARC-Payload-Digest": sha(b"body"), "Content-Type": "application/http"}, http), ({}, b"x"),
            ({"WARC-Type": "revisit", "WARC-Payload-Digest": sha(b"other")}, b""), ({"WARC-Payload-Digest": "md5:x"}, b"x")]
    for headers, block in good:
        assert [b for _, b in W.read_records(io.BytesIO(W.record(base | headers, block)))] == [block]
    bad = [({"WARC-Payload-Digest": sha(b"other")}, b"block"), ({"WARC-Payload-Digest": sha(http), "Content-Type": "application/http"}, http),
           ({"WARC-Block-Digest": sha(b"block"), "WARC-Payload-Digest": sha(b"other")}, b"block")]
    for headers, block in bad:
        with pytest.raises(W.WarcError):
            list(W.read_records(io.BytesIO(W.record(base | headers, block))))


def test_a_header_without_end_is_refused():
    with pytest.raises(W.WarcError, match="too long"):
        list(W.read_records(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"X: " + b"y" * 10_000_000))))
