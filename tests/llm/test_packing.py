import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import EDGE, docs_of, long_text
from webloom.llm import packing as P
from webloom.llm.common import tokenizer_path
from webloom.llm.tokens import Encoder


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 320)), max_size=40), st.integers(1, 6), st.sampled_from([16, 64]),
       st.sampled_from([5, 16, 64]))
def test_pack_keeps_limits_and_every_token(items, segments, tokens, loss):
    n = np.array([a for a, _ in items], np.int64)
    lf = np.array([min(b, a) for a, b in items], np.int64)
    seen = [[] for _ in items]
    for seq in P.pack(n, lf, tokens, segments, loss):
        assert sum(b - a for _, a, b in seq) <= tokens and len(seq) <= segments
        assert sum(max(0, b - max(a, lf[i])) for i, a, b in seq) <= loss
        size = sum(b - a for _, a, b in seq)
        assert size == tokens or size & (size - 1) == 0
        for i, a, b in seq:
            seen[i].append((a, b))
    for x, size in zip(seen, n):
        x.sort()
        assert [a for a, _ in x] == [0, *[b for _, b in x[:-1]]] and x[-1][1] == size


WORDS = st.sampled_from(["word", " ", "  ", "\n", "\n\n ", "don't", "'s", "123", " 4", "!?", "é", "日本", "🙂", " ", "\x1c", "\x85", " ",
                         "<|endoftext|>", "<|", "ɏ", "ɐ", "\t", ".\nNext"])


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=25).map("".join))
def test_ids_equal_tokenizers(text):
    own = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == own
    assert ENCODER.count(text) == len(own)


ENCODER = Encoder()


def test_rows_equal_brute_force(spark):
    rows = [*[r for r in EDGE if r[0] not in (6, None)], (40, long_text(6000)), *[(100 + i, f"short text {i} " * (i % 40)) for i in range(300)]]
    got = P.pack_documents(docs_of(spark, rows).repartition(3)).collect()
    own = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    parts, seqs = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        mine = ids[r.doc_id]
        assert r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(mine[r.start:r.start + r.length].tobytes())
    for i, mine in ids.items():
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(mine)
    for seq in seqs.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    full = sum(len(x) for x in ids.values()) // 2048
    assert full <= len(seqs) <= full + 3 * 11 + 3


def test_repeated_rows_null_ids_loss_and_empty(spark):
    docs = docs_of(spark, [(6, "a b"), (6, "a b"), (None, "c"), (None, None)])
    assert P.pack_documents(docs).where("start = 0").count() == 4
    assert P.pack_documents(docs.limit(0)).count() == 0
    part = P.pack_documents(docs_of(spark, [(1, "word " * 50)]).withColumn("loss_from", F.lit(10)))
    r = part.agg(F.sum("loss_tokens"), F.sum("length")).first()
    assert r[0] == r[1] - 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_several_at_once_is_one_after_the_other(items):
    """A step of ``times`` pieces leaves the class the best one (or level with it) until its last piece."""
    limit = np.array([64.0, 9.0, 40.0])
    pool = P._Classes(limit)
    for i, (n, loss) in enumerate(items):
        pool.add((i, 0, n), min(n, loss))
    free = limit.copy()
    while True:
        k, times = pool.best(free)
        if not times:
            break
        for _ in range(times):
            worth = (pool.need / limit) @ (free / limit)
            fits = (pool.count > 0) & (pool.need <= free).all(axis=1)
            assert fits[k] and worth[k] >= worth[fits].max() - 1e-9
            pool.take(k)
            free -= pool.need[k]


def test_very_many_tiny_documents():
    n = np.ones(200_000, np.int64)
    start = time.process_time()
    seqs = list(P.pack(n, np.zeros(len(n), np.int64)))
    assert time.process_time() - start < 5
    assert sorted(i for s in seqs for i, _, _ in s) == list(range(len(n)))
    mixed = np.random.default_rng(2).integers(1, 9, 200_000)
    start = time.process_time()
    seqs = list(P.pack(mixed, np.zeros(len(n), np.int64)))
    assert time.process_time() - start < 5
    assert sum(b - a for s in seqs for _, a, b in s) == mixed.sum()


def test_the_limits_bind_together():
    n = np.full(100, 40, np.int64)
    none = np.zeros(100, np.int64)
    size = lambda seqs: max(sum(b - a for _, a, b in s) for s in seqs)                          # noqa: E731
    assert size(P.pack(n, none, max_segments=100)) == P.MAX_TOKENS
    assert size(P.pack(n, none, max_segments=12)) == 256    # 12 pieces of 40 tokens, laid out in powers of two
    assert size(P.pack(n, none, max_segments=100, max_loss=600)) == 512
    assert size(P.pack(n, n - 5, max_segments=100, max_loss=300)) == P.MAX_TOKENS       # 5 loss tokens each
