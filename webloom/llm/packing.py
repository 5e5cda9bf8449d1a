"""Vector bin packing of documents into training sequences.

A sequence is a bin with limits on tokens, on segments (pieces) and on
loss-bearing tokens.  Pieces are placed by the dot-product heuristic: of
the pieces that fit, the open bin takes the one whose demand vector has the
largest dot product with the bin's free capacity (both relative to the
limits).  If none fits, the best piece is cut to fill the bin, as pieces may
be cut freely.  What is left at the end of a block, in bins that could not be filled, is
laid out in sequences whose lengths are powers of two, which need no
padding.

Tokenising and packing are one narrow pass: each task packs the documents
that it reads, in blocks of about ``BLOCK_TOKENS`` tokens (bounded memory),
and nothing is shuffled.  A sequence id is the partition's number and a
counter; a task that runs again gives the same.

Defined results: a null text counts as empty, which is the end id alone;
repeated rows are packed one by one; a document of any length is cut; an
empty table gives no rows.  Other columns are ignored, but for ``loss_from``
if it is there (the first token that bears loss; null: 0), as in
instruction data whose prompts bear none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import small_batches
from webloom.llm.tokens import encoder

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
BLOCK_TOKENS = 2_000_000
END_ID = 1
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class _Classes:
    """Pieces by demand: those that need as many tokens and loss-bearing tokens are one class with a count.

    The heuristic sees classes, so a placement costs as much as there are
    different demands, however many pieces there are.
    """

    def __init__(self, limit: np.ndarray):
        self.limit = limit
        self.place: dict[tuple[int, int], int] = {}
        self.members: list[list[tuple[int, int, int]]] = []         # (document, start, end), the last is taken first
        self.need = np.empty((0, 3))
        self.count = np.empty(0, np.int64)
        self.left = 0

    def add(self, piece: tuple[int, int, int], loss: int) -> None:
        key = (piece[2] - piece[1], loss)
        k = self.place.get(key)
        if k is None:
            k = self.place[key] = len(self.members)
            self.members.append([])
            if k == len(self.need):
                more = max(64, k)
                self.need = np.concatenate([self.need, np.zeros((more, 3))])
                self.count = np.concatenate([self.count, np.zeros(more, np.int64)])
            self.need[k] = (key[0], 1, loss)
        self.members[k].append(piece)
        self.count[k] += 1
        self.left += 1

    def take(self, k: int) -> tuple[int, int, int]:
        self.count[k] -= 1
        self.left -= 1
        return self.members[k].pop()

    def best(self, free: np.ndarray) -> tuple[int, int]:
        """The class to place next, and how many of it one after the other; (-1, 0) if none fits."""
        fits = (self.count > 0) & (self.need <= free).all(axis=1)
        if not fits.any():
            return -1, 0
        scaled = self.need / self.limit
        worth = np.where(fits, scaled @ (free / self.limit), -1.0)
        k = int(worth.argmax())
        room = int(min(free[i] // self.need[k, i] for i in range(3) if self.need[k, i] > 0))
        # With each piece placed all worths fall in proportion; k stays the best until another class passes it.
        gain = (scaled[k] - scaled) @ scaled[k]
        rivals = fits & (gain > 0)
        until = int(np.floor(((worth[k] - worth[rivals]) / gain[rivals]).min())) + 1 if rivals.any() else room
        return k, max(1, min(room, int(self.count[k]), until))

    def longest_worth(self, free: np.ndarray) -> int:
        """The best class regardless of whether it fits."""
        return int(np.where(self.count > 0, (self.need / self.limit) @ (free / self.limit), -1.0).argmax())


def pack(lengths: np.ndarray, loss_from: np.ndarray, max_tokens: int = MAX_TOKENS,
         max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, end)."""
    limit = np.array([max_tokens, max_segments, max_loss], float)

    def loss(i: int, a: int, b: int) -> int:
        return max(0, b - max(a, int(loss_from[i])))

    # Stretches of long documents that fill a bin alone; the rest is put into classes.
    pool = _Classes(limit)
    for i, n in enumerate(lengths.tolist()):
        a = 0
        while n - a >= max_tokens and loss(i, a, a + max_tokens) <= max_loss:
            yield [(i, a, a + max_tokens)]
            a += max_tokens
        if n > a:
            pool.add((i, a, n), loss(i, a, n))
    unfilled: list[list[tuple[int, int, int]]] = []
    while pool.left:
        free, bin_ = limit.copy(), []
        while pool.left and free[0] > 0 and free[1] > 0:
            k, times = pool.best(free)
            if times:
                free -= times * pool.need[k]
                bin_ += [pool.take(k) for _ in range(times)]
                continue
            k = pool.longest_worth(free)
            i, a, b = pool.members[k][-1]
            # Up to the free tokens, and to the free loss-bearing tokens.
            size = min(int(free[0]), b - a, max(0, int(loss_from[i]) - a) + int(free[2]))
            if size <= 0:
                break
            pool.take(k)
            bin_.append((i, a, a + size))
            free -= (size, 1, loss(i, a, a + size))
            if a + size < b:
                pool.add((i, a + size, b), loss(i, a + size, b))
        if free[0] == 0:
            yield bin_
        else:
            unfilled.append(bin_)
    for bin_ in unfilled:
        yield from _powers_of_two(bin_)


def _powers_of_two(bin_: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a bin that is not full, in sequences whose lengths are powers of two."""
    total = sum(b - a for _, a, b in bin_)
    todo = list(reversed(bin_))
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            i, a, b = todo.pop()
            take = min(size, b - a)
            out.append((i, a, a + take))
            size -= take
            if a + take < b:
                todo.append((i, a + take, b))
        yield out


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
                   max_loss: int = MAX_TOKENS, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS,
                   tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens."""
    small_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        number = TaskContext.get().partitionId() << 33
        ids, docs_, first, held = [], [], [], 0

        def flush():
            nonlocal number
            size = np.array([len(x) // 4 for x in ids], np.int64)
            lf = np.array(first, np.int64)
            rows = []
            for seq in pack(size, lf, max_tokens, max_segments, max_loss):
                at = 0
                for i, a, b in seq:
                    rows.append((docs_[i], a, b - a, zlib.crc32(ids[i][4 * a:4 * b]), int(size[i]), number, at,
                                 max(0, b - max(a, int(lf[i])))))
                    at += b - a
                number += 1
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*COLUMNS, "loss_tokens"])

        for b in batches:
            for d, t, f in zip(*[b.column(i).to_pylist() for i in range(3)]):
                x = encode(t or "") + tail
                ids.append(x)
                docs_.append(d)
                first.append(min(max(f or 0, 0), len(x) // 4))
                held += len(x) // 4
                if held >= block_tokens:
                    yield flush()
                    ids, docs_, first, held = [], [], [], 0
        if ids:
            yield flush()

    loss_from = F.col("loss_from").cast("long") if "loss_from" in docs.columns else F.lit(None).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", loss_from.alias("loss_from"))
    return src.mapInArrow(run, SCHEMA)
