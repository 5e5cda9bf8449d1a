"""The best documents of each query, from postings with weights: cells of a block of documents and a block of queries.

Nearly every (query, document) shares some common term, so pairs are never
rows of a table.  A block holds the postings of about ``DOC_BLOCK`` documents
or about ``QUERY_ROWS`` terms of queries.  Each is written once, as a file in
the shared folder: what a block's cells need is read as often as there are
cells, and shuffled once.  A cell is a block of queries and some blocks of
documents, one of them in memory at a time; its task adds up a query's scores in
one array and gives only its best documents.  There are as many cells as the corpus and the queries
need, up to ``CELL_TASKS`` for a core, then a cell has more blocks of documents: so the rows
that the cells give grow with the queries, not with queries times documents.
"""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import checkpoint_dir
from webloom.sources.fetch import _filesystem
from webloom.sources.tables import stored

DOC_BLOCK, QUERY_ROWS, CELL_TASKS = 16_384, 200_000, 64


class _Lists(NamedTuple):
    """Postings of a block: of ``terms[i]`` the entries ``bounds[i]`` to ``bounds[i + 1]``, each a place in ``docs`` and a weight."""
    docs: pa.Array
    terms: np.ndarray
    bounds: np.ndarray
    pos: np.ndarray
    w: np.ndarray


class _Wanted(NamedTuple):
    """Rows of a block of queries: a place in ``ids``, a term and its idf."""
    ids: pa.Array
    who: np.ndarray
    term: np.ndarray
    idf: np.ndarray


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up in the decimal notation of the number, as Spark's ``round``."""
    scaled = x * 10.0 ** digits
    out = np.rint(scaled) / 10.0 ** digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values in ascending order (NULL first), and each row's place among them."""
    column = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(column.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return column.dictionary.take(pa.array(order)), place[column.indices.to_numpy()]


def _lists(postings: pa.Table) -> _Lists:
    docs, pos = _coded(postings.column("doc"))
    term, w = postings.column("tid").to_numpy(), postings.column("w").to_numpy()
    o = np.lexsort((pos, term))
    pos, term, w = pos[o], term[o], w[o]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (pos[1:] != pos[:-1])))
    pos, term, w = pos[first], term[first], np.add.reduceat(w, first)       # rows of one document are one entry
    terms, bounds = np.unique(term, return_index=True)
    return _Lists(docs, terms, np.append(bounds, len(term)), pos, w)


def _wanted(queries: pa.Table) -> _Wanted:
    ids, who = _coded(queries.column("_q"))
    return _Wanted(ids, who, queries.column("tid").to_numpy(), queries.column("idf").to_numpy())


def _top(lists: _Lists, wanted: _Wanted, last: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the document, score): each query's first ``last`` documents by score, then by id."""
    docs, terms, bounds, pos, w = lists
    at = np.minimum(np.searchsorted(terms, wanted.term), len(terms) - 1)
    known = terms[at] == wanted.term
    who, at, idf = wanted.who[known], at[known], wanted.idf[known]
    o = np.lexsort((at, who))
    who, at, idf = who[o], at[o], idf[o]
    starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    score, n = np.zeros(len(docs)), len(docs)
    got_q, got_d, got_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(who)]):
        score[:] = 0
        for t, weight in zip(at[a:b].tolist(), idf[a:b].tolist()):
            s = slice(bounds[t], bounds[t + 1])
            score[pos[s]] += weight * w[s]
        least = np.partition(score, n - last)[n - last] if n > last else 0.0
        # What is rounded to the score of the last place is less than a unit of the last digit below it.
        found = np.flatnonzero((score > 0) & (score >= least - 1.5 * 10.0 ** -digits))
        r = _rounded(score[found], digits)
        o = np.lexsort((found, -r))[:last]
        got_q.append(np.full(len(o), who[a])), got_d.append(found[o]), got_s.append(r[o])
    return np.concatenate(got_q), np.concatenate(got_d), np.concatenate(got_s)


def _best(postings: pa.Table, queries: pa.Table, last: int, digits: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query, document, score) of one block of each."""
    lists, wanted = _lists(postings), _wanted(queries)
    who, found, score = _top(lists, wanted, last, digits)
    return wanted.ids.take(pa.array(who)), lists.docs.take(pa.array(found)), score


def _first(rows: pa.Table, last: int) -> pa.Table:
    """Of ``(who, doc, score)``, each query's first ``last`` by score, then by id."""
    rows = rows.take(pc.sort_indices(rows, [("who", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_start"))
    who = rows.column("who").to_numpy()
    starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))[:len(who)]
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
    return rows.filter(pa.array(rank < last))


def _save(path: str, columns: dict) -> None:
    """One row of lists, as an Arrow file."""
    filesystem, p = _filesystem(path)
    filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in map(pa.array, columns.values())]
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    with filesystem.open_output_stream(p, compression=None) as out, \
            pa.ipc.new_file(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)


def _load(path: str) -> list[pa.Array]:
    filesystem, p = _filesystem(path)
    with filesystem.open_input_file(p) as source:
        return [c.flatten() for c in pa.ipc.open_file(source).get_batch(0).columns]


def _written(rows: DataFrame, column: str, n: int, save) -> DataFrame:
    """``(block, path)``: the ``rows`` in ``n`` blocks by ``column``, each a file that ``save(path, rows of the block)`` writes."""
    folder = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"

    def write(key: tuple, block: pa.Table) -> pa.Table:
        path = f"{folder}/{uuid.uuid4().hex}.arrow"         # of each attempt; only that of one that ended is named
        save(path, block)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "path": [path]})
    dealt = rows.withColumn("_n", F.pmod(F.xxhash64(column), F.lit(n)).cast("int")).repartition(n, "_n")
    return stored(dealt.groupBy("_n").applyInArrow(write, "block int, path string"))


def best_documents(postings: DataFrame, weighted: DataFrame, n_docs: int, n_rows: int, last: int, digits: int) -> DataFrame:
    """``(_q, doc, score)``: of each cell, a query's best documents; the first ``last`` of all cells are those of the query.

    ``postings`` is (doc, tid, w), ``weighted`` (_q, tid, idf), ``n_docs`` and ``n_rows`` about how many documents and
    rows they have.  A score is the sum of ``idf * w``, rounded to ``digits``.
    """
    cores = postings.sparkSession.sparkContext.defaultParallelism
    columns = max(1, -(-n_rows // QUERY_ROWS))
    blocks = max(1, -(-n_docs // DOC_BLOCK), -(-2 * cores // columns))
    ranges = min(blocks, -(-CELL_TASKS * cores // columns))     # of blocks of documents

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def save_lists(path: str, block: pa.Table) -> None:
        lists = _lists(block)
        _save(path, lists._replace(pos=lists.pos.astype(np.min_scalar_type(len(lists.docs))))._asdict())

    def save_wanted(path: str, block: pa.Table) -> None:
        _save(path, _wanted(block)._asdict())
    left = _written(postings.select("doc", "tid", "w"), "doc", blocks, save_lists)
    right = _written(weighted.select("_q", "tid", "idf"), "_q", columns, save_wanted)
    out = T.StructType([T.StructField("_q", weighted.schema["_q"].dataType), T.StructField("doc", postings.schema["doc"].dataType),
                        T.StructField("score", T.DoubleType())])

    none = to_arrow_schema(out).empty_table()

    def cell(p: pa.Table, q: pa.Table) -> pa.Table:
        got = [none]
        for queries in q.column("path").to_pylist():
            ids, *wanted = _load(queries)
            wanted = _Wanted(ids, *[c.to_numpy() for c in wanted])
            best = None
            for path in p.column("path").to_pylist():
                docs, *lists = _load(path)
                lists = _Lists(docs, *[c.to_numpy() for c in lists])
                who, found, score = _top(lists._replace(pos=lists.pos.astype(np.int64)), wanted, last, digits)
                rows = pa.table({"who": who, "doc": docs.take(pa.array(found)), "score": score})
                best = rows if best is None else _first(pa.concat_tables([best, rows]), last)
            if best is not None:
                got.append(pa.table({"_q": ids.take(best.column("who").combine_chunks()), "doc": best.column("doc"), "score": best.column("score")}))
        return pa.concat_tables(got, promote_options="permissive")

    parts = ranges * columns
    left = left.select(F.pmod("block", F.lit(ranges)).alias("_b"), every(columns).alias("_c"), "path")
    right = right.select(every(ranges).alias("_b"), F.col("block").alias("_c"), "path")
    return (left.repartition(parts, "_b", "_c").groupBy("_b", "_c")
            .cogroup(right.repartition(parts, "_b", "_c").groupBy("_b", "_c")).applyInArrow(cell, out))
