"""A data source that fetches URLs through a fetcher of the user's.

``spark.read.format("webloom_fetch").option("fetcher", "package.module:Class").load(folder)``
reads ``(pos, url)`` from the Parquet files of a folder and gives one row for
each URL: ``(pos, url, status, status_text, headers, body, error)``.  A URL
that fails gives a row with its error and never stops the others.
``spark.readStream`` takes new files of the folder, in the order of their names, as they come.

Partitions are planned from the files' row groups, up to ``partitionRows``
rows each; a task makes one fetcher and closes it.  The class must be
importable on the executors, and the folder readable there (``pyarrow.fs``).
Options whose names begin with ``fetcher.`` go to the fetcher.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "pos bigint, url string, status int, status_text string, headers map<string,string>, body binary, error string"
PARTITION_ROWS = 10_000
CHUNK = 500                 # URLs that a fetcher is told of together
SNAPSHOT_ROWS = 1_000       # pages of a snapshot that are held together


@dataclass
class Response:
    status: int
    body: bytes
    status_text: str = ""
    headers: dict[str, str] = field(default_factory=dict)


class Fetcher:
    """What users write: ``fetch`` gives a response or raises; ``prepare`` may look at the URLs that come next."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def prepare(self, urls: list[str]) -> None:
        pass

    def fetch(self, url: str) -> Response:
        raise NotImplementedError

    def close(self) -> None:
        pass


class SnapshotFetcher(Fetcher):
    """A crawl's snapshot as the web: pages of a Parquet table (options ``path``, ``url`` and ``body`` columns).

    Of a table sorted by URL, only the row groups around the URLs that come next are read, so sorted URLs read the table
    about once.  Rows come in small batches, and of a URL's rows only the least body is kept."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        filesystem, path = _filesystem(options["path"])
        self.pages = ds.dataset(path, filesystem=filesystem, format="parquet")
        self.known: dict[str, str | None] = {}
        self.asked: set[str] = set()

    def prepare(self, urls: list[str]) -> None:
        url, body = self.options.get("url", "url"), self.options.get("body", "html")
        self.known = {u: self.known[u] for u in urls if u in self.known}
        new, self.asked = set(urls) - self.asked, set(urls)
        if not new:
            return
        field = ds.field(url)
        for b in self.pages.to_batches(columns=[url, body], filter=(field >= min(new)) & (field <= max(new)) & field.isin(sorted(new)),
                                       batch_size=SNAPSHOT_ROWS, batch_readahead=1, fragment_readahead=1):
            for u, text in zip(b.column(url).to_pylist(), b.column(body).to_pylist()):
                self.known[u] = min(self.known.get(u, text) or "", text or "")

    def fetch(self, url: str) -> Response:
        if url not in self.known:
            raise LookupError(f"net::ERR_NAME_NOT_RESOLVED at {url}")
        return Response(200, (self.known[url] or "").encode(), "OK", {"content-type": "text/html"})


def _filesystem(path: str):
    from pyarrow import fs

    from webloom.operators.downloads import _fs_path
    return fs.FileSystem.from_uri(_fs_path(path))


@dataclass
class _Rows(InputPartition):
    path: str
    groups: list[int]

    def __init__(self, path: str, groups: list[int]):
        super().__init__((path, tuple(groups)))
        self.path, self.groups = path, groups


def _files(folder: str) -> list[str]:
    filesystem, path = _filesystem(folder)
    return sorted(f for f in ds.dataset(path, filesystem=filesystem, format="parquet").files if f.endswith(".parquet"))


def _plan(folder: str, files: list[str], rows: int) -> list[_Rows]:
    filesystem, _ = _filesystem(folder)
    out = []
    for f in files:
        held, n = [], 0
        meta = pq.ParquetFile(f, filesystem=filesystem).metadata
        for g in range(meta.num_row_groups):
            if held and n + meta.row_group(g).num_rows > rows:
                out.append(_Rows(f, held))
                held, n = [], 0
            held.append(g)
            n += meta.row_group(g).num_rows
        if held:
            out.append(_Rows(f, held))
    return out


def _fetched(folder: str, part: _Rows, options: dict[str, str]) -> Iterator[tuple]:
    filesystem, _ = _filesystem(folder)
    module, name = options["fetcher"].split(":")
    own = {k[len("fetcher."):]: v for k, v in options.items() if k.startswith("fetcher.")}
    fetcher = getattr(importlib.import_module(module), name)(own)
    try:
        for b in pq.ParquetFile(part.path, filesystem=filesystem).iter_batches(CHUNK, row_groups=part.groups, columns=["pos", "url"]):
            urls = b.column("url").to_pylist()
            trouble = None
            try:
                fetcher.prepare([u for u in urls if u is not None])
            except Exception as e:  # noqa: BLE001 -- every URL of the chunk tells it
                trouble = e
            for pos, url in zip(b.column("pos").to_pylist(), urls):
                try:
                    if trouble is not None:
                        raise trouble
                    if url is None:
                        raise ValueError("no URL")
                    r = fetcher.fetch(url)
                    yield pos, url, r.status, r.status_text, r.headers, r.body, None
                except Exception as e:  # noqa: BLE001 -- one URL must not stop the others
                    yield pos, url, None, None, None, None, str(e) or type(e).__name__
    finally:
        fetcher.close()


class _Batch(DataSourceReader):
    def __init__(self, folder: str, options: dict[str, str], rows: int):
        self.folder, self.options, self.rows = folder, options, rows

    def partitions(self) -> list[InputPartition]:
        return _plan(self.folder, _files(self.folder), self.rows) or [_Rows("", [])]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        if partition.path:
            yield from _fetched(self.folder, partition, self.options)


class _Stream(DataSourceStreamReader):
    """Offsets are the name of the last file taken."""

    def __init__(self, folder: str, options: dict[str, str], rows: int):
        self.folder, self.options, self.rows = folder, options, rows

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.folder)
        return {"file": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _plan(self.folder, [f for f in _files(self.folder) if start["file"] < f <= end["file"]], self.rows)

    def read(self, partition: _Rows) -> Iterator[tuple]:
        yield from _fetched(self.folder, partition, self.options)

    def commit(self, end: dict) -> None:
        pass


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webloom_fetch"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, dict[str, str], int]:
        options = dict(self.options)
        if "path" not in options or "fetcher" not in options:
            raise ValueError("webloom_fetch needs a folder of URLs and the option fetcher")
        return options["path"], options, int(options.get("partitionrows", options.get("partitionRows", PARTITION_ROWS)))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._args())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._args())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FetchSource)
