"""K2 as a data source writer: files that appear when the whole job is done.

``df.write.format("webloom_files").mode("append").save(folder)`` takes ``(path, body)``, the path relative to the
folder.  A task writes into a place of its own below ``_staged``; only when
every task has ended does the commit move the files of the attempts that
count to their names, and an abort removes what was staged.  So a failing
task leaves no file, a task that runs twice leaves one, and a job that runs
again leaves the same set.

Defined results: a NULL body is an empty file; a NULL path, or one that
leaves the folder, fails the job; of rows with one path the last one moved
stays (feed it ``final_files`` output).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGED = "_staged"


@dataclass
class _Written(WriterCommitMessage):
    place: str                  # the attempt's folder
    names: list[str]


def _relative(path: str | None) -> str:
    if not path:
        raise ValueError("a file needs a path")
    p = posixpath.normpath(path)
    if p.startswith(("/", "../")) or p in ("..", ".") or p.split("/")[0] == STAGED:
        raise ValueError(f"{path!r} is no path inside the folder")
    return p


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder.rstrip("/"), uuid.uuid4().hex

    def _filesystem(self):
        from webloom.sources.fetch import _filesystem
        return _filesystem(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, root = self._filesystem()
        place = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        names, made = [], set()
        for b in iterator:
            for path, body in zip(b.column("path").to_pylist(), b.column("body").to_pylist()):
                name = _relative(path)
                target = f"{place}/{name}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                with filesystem.open_output_stream(target, compression=None) as fh:
                    fh.write(body or b"")
                names.append(name)
        return _Written(place, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, root = self._filesystem()
        made = set()
        with ThreadPoolExecutor(16) as pool:
            for m in messages:              # one task's files after the other: never a list of all moves
                names = dict.fromkeys(m.names) if m is not None else ()
                for parent in {f"{root}/{n}".rsplit("/", 1)[0] for n in names} - made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                for _ in pool.map(lambda n, place=m and m.place: filesystem.move(f"{place}/{n}", f"{root}/{n}"), names):
                    pass
        self._clear(filesystem, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._filesystem())

    def _clear(self, filesystem, root: str) -> None:
        from pyarrow import fs
        staged = f"{root}/{STAGED}"
        if filesystem.get_file_info(f"{staged}/{self.job}").type == fs.FileType.Directory:
            filesystem.delete_dir(f"{staged}/{self.job}")
        if filesystem.get_file_info(staged).type == fs.FileType.Directory and not filesystem.get_file_info(fs.FileSelector(staged)):
            filesystem.delete_dir(staged)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webloom_files"

    def schema(self) -> str:
        return "path string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("webloom_files replaces single files; use mode append")
        if sorted(schema.names) != ["body", "path"]:
            raise ValueError("webloom_files takes the columns path and body")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)
