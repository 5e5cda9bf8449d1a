"""S8 folder listing and S5 document text extraction.

``file_inventory`` lists folders in tasks, level by level, into a stored
table: contents are never read, and the driver holds no list of files.  Its
rows are those of the ``binaryFile`` source, which lists a store
that ``pyarrow.fs`` does not open.  ``parse_documents`` reads contents and extracts text in
``mapInPandas`` (Arrow batches): plain text and HTML as UTF-8, DOCX from its
``word/document.xml`` (zip + XML, standard library), PDF from the text
operators of its (Flate-decoded) content streams.  A file that cannot be
parsed yields an error row instead of failing the job.
"""

from __future__ import annotations

import io
import os
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.tables import scan_bytes, stored


FILE_BYTES, SCAN_TASKS = 8 << 20, 64        # of one task: bytes of contents; tasks as Spark would deal them


def _dealt(files: DataFrame) -> DataFrame:
    """A scan counts a file as ``openCostInBytes`` at least, so tasks of few small files each, whose start takes longer
    than their work, are put together."""
    parts = files.rdd.getNumPartitions()
    want = max(files.sparkSession.sparkContext.defaultParallelism, scan_bytes(files) // FILE_BYTES, parts // SCAN_TASKS)
    return files.coalesce(want) if want < parts else files


LISTED_ROWS, FOLDERS = 10_000, 16           # of a batch; of a task where there are very many
LOCAL = "file:"
_LISTED = "path string, modificationTime timestamp, length bigint, folder boolean"


def _store(store: str):
    """(file system, what its paths begin with)"""
    from pyarrow import fs
    if store == LOCAL:
        return fs.LocalFileSystem(), ""
    filesystem, base = fs.FileSystem.from_uri(store + "/")
    return filesystem, base.rstrip("/")


def _entries(store: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, milliseconds) of what is in a folder; of a local one, one at a time."""
    from pyarrow import fs
    filesystem, base = _store(store)
    if store == LOCAL:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    s = e.stat()
                except FileNotFoundError:       # gone meanwhile, or a link to nothing
                    continue
                yield e.name, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns // 1_000_000
    else:
        for i in filesystem.get_file_info(fs.FileSelector(base + folder)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) // 1_000_000


def _hidden(name: str, is_folder: bool) -> bool:
    """As Spark's readers have it."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _list_level(store: str, pattern: str | None, inside: bool, wanted: str | None):
    """Of folders, the entries that match ``pattern``; files only where they are wanted (``inside``)."""
    schema = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("folder", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for folder in b.column("path").to_pylist():
                for name, is_folder, size, ms in _entries(store, folder):
                    if pattern is None and _hidden(name, is_folder) or pattern is not None and not re.fullmatch(pattern, name, re.S):
                        continue
                    # Spark's readers leave out empty files.
                    if is_folder or inside and size and not _hidden(name, False) and (wanted is None or re.fullmatch(wanted, name, re.S)):
                        rows.append((f"{folder.rstrip('/')}/{name}", ms * 1000, size, is_folder))
                    if len(rows) == LISTED_ROWS:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()
    return run


def _place(spark: SparkSession, path: str) -> tuple[str, str, list[str]] | None:
    """(store, folder, patterns below it as regular expressions), or None for what only Spark's readers list."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    uri, parts = whole.toUri(), whole.toUri().getPath().strip("/").split("/")
    store = LOCAL if uri.getScheme() == "file" else f"{uri.getScheme()}://{uri.getAuthority() or ''}"
    n = next((i for i, part in enumerate(parts) if re.search(r"[{}\[\]*?\\]", part)), len(parts))
    if re.search(r"\{[^}]*/", "/".join(parts)) or "\\" in path:
        return None
    folder = "/" + "/".join(parts[:n])
    top = jvm.Path(whole.toUri().resolve("/")) if n == 0 else jvm.Path(f"{store}{folder}")
    try:
        _store(store)
    except Exception:  # noqa: BLE001 -- each store has errors of its own
        return None
    if not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        return None
    return store, folder, [jvm.GlobPattern(part).compiled().pattern() for part in parts[n:]]


def file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length)`` of every file under ``path``."""
    place = _place(spark, path)
    found = _inventory(spark, *place, glob) if place else None
    if found is None:
        r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            r = r.option("pathGlobFilter", glob)
        found = r.load(path).select("path", "modificationTime", "length")
    return _dealt(found)


def _inventory(spark: SparkSession, store: str, folder: str, patterns: list[str], glob: str | None) -> DataFrame | None:
    """The files, or None if nothing matches the patterns."""
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern() if glob else None
    cores = spark.sparkContext.defaultParallelism
    folders, levels = spark.range(1).select(F.lit(folder).alias("path")), []
    while True:
        k = len(levels)
        inside = k + 1 >= len(patterns)
        levels.append(stored(folders.mapInArrow(_list_level(store, patterns[k] if k < len(patterns) else None, inside, wanted), _LISTED)))
        folders = levels[-1].where("folder").select("path")
        n = folders.count()
        if k < len(patterns) and not n and (not inside or levels[-1].isEmpty()):
            return None
        if not n:
            break
        folders = folders.repartition(min(n, max(4 * cores, n // FOLDERS)))
    files = reduce(DataFrame.union, levels).where("NOT folder")
    return files.select(F.concat(F.lit(store), "path").alias("path"), "modificationTime", "length")


_DOCX_PARA = re.compile(rb"</w:p>")
_DOCX_TEXT = re.compile(rb"<w:t(?:\s[^>]*)?>([^<]*)</w:t>")
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_TEXT = re.compile(rb"(?:\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)\s*Tj|\[(?:\((?:\\.|[^\\)])*\)|[^\](])*\]\s*TJ")
_PDF_STR = re.compile(rb"\(((?:\\.|[^\\)])*)\)|<([0-9A-Fa-f\s]*)>")


def _docx_text(data: bytes) -> str:
    from html import unescape
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml")
    paras = [b"".join(_DOCX_TEXT.findall(p)) for p in _DOCX_PARA.split(xml)]
    return "\n".join(unescape(p.decode("utf-8")) for p in paras if p)


def _pdf_unescape(s: bytes) -> str:
    def one(m):
        if m.group(1).isdigit():
            return bytes([int(m.group(1), 8) & 255])
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m.group(1), m.group(1))
    return re.sub(rb"\\([0-7]{1,3}|[nrtbf()\\])", one, s).decode("latin-1")


def _pdf_hex(s: bytes) -> str:
    digits = b"".join(s.split())
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")


def _pdf_text(data: bytes) -> str:
    lines = []
    for raw in _PDF_STREAM.findall(data):
        try:
            body = zlib.decompress(raw)
        except zlib.error:
            body = raw
        for op in _PDF_TEXT.findall(body):
            lines.append("".join(_pdf_hex(h) if h else _pdf_unescape(s) for s, h in _PDF_STR.findall(op)))
    if not lines:
        raise ValueError("no text that can be extracted")
    return "\n".join(lines)


def extract_text(path: str, data: bytes) -> str:
    low = path.lower()
    if low.endswith(".docx"):
        return _docx_text(data)
    if low.endswith(".pdf") or data[:5] == b"%PDF-":
        return _pdf_text(data)
    return data.decode("utf-8")


def parse_documents(spark: SparkSession, path: str, glob: str | None = None,
                    extractor=extract_text) -> DataFrame:
    """``(path, text, error)`` per file; ``extractor(path, bytes) -> str``."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = _dealt(r.load(path).select("path", "content"))

    def run(it):
        for pdf in it:
            texts, errs = [], []
            for p, c in zip(pdf["path"], pdf["content"]):
                try:
                    texts.append(extractor(p, bytes(c))), errs.append(None)
                except Exception as e:  # noqa: BLE001 -- error row, job goes on
                    texts.append(None), errs.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errs})

    return files.mapInPandas(run, "path string, text string, error string")
