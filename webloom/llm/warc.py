"""WARC archives: a writer, and a sequential reader.

An archive is a sequence of gzip members, one for each record.  The reader
goes through an archive from its first byte: it inflates each member with
an incremental zlib decompressor, in pieces of ``READ_BYTES``, frames the
record's block by its Content-Length, and compares the SHA-1 of block and
payload with the digests that the record has.  A member or record that is cut off or damaged, or
whose digest differs, ends the archive with an error, never with rows that
look whole.

Archives are files in the shared folder.  The writer's tasks write one or
more each under a name of their own attempt, and rename it when it is
complete, so a task that runs again leaves one archive; what was written
is told by a manifest of (path, records, bytes).  The reader's tasks take
whole archives, ``MAX_ARCHIVE_BYTES`` each at most before the last record.

Defined results: of records with equal payloads (SHA-1 and length) of
``min_bytes`` or more, the rows with the largest page_id are responses and
the others revisit it; a null payload counts as empty; a null page_id is
smaller than every other, and if all ids of a payload are null they are
responses; repeated rows are written one by one; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import cores, small_batches
from webloom.session import checkpoint_dir

READ_BYTES = 1 << 16
MAX_ARCHIVE_BYTES = 1 << 28
MAX_HEADER_BYTES = 1 << 16
LEVEL = 6
_CRLF2 = b"\r\n\r\n"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([z.compress(head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode()),
                     z.compress(block), z.compress(_CRLF2), z.flush()])


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit record without the payload."""
    headers = {"WARC-Type": "response" if refers_to is None else "revisit",
               "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
               "WARC-Target-URI": " ".join((url or "").split()),
               "WARC-Payload-Digest": f"sha1:{digest(payload)}",
               "X-Payload-Length": str(len(payload))}
    if refers_to is None:
        headers["WARC-Block-Digest"] = headers["WARC-Payload-Digest"]
        return record(headers, payload)
    headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>",
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record(headers, b"")


class _Members:
    """The inflated bytes of a stream, one gzip member after the other."""

    def __init__(self, stream):
        self.stream, self.rest, self.z = stream, b"", None

    def begin(self) -> bool:
        """Open the next member; False at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        self.z = zlib.decompressobj(31) if self.rest else None
        return self.z is not None

    def read(self) -> bytes:
        """The next piece of the member, empty at its end; never more than READ_BYTES."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.rest or self.stream.read(READ_BYTES)
            if not data:
                raise WarcError("a gzip member is cut off")
            self.rest = b""
            try:
                out = self.z.decompress(data, READ_BYTES)
            except zlib.error as e:
                raise WarcError(f"a gzip member is damaged: {e}") from e
            if self.z.eof:
                self.rest = self.z.unused_data
            if out:
                return out
        return b""


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, in order."""
    members = _Members(stream)
    while members.begin():
        head = b""
        while _CRLF2 not in head:
            piece = members.read()
            if not piece:
                raise WarcError("a record has no end of its header")
            head += piece
            if len(head) > MAX_HEADER_BYTES + READ_BYTES:
                raise WarcError("a record's header is too long")
        head, _, first = head.partition(_CRLF2)
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record has no length") from e
        parts, have = [first], len(first)
        while piece := members.read():
            parts.append(piece)
            have += len(piece)
            if have > length + 4:
                raise WarcError("a record is longer than its length")
        body = b"".join(parts)
        if have != length + 4 or body[length:] != _CRLF2:
            raise WarcError("a record's length is wrong")
        block = body[:length]
        _verify(headers, block)
        yield headers, block


def _verify(headers: dict[str, str], block: bytes) -> None:
    """Whichever SHA-1 digest a record has must be that of its block or payload.

    The payload is the block, or what follows the header of an HTTP message;
    a revisit names the payload of another record, which is not here.
    """
    said, of_payload = headers.get("warc-block-digest"), headers.get("warc-payload-digest")
    if headers.get("warc-type") == "revisit":
        of_payload = None
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(_CRLF2)[2]
    checks = {said: block} if payload is block and said == of_payload else {said: block, of_payload: payload}
    for text, data in checks.items():
        if text is not None and text.startswith("sha1:") and text != f"sha1:{digest(data)}":
            raise WarcError(f"the digest of {headers.get('warc-record-id')} differs")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses).

    Payload digests go through the shuffle, and the payloads once, by page;
    a group of equal payloads is only a minimum, never a task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = [F.sha1("payload").alias("sha"), F.length("payload").alias("n")]
    ids = rows.select("page_id", *key).distinct()
    top = ids.groupBy("sha", "n").agg(F.max("page_id").alias("top"))
    later = (ids.join(top, ["sha", "n"]).where((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")))
             .select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "top"))
    keyed = rows.select("*", F.sha1("payload").alias("sha"))
    return (keyed.join(later, keyed["page_id"].eqNullSafe(later["_id"]) & (keyed["sha"] == later["_sha"]), "left")
            .select("page_id", "url", "payload", F.col("top").alias("refers_to")))


def write_archives(rows: DataFrame, folder: str, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write ``with_revisits`` rows to archives below ``folder``; the manifest: path, records, bytes."""
    small_batches(rows.sparkSession)

    def run(batches):
        store, root = _store(folder)
        task = TaskContext.get()
        out, name, count, size, number = None, None, 0, 0, 0

        def close():
            out.close()
            final = f"{root}/part-{task.partitionId():06d}-{number:04d}.warc.gz"
            if store.get_file_info(final).type != pafs.FileType.NotFound:
                store.delete_file(final)
            store.move(name, final)
            return pa.RecordBatch.from_arrays([pa.array([final]), pa.array([count]), pa.array([size])],
                                              ["path", "records", "bytes"])

        for b in batches:
            for page, url, payload, refers in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if out is None:
                    name = f"{root}/_attempt-{task.taskAttemptId()}-{number}"
                    out, count, size = store.open_output_stream(name, compression=None), 0, 0
                data = page_record(page, url, payload, refers)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= max_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return rows.mapInArrow(run, "path string, records long, bytes long")


def _store(folder: str):
    """The file system of a folder, and its path there; the folder is made if needed."""
    if "://" not in folder and not folder.startswith("file:"):
        store, root = pafs.LocalFileSystem(), folder
    else:
        uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
        store, root = pafs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    return store, root


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record: page_id, record_type, refers_to, url, payload_digest, payload_bytes, payload (null: revisit)."""
    schema = ("page_id long, record_type string, refers_to long, url string, payload_digest string, "
              "payload_bytes long, payload binary")

    def number(uri: str | None):
        text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, _ = _store(folder)
        for b in batches:
            for path, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for h, block in read_records(stream):
                        kind = h["warc-type"]
                        rows.append((number(h["warc-record-id"]), kind, number(h.get("warc-refers-to")),
                                     h["warc-target-uri"], h["warc-payload-digest"].removeprefix("sha1:"),
                                     len(block) if kind == "response" else int(h["x-payload-length"]),
                                     block if kind == "response" else None))
                        size, seen = size + len(block), seen + 1
                        if len(rows) >= 512 or size >= 1 << 23:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)
                if seen != records:
                    raise WarcError(f"{path} has {seen} records, {records} were written")

    return manifest.select("path", "records").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, and read them back."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_revisits(pages, min_bytes), folder)
    # The archives are written here, once; the manifest has one row for each.
    manifest = manifest.checkpoint(eager=True).repartition(cores(spark), "path")
    return read_archives(manifest, folder)
