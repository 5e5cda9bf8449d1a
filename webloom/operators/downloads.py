"""Download manifests (P14), last-write-wins files (W8), folder sets (A3),
and the sink that writes bodies to their destinations (K2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_path

DEFAULT_FILENAME = "downloaded_file"   # fixed value


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_folder(folder, root: str) -> Column:
    """path.resolve(root, folder): absolute folders kept, relative ones put under
    ``root``; '.' segments and trailing '/' removed, '..' applied."""
    f = _col(folder)
    raw = F.when(f.startswith("/"), f).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), f))
    segs = F.filter(F.split(raw, "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(segs, F.array().cast("array<string>"),
                        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0,
                                                                F.slice(acc, 1, F.size(acc) - 1))
                                              .otherwise(acc))
                        .otherwise(F.array_append(acc, s)))
    return F.concat(F.lit("/"), F.array_join(stack, "/"))


def file_name(url, filename=None) -> Column:
    """Explicit name if non-empty, else the last segment of the URL path
    (trailing '/' ignored, not decoded), else ``downloaded_file``.  NULL when
    the name must come from ``url`` and it is not a URL (the reference's
    ``new URL`` throws there)."""
    p = url_path(url)
    base = F.nullif(F.regexp_extract(F.coalesce(p, F.lit("")), r"([^/]+)/*$", 1), F.lit(""))
    derived = F.when(p.isNotNull(), F.coalesce(base, F.lit(DEFAULT_FILENAME)))
    if filename is None:
        return derived
    return F.coalesce(F.nullif(_col(filename), F.lit("")), derived)


def download_manifest(df: DataFrame, url_col: str, root: str, folder="downloads",
                      filename_col: str | None = None, keep: tuple = ()) -> DataFrame:
    """``(*keep, folder, filename, path)`` for each download request."""
    folder_col = folder if isinstance(folder, Column) else F.lit(folder)
    return (df.select(*keep, resolve_folder(folder_col, root).alias("folder"),
                      file_name(url_col, filename_col).alias("filename"))
            .withColumn("path", F.concat(F.col("folder"), F.lit("/"), F.col("filename"))))


def final_files(manifest: DataFrame, seq_col: str) -> DataFrame:
    """The write with the highest ``seq_col`` wins each path:
    ``(path, <seq_col>, n_writes)``; partial aggregation handles hot paths."""
    return manifest.groupBy("path").agg(F.max(seq_col).alias(seq_col),
                                        F.count(F.lit(1)).cast("bigint").alias("n_writes"))


def distinct_folders(manifest: DataFrame, default_folder: str) -> DataFrame:
    """A3: distinct destination folders other than the default one."""
    return manifest.where(F.col("folder") != default_folder).select("folder").distinct()


def _fs_path(path: str) -> str:
    # Spark reports local folders as 'file:/x'; pyarrow wants 'file:///x'.
    if path.startswith("file:/") and not path.startswith("file:///"):
        return "file://" + path[5:]
    if "://" not in path:
        return "file://" + path
    return path


def write_downloads(df: DataFrame, body_col: str, path_col: str) -> int:
    """K2: write each row's body to its path (overwrite, via a temporary name
    and a rename, so a retried task leaves the same file); the number of files
    written.  Runs on the executors through ``pyarrow.fs`` in Arrow batches,
    so the paths must be on storage every executor reaches (the shared
    folder, HDFS, S3 ...).  Paths must be unique: feed it :func:`final_files`
    output.  Rows with a NULL path are refused; a NULL body is an empty file."""
    import pyarrow as pa

    def write_part(batches):
        from pyspark import TaskContext
        from pyarrow import fs as pafs
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                filesystem, p = pafs.FileSystem.from_uri(_fs_path(path))
                parent = p.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                tmp = f"{p}.{attempt}.part"
                with filesystem.open_output_stream(tmp, compression=None) as fh:
                    fh.write(body or b"")
                filesystem.move(tmp, p)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = df.select(F.col(path_col).cast("string").alias("path"), F.col(body_col).cast("binary").alias("body"))
    return rows.mapInArrow(write_part, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
