"""A tree of files, listed by executors: folders are expanded round by round, and what can't be read becomes a row."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.workspace import cut

#: What is wrong with a listed name: it is no UTF-8, its file can't be looked at, or it is a folder that can't be read.
BAD_NAME, LOST, CLOSED = "name", "stat", "folder"
_ROWS = "raw binary, is_folder boolean, path string, mtime long, size long, walk string, problem string"
_BATCH = 4096


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it, taken as it is: names need no quoting."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file" or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if scheme == "file" else path
    authority, _, inner = rest.removeprefix("//").partition("/")
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0], "/" + inner


def _local(folder: bytes) -> Iterator[tuple[bytes, bool, int, int, str | None]]:
    for entry in os.scandir(folder):
        if entry.name.startswith(b".") or (entry.is_symlink() and entry.is_dir()):
            continue
        if entry.is_dir():
            yield entry.name, True, 0, 0, None
            continue
        try:
            found = entry.stat()
            yield entry.name, False, int(found.st_mtime), found.st_size, None
        except OSError:
            yield entry.name, False, 0, 0, LOST


def _remote(folder: bytes) -> Iterator[tuple[bytes, bool, int, int, str | None]]:
    store, place = store_of(folder.decode())
    for entry in store.get_file_info(pyarrow.fs.FileSelector(place)):
        if not entry.base_name.startswith("."):
            is_folder = entry.type == pyarrow.fs.FileType.Directory
            yield entry.base_name.encode(), is_folder, 0 if is_folder else int(entry.mtime.timestamp()), entry.size or 0, None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of each folder; ``walk`` sorts files of a folder by name before its folders, as a walk from the top meets them."""

    def ready(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["raw", "is_folder", "path", "mtime", "size", "walk", "problem"])

    for batch in batches:
        for folder, walk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, local = [], folder.startswith((b"file:", b"/"))
            try:
                for name, is_folder, mtime, size, problem in _local(b"/" + folder.removeprefix(b"file:").lstrip(b"/")) if local else _remote(folder):
                    raw = folder.rstrip(b"/") + b"/" + name
                    shown = raw.decode("utf-8", "backslashreplace")
                    bad = BAD_NAME if shown.encode() != raw else problem
                    rows.append((raw, is_folder, shown, mtime, size, f"{walk}\0{int(is_folder)}{name.decode('utf-8', 'backslashreplace')}", bad))
                    if len(rows) == _BATCH:
                        yield ready(rows)
                        rows = []
            except OSError:
                rows.append((folder, False, folder.decode("utf-8", "backslashreplace"), 0, 0, walk, CLOSED))
            if rows:
                yield ready(rows)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, mtime, size, walk, problem`` of all files of a tree; nothing of a file is read.

    Names that begin with a dot are skipped, no others; links to files are followed, links to folders are not. ``walk`` is the order of a walk
    from the top, each folder's files by name before its folders. A name that is no UTF-8 (shown with escapes), a file that
    can't be looked at and a folder that can't be read are rows with a ``problem``. Each round lists the folders of one depth, each in
    the task that has it.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    folders, levels = spark.createDataFrame([(bytearray(top.encode()), "")], "raw binary, walk string"), []
    while not levels or not folders.isEmpty():
        found = cut(folders.repartition("raw").mapInArrow(_expand, _ROWS), "walk")
        levels.append(found.where("not is_folder").select("path", "mtime", "size", "walk", "problem"))
        folders = found.where("is_folder").select("raw", "walk")
    return reduce(DataFrame.unionByName, levels)


def walk_errors(listing: DataFrame) -> DataFrame:
    """``path`` of the folders that could not be read."""
    return listing.where(F.col("problem") == CLOSED).select("path")
