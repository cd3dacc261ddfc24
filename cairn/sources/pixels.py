"""Difference hashes of picture files, which Spark's image source decodes on the JVM."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import batched
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.walk import store_of
from cairn.workspace import cut, fresh_dir

#: Pictures of more pixels are not decoded.
MOST_PIXELS = 357_913_941
#: Columns and rows of the gray picture that is compared.
WIDE, HIGH = 9, 8
#: Files that one job decodes.
GROUP = 20_000
#: Fixed value: bits of a weight behind the point.
_BITS = 22
#: Names that the image source takes as they are; it hides some and reads others as patterns.
_PLAIN = r"^(?:file:)?[A-Za-z0-9/:.\-+= ]*/[A-Za-z0-9\-+= ][A-Za-z0-9_.\-+= ]*$"


@lru_cache(maxsize=64)
def weights(have: int, want: int) -> np.ndarray:
    """Fixed-point weights of a cubic filter whose support grows with the scale, a row for each value wanted."""
    scale = have / want
    wide = max(scale, 1.0)
    out = np.zeros((want, have), dtype=np.int64)
    for i in range(want):
        middle = (i + 0.5) * scale
        low, high = max(0, int(middle - 2 * wide + 0.5)), min(have, int(middle + 2 * wide + 0.5))
        x = np.abs((np.arange(low, high) - middle + 0.5) / wide)
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, -0.5 * (((x - 5) * x + 8) * x - 4), 0.0))
        w = w / w.sum()
        out[i, low:high] = np.trunc(w * (1 << _BITS) + np.where(w < 0, -0.5, 0.5))
    return out


def _shrunk(gray: np.ndarray, want: int) -> np.ndarray:
    """Columns brought to ``want``, rounded and clipped to a byte; in strips, so that a large picture takes little more room."""
    if gray.shape[1] == want:
        return gray
    w = weights(gray.shape[1], want).T
    strips = [np.clip(gray[i : i + 64].astype(np.int64) @ w + (1 << _BITS - 1) >> _BITS, 0, 255).astype(np.uint8) for i in range(0, len(gray), 64)]
    return np.concatenate(strips)


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Brightness of pixels stored as gray, or as blue, green and red with or without an alpha, which does not count."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels < 3:
        return pixels[:, :, 0]
    out = np.empty((height, width), dtype=np.uint8)
    for i in range(0, height, 256):
        b, g, r = (pixels[i : i + 256, :, c].astype(np.uint32) for c in range(3))
        out[i : i + 256] = (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16
    return out


def difference_hash(gray: np.ndarray) -> int:
    """63 bits of an 8 by 9 picture, row by row: whether a pixel is brighter than its right neighbour. The first of 64 is left out."""
    small = _shrunk(np.ascontiguousarray(_shrunk(gray, WIDE).T), HIGH).T.astype(np.int64)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(sum(1 << (63 - i) for i in np.flatnonzero(bits).tolist() if i))


def _staged(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Copies of files under names that the image source reads; a file that can't be copied is left out."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            ending = os.path.splitext(path)[1]
            name = f"{folder}/{hashlib.sha256(path.encode()).hexdigest()}{ending if ending.isascii() and ending[1:].isalnum() else ''}"
            try:
                (store, place), (other, target) = store_of(path), store_of(name)
                other.create_dir(os.path.dirname(target), recursive=True)
                with store.open_input_stream(place) as source, other.open_output_stream(target) as sink:
                    while piece := source.read(1 << 20):
                        sink.write(piece)
                rows.append((path, name))
            except OSError:
                continue
        yield pa.RecordBatch.from_pydict({"path": pa.array([r[0] for r in rows], pa.string()), "place": pa.array([r[1] for r in rows], pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for origin, width, height, channels, data in zip(*(batch.column(i) for i in range(5)), strict=True):
            if width.as_py() > 0 and height.as_py() > 0:
                rows.append((unquote(origin.as_py()), difference_hash(gray_of(data.as_buffer(), width.as_py(), height.as_py(), channels.as_py()))))
        yield pa.RecordBatch.from_pydict({"origin": pa.array([r[0] for r in rows], pa.string()), "phash": pa.array([r[1] for r in rows], pa.int64())})


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def within_budget(most_pixels: int = MOST_PIXELS) -> Column:
    """Whether a header names a size, and one that may be decoded."""
    return (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width").cast("long") * F.col("height") <= most_pixels)


def picture_hashes(files: DataFrame, *, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``path, phash`` of files (path, width, height) that can be decoded: formats that Java reads, among them JPEG, PNG, GIF and BMP.

    Files of more pixels, and files whose header names no size, are left out before their pixels are touched; so are files that
    turn out damaged. Files go to the image source in groups of ``GROUP`` by path, which is all that
    the driver holds of them; those with names that it would hide or take for patterns are copied to the shared
    folder first. Repeated paths count once; an empty table gives an empty result.
    """
    spark = files.sparkSession
    wanted = files.where(within_budget(most_pixels)).select("path").distinct()
    plain = F.col("path").rlike(_PLAIN)
    folder = fresh_dir(spark, "staged")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _staged(batches, folder)

    odd = wanted.where(~plain).mapInArrow(copy, "path string, place string")
    places = cut(wanted.where(plain).withColumn("place", F.col("path")).unionByName(odd), "places")
    parts = []
    for group in batched(places.select("place").toLocalIterator(), GROUP):
        images = spark.read.format("image").load([r.place for r in group]).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
        parts.append(cut(images.mapInArrow(_hashed, "origin string, phash long"), "hashes"))
    if not parts:
        return spark.createDataFrame([], "path string, phash long")
    found = reduce(DataFrame.unionByName, parts).select(_bare(F.col("origin")).alias("at_"), "phash")
    return places.join(found, _bare(F.col("place")) == F.col("at_")).select("path", "phash")
