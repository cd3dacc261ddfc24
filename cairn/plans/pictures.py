"""Picture files that stand for the vectors of the test tables, and the queries over them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.schema import TABLES
from cairn.sources import driver_views as D
from cairn.sources import files
from cairn.sources.pixels import HIGH, WIDE
from cairn.sources.walk import store_of
from cairn.workspace import fresh_dir


def exif_block(original: str, order: str) -> bytes:
    """Exif data with one tag, the time at which a picture was taken."""
    text = original.encode() + b"\0"
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8)
    main = struct.pack(f"{order}HHHIII", 1, 0x8769, 4, 1, 26, 0)
    return head + main + struct.pack(f"{order}HHHIII", 1, 0x9003, 2, len(text), 44, 0) + text


def png(gray: np.ndarray, exif: bytes | None = None) -> bytes:
    """A gray picture as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + row.tobytes() for row in gray.astype(np.uint8))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)), chunk(b"eXIf", exif) if exif else b"", chunk(b"IDAT", zlib.compress(rows)), chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, vector, taken in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.floor((np.asarray(vector, dtype=np.float64) + 1) * 100).clip(0, 255)
            gray = values[np.arange(WIDE * HIGH) % len(values)].reshape(HIGH, WIDE)
            store, place = store_of(f"{root}/_edited/{i % 5}/_IMG {i}.png")
            store.create_dir(place.rpartition("/")[0], recursive=True)
            with store.open_output_stream(place) as sink:
                sink.write(png(gray, exif_block(taken, "<>"[i % 2]) if taken else None))
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def write_pictures(c: D.Catalog) -> str:
    """A PNG file for each vector, most with a capture time, in a tree whose names begin with an underscore; where it is."""
    root = fresh_dir(c.photos.sparkSession, "pictures")
    days = F.timestamp_add("DAY", (F.col("photo_id") % 365).cast("int"), F.lit("2011-03-15 08:00:00").cast("timestamp_ntz"))
    taken = F.when(F.col("photo_id") % 4 != 0, F.date_format(days, "yyyy:MM:dd HH:mm:ss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write(batches, root)

    c.embeddings.where(F.size("vector") > 0).select("photo_id", "vector", taken).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
    return root


def _id(path: str = "path"):
    return F.regexp_extract(path, "_IMG ([0-9]+)", 1).cast("long").alias("id")


def _empty(spark, *names: str) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], TABLES[n]) for n in names}


def scanned(c: D.Catalog) -> DataFrame:
    """``id, phash, date_taken`` of every picture file, found by a scan of its tree."""
    spark = c.photos.sparkSession
    after = files.scan(_empty(spark, "photos", "locations"), files.list_files(spark, write_pictures(c)), 1)
    return after["locations"].join(after["photos"].select(F.col("id").alias("photo_id"), "phash", "date_taken"), "photo_id").select(_id(), "phash", "date_taken")


def backfilled(c: D.Catalog) -> DataFrame:
    """One row: what a backfill of dates finds in the files of a catalog that has none."""
    spark = c.photos.sparkSession
    listing = files.list_files(spark, write_pictures(c))
    photos = listing.select(_id(), F.lit(None).cast("timestamp_ntz").alias("date_taken"))
    places = listing.select(_id(), _id().alias("photo_id"), "path")
    return files.date_counts(photos, files.find_dates(photos, places, listing), use_file_time=False)


_WALK = "list_transform(range(1, 64), lambda p: CASE WHEN q[1 + (p // 8 * 9 + p % 8) % 64] > q[1 + (p // 8 * 9 + p % 8 + 1) % 64] THEN CAST(1 AS BIGINT) << (63 - p) ELSE 0 END)"
SCANNED_SQL = f"""SELECT id, CAST(list_sum({_WALK}) AS BIGINT) AS phash, CASE WHEN id % 4 <> 0 THEN TIMESTAMP '2011-03-15 08:00:00' + to_days(CAST(id % 365 AS INTEGER)) END AS date_taken
FROM (SELECT photo_id AS id, list_transform(vector, lambda x: least(255, greatest(0, floor((CAST(x AS DOUBLE) + 1) * 100)))) AS q FROM photo_embeddings)"""
BACKFILLED_SQL = "SELECT count(*) FILTER (photo_id % 4 <> 0) AS from_exif, CAST(0 AS BIGINT) AS from_file, count(*) FILTER (photo_id % 4 = 0) AS undated FROM photo_embeddings"
