"""Ingest of picture files: listing, sniffing, slices, fast path, hashing and dedup by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.transitions import fill_dates, insert_new, merge_by_key, place
from cairn.sources import exif, pixels
from cairn.sources.walk import BAD_NAME, CLOSED, LOST, list_files, store_of, walk_errors
from cairn.workspace import cut

__all__ = ["list_files", "walk_errors"]

#: Extensions read as pictures and extensions passed over.
IMAGES = "jpg jpeg jfif png heic heif tif tiff webp bmp gif jp2 jpx j2k pict pct psd tga ico dng cr2 crw nef arw orf raf rw2 sr2 pef".split()
OTHERS = "mov mp4 m4v avi mkv 3gp wmv db db-wal db-shm plist aae json xml txt rtf pdf mp3 m4a wav aiff zip gz".split()
#: First bytes of picture formats, as hex.
MAGIC = ("FFD8FF", "89504E47", "47494638", "424D", "49492A00", "4D4D002A", "0000000C6A5020200D0A870A", "38425053", "00000100")
#: Suffixes of photo libraries, and where their originals lie.
LIBRARY_SUFFIXES = (".photoslibrary", ".photolibrary")
ORIGINALS = ("originals", "Originals", "Masters", "masters")
#: What a scan counts.
COUNTERS = ("images_found", "new_photos", "updated", "unchanged", "errors", "slice_skipped", "deferred", "previews", "bad_names", "offloaded", "library_hidden", "vision_ocr")


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def by_name(path: Column) -> Column:
    """Whether the extension says picture or not; null if it says nothing."""
    return F.when(extension(path).isin(*IMAGES), True).when(extension(path).isin(*OTHERS), False)


def sniffed(head: Column) -> Column:
    """Whether the first bytes are those of a picture format."""
    found = F.hex(F.substring(head, 1, 12))
    other = (found.startswith("52494646") & found.endswith("57454250")) | F.substring(found, 9, 8).isin("66747970")
    return reduce(lambda a, b: a | b, [found.startswith(m) for m in MAGIC], other)


def is_image(path: Column, content: Column) -> Column:
    """By extension, else by the first bytes."""
    return F.coalesce(by_name(path), sniffed(content))


def hash_files(files: DataFrame) -> DataFrame:
    """``files`` with ``sha256`` and ``head`` (16 bytes), read in pieces by the task that has the path; both null if it can't be read."""
    return _read(files, "sha256 string, head binary")


def read_files(files: DataFrame) -> DataFrame:
    """As ``hash_files``, and what the header says of capture time and size: each file is read once."""
    return _read(files, f"sha256 string, head binary, {exif.COLUMNS}")


def _read(files: DataFrame, added: str) -> DataFrame:
    names = [c.split(" ")[0] for c in added.split(", ")]
    kept = files.select(*[c for c in files.columns if c not in names])
    kinds = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[c.split(" ")[1]] for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(p) for p in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), added]))


def _digest(path: str) -> tuple:
    """Digest, first bytes and header fields of a file; nulls if it can't be read."""
    try:
        store, place_ = store_of(path)
        found, head = hashlib.sha256(), b""
        with store.open_input_stream(place_) as stream:
            while piece := stream.read(1 << 20):
                head = head or piece
                found.update(piece)
        return found.hexdigest(), head[:16] or None, *exif.header(head)
    except OSError:
        return None, None, *exif.Header()


def resolve_source(spark: SparkSession, path: str) -> tuple[str, str]:
    """Where the pictures of a source lie, and its kind: a library is entered at the first folder of originals that it has."""
    jvm = spark.sparkContext._jvm
    root = path.rstrip("/")
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(jvm.org.apache.hadoop.fs.Path(root)):
        raise FileNotFoundError(f"path not found: {path}")
    if not root.endswith(LIBRARY_SUFFIXES):
        return root, "folder"
    for name in ORIGINALS:
        if store.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")):
            return f"{root}/{name}", "library"
    raise ValueError(f"{path} looks like a photo library without originals")


def register_source(sources: DataFrame, uri: str, kind: str) -> DataFrame:
    """The sources with this one, under the id it has or the next."""
    new = sources.sparkSession.createDataFrame([(uri, kind)], "uri string, kind string")
    return sources.unionByName(insert_new(sources, new, ["uri"], ["uri"]), allowMissingColumns=True)


def parse_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """``kind, id`` of the lines of an ids file, ``#`` comments and blank lines left out: a number, a path if it holds a slash, else a uuid.

    Paths and uuids are in lower case, for they compare without it.
    """
    line = F.trim(F.col(column))
    rows = lines.select(line.alias("line")).where("line <> '' and not startswith(line, '#')")
    kind = F.when(F.col("line").rlike("^[0-9]+$"), "id").when(F.col("line").contains("/"), "path").otherwise("uuid")
    return rows.select(kind.alias("kind"), F.lower("line").alias("id")).distinct()


def in_slice(files: DataFrame, allowed: list[DataFrame] = (), date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Files whose path is in every one of the ``allowed`` sets (path, without case) and whose time is in the range.

    The time is ``date_taken`` where the table has one, else the file's.
    """
    for paths in allowed:
        wanted = paths.select(F.lower("path").alias("allowed_")).distinct()
        files = files.join(wanted, F.lower(files["path"]) == wanted["allowed_"], "left_semi")
    written = F.timestamp_seconds("mtime").cast("timestamp_ntz")
    time = F.coalesce("date_taken", written) if "date_taken" in files.columns else written
    for bound, test in ((date_from, time.__ge__), (date_to, time.__le__)):
        if bound is not None:
            files = files.where(test(F.lit(bound).cast("timestamp_ntz")))
    return files


def unchanged(files: DataFrame, locations: DataFrame, source_id: int) -> DataFrame:
    """Files whose path, time and size are known; nothing of them is read."""
    return files.join(locations.where(F.col("source_id") == source_id).select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")


def dated(files: DataFrame) -> DataFrame:
    """``files`` with ``date_taken``, the capture time of their headers."""
    found = exif.with_headers(files)
    return found.withColumn("date_taken", taken_at(F.col("original"), F.col("changed"))).drop(*exif.Header._fields)


def _until(asked: DataFrame, digest: Callable[[DataFrame], DataFrame], photos: DataFrame, limit: int, is_picture: Column) -> DataFrame:
    """Files read in growing ranges of the walk, until they have brought ``limit`` contents that ``photos`` lacks."""
    seen, rest, size = None, asked, max(64, 4 * limit)
    while True:
        part = rest.orderBy("walk").limit(size).repartition("walk")
        got = cut(digest(part), "hashed")
        seen = got if seen is None else seen.unionByName(got)
        n, last = got.agg(F.count("*"), F.max("walk")).first()
        fresh = seen.where(is_picture & F.col("sha256").isNotNull()).select("sha256").distinct().join(photos.select("sha256"), "sha256", "left_anti")
        if n < size or fresh.count() >= limit:
            return seen
        rest, size = asked.where(F.col("walk") > last), size * 4


def scan(tables: dict[str, DataFrame], files: DataFrame, source_id: int, *, digest: Callable[[DataFrame], DataFrame] = read_files, allowed: list[DataFrame] = (), date_from: str | None = None, date_to: str | None = None, limit: int | None = None, now: str | None = None) -> dict[str, DataFrame]:
    """All tables after a scan of one source, and ``stats``, a row of what it counted.

    ``files`` (path, mtime, size, perhaps walk, problem, date_taken) is a listing; names that are no pictures are passed over, and empty files but
    for being found. Names that are no UTF-8 are counted, files that can't be looked at are errors.
    Files whose path, time and size are known are left out before anything is read; those left get ``sha256`` by ``digest``,
    null if they can't be read; a file that neither its name nor its first bytes show to be a picture is left. New content becomes a queued photo with the next id in order of the walk (without one, of path), known content only
    another location. With a ``limit`` the scan stops behind the file that brought that many new photos, and reads few files beyond it. A capture
    date of the listing, or that ``digest`` finds in the file, fills a gap; slices by date look into the heads of files where the listing has none. New photos of
    real files get their difference hash.
    """
    photos, locations = tables["photos"], tables["locations"]
    real = digest is read_files
    given_walk = files if "walk" in files.columns else files.withColumn("walk", F.col("path"))
    all_files = given_walk if "problem" in files.columns else given_walk.withColumn("problem", F.lit(None).cast("string"))
    named = all_files.where(F.coalesce("problem", F.lit("")) != CLOSED).withColumn("named_", by_name(F.col("path"))).where("coalesce(named_, true)")
    sound = F.col("problem").isNull() & (F.col("size") > 0)
    listed = named.where(F.coalesce("named_", sound))
    sized = listed.where(sound)
    if real and "date_taken" not in files.columns and (date_from is not None or date_to is not None):
        sized = cut(dated(sized), "dated")
    wanted = in_slice(sized, allowed, date_from, date_to)
    known = locations.where(F.col("source_id") == source_id).select("path", "mtime", "size")
    asked = wanted.join(known, ["path", "mtime", "size"], "left_anti")
    columns = ["path", "walk", "mtime", "size", "date_taken", "named_", "sha256", "head", *exif.Header._fields]
    pick = lambda rows: rows.select(*[c for c in columns if c in rows.columns])
    sniffs = "head" in digest(asked).columns
    is_picture = F.coalesce("named_", sniffed(F.col("head")), F.lit(False)) if sniffs else F.lit(True)
    looked = cut(pick(digest(asked)), "hashed") if limit is None else _until(asked, lambda rows: pick(digest(rows)), photos, limit, is_picture)  # every file is read once
    if "original" in looked.columns:
        found_date = taken_at(F.col("original"), F.col("changed"))
        looked = looked.withColumn("date_taken", F.coalesce("date_taken", found_date) if "date_taken" in looked.columns else found_date)
    read = looked.where(is_picture)
    good = read.where("sha256 is not null")
    least = [F.min_by(c, "walk").alias(n) for c, n in (("path", "path"), ("size", "byte_size"))]
    first = good.groupBy("sha256").agg(F.min("walk").alias("walk"), *least, *([F.min_by("width", "walk").alias("width"), F.min_by("height", "walk").alias("height")] if "width" in looked.columns else []))
    fresh = first.join(photos.select("sha256"), "sha256", "left_anti")
    if limit is not None:
        last = fresh.orderBy("walk").limit(limit).agg(F.when(F.count("*") == limit, F.max("walk")).alias("last_"))
        listed, sized, wanted, looked, read, good, fresh, asked = (t.crossJoin(F.broadcast(last)).where("last_ is null or walk <= last_").drop("last_") for t in (listed, sized, wanted, looked, read, good, fresh, asked))  # one row
    given = {"status": F.lit("queued"), "attempts": F.lit(0), "first_seen_at": F.lit(now).cast("timestamp_ntz")} | {c: F.lit(False) for c in ("tiled", "gated", "hidden", "derivative", "offloaded")}
    if real and "phash" in photos.columns:
        fresh = cut(fresh, "fresh")
        fresh = fresh.join(pixels.picture_hashes(fresh), "path", "left")
    added = insert_new(photos, fresh, ["sha256"], ["walk"]).withColumns(given)
    after = photos.unionByName(added.select(*[(F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in photos.schema]))
    owner = after.select(F.col("id").alias("photo_id"), "sha256")
    placed = good.join(owner, "sha256")
    if "date_taken" in good.columns:
        after = fill_dates(after, placed.where("date_taken is not null").select(F.col("photo_id").alias("id"), "date_taken"))
    where = place(locations, placed.select(F.lit(source_id).cast("long").alias("source_id"), "path", "photo_id", "mtime", "size"))

    def count(rows: DataFrame, **parts: Column | None) -> DataFrame:
        """One row: how many rows each condition holds for."""
        return rows.agg(*[F.count("*" if c is None else F.when(c, True)).alias(n) for n, c in parts.items()])

    counts = [
        count(listed, listed=None, bad_names=F.col("problem") == BAD_NAME, lost=F.col("problem") == LOST, sized=sound), count(wanted, in_slice=None), count(asked, asked=None),
        count(looked, looked=None, read=is_picture, unread=is_picture & F.col("sha256").isNull()), count(fresh, new_photos=None),
    ]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)  # one row each
    said = {
        "images_found": F.expr("listed - looked + read"), "updated": F.expr("read - unread - new_photos"), "unchanged": F.expr("in_slice - asked"), "errors": F.expr("unread + lost"),
        "slice_skipped": F.expr("sized - in_slice"), "new_photos": F.col("new_photos"), "bad_names": F.col("bad_names"),
    }  # a folder has no assets, so nothing is deferred, hidden by a library or offloaded
    stats = row.select(*[said.get(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS])
    return tables | {"photos": after, "locations": where, "stats": stats}


def total_stats(parts: list[DataFrame]) -> DataFrame:
    """One row with the sums of what several scans counted."""
    return reduce(DataFrame.unionByName, parts).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def scan_all(tables: dict[str, DataFrame], listings: dict[int, DataFrame], **options) -> dict[str, DataFrame]:
    """All sources one after another, each over the tables that the one before left; ``stats`` are the sums."""
    stats = []
    for source_id, files in listings.items():
        tables = scan(tables, files, source_id, **options)
        stats.append(tables["stats"])
    return tables | {"stats": total_stats(stats)}


def taken_at(original: Column, changed: Column) -> Column:
    """Capture time of two picture tags, the original before the other; zone and fractions are cut off, two formats are read."""
    raw = F.trim(F.when(F.coalesce(original, F.lit("")) != "", original).otherwise(changed))
    head = F.trim(F.substring_index(F.substring_index(raw, "+", 1), ".", 1))
    parsed = [F.try_to_timestamp(head, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def find_dates(photos: DataFrame, locations: DataFrame, listing: DataFrame) -> DataFrame:
    """``id, taken, mtime`` of each photo without a date, from the head of the first of its files that is there."""
    lacking = photos.where(F.col("date_taken").isNull()).select(F.col("id").alias("photo_id"))
    there = locations.join(lacking, "photo_id", "left_semi").join(listing.select("path", F.col("mtime").alias("written")).distinct(), "path")
    first = there.groupBy(F.col("photo_id").alias("id")).agg(F.min_by("path", "id").alias("path"), F.min_by("written", "id").alias("mtime"))
    return dated(first).select("id", F.col("date_taken").alias("taken"), "mtime")


def date_counts(photos: DataFrame, found: DataFrame, use_file_time: bool = False) -> DataFrame:
    """One row: dates that ``backfill_dates`` takes ``from_exif`` and ``from_file``, and photos that it leaves ``undated``."""
    rows = photos.where(F.col("date_taken").isNull()).select("id").join(found.select("id", "taken", "mtime"), "id", "left")
    by_file = F.col("taken").isNull() & F.col("mtime").isNotNull() & F.lit(use_file_time)
    return rows.agg(F.count_if(F.col("taken").isNotNull()).alias("from_exif"), F.count_if(by_file).alias("from_file"), F.count_if(F.col("taken").isNull() & ~by_file).alias("undated"))


def find_hashes(photos: DataFrame, locations: DataFrame, listing: DataFrame) -> DataFrame:
    """``id, phash`` of each photo without a hash, from the first of its files that is there, where that can be decoded."""
    lacking = photos.where(F.col("phash").isNull()).select(F.col("id").alias("photo_id"))
    there = locations.join(lacking, "photo_id", "left_semi").join(listing.select("path").distinct(), "path", "left_semi")
    first = cut(exif.with_headers(there.groupBy(F.col("photo_id").alias("id")).agg(F.min_by("path", "id").alias("path"))), "headers")
    return first.join(pixels.picture_hashes(first), "path").select("id", "phash")


def backfill_dates(photos: DataFrame, found: DataFrame, use_file_time: bool = False) -> DataFrame:
    """Dates ``(id, taken, mtime)`` where none is known: the capture time, else with ``use_file_time`` the file's."""
    fallback = F.timestamp_seconds("mtime").cast("timestamp_ntz") if use_file_time else F.lit(None).cast("timestamp_ntz")
    rows = found.select("id", F.coalesce("taken", fallback).alias("date_taken")).where("date_taken is not null")
    return fill_dates(photos, rows)


def fill_missing(photos: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Values ``(id, <column>)``, of hashes or recognised text, where the photo has none; trashed rows too."""
    return merge_by_key(photos, found.select("id", column).where(F.col(column).isNotNull()), ["id"], {column: F.coalesce(f"old.{column}", f"new.{column}")}, insert=False)
