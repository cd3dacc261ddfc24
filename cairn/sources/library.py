"""Photo libraries as a source: assets, previews, albums, and the scan that follows assets rather than files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import transitions as T
from cairn.sources.files import COUNTERS, hash_files
from cairn.workspace import cut


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """``uuid, path, hidden`` of a JSON file of ``[uuid, path or null, hidden]`` triples."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("a"))
    return rows.select(F.get("a", F.lit(0)).alias("uuid"), F.get("a", F.lit(1)).alias("path"), F.coalesce(F.get("a", F.lit(2)) == "true", F.lit(False)).alias("hidden"))


def previews(assets: DataFrame, files: DataFrame, width: int = 36) -> DataFrame:
    """``uuid, preview``: the largest file whose name begins with the uuid, of ``width`` characters, as those of libraries are."""
    named = files.withColumn("uuid", F.substring(F.substring_index("path", "/", -1), 1, width))
    best = named.groupBy("uuid").agg(F.max_by("path", F.struct("size", "path")).alias("preview"))
    return assets.select("uuid").distinct().join(best, "uuid")


def pick(table: DataFrame, *names: str) -> Column:
    """The first column of the table that has one of the names, whatever the case; an error names what was looked for."""
    have = {c.lower(): c for c in table.columns}
    for name in names:
        if name.lower() in have:
            return F.col(have[name.lower()])
    raise ValueError(f"none of the columns {', '.join(names)} is there")


def album_members(albums: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """``version`` of the members of albums of this name, whatever the case; members refer to an album by uuid, else by row id."""
    own = albums.where(F.lower(pick(albums, "name", "albumName")) == name.lower())
    album = pick(members, "albumUuid", "albumId", "album")
    by_uuid = own.select(pick(own, "uuid", "albumUuid").cast("string").alias("ref"))
    by_row = own.select(pick(own, "modelId", "rowid", "id").cast("string").alias("ref"))
    rows = members.select(album.cast("string").alias("ref"), pick(members, "versionId", "versionUuid", "version").cast("string").alias("version"))
    found = rows.join(by_uuid, "ref", "left_semi")
    return (found if not found.isEmpty() else rows.join(by_row, "ref", "left_semi")).select("version").distinct()


def library_paths(tables: dict[str, DataFrame], root: str, album: str | None = None, favorites: bool = False, uuids: DataFrame | None = None) -> DataFrame:
    """``path`` of the originals of a library that are in the album, are favourites and have one of the uuids, as far as asked.

    ``tables`` holds versions and masters, and albums and members for an album. Versions are referred to by uuid or row id, masters
    too; relative paths lie under ``root``. A uuid that no version has is an error.
    """
    versions, masters = tables["versions"], tables["masters"]
    rows = versions.select(
        pick(versions, "uuid", "versionUuid").cast("string").alias("uuid"), pick(versions, "modelId", "rowid", "id").cast("string").alias("row"),
        pick(versions, "masterUuid", "masterId").cast("string").alias("master"), F.coalesce(pick(versions, "isFavorite", "favorite", "isFlagged").cast("boolean"), F.lit(False)).alias("favorite"),
    )
    if uuids is not None:
        unknown = uuids.select(F.lower("uuid").alias("u")).join(rows.select(F.lower("uuid").alias("u")), "u", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"unknown uuids: {', '.join(r['u'] for r in unknown)}")
        rows = rows.join(uuids.select(F.lower("uuid").alias("u")).distinct(), F.lower("uuid") == F.col("u"), "left_semi")
    if favorites:
        rows = rows.where("favorite")
    if album is not None:
        wanted = album_members(tables["albums"], tables["members"], album)
        named = rows.withColumn("version", F.explode(F.array_distinct(F.array("uuid", "row"))))  # one key, whichever of the two an album refers to
        rows = named.join(wanted, "version", "left_semi").drop("version")
    path = pick(masters, "imagePath", "path")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    refs = [masters.select(c.cast("string").alias("master"), whole.alias("path")) for c in (pick(masters, "uuid", "masterUuid"), pick(masters, "modelId", "rowid", "id"))]
    return rows.join(refs[0].union(refs[1]), "master").select("path").distinct()


def _settled(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a step changes, written, so that the next ones don't make them anew."""
    changed = ("photos", "locations", "photo_assets", "changed")
    return {name: cut(t, name) if name in changed else t for name, t in tables.items()}


def scan_library(tables: dict[str, DataFrame], assets: DataFrame, files: DataFrame, shown: DataFrame, source_id: int, *, digest: Callable[[DataFrame], DataFrame] = hash_files, queue_previews: bool = True, now: str | None = None) -> dict[str, DataFrame]:
    """All tables after a scan of the ``assets`` (uuid, path, hidden) of a library, and ``stats``.

    ``files`` (path, mtime, size) lists the originals that are there, ``shown`` (uuid, preview) the previews. An original that is
    there and not known brings its content: a deferred row takes it, or goes if a photo has it, else a photo begins. Without
    its original, an asset that has a photo is flagged as offloaded, and another waits as a deferred row, or is queued if it has a
    preview. Then every asset points to its photo, and the library's hidden flag is taken over.
    """
    first = {c.name for c in tables["photos"].schema}
    here = assets.join(files.select("path", "mtime", "size"), "path")
    known = tables["locations"].where(F.col("source_id") == source_id).select("path", "mtime", "size", "photo_id")
    waiting = tables["photos"].where(F.col("sha256").startswith("deferred:")).select(F.substring("sha256", 10, 2**30).alias("uuid"), F.col("id").alias("waits"), F.col("derivative").alias("had_preview"))
    met = here.join(known, ["path", "mtime", "size"], "left").join(waiting, "uuid", "left")
    same = met.where("photo_id is not null and waits is null").select("uuid", "photo_id", "hidden")
    arrived = cut(digest(met.where("photo_id is null or waits is not null").select("uuid", "path", "mtime", "size", "hidden", "waits")).select("uuid", "path", "mtime", "size", "hidden", "waits", "sha256"), "arrived")
    came = arrived.where("sha256 is not null").select("uuid", "sha256", F.col("size").alias("byte_size"), F.lit(source_id).cast("long").alias("source_id"), "path", "mtime")
    after = _settled(T.promote_arrivals(tables, came, now=now))
    away = assets.join(files.select("path"), "path", "left_anti").join(shown, "uuid", "left")
    linked = tables["photo_assets"].where(F.col("source_id") == source_id).select(F.lower("uuid").alias("u"), "photo_id")
    left = cut(away.join(linked, F.lower("uuid") == F.col("u"), "left").drop("u"), "away")
    evicted = left.where("photo_id is not null")
    after = T.demote_offloaded(after, evicted.select(F.col("photo_id").alias("id"), "preview"), files, source_id)
    after = _settled(after)
    offloaded = after.pop("changed")
    unknown = left.where("photo_id is null").drop("photo_id").join(waiting, "uuid", "left")
    fresh = unknown.where("waits is null or (preview is not null and not had_preview)")
    after = T.ensure_deferred(after, fresh.select("uuid", F.col("preview").alias("path"), F.col("preview").isNotNull().alias("derivative"), "hidden"), source_id, queue_previews, now)
    after = _settled(after)
    if queue_previews:
        shows = fresh.where("waits is not null").select(F.col("waits").alias("id"))
        after["photos"] = T.merge_by_key(after["photos"], shows, ["id"], {"status": F.lit("queued")}, F.col("old.status") == "deferred", insert=False)
    by_hash = after["photos"].select("sha256", F.col("id").alias("photo_id"))
    owners = same.select("uuid", "photo_id").unionByName(came.select("uuid", "sha256").join(by_hash, "sha256").select("uuid", "photo_id"))
    owners = owners.unionByName(evicted.select("uuid", "photo_id")).unionByName(unknown.select("uuid", T.deferred_key(F.col("uuid")).alias("sha256")).join(by_hash, "sha256").select("uuid", "photo_id"))
    owners = cut(owners, "owners")
    after["photo_assets"] = T.record_assets(after["photo_assets"], owners.select(F.lit(source_id).cast("long").alias("source_id"), "uuid", "photo_id"))
    flags = owners.join(assets.select("uuid", "hidden"), "uuid").groupBy(F.col("photo_id").alias("id")).agg(F.max("hidden").alias("hidden"))
    after["photos"] = T.sync_hidden(after["photos"], flags).select(*first)
    counted = {
        "images_found": assets, "new_photos": arrived.where("sha256 is not null and waits is null"), "updated": arrived.where("sha256 is not null and waits is not null"), "unchanged": same, "errors": arrived.where("sha256 is null"),
        "deferred": fresh.where("preview is null"), "previews": fresh.where("preview is not null"), "offloaded": offloaded, "library_hidden": owners.join(assets.where("hidden").select("uuid"), "uuid"),
    }
    rows = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in counted.items()]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    after["stats"] = all_rows.agg(*[F.coalesce(F.sum(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS])
    return after
