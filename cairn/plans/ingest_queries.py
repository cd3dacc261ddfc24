"""Queries of ingest, libraries, models, geometry and pages, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import normalize as N
from cairn.operators import browse as B
from cairn.operators import cluster, extract, filters, geometry, people, search, transitions
from cairn.plans import pictures
from cairn.plans.queries import _ALIVE, _TOKENS, _VISIBLE, QUERIES, SQL, _add, _hashes, _reach, _term
from cairn.schema import TABLES
from cairn.sources import driver_views as D
from cairn.sources import files, library
from cairn.plans.stub_model import StubModel
from cairn.streaming import run

_NOW = "2024-08-08"


def _photos(c: D.Catalog) -> DataFrame:
    """All columns of the photos table; those that the test tables lack are null or false."""
    have = set(c.photos.columns)
    columns = [f.split(" ") for f in TABLES["photos"].split(", ")]
    lacking = {n: F.lit(False) if t == "boolean" else F.lit(None).cast(t) for n, t in columns if n not in have}
    return c.photos.withColumns(lacking).select(*[F.col(n).cast(t).alias(n) for n, t in columns])


def _locations(c: D.Catalog) -> DataFrame:
    return c.locations.select("id", "photo_id", "source_id", "path", (F.col("id") * 10).alias("mtime"), (F.col("id") % 100).alias("size"))


_LOCATED = "located AS (SELECT *, id * 10 AS mtime, id % 100 AS size FROM locations)"


def _tables(c: D.Catalog) -> dict[str, DataFrame]:
    return {"photos": _photos(c), "locations": _locations(c), "sources": c.sources, "photo_assets": _assets(c)}


# files: pages stand for the files of a source that the catalog has not seen

_EXT = "CASE page_id % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.mov' WHEN 3 THEN '' WHEN 4 THEN '.heic' ELSE '.txt' END"


def _listing(c: D.Catalog) -> DataFrame:
    spark = c.photos.sparkSession
    pages = spark.read.parquet(f"{c.folder}/pages.parquet")
    return pages.selectExpr("page_id", "html", f"concat('/web/', page_id, {_EXT}) AS path", "page_id * 7 AS mtime", "cast(length(html) AS bigint) AS size")


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sha256", F.when(F.col("page_id") % 11 != 0, F.sha2("html", 256))).withColumn("head", F.when(F.col("page_id") % 12 == 3, F.unhex(F.lit("ffd8ffe0"))).otherwise(F.unhex(F.lit("00"))))


_FILES = f"""listing AS (SELECT page_id, html, '/web/' || page_id || {_EXT} AS path, page_id * 7 AS mtime, length(html) AS size FROM pages WHERE html IS NOT NULL AND length(html) > 0 AND page_id % 6 NOT IN (2, 5)),
readable AS (SELECT *, CASE WHEN page_id % 11 <> 0 THEN sha256(html) END AS h FROM listing WHERE page_id % 6 <> 3 OR page_id % 12 = 3),
firsts AS (SELECT h AS sha256, min(path) AS path, arg_min(size, path) AS byte_size FROM readable WHERE h IS NOT NULL GROUP BY h)"""
_add("scan_new_photos", lambda c: files.scan(_tables(c), _listing(c), 99, digest=_digest, now=_NOW)["photos"].where(F.col("first_seen_at") == F.lit(_NOW).cast("timestamp_ntz")).select("id", "sha256", "byte_size", "status", "attempts", "hidden"), "SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY path) AS id, sha256, byte_size, 'queued' AS status, 0 AS attempts, false AS hidden FROM firsts WHERE sha256 NOT IN (SELECT sha256 FROM photos)", _FILES)
_add("scan_locations", lambda c: files.scan(_tables(c), _listing(c), 99, digest=_digest)["locations"].where("source_id = 99").select("path", "mtime", "size"), "SELECT path, mtime, size FROM readable WHERE h IS NOT NULL", _FILES)
_COUNTED = ["images_found", "new_photos", "updated", "unchanged", "errors", "slice_skipped"]
_add("scan_stats", lambda c: files.scan(_tables(c), _listing(c), 99, digest=_digest)["stats"].select(*_COUNTED), "SELECT count(*) AS images_found, n AS new_photos, count(*) FILTER (h IS NOT NULL) - n AS updated, 0 AS unchanged, count(*) FILTER (h IS NULL) AS errors, 0 AS slice_skipped FROM readable, (SELECT count(*) AS n FROM firsts WHERE sha256 NOT IN (SELECT sha256 FROM photos)) GROUP BY n", _FILES)
_add("scan_limit", lambda c: files.scan(_tables(c), _listing(c), 99, digest=_digest, limit=5)["locations"].where("source_id = 99").select("path"), "SELECT path FROM readable WHERE h IS NOT NULL AND path <= (SELECT max(path) FROM (SELECT path FROM firsts WHERE sha256 NOT IN (SELECT sha256 FROM photos) ORDER BY path LIMIT 5))", _FILES)


def _odd_listing(c: D.Catalog) -> DataFrame:
    """The pages with some empty, some of names that are no UTF-8, and some that can't be looked at."""
    return _listing(c).where("html IS NOT NULL").withColumn("size", F.expr("CASE WHEN page_id % 13 = 0 THEN 0L ELSE size END")).withColumn("problem", F.expr("CASE WHEN page_id % 17 = 1 THEN 'name' WHEN page_id % 19 = 2 THEN 'stat' END"))


def _counted(c: D.Catalog) -> DataFrame:
    listing = _odd_listing(c)
    known = listing.where("page_id % 5 = 1").select(F.col("page_id").alias("id"), F.col("page_id").alias("photo_id"), F.lit(99).cast("long").alias("source_id"), "path", "mtime", "size")
    return files.scan(_tables(c) | {"locations": _locations(c).unionByName(known)}, listing, 99, digest=_digest, date_from="1970-01-01T00:05:00")["stats"]


_add("scan_counters", _counted, """SELECT count(*) FILTER (c.named OR c.sound) - any_value(x.looked) + any_value(x.pictures) AS images_found, any_value(n) AS new_photos, any_value(x.pictures - x.unread - n) AS updated,
  count(*) FILTER (c.wanted) - any_value(x.looked) AS unchanged, count(*) FILTER (c.problem = 'stat' AND c.named) + any_value(x.unread) AS errors, count(*) FILTER (c.sound AND NOT c.wanted) AS slice_skipped,
  CAST(0 AS BIGINT) AS deferred, CAST(0 AS BIGINT) AS previews, count(*) FILTER (c.problem = 'name' AND c.named) AS bad_names, CAST(0 AS BIGINT) AS offloaded, CAST(0 AS BIGINT) AS library_hidden, CAST(0 AS BIGINT) AS vision_ocr
FROM counted c, fresh, (SELECT count(*) AS looked, count(*) FILTER (picture) AS pictures, count(*) FILTER (picture AND page_id % 11 = 0) AS unread FROM asked) x""", """counted AS (
  SELECT *, problem IS NULL AND size > 0 AS sound, mtime >= 300 AND problem IS NULL AND size > 0 AS wanted, sha256(html) AS h FROM (
    SELECT page_id, html, page_id * 7 AS mtime, CASE WHEN page_id % 13 = 0 THEN 0 ELSE length(html) END AS size, page_id % 6 <> 3 AS named,
      CASE WHEN page_id % 17 = 1 THEN 'name' WHEN page_id % 19 = 2 THEN 'stat' END AS problem FROM pages WHERE html IS NOT NULL AND page_id % 6 NOT IN (2, 5))
), asked AS (SELECT *, named OR page_id % 12 = 3 AS picture FROM counted WHERE wanted AND page_id % 5 <> 1),
fresh AS (SELECT count(DISTINCT h) AS n FROM asked WHERE picture AND page_id % 11 <> 0 AND h NOT IN (SELECT sha256 FROM photos))""")
_add("rescan_fastpath", lambda c: files.unchanged(_locations(c).withColumn("mtime", F.when(F.col("photo_id") == F.col("id"), F.col("mtime")).otherwise(F.col("mtime") + 1)), _locations(c), 0).select("id", "path"), "SELECT id, path FROM locations WHERE source_id = 0 AND photo_id = id")
_IN_TAGS, _IN_LIBRARY = "SELECT path FROM locations l JOIN tags t ON t.photo_id = l.photo_id", "SELECT path FROM locations l JOIN sources s ON s.id = l.source_id WHERE kind = 'library'"


def _album(c: D.Catalog) -> DataFrame:
    return c.locations.join(c.tags.select("photo_id"), "photo_id", "left_semi").select(F.upper("path").alias("path"))


def _in_libraries(c: D.Catalog) -> DataFrame:
    return c.locations.join(c.sources.where("kind = 'library'").select(F.col("id").alias("source_id")), "source_id").select("path")


_add("slice_paths_intersect", lambda c: files.in_slice(c.locations, [_album(c), _in_libraries(c)]).select("path"), f"SELECT path FROM locations WHERE path IN ({_IN_TAGS}) AND path IN ({_IN_LIBRARY})")
_add(
    "slice_files",
    lambda c: files.in_slice(_locations(c).join(c.photos.select(F.col("id").alias("photo_id"), "date_taken"), "photo_id"), [_in_libraries(c)], "1970-01-01", "2016-06-30T23:59:59").select("id"),
    f"SELECT l.id FROM located l JOIN photos p ON p.id = l.photo_id WHERE l.path IN ({_IN_LIBRARY}) AND coalesce(date_taken, TIMESTAMP '1970-01-01' + to_seconds(mtime)) BETWEEN TIMESTAMP '1970-01-01' AND TIMESTAMP '2016-06-30 23:59:59'",
    _LOCATED,
)
_add("ids_file", lambda c: files.parse_ids(c.locations.select(F.expr("CASE id % 5 WHEN 0 THEN concat(' ', id, ' ') WHEN 1 THEN upper(path) WHEN 2 THEN concat('# ', path) WHEN 3 THEN concat('AB-', id % 9) ELSE '  ' END").alias("value"))), "SELECT DISTINCT CASE id % 5 WHEN 0 THEN 'id' WHEN 1 THEN 'path' ELSE 'uuid' END AS kind, CASE id % 5 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN lower(path) ELSE 'ab-' || (id % 9) END AS id FROM locations WHERE id % 5 IN (0, 1, 3)")
_add(
    "date_taken",
    lambda c: c.photos.select("id", files.taken_at(F.expr("CASE id % 4 WHEN 0 THEN concat(date_format(first_seen_at, 'yyyy:MM:dd HH:mm:ss'), '.123') WHEN 1 THEN '' WHEN 2 THEN 'soon' END"), F.expr("concat(date_format(first_seen_at, 'yyyy-MM-dd HH:mm:ss'), ' +09:00')")).alias("taken")),
    "SELECT id, CASE WHEN id % 4 <> 2 THEN first_seen_at END AS taken FROM photos",
)
_add("scan_pictures", pictures.scanned, pictures.SCANNED_SQL)
_add("backfill_counts", pictures.backfilled, pictures.BACKFILLED_SQL)
_add("backfill_dates", lambda c: files.backfill_dates(c.photos, _locations(c).groupBy(F.col("photo_id").alias("id")).agg(F.min("mtime").alias("mtime"), F.lit(None).cast("timestamp_ntz").alias("taken")), use_file_time=True).select("id", "date_taken"), "SELECT p.id, coalesce(date_taken, TIMESTAMP '1970-01-01' + to_seconds(m)) AS date_taken FROM photos p LEFT JOIN (SELECT photo_id, min(mtime) AS m FROM located GROUP BY photo_id) l ON l.photo_id = p.id", _LOCATED)
_hashes("fill_hashes", lambda h: files.fill_missing(h.withColumn("phash", F.when(F.col("id") % 2 == 0, F.col("phash"))), h, "phash").select("id", "phash"), "SELECT id, phash FROM hashed", "none AS (SELECT 1)")
_add("source_registered", lambda c: files.register_source(c.sources.select("id", "uri", "kind"), "/new", "folder").unionByName(files.register_source(c.sources.select("id", "uri", "kind"), "src0", "folder")), "SELECT id, uri, kind FROM sources UNION ALL SELECT id, uri, kind FROM sources UNION ALL SELECT max(id) + 1, '/new', 'folder' FROM sources")

# assets and deferred photos


def _assets(c: D.Catalog) -> DataFrame:
    return c.locations.where("source_id = 0").select("source_id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), "photo_id")


_ASSETS = "assets AS (SELECT source_id, 'u' || id AS uuid, photo_id FROM locations WHERE source_id = 0)"
_add("record_assets", lambda c: transitions.record_assets(_assets(c), c.tags.select(F.lit(0).cast("long").alias("source_id"), F.concat(F.lit(" U"), F.col("photo_id").cast("string")).alias("uuid"), (F.col("photo_id") + 1).alias("photo_id"))), "SELECT 0 AS source_id, coalesce(a.uuid, 'U' || t.photo_id) AS uuid, coalesce(t.photo_id + 1, a.photo_id) AS photo_id FROM assets a FULL JOIN (SELECT DISTINCT photo_id FROM tags) t ON a.uuid = 'u' || t.photo_id", _ASSETS)
_UUID = "concat('ABCDEFAB-0000-0000-0000-', lpad(cast(photo_id AS string), 12, '0'))"
_add("spell_assets", lambda c: transitions.spell_assets(c.locations.where("source_id = 0").selectExpr("source_id", f"lower({_UUID}) AS uuid", "photo_id"), c.locations.where("id = photo_id").selectExpr("photo_id", f"concat('/x/', {_UUID}, '_1.jpg') AS path")), "SELECT source_id, CASE WHEN photo_id IN (SELECT id FROM locations WHERE id = photo_id) THEN upper(u) ELSE lower(u) END AS uuid, photo_id FROM (SELECT *, 'ABCDEFAB-0000-0000-0000-' || lpad(CAST(photo_id AS VARCHAR), 12, '0') AS u FROM locations WHERE source_id = 0)")
_add("newest_uuids", lambda c: B.newest_uuids(c.locations.selectExpr("id AS seq", "concat('u', id) AS uuid", "photo_id")), "SELECT photo_id, 'u' || id AS uuid, CAST(row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) AS INTEGER) AS place FROM locations")
_add("first_existing", lambda c: B.first_existing(c.locations, _in_libraries(c)), f"SELECT photo_id AS id, arg_min(path, id) AS path FROM locations WHERE path IN ({_IN_LIBRARY}) GROUP BY photo_id")


def _wanted(c: D.Catalog) -> DataFrame:
    return c.tags.selectExpr("concat('a', photo_id) AS uuid", "CASE WHEN photo_id % 3 = 0 THEN concat('/p/', photo_id) END AS path", "photo_id % 3 = 0 AS derivative", "photo_id % 4 = 0 AS hidden").distinct()


_add("ensure_deferred", lambda c: transitions.ensure_deferred(_tables(c), _wanted(c), 0)["photos"].where("startswith(sha256, 'deferred:')").select("id", "sha256", "byte_size", "status", "derivative", "hidden", "hidden_origin"), "SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY 'deferred:a' || p) AS id, 'deferred:a' || p AS sha256, 0 AS byte_size, CASE WHEN p % 3 = 0 THEN 'queued' ELSE 'deferred' END AS status, p % 3 = 0 AS derivative, p % 4 = 0 AS hidden, CASE WHEN p % 4 = 0 THEN 'library' END AS hidden_origin FROM (SELECT DISTINCT photo_id AS p FROM tags)")
_add("deferred_previews", lambda c: transitions.ensure_deferred(_tables(c), _wanted(c), 0)["locations"].where("startswith(path, '/p/')").select("source_id", "path", "mtime", "size"), "SELECT DISTINCT 0 AS source_id, '/p/' || photo_id AS path, 0 AS mtime, 0 AS size FROM tags WHERE photo_id % 3 = 0")


def _demoted(c: D.Catalog) -> dict[str, DataFrame]:
    missing = c.tags.selectExpr("photo_id AS id", "CASE WHEN photo_id % 3 = 0 THEN concat('/p/', photo_id) END AS preview")
    return transitions.demote_offloaded(_tables(c), missing, _in_libraries(c), 1)


_add("demote_offloaded", lambda c: _demoted(c)["photos"].select("id", "status", "offloaded"), "SELECT id, status, id IN (SELECT photo_id FROM tags) AS offloaded FROM photos")
_add("demoted_locations", lambda c: _demoted(c)["locations"].select("source_id", "path"), f"SELECT source_id, path FROM locations WHERE NOT (source_id = 1 AND photo_id IN (SELECT photo_id FROM tags) AND path NOT IN ({_IN_LIBRARY})) UNION ALL SELECT DISTINCT 1, '/p/' || photo_id FROM tags WHERE photo_id % 3 = 0")


def _library(c: D.Catalog) -> dict[str, DataFrame]:
    """A library over source 0: most originals are there as they were, some are new, some are gone, some never came."""
    tables = _tables(c)
    own = tables["locations"].where("source_id = 0 and id = photo_id and size > 0")
    here = own.where("id % 4 <> 0").select("path", "mtime", "size", F.concat(F.lit("h"), F.col("id").cast("string")).alias("h"))
    fresh = c.tags.selectExpr("concat('/new/', photo_id) AS path", "cast(1 AS bigint) AS mtime", "cast(5 AS bigint) AS size", "concat('n', photo_id) AS h").distinct()
    listing = here.unionByName(fresh)
    assets = own.selectExpr("concat('u', id) AS uuid", "path", "id % 3 = 0 AS hidden").unionByName(c.tags.selectExpr("concat('n', photo_id) AS uuid", "concat('/new/', photo_id) AS path", "false AS hidden").distinct()).unionByName(c.people.selectExpr("concat('cloud', id) AS uuid", "cast(null AS string) AS path", "id % 2 = 0 AS hidden"))
    shown = c.people.where("id % 3 = 0").selectExpr("concat('cloud', id) AS uuid", "concat('/small/', id) AS preview")
    return library.scan_library(tables, assets, listing, shown, 0, digest=lambda rows: rows.join(listing.select("path", F.col("h").alias("sha256")), "path"), now=_NOW)


_OWN = "own AS (SELECT * FROM located WHERE source_id = 0 AND id = photo_id AND size > 0)"
_add("library_new_photos", lambda c: _library(c)["photos"].join(c.photos.select("id"), "id", "left_anti").select("sha256", "status", "hidden", "hidden_origin", "derivative"), "SELECT DISTINCT 'n' || photo_id AS sha256, 'queued' AS status, false AS hidden, CAST(NULL AS VARCHAR) AS hidden_origin, false AS derivative FROM tags UNION ALL SELECT 'deferred:cloud' || id, CASE WHEN id % 3 = 0 THEN 'queued' ELSE 'deferred' END, id % 2 = 0, CASE WHEN id % 2 = 0 THEN 'library' END, id % 3 = 0 FROM people")
_add("library_offloaded", lambda c: _library(c)["photos"].join(c.photos.select("id"), "id", "left_semi").select("id", "status", "offloaded", "hidden", "hidden_origin"), """SELECT p.id, status, coalesce(o.id % 4 = 0, false) AS offloaded, CASE WHEN o.id IS NULL THEN hidden WHEN o.id % 3 = 0 AND hidden_origin IS DISTINCT FROM 'user' THEN true WHEN o.id % 3 <> 0 AND hidden_origin IS NOT DISTINCT FROM 'library' THEN false ELSE hidden END AS hidden,
CASE WHEN o.id IS NULL THEN hidden_origin WHEN o.id % 3 = 0 AND hidden_origin IS DISTINCT FROM 'user' THEN 'library' WHEN o.id % 3 <> 0 AND hidden_origin IS NOT DISTINCT FROM 'library' THEN NULL ELSE hidden_origin END AS hidden_origin FROM photos p LEFT JOIN own o ON o.id = p.id""", f"{_LOCATED}, {_OWN}")
_add("library_stats", lambda c: _library(c)["stats"].select("images_found", "new_photos", "updated", "unchanged", "errors", "deferred", "previews", "offloaded"), "SELECT (SELECT count(*) FROM own) + t + count(*) AS images_found, t AS new_photos, 0 AS updated, (SELECT count(*) FROM own WHERE id % 4 <> 0) AS unchanged, 0 AS errors, count(*) FILTER (id % 3 <> 0) AS deferred, count(*) FILTER (id % 3 = 0) AS previews, (SELECT count(*) FROM own WHERE id % 4 = 0) AS offloaded FROM people, (SELECT count(DISTINCT photo_id) AS t FROM tags) GROUP BY t", f"{_LOCATED}, {_OWN}")
_add("library_assets", lambda c: _library(c)["photo_assets"].groupBy("source_id").agg(F.count("*").alias("n")), "SELECT 0 AS source_id, (SELECT count(*) FROM assets) + (SELECT count(DISTINCT photo_id) FROM tags) + (SELECT count(*) FROM people) AS n", _ASSETS)
_add("previews", lambda c: library.previews(c.people.selectExpr("cast(id AS string) AS uuid"), c.tags.selectExpr("concat('/d/', person_id, '_', photo_id) AS path", "photo_id % 10 AS size"), 1), "SELECT CAST(person_id AS VARCHAR) AS uuid, max_by('/d/' || person_id || '_' || photo_id, (photo_id % 10, '/d/' || person_id || '_' || photo_id)) AS preview FROM tags GROUP BY person_id")


def _apdb(c: D.Catalog) -> dict[str, DataFrame]:
    """A library of the older kind: people are albums, photos are versions, and masters lie under its root."""
    return {
        "versions": c.photos.selectExpr("concat('V', id) AS UUID", "id AS modelId", "concat('M', id) AS masterUuid", "id % 3 = 0 AS isFavorite"),
        "masters": c.photos.selectExpr("concat('M', id) AS uuid", "id AS modelId", "CASE WHEN id % 2 = 0 THEN concat('/abs/', id) ELSE concat('rel/', id) END AS imagePath"),
        "albums": c.people.selectExpr("concat('A', id) AS uuid", "id AS modelId", "name"),
        "members": c.tags.selectExpr("person_id AS albumId", "photo_id AS versionId"),
    }


_add("library_paths", lambda c: library.library_paths(_apdb(c), "/lib/", album="PERSON 3", favorites=True), "SELECT DISTINCT CASE WHEN id % 2 = 0 THEN '/abs/' || id ELSE '/lib/rel/' || id END AS path FROM photos WHERE id % 3 = 0 AND id IN (SELECT photo_id FROM tags WHERE person_id = 3)")
_add("remove_source_counts", lambda c: transitions.removal_counts({"photos": c.photos, "locations": c.locations, "sources": c.sources}, 0), "SELECT count(*) AS locations, count(DISTINCT photo_id) FILTER (photo_id NOT IN (SELECT photo_id FROM locations WHERE source_id <> 0)) AS forgotten FROM locations WHERE source_id = 0")
_add("schema_version", lambda c: B.schema_version(c.people.select(F.col("id").alias("version"))), "SELECT coalesce(max(id), 0) AS version FROM people")

# the model: gate, ladder, retries; people; embeddings


def _read(c: D.Catalog) -> DataFrame:
    images = c.photos.where("id % 10 <> 9").select("id", F.col("id").cast("string").cast("binary").alias("image"))
    photos = _photos(c).withColumns({"status": F.lit("queued"), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    after, _ = extract.process(photos, images, StubModel(), _NOW, extract.Policy(two_tier=True, backoff_seconds=0.0))
    return after.select("id", "status", "attempts", "error", "has_text", "text", "context", "text_kind", "category", "tiled", "gated", "model")


_add(
    "extract_queue",
    _read,
    """SELECT id, CASE WHEN bad THEN 'error' ELSE 'done' END AS status, CASE WHEN bad THEN attempts + 1 ELSE attempts END AS attempts,
    CASE WHEN attempts >= 3 THEN 'max attempts exceeded' WHEN id % 10 = 9 THEN 'no readable file' WHEN k = 3 THEN 'BadAnswer: no object in the answer' END AS error,
    CASE WHEN bad THEN has_text ELSE k NOT IN (0, 4) END AS has_text, CASE WHEN bad THEN text WHEN k IN (0, 4) THEN '' WHEN k = 1 THEN 't' || id || '/0' || chr(10) || chr(10) || 't' || id || '/2' ELSE 't' || id END AS text,
    CASE WHEN bad THEN context WHEN k = 0 THEN 'seen' WHEN k = 1 THEN 'c | c' ELSE 'c' END AS context, CASE WHEN bad THEN NULL WHEN k = 0 THEN 'none' ELSE 'sign' END AS text_kind,
    CASE WHEN bad THEN category WHEN k = 0 THEN 'scene' ELSE 'a sign' END AS category, CASE WHEN bad THEN tiled ELSE k = 1 END AS tiled, CASE WHEN bad THEN gated ELSE k = 0 END AS gated, CASE WHEN bad THEN model ELSE 'stub' END AS model
    FROM (SELECT *, id % 7 AS k, attempts >= 3 OR id % 10 = 9 OR id % 7 = 3 AS bad FROM photos)""",
)


def _run(c: D.Catalog) -> DataFrame:
    """A scan of the pages and then the whole queue, by the stub."""
    done = run.run_once(_tables(c), {99: _listing(c)}, lambda t: t["photos"].select("id", F.col("id").cast("string").cast("binary").alias("image")), StubModel(), _NOW, extract.Policy(backoff_seconds=0.0), digest=_digest)
    return done["counts"]


_add(
    "run_once",
    _run,
    f"""SELECT coalesce(status, 'total') AS status, count(*) AS n FROM (
    SELECT CASE WHEN (status = 'queued' OR status = 'processing') AND (attempts >= 3 OR id % 7 = 3) THEN 'error' WHEN status IN ('queued', 'processing') THEN 'done' ELSE status END AS status FROM photos WHERE {_ALIVE}
    UNION ALL SELECT CASE WHEN (m + r) % 7 = 3 THEN 'error' ELSE 'done' END FROM (SELECT row_number() OVER (ORDER BY path) AS r, (SELECT max(id) FROM photos) AS m FROM firsts WHERE sha256 NOT IN (SELECT sha256 FROM photos))) GROUP BY ROLLUP (status)""",
    _FILES,
)


def _matched(c: D.Catalog) -> DataFrame:
    some = c.people.where("id < 3").withColumn("description", F.lit(None).cast("string"))
    faces = c.photos.select("id", (F.col("id") % 2).alias("n"))
    images = c.photos.select(F.col("id").alias("photo_id"), F.array(F.col("id").cast("string").cast("binary")).alias("images"))
    return people.match_people(c.photos, some, c.tags, faces, images, StubModel(), _NOW).select("photo_id", "person_id", "present", "confidence", "origin")


_add(
    "match_people",
    _matched,
    f"""SELECT coalesce(n.photo_id, t.photo_id) AS photo_id, coalesce(n.person_id, t.person_id) AS person_id, CASE WHEN w THEN n.present ELSE t.present END AS present, CASE WHEN w THEN n.confidence ELSE t.confidence END AS confidence, CASE WHEN w THEN 'model' ELSE t.origin END AS origin
    FROM (SELECT n.*, t.origin IS NULL OR t.origin = 'model' AS w FROM new n LEFT JOIN tags t USING (photo_id, person_id)) n FULL JOIN tags t ON t.photo_id = n.photo_id AND t.person_id = n.person_id""",
    f"""few AS (SELECT id FROM people WHERE id < 3), cand AS (SELECT id FROM photos p WHERE {_VISIBLE} AND status <> 'deferred' AND EXISTS (SELECT 1 FROM few q WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.photo_id = p.id AND t.person_id = q.id))),
    new AS (SELECT c.id AS photo_id, f.id AS person_id, c.id % 2 = 1 AND (c.id + f.id) % 2 = 0 AS present, CASE WHEN c.id % 2 = 1 THEN c.id % 10 / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM cand c, few f
    WHERE c.id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM tags t WHERE t.photo_id = c.id AND t.person_id = f.id AND present AND origin <> 'model'))""",
)
_add("people_profiles", lambda c: people.profiles_json(c.people.withColumn("description", F.lit(None).cast("string"))).select(F.length("profiles").cast("long").alias("n")), "SELECT CAST(sum(length('{\"person_id\":' || id || ',\"name\":\"' || name || '\",\"recognition_profile\":\"\"}')) + count(*) + 1 AS BIGINT) AS n FROM people")
_add("seed_boxes", lambda c: people.seed_boxes(c.tags).select("person_id", "photo_id", "box.w"), "SELECT person_id, photo_id, CASE WHEN box IS NOT NULL THEN CAST(30 AS BIGINT) END AS w FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(updated_at, created_at) DESC, photo_id DESC) AS r FROM tags WHERE seed) WHERE r <= 3")
_add(
    "embed_missing",
    lambda c: extract.embed_missing(c.photos, c.embeddings.select("photo_id", "model", "dims", "vector"), StubModel(D.MODEL)).select("photo_id", "dims", F.get("vector", F.lit(0)).cast("double").alias("first")),
    f"SELECT photo_id, len(vector) AS dims, CAST(vector[1] AS DOUBLE) AS first FROM photo_embeddings UNION ALL SELECT id, 2, CAST(length(text) + 1 + length(coalesce(context, '')) AS DOUBLE) FROM photos WHERE {_VISIBLE} AND id NOT IN (SELECT photo_id FROM photo_embeddings)",
)
_add("vector_blobs", lambda c: extract.unpack_vectors(extract.pack_vectors(c.embeddings.select("photo_id", "vector"))).select("photo_id", F.size("vector").alias("n"), F.element_at("vector", -1).cast("double").alias("last")), "SELECT photo_id, len(vector) AS n, CAST(vector[-1] AS DOUBLE) AS last FROM photo_embeddings")

# geometry and small functions



def _sides() -> list:
    """Width and height of a picture."""
    return [F.expr("cast(id % 977 + 1 as int)"), F.expr("cast(id % 613 + 1 as int)")]


_TW, _TH = "least(w, greatest(1, round_even(w * 0.58::DOUBLE, 0)))", "least(h, greatest(1, round_even(h * 0.58::DOUBLE, 0)))"
_WH = "wh AS (SELECT id, id % 977 + 1 AS w, id % 613 + 1 AS h FROM photos)"
_add("tile_boxes", lambda c: c.photos.select("id", F.posexplode(geometry.tiles(*_sides())).alias("tile", "b")).select("id", "tile", "b.*"), f"SELECT id, t AS tile, CAST(CASE WHEN t % 2 = 0 THEN 0 ELSE w - {_TW} END AS INTEGER) AS left, CAST(CASE WHEN t < 2 THEN 0 ELSE h - {_TH} END AS INTEGER) AS top, CAST(CASE WHEN t % 2 = 0 THEN {_TW} ELSE w END AS INTEGER) AS right, CAST(CASE WHEN t < 2 THEN {_TH} ELSE h END AS INTEGER) AS bottom FROM wh, (SELECT unnest(range(0, 4)) AS t)", _WH)
_add("crop_box", lambda c: c.photos.select("id", geometry.crop(F.expr("struct(cast(id % 200 - 20 as int) AS x, cast(id % 90 as int) AS y, cast(id % 70 as int) AS w, cast(id % 40 as int) AS h)"), *_sides()).alias("b")).select("id", "b.*"), "SELECT id, CASE WHEN ok THEN l END AS left, CASE WHEN ok THEN t END AS top, CASE WHEN ok THEN r END AS right, CASE WHEN ok THEN b END AS bottom FROM (SELECT *, r > l AND b > t AS ok FROM (SELECT id, greatest(0, x - floor(bw * 0.2)) AS l, greatest(0, y - floor(bh * 0.2)) AS t, least(w, x + bw + floor(bw * 0.2)) AS r, least(h, y + bh + floor(bh * 0.2)) AS b FROM (SELECT *, greatest(0, id % 200 - 20) AS x, id % 90 AS y, greatest(1, id % 70) AS bw, greatest(1, id % 40) AS bh FROM wh)))", _WH)
_add("faces_ranked", lambda c: c.photos.select("id", F.posexplode(geometry.largest_first(geometry.parse_faces(F.expr("concat('1,2,', id % 5, ',3+bad+', '4,5,2,', id % 4, '+0,0,1,1')")), 2)).alias("place", "b")).select("id", "place", "b.w", "b.h"), "SELECT id, CAST(r AS INTEGER) AS place, w, h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w * h DESC, i) - 1 AS r FROM (SELECT id, 0 AS i, id % 5 AS w, 3 AS h FROM photos UNION ALL SELECT id, 1, 2, id % 4 FROM photos UNION ALL SELECT id, 2, 1, 1 FROM photos)) WHERE r < 2")
_add("face_pixels", lambda c: c.photos.select("id", geometry.pixels(F.expr("struct(0.25D AS x, 0.5D AS y, (id % 4) / 8.0D AS w, 0.25D AS h)"), *_sides()).alias("b")).select("id", "b.*"), "SELECT id, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN bw END AS w, CASE WHEN ok THEN bh END AS h FROM (SELECT *, bw > 0 AND bh > 0 AS ok FROM (SELECT id, floor(0.25 * w) AS x, floor(0.25 * h) AS y, floor((id % 4) / 8.0 * w) AS bw, floor(0.25 * h) AS bh FROM wh))", _WH)
_add("display_size", lambda c: c.photos.select("id", geometry.display_size(*_sides(), F.expr("cast(nullif(id % 9, 0) as int)")).alias("s"), geometry.within_budget(*_sides(), 100_000).alias("fits")).select("id", "s.*", "fits"), "SELECT id, CASE WHEN id % 9 IN (5, 6, 7, 8) THEN h ELSE w END AS width, CASE WHEN id % 9 IN (5, 6, 7, 8) THEN w ELSE h END AS height, w * h <= 100000 AS fits FROM wh", _WH)
_add("norm_path", lambda c: c.locations.select("id", N.norm_path(F.concat(F.lit("~/A//b/./"), F.col("path"), F.lit("/")), "/Home").alias("path")), "SELECT id, '/home/a/b/' || lower(path) AS path FROM locations")
_add("clean_text", lambda c: c.photos.select("id", N.clean_text(F.concat(F.col("category").cast("binary"), F.unhex(F.lit("EDA080")))).startswith(F.col("category")).alias("kept"), N.recognised_text(F.array(F.lit(" a "), F.lit(" "), F.when(F.col("id") % 2 == 0, "b"))).alias("lines")), "SELECT id, true AS kept, CASE WHEN id % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE 'a' END AS lines FROM photos")
_add("person_name", lambda c: c.photos.select("id", N.person_name(F.concat(F.lit(" \t"), F.col("category"), F.lit("  "), F.when(F.col("id") % 5 == 0, F.repeat(F.lit("x"), F.lit(60))).otherwise(""))).alias("name"), N.model_name(F.concat("model", F.when(F.col("id") % 2 == 0, ":latest").otherwise(""))).alias("model")), "SELECT id, CASE WHEN id % 5 <> 0 THEN category END AS name, model FROM photos")
_add("size_text", lambda c: c.photos.select("id", N.size_text(F.expr("cast(id * id * id as double)")).alias("size")), "SELECT id, CASE WHEN n >= 1024::BIGINT ** 4 THEN printf('%.1f TB', n / 1024.0 ** 4) WHEN n >= 1024 ** 3 THEN printf('%.1f GB', n / 1024.0 ** 3) WHEN n >= 1024 ** 2 THEN printf('%.1f MB', n / 1024.0 ** 2) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%d B', CAST(n AS BIGINT)) END AS size FROM (SELECT id, CAST(id AS DOUBLE) * id * id AS n FROM photos)")
_add("embedding_text", lambda c: c.photos.select("id", F.sha2(N.embedding_text(F.when(F.col("id") % 3 != 0, F.col("text")), F.when(F.col("id") % 2 != 0, F.col("context"))), 256).alias("content")), "SELECT id, CASE WHEN regexp_matches(c, '\\S') THEN sha256(c) END AS content FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN text ELSE '' END || chr(10) || CASE WHEN id % 2 <> 0 THEN coalesce(context, '') ELSE '' END AS c FROM photos)")

# pages, lookups and results

_add("people_by_name", lambda c: B.people_by_name(c.people), "SELECT id, name, CAST(row_number() OVER (ORDER BY lower(name), id) AS INTEGER) AS place FROM people")
_add("trash_page", lambda c: B.trash_page(c.photos, c.locations, 20), "SELECT p.id, deleted_at, path FROM (SELECT * FROM photos WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, id LIMIT 20) p LEFT JOIN first_location USING (id)")
_add("pager", lambda c: c.photos.select("id", B.pages(F.col("id"), F.col("id") % 7 - 1).alias("p")).select("id", "p.*"), "SELECT id, c AS pages, (p - 1) * 48 AS offset, p > 1 AS newer, p < c AS older FROM (SELECT id, greatest(1, CAST(ceil(id / 48.0) AS BIGINT)) AS c, greatest(1, id % 7 - 1) AS p FROM photos)")
_add("photo_detail", lambda c: B.detail(c.photos, c.locations, c.tags, c.people, 4).select("id", "status", F.array_join("paths", "|").alias("paths"), F.array_join("people", "|").alias("people")), "SELECT id, status, (SELECT string_agg(path, '|' ORDER BY l.id) FROM locations l WHERE l.photo_id = p.id) AS paths, (SELECT coalesce(string_agg(name, '|' ORDER BY name), '') FROM tags t JOIN people q ON q.id = person_id WHERE t.photo_id = p.id AND present) AS people FROM photos p WHERE id = 4")
_add("ids_for_paths", lambda c: B.ids_for_paths(c.locations, _album(c)), f"SELECT DISTINCT photo_id AS id FROM locations WHERE path IN ({_IN_TAGS})")
_add("missing_dates", lambda c: B.missing_dates(c.photos), f"SELECT id FROM photos WHERE {_ALIVE} AND date_taken IS NULL")
_add("pick_ids", lambda c: filters.pick_ids(c.photos, c.locations.select(F.col("photo_id").alias("id")), c.tags, c.people, " person 3 ", **filters.date_params("2013-01-01", "2020-12-31", "x")), "SELECT id FROM photos WHERE id IN (SELECT photo_id FROM locations) AND id IN (SELECT photo_id FROM tags WHERE person_id = 3 AND present) AND date_taken BETWEEN TIMESTAMP '2013-01-01' AND TIMESTAMP '2020-12-31 23:59:59'")
_add("bulk_trash", lambda c: transitions.trash(c.photos, filters.bulk(filters.browse("error", show_hidden=True)), _NOW).select("id", "hidden", "deleted_at"), f"SELECT id, CASE WHEN status = 'error' AND {_ALIVE} THEN false ELSE hidden END AS hidden, CASE WHEN status = 'error' AND {_ALIVE} THEN TIMESTAMP '{_NOW}' ELSE deleted_at END AS deleted_at FROM photos")


def _snippet_views(name: str, column: str, words: tuple[str, str], size: int) -> str:
    """View ``name`` (id, snippet) of a column for a query of two words: windows are rows, and the best of each id is kept."""
    a, b = words
    split = f"'([^\\p{{L}}\\p{{N}}]*)([\\p{{L}}\\p{{N}}]+)'"
    hit = f"list_contains(['{a}', '{b}'], f[i + 1])"
    points = "len(held) + 999 * len(list_distinct(list_transform(held, lambda i: f[i + 1])))"
    body = f"array_to_string(list_transform(range(g, least(g + {size}, n)), lambda i: CASE WHEN i > g OR g = 0 THEN gaps[i + 1] ELSE '' END || CASE WHEN {hit} THEN '[' || spelt[i + 1] || ']' ELSE spelt[i + 1] END), '')"
    return f"""{name}_split AS (
      SELECT *, len(f) AS n, list_filter(range(len(f)), lambda i: {hit}) AS hits, list_filter(range(len(f)), lambda i: i = 0 OR regexp_matches(gaps[i + 1], '[.:][ \\t\\r\\n]+$')) AS opens
      FROM (SELECT id, {column} AS t, regexp_extract_all({column}, {split}, 1) AS gaps, regexp_extract_all({column}, {split}, 2) AS spelt, list_transform(regexp_extract_all({column}, {split}, 2), lambda w: strip_accents(lower(w))) AS f FROM photos WHERE {column} IS NOT NULL)
    ), {name}_hit AS (SELECT id, f, n, hits, unnest(hits) AS h, opens FROM {name}_split),
    {name}_from AS (
      SELECT id, f, n, h, 0 AS kind, h AS s, list_filter(hits, lambda i: i >= h AND i < h + {size}) AS held FROM {name}_hit
      UNION ALL SELECT id, f, n, h, 1, s, list_filter(hits, lambda i: i >= s AND i < s + {size}) FROM (SELECT *, list_max(list_filter(opens, lambda i: i <= h)) AS s FROM {name}_hit) WHERE s < h AND n > {size}
    ), {name}_best AS (
      SELECT id, arg_max(begin, (points, -h, -kind)) AS begin FROM (
        SELECT id, h, kind, {points} + CASE WHEN kind = 0 THEN 0 WHEN s = 0 THEN 120 ELSE 100 END AS points,
          CASE WHEN kind = 1 THEN s ELSE greatest(0, least(h - ({size} - (held[-1] + 1 - h)) // 2, n - {size})) END AS begin FROM {name}_from)
      GROUP BY id
    ), {name} AS (
      SELECT id, CASE WHEN n = 0 THEN t ELSE CASE WHEN g > 0 THEN ' ... ' ELSE '' END || {body} || CASE WHEN g + {size} < n THEN ' ... ' ELSE regexp_extract(t, '[^\\p{{L}}\\p{{N}}]*$') END END AS snippet
      FROM (SELECT s.*, coalesce(begin, 0) AS g FROM {name}_split s LEFT JOIN {name}_best USING (id))
    )"""


def _snippets(c: D.Catalog) -> DataFrame:
    return search.snippets(c.photos.join(search.match(c.photos, "with from"), "id", "left_semi"), "with from")


_BOTH = f"{_term('with')} > 0 AND {_term('from')} > 0"
_add("fts_snippet", _snippets, f"SELECT id, snippet FROM tok JOIN shown USING (id) WHERE {_BOTH}", f"{_TOKENS}, {_snippet_views('shown', 'text', ('with', 'from'), 10)}")
_top = SQL["fts_topk"]
QUERIES["fts_results"] = lambda spark, sf_dir: _results(D.catalog(spark, sf_dir))
_SHOWN = f"{_snippet_views('shown', 'text', ('licensed', 'under'), 10)}, {_snippet_views('told', 'context', ('licensed', 'under'), 6)}"
_head, _page = _top.split(") SELECT id, round(", 1)
SQL["fts_results"] = f"{_head}), {_SHOWN} SELECT s.id, rank, status, category, length(text) AS text_len, shown.snippet AS text_snippet, told.snippet AS context_snippet, path FROM (SELECT id, round({_page}) s JOIN photos t ON t.id = s.id LEFT JOIN shown ON shown.id = s.id LEFT JOIN told ON told.id = s.id LEFT JOIN first_location f ON f.id = s.id"


def _results(c: D.Catalog) -> DataFrame:
    return search.results(c.photos, c.locations, "licensed under", limit=20).withColumn("rank", F.round("rank", 6))


QUERIES["fts_indexed"] = lambda spark, sf_dir: _indexed(D.catalog(spark, sf_dir))
SQL["fts_indexed"] = _top


def _indexed(c: D.Catalog) -> DataFrame:
    return search.search_index(c.photos, search.build_index(c.photos), "licensed under", limit=20).select("id", F.round("rank", 6).alias("rank"))


_hashes(
    "cluster_groups",
    lambda h: _grouped(h),
    "SELECT cluster, max(size) AS size, arg_max(id, (byte_size, -id)) AS largest, min_by('t' || id, id) FILTER (id % 3 = 0) AS sample, array_to_string(list_slice(list_sort(list(id)), 1, 12), '|') AS members FROM cl JOIN hashed USING (id) WHERE size >= 2 GROUP BY cluster ORDER BY size DESC, cluster LIMIT 10",
    _reach("true"),
    True,
)


def _grouped(hashed: DataFrame) -> DataFrame:
    with_text = hashed.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))))
    found = cluster.top_groups(cluster.groups(cluster.clusters(hashed, 16), with_text))
    return found.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), "|"))
