"""Pages, lists and aggregates of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.filters import alive, review, visible


def first_location(locations: DataFrame) -> DataFrame:
    """``id, path``: of each photo the path with the least location id, pre-aggregated rather than looked up by row."""
    return locations.groupBy(F.col("photo_id").alias("id")).agg(F.min_by("path", "id").alias("path"))


def page(photos: DataFrame, locations: DataFrame, where: Column, limit: int = 48, offset: int = 0) -> DataFrame:
    """Newest first, nulls last, ties by larger id; first paths are joined to the page's rows only."""
    rows = photos.where(where).select("id", "status", "category", "finished_at").orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).offset(offset).limit(limit)
    return rows.join(first_location(locations.join(F.broadcast(rows.select(F.col("id").alias("photo_id"))), "photo_id", "left_semi")), "id", "left")


def recent_results(photos: DataFrame, where: Column, n: int = 20) -> DataFrame:
    """Unfinished rows first, then the latest finished; ties by larger id."""
    return photos.where(where).select("id", "status", "finished_at").orderBy(F.desc_nulls_first("finished_at"), F.desc("id")).limit(n)


def status_counts(photos: DataFrame) -> DataFrame:
    """Rows not trashed by status, and their total."""
    counted = photos.where(alive()).rollup("status").agg(F.count("*").alias("n"))
    return counted.select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def date_histogram(photos: DataFrame) -> DataFrame:
    return photos.where(visible() & F.col("date_taken").isNotNull()).groupBy(F.year("date_taken").alias("year")).agg(F.count("*").alias("n"))


def categories(photos: DataFrame) -> DataFrame:
    """All rows count, hidden and trashed ones too."""
    return photos.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))


def recent_duration(photos: DataFrame, n: int = 50) -> DataFrame:
    """Mean duration of the ``n`` last finished rows; null of none."""
    last = photos.where((F.col("status") == "done") & F.col("duration_ms").isNotNull()).select("duration_ms", "finished_at", "id").orderBy(F.desc_nulls_last("finished_at"), F.desc("id")).limit(n)
    return last.agg(F.avg("duration_ms").alias("avg_ms"))


def eta_minutes(photos: DataFrame, n: int = 50) -> DataFrame:
    queued = photos.where(alive() & (F.col("status") == "queued")).agg(F.count("*").alias("queued"))
    joined = queued.crossJoin(F.broadcast(recent_duration(photos, n)))  # one row each
    return joined.select("queued", F.round(F.col("avg_ms") / 1000 * F.col("queued") / 60, 6).alias("minutes"))


def people_list(people: DataFrame, tags: DataFrame, photos: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Tag counts of every person in one conditional aggregation; seeds count wherever they are."""
    shown = photos.where(alive()).select(F.col("id").alias("photo_id"), F.lit(True).alias("there"))
    met = tags.join(shown, "photo_id", "left")
    here = F.col("there").isNotNull() & F.col("present")
    confirmed = F.col("origin").isin("user", "seed")
    counts = met.groupBy("person_id").agg(
        F.count_if(here).alias("tags"),
        F.count_if(here & confirmed).alias("confirmed"),
        F.count_if(here & ~confirmed & (F.col("confidence") >= min_confidence)).alias("strong"),
        F.count_if(here & review(min_confidence)).alias("uncertain"),
        F.count_if(F.col("seed")).alias("seeds"),
    )
    return people.join(counts, people["id"] == counts["person_id"], "left").select("id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tags", "confirmed", "strong", "uncertain", "seeds")])


def person_photos(tags: DataFrame, photos: DataFrame, person_id: int) -> DataFrame:
    """Present tags of a person on visible photos: seeds first, then by confidence, then the newest, then by id."""
    own = tags.where((F.col("person_id") == person_id) & F.col("present"))
    rows = own.join(photos.where(visible()).select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    order = Window.partitionBy("person_id").orderBy((F.col("origin") == "seed").desc(), F.desc("confidence"), F.desc("created_at"), F.asc("photo_id"))
    return rows.select("photo_id", "origin", "confidence", F.row_number().over(order).alias("place"))


def people_for_photo(tags: DataFrame, people: DataFrame, photo_id: int) -> DataFrame:
    own = tags.where((F.col("photo_id") == photo_id) & F.col("present"))
    return own.join(people.select(F.col("id").alias("person_id"), "name"), "person_id").select("person_id", "name", "origin", "confidence")


def seeds(tags: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` newest seeds of each person."""
    newest = Window.partitionBy("person_id").orderBy(F.coalesce("updated_at", "created_at").desc(), F.desc("photo_id"))
    return tags.where(F.col("seed")).select("person_id", "photo_id", F.row_number().over(newest).alias("place")).where(F.col("place") <= n)


def people_candidates(photos: DataFrame, people: DataFrame, tags: DataFrame) -> DataFrame:
    """Visible photos that lack a tag for some person: their distinct tag count is below the number of people."""
    known = tags.join(people.select(F.col("id").alias("person_id")), "person_id", "left_semi").groupBy(F.col("photo_id").alias("id")).agg(F.count_distinct("person_id").alias("n"))
    total = people.agg(F.count_distinct("id").alias("total"))
    rows = photos.where(visible() & (F.col("status") != "deferred")).select("id").join(known, "id", "left").crossJoin(F.broadcast(total))  # one row
    return rows.where(F.coalesce("n", F.lit(0)) < F.col("total")).select("id")


def missing_embeddings(photos: DataFrame, embeddings: DataFrame, model: str, everything: bool = False) -> DataFrame:
    wanted = photos.where(visible() & (F.col("text").isNotNull() | F.col("context").isNotNull())).select("id")
    have = embeddings.where(F.col("model") == model).select(F.col("photo_id").alias("id"))
    return wanted if everything else wanted.join(have, "id", "left_anti")


def orphans(photos: DataFrame, locations: DataFrame) -> DataFrame:
    return photos.select("id").join(locations.select(F.col("photo_id").alias("id")), "id", "left_anti")


def orphan_files(listing: DataFrame, photos: DataFrame) -> DataFrame:
    """Cached files of photos that are gone: count and bytes."""
    return listing.join(photos.select("id"), "id", "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def locations_with_sources(locations: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select(F.col("id").alias("source_id"), "kind", "uri")
    return locations.join(named, "source_id").select("id", "photo_id", "path", "kind", "uri")


def paths(locations: DataFrame) -> DataFrame:
    """All paths of each photo, by location id; a photo's locations are its copies."""
    listed = locations.groupBy(F.col("photo_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("at"), "path"))).alias("p"))
    return listed.select("id", F.transform("p", lambda x: x["path"]).alias("paths"))


def trash(photos: DataFrame, locations: DataFrame) -> DataFrame:
    return photos.where(F.col("deleted_at").isNotNull()).select("id", "deleted_at").join(first_location(locations), "id", "left")


def trash_page(photos: DataFrame, locations: DataFrame, limit: int = 48) -> DataFrame:
    """The newest in the trash first, ties by id."""
    rows = photos.where(F.col("deleted_at").isNotNull()).select("id", "deleted_at").orderBy(F.desc("deleted_at"), "id").limit(limit)
    return rows.join(first_location(locations), "id", "left")


def first_existing(locations: DataFrame, listing: DataFrame) -> DataFrame:
    """``id, path``: of each photo the path with the least location id that is in the listing."""
    return first_location(locations.join(listing.select("path").distinct(), "path", "left_semi"))


def pages(total: Column, page: Column, size: int = 48) -> Column:
    """A pager: pages in all, at least one, the rows passed over, and whether there are newer and older pages."""
    count = F.greatest(F.lit(1), F.ceil(total / size))
    at = F.greatest(F.lit(1), page)
    return F.struct(count.cast("long").alias("pages"), ((at - 1) * size).cast("long").alias("offset"), (at > 1).alias("newer"), (at < count).alias("older"))


def detail(photos: DataFrame, locations: DataFrame, tags: DataFrame, people: DataFrame, photo_id: int) -> DataFrame:
    """One photo with all its paths and the names of the people on it, by name."""
    one = photos.where(F.col("id") == photo_id)
    names = people_for_photo(tags, people, photo_id).agg(F.array_sort(F.collect_list("name")).alias("people"))
    return one.join(paths(locations.where(F.col("photo_id") == photo_id)), "id", "left").crossJoin(F.broadcast(names))  # one row


def ids_for_paths(locations: DataFrame, paths_: DataFrame) -> DataFrame:
    """Photos with a place at one of these paths, which compare without case."""
    wanted = paths_.select(F.lower("path").alias("p_")).distinct()
    return locations.join(wanted, F.lower(locations["path"]) == wanted["p_"], "left_semi").select(F.col("photo_id").alias("id")).distinct()


def missing_dates(photos: DataFrame) -> DataFrame:
    return photos.where(alive() & F.col("date_taken").isNull()).select("id")


def newest_uuids(assets: DataFrame, order: str = "seq") -> DataFrame:
    """Uuids of each photo, the newest registration first."""
    newest = Window.partitionBy("photo_id").orderBy(F.desc(order))
    return assets.select("photo_id", "uuid", F.row_number().over(newest).alias("place"))


def people_by_name(people: DataFrame) -> DataFrame:
    """``id, name, place``: people by name without case, ties by id; people are few, so one task ranks them."""
    return people.select("id", "name", F.row_number().over(Window.orderBy(F.lower("name"), "id")).alias("place"))


def schema_version(versions: DataFrame) -> DataFrame:
    """The largest version, 0 of none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def status_text(row: dict) -> str:
    """What a status report says in one line, states in the order of the queue."""
    return ", ".join(f"{row[s]} {s}" for s in ("queued", "processing", "done", "error", "deferred") if row.get(s))


def claim(photos: DataFrame, n: int, recent_first: bool = False) -> DataFrame:
    """The next ``n`` queued rows: in order of id, or newest capture (else first sight) first."""
    order = [F.coalesce("date_taken", "first_seen_at").desc(), F.desc("id")] if recent_first else [F.asc("id")]
    return photos.where(alive() & (F.col("status") == "queued")).select("id", "date_taken").orderBy(*order).limit(n)
