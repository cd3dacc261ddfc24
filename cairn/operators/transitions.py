"""State transitions: each is a pure function from the tables before to the table after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.workspace import cut

CHILDREN = ("locations", "photo_warnings", "person_tags", "photo_assets", "photo_embeddings")


def update(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """The table with ``changes`` where the condition holds; one narrow projection."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def merge_by_key(table: DataFrame, incoming: DataFrame, keys: list[str], changes: dict[str, Column] | None = None, guard: Column | None = None, insert: bool = True) -> DataFrame:
    """Keyed upsert. In ``changes`` and ``guard`` columns are ``old.<c>`` and ``new.<c>``; by default a new value replaces the old.

    Of several incoming rows of a key the least one, column by column from the left, is taken.
    """
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("m_")).select(*keys, "m_.*") if rest else incoming.distinct()
    old, new = table.withColumn("had_", F.lit(True)).alias("old"), one.withColumn("came_", F.lit(True)).alias("new")
    met = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full" if insert else "left")
    both = F.col("had_").isNotNull() & F.col("came_").isNotNull() & (guard if guard is not None else F.lit(True))
    out = []
    for c in table.columns:
        fresh = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        if c in keys:
            out.append(F.when(F.col("had_").isNotNull(), F.col(f"old.{c}")).otherwise(fresh).alias(c))
        else:
            changed = (changes or {}).get(c, fresh if changes is None and c in incoming.columns else F.col(f"old.{c}"))
            out.append(F.when(both, changed).when(F.col("had_").isNotNull(), F.col(f"old.{c}")).otherwise(fresh).alias(c))
    return met.select(*out)


def insert_new(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], id_column: str = "id") -> DataFrame:
    """Rows of keys not yet there, numbered on from the largest id in the given order.

    Ranks are dealt by range partition: counts of the partitions are summed first, so no task ranks all rows. The parts are
    written once, so that both uses see the same.
    """
    fresh = incoming.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    placed = cut(fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()), "parts")
    within = placed.withColumn("in_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    sizes = within.groupBy("part_").agg(F.max("in_").alias("n_"))
    before = sizes.select("part_", (F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before_"))
    largest = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("largest_"))
    return within.join(F.broadcast(before), "part_").crossJoin(F.broadcast(largest)).withColumn(id_column, F.col("largest_") + F.col("before_") + F.col("in_")).drop("part_", "in_", "before_", "largest_")


# queue


def _no_time() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def mark_done(photos: DataFrame, results: DataFrame) -> DataFrame:
    """Results by id (any photo columns) become final; the error goes."""
    done = results.withColumns({"status": F.lit("done"), "error": F.lit(None).cast("string")})
    return merge_by_key(photos, done, ["id"], insert=False)


def mark_error(photos: DataFrame, errors: DataFrame, now: str) -> DataFrame:
    """Errors ``(id, error, raw_response)``: one more attempt; an older raw response stays unless a new one came."""
    changes = {"status": F.lit("error"), "error": F.col("new.error"), "attempts": F.col("old.attempts") + 1, "finished_at": F.lit(now).cast("timestamp_ntz"), "raw_response": F.coalesce("new.raw_response", "old.raw_response")}
    return merge_by_key(photos, errors, ["id"], changes, insert=False)


def requeue(photos: DataFrame, condition: Column) -> DataFrame:
    """Back to the queue with attempts and error as they are."""
    return update(photos, condition, {"status": F.lit("queued"), "started_at": _no_time(), "finished_at": _no_time()})


def _anew(photos: DataFrame, condition: Column) -> DataFrame:
    changes = {"status": F.lit("queued"), "attempts": F.lit(0), "error": F.lit(None).cast("string"), "started_at": _no_time(), "finished_at": _no_time()}
    return update(photos, condition, changes)


def requeue_errors(photos: DataFrame) -> DataFrame:
    """All errors outside the trash start anew."""
    return _anew(photos, (F.col("status") == "error") & F.col("deleted_at").isNull())


def requeue_photos(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """These ids start anew, trashed ones too."""
    marked = photos.join(ids.select("id").distinct().withColumn("asked_", F.lit(True)), "id", "left")
    return _anew(marked, F.col("asked_")).select(*photos.columns)


def reset_processing(photos: DataFrame) -> DataFrame:
    """What was interrupted waits again; trashed rows and times of finishing stay."""
    return update(photos, (F.col("status") == "processing") & F.col("deleted_at").isNull(), {"status": F.lit("queued"), "started_at": _no_time()})


def reclaim_stale(photos: DataFrame, now: str, lease_seconds: int = 3600) -> DataFrame:
    """Leases that ran out go back to the queue with their attempts as they are; trashed rows stay."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    changes = {"status": F.lit("queued"), "error": F.lit(None).cast("string"), "started_at": _no_time(), "finished_at": _no_time()}
    return update(photos, (F.col("status") == "processing") & (F.col("started_at") <= limit) & F.col("deleted_at").isNull(), changes)


def start(photos: DataFrame, claimed: DataFrame, now: str) -> DataFrame:
    """Claimed ids that are still queued are being processed from ``now`` on."""
    changes = {"status": F.lit("processing"), "started_at": F.lit(now).cast("timestamp_ntz")}
    return merge_by_key(photos, claimed.select("id"), ["id"], changes, F.col("old.status") == "queued", insert=False)


# visibility


def hide(photos: DataFrame, ids: DataFrame, hidden: bool = True) -> DataFrame:
    return merge_by_key(photos, ids.select("id"), ["id"], {"hidden": F.lit(hidden), "hidden_origin": F.lit("user")}, F.col("old.deleted_at").isNull(), insert=False)


def trash(photos: DataFrame, condition: Column, now: str) -> DataFrame:
    """Idempotent: rows in the trash keep their time; a trashed row is not hidden."""
    return update(photos, condition & F.col("deleted_at").isNull(), {"deleted_at": F.lit(now).cast("timestamp_ntz"), "hidden": F.lit(False)})


def restore(photos: DataFrame, condition: Column) -> DataFrame:
    return update(photos, condition & F.col("deleted_at").isNotNull(), {"deleted_at": F.lit(None).cast("timestamp_ntz")})


def sync_hidden(photos: DataFrame, library: DataFrame) -> DataFrame:
    """Library flags ``(id, hidden)``: it may hide what no user decided about, and shows only what it hid itself.

    A row that was hidden without an origin becomes the library's when that hides it; one of the library's loses its
    origin when that shows it.
    """
    hides = F.col("new.hidden") & ~F.col("old.hidden_origin").eqNullSafe("user")
    shows = ~F.col("new.hidden") & F.col("old.hidden_origin").eqNullSafe("library")
    changes = {"hidden": F.col("new.hidden"), "hidden_origin": F.when(F.col("new.hidden"), "library")}
    return merge_by_key(photos, library, ["id"], changes, hides | shows, insert=False)


def import_hidden(photos: DataFrame, locations: DataFrame, source_id: int, hidden_paths: DataFrame) -> DataFrame:
    """The hidden set ``(path)`` of a library of another kind: what that hid in this source is shown first, then the set is hidden.

    Paths compare without case.
    """
    own = locations.where(F.col("source_id") == source_id)
    paths = hidden_paths.select(F.lower("path").alias("path")).distinct().withColumn("match", F.lit(True))
    flags = own.select(F.col("photo_id").alias("id"), F.lower("path").alias("path")).join(paths, "path", "left").groupBy("id").agg(F.max(F.coalesce("match", F.lit(False))).alias("hidden"))
    return sync_hidden(photos, flags)


def purge(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the doomed photo ids and what hangs on them."""
    ids = doomed.select("id").distinct()
    out = {name: t.join(ids.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti").select(*t.columns) if name in CHILDREN else t for name, t in tables.items()}
    out["photos"] = tables["photos"].join(ids, "id", "left_anti")
    return out


def remove_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """Without the source, its locations, and photos that then have no location."""
    gone = tables["locations"].where(F.col("source_id") == source_id)
    left = tables["locations"].where(F.col("source_id") != source_id)
    doomed = gone.select(F.col("photo_id").alias("id")).distinct().join(left.select(F.col("photo_id").alias("id")), "id", "left_anti")
    return purge(tables | {"locations": left, "sources": tables["sources"].where(F.col("id") != source_id)}, doomed)


def removal_counts(tables: dict[str, DataFrame], source_id: int) -> DataFrame:
    """One row: locations that go with a source, and photos that are forgotten with them."""
    gone = tables["locations"].where(F.col("source_id") == source_id)
    left = tables["locations"].where(F.col("source_id") != source_id).select("photo_id")
    forgotten = gone.select("photo_id").distinct().join(left, "photo_id", "left_anti").agg(F.count("*").alias("forgotten"))
    return gone.agg(F.count("*").alias("locations")).crossJoin(F.broadcast(forgotten))  # one row each


# people


def tag_people(tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of tags: a model never overwrites a user or seed; a missing box keeps the old one; a seed stays one."""
    guard = ~((F.col("new.origin") == "model") & F.col("old.origin").isin("user", "seed"))
    changes = {c: F.col(f"new.{c}") for c in ("present", "confidence", "origin", "updated_at") if c in incoming.columns}
    changes |= {"box": F.coalesce("new.box", "old.box")} if "box" in incoming.columns else {}
    changes |= {"seed": F.col("new.seed") | F.col("old.seed")} if "seed" in incoming.columns else {}
    return merge_by_key(tags, incoming, ["photo_id", "person_id"], changes, guard)


def confirm_tags(tags: DataFrame, keys: DataFrame, now: str, add_seed: bool = False) -> DataFrame:
    """Tags ``(photo_id, person_id)`` become a user's, for certain and present; with ``add_seed`` they are seeds too."""
    changes = {"confidence": F.lit(1.0), "origin": F.lit("user"), "present": F.lit(True), "seed": F.col("old.seed") | F.lit(add_seed), "updated_at": F.lit(now).cast("timestamp_ntz")}
    return merge_by_key(tags, keys.select("photo_id", "person_id"), ["photo_id", "person_id"], changes, insert=False)


def untag(tags: DataFrame, keys: DataFrame) -> DataFrame:
    return tags.join(keys.select("photo_id", "person_id").distinct(), ["photo_id", "person_id"], "left_anti")


def reset_person(tags: DataFrame, person_id: int) -> DataFrame:
    """Without a person's model tags, absences too, so that the photos become candidates again."""
    return tags.where(~((F.col("person_id") == person_id) & (F.col("origin") == "model")))


def delete_person(tables: dict[str, DataFrame], person_id: int) -> dict[str, DataFrame]:
    """Without the person and all tags of theirs."""
    return tables | {"person_tags": tables["person_tags"].where(F.col("person_id") != person_id), "people": tables["people"].where(F.col("id") != person_id)}


def rename_person(people: DataFrame, person_id: int, name: str, now: str) -> DataFrame:
    """The name with white space collapsed; blank or over 60 characters is an error."""
    flat = " ".join(name.split())
    if not 1 <= len(flat) <= 60:
        raise ValueError("a name has 1 to 60 characters")
    return update(people, F.col("id") == person_id, {"name": F.lit(flat), "updated_at": F.lit(now).cast("timestamp_ntz")})


def describe_person(people: DataFrame, person_id: int, description: str, now: str) -> DataFrame:
    """The description with white space collapsed, 1,500 characters at most."""
    return update(people, F.col("id") == person_id, {"description": F.lit(" ".join(description.split())[:1500]), "updated_at": F.lit(now).cast("timestamp_ntz")})


# sources


def record_warnings(warnings: DataFrame, incoming: DataFrame) -> DataFrame:
    """New ``(photo_id, kind, message)`` triples only, messages cut to 300 characters."""
    cut = incoming.withColumn("message", F.substring("message", 1, 300)).dropDuplicates(["photo_id", "kind", "message"])
    fresh = cut.join(warnings, ["photo_id", "kind", "message"], "left_anti")
    return warnings.unionByName(fresh, allowMissingColumns=True)


def fill_dates(photos: DataFrame, found: DataFrame) -> DataFrame:
    """Capture dates ``(id, date_taken)`` only where none is known."""
    return merge_by_key(photos, found, ["id"], {"date_taken": F.coalesce("old.date_taken", "new.date_taken")}, insert=False)


def deferred_key(uuid: Column) -> Column:
    return F.concat(F.lit("deferred:"), uuid)


def _claims(photos: DataFrame, arrived: DataFrame) -> DataFrame:
    """``claim_, to_, size_, stays_``: deferred rows whose original came, its content, and whether the row takes it.

    A row stays if no photo has the content yet; of several such rows that of the least id does. Of several contents
    of one uuid the row gets the least.
    """
    came = arrived.where("sha256 is not null").groupBy(deferred_key(F.col("uuid")).alias("was_")).agg(F.min(F.struct("sha256", "byte_size")).alias("m_"))
    met = photos.select(F.col("id").alias("claim_"), F.col("sha256").alias("was_")).join(came, "was_").select("claim_", F.col("m_.sha256").alias("to_"), F.col("m_.byte_size").alias("size_"))
    known = photos.select(F.col("sha256").alias("to_"), F.lit(True).alias("known_"))
    first = met.groupBy("to_").agg(F.min("claim_").alias("first_"))
    return met.join(known, "to_", "left").join(first, "to_").select("claim_", "to_", "size_", (F.col("known_").isNull() & (F.col("claim_") == F.col("first_"))).alias("stays_"))


def promote_deferred(photos: DataFrame, arrived: DataFrame, requeue: bool = True, now: str | None = None) -> DataFrame:
    """Photos after arrivals ``(uuid, sha256, byte_size)``, originals that appeared on the disk.

    Where the content is known already, the deferred row goes and the photo that has it is offloaded no longer;
    else the deferred row takes the content's identity and is queued anew (done without ``requeue``); content
    with neither becomes a new queued photo, first seen at ``now``. ``promote_arrivals`` does the other tables.
    """
    claims = _claims(photos, arrived)
    contents = arrived.where("sha256 is not null").groupBy("sha256").agg(F.min("byte_size").alias("byte_size"))
    met = photos.join(claims, photos["id"] == claims["claim_"], "left").join(contents.select(F.col("sha256").alias("back_")), photos["sha256"] == F.col("back_"), "left").where("claim_ is null or stays_")
    changes = {"sha256": F.col("to_"), "byte_size": F.col("size_"), "status": F.lit("queued" if requeue else "done"), "derivative": F.lit(False), "attempts": F.lit(0)}
    changes |= {c: F.lit(None) for c in ("error", "started_at", "finished_at")}
    after = update(met, F.col("claim_").isNotNull(), {c: v for c, v in changes.items() if c in photos.columns})
    after = update(after, F.col("claim_").isNotNull() | F.col("back_").isNotNull(), {"offloaded": F.lit(False)}).select(*photos.columns)
    fresh = contents.join(claims.where("stays_").select(F.col("to_").alias("sha256")), "sha256", "left_anti")
    given = {"status": F.lit("queued"), "attempts": F.lit(0), "first_seen_at": F.lit(now)} | {c: F.lit(False) for c in ("tiled", "gated", "hidden", "derivative", "offloaded")}
    added = insert_new(photos, fresh, ["sha256"], ["sha256"]).withColumns(given)
    return after.unionByName(added.select(*[(F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in photos.schema]))


def promote_arrivals(tables: dict[str, DataFrame], arrived: DataFrame, requeue: bool = True, now: str | None = None) -> dict[str, DataFrame]:
    """All tables after arrivals ``(uuid, sha256, byte_size, source_id, path, mtime)``.

    Assets of deferred rows that go point to the photo that has their content; what else hangs on them goes too.
    The place of each arrival is added, or replaces the place of its source and path.
    """
    photos = promote_deferred(tables["photos"], arrived, requeue, now)
    owner = photos.select(F.col("id").alias("photo_id"), "sha256")
    gone = _claims(tables["photos"], arrived).where("not stays_")
    out = dict(tables)
    if "photo_assets" in out:
        to = gone.join(owner, gone["to_"] == owner["sha256"]).select("claim_", F.col("photo_id").alias("owner_"))
        out["photo_assets"] = out["photo_assets"].join(to, F.col("photo_id") == F.col("claim_"), "left").withColumn("photo_id", F.coalesce("owner_", "photo_id")).select(*out["photo_assets"].columns)
    out = purge(out, gone.select(F.col("claim_").alias("id"))) | {"photos": photos}
    key = ["source_id", "path"]
    placed = arrived.groupBy(*key).agg(F.min(F.struct("sha256", "mtime", F.col("byte_size").alias("size"))).alias("m_")).select(*key, "m_.*").join(owner, "sha256").drop("sha256")
    out["locations"] = place(out["locations"], placed)
    return out


def repoint_assets(assets: DataFrame, photos: DataFrame, arrived: DataFrame) -> DataFrame:
    """Assets of arrivals point to the photo that has their content; uuids compare without case."""
    target = arrived.join(photos.select("sha256", F.col("id").alias("to_")), "sha256").select(F.lower("uuid").alias("u_"), "to_").dropDuplicates(["u_"])
    return assets.join(target, F.lower(assets["uuid"]) == F.col("u_"), "left").withColumn("photo_id", F.coalesce("to_", "photo_id")).select(*assets.columns)


def demote_offloaded(tables: dict[str, DataFrame], missing: DataFrame, present: DataFrame, source_id: int) -> dict[str, DataFrame]:
    """All tables, and ``changed`` (id), after originals of photos ``missing`` (id, preview) left the disk.

    Their places in this source that are not among the ``present`` paths go, a preview's place comes or is taken over, and the photo
    is flagged but never queued again. Changed are photos with any of these.
    """
    gone = missing.groupBy("id").agg(F.min("preview").alias("preview"))
    ids = gone.select(F.col("id").alias("photo_id"))
    dead = tables["locations"].where(F.col("source_id") == source_id).join(ids, "photo_id", "left_semi").join(present.select("path"), "path", "left_anti").select("id", "photo_id")
    kept = tables["locations"].join(dead.select("id"), "id", "left_anti")
    shown = gone.where("preview is not null").select(F.lit(source_id).cast("long").alias("source_id"), F.col("preview").alias("path"), F.col("id").alias("photo_id"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"))
    changed = dead.select(F.col("photo_id").alias("id")).union(shown.select("photo_id")).union(tables["photos"].where(~F.col("offloaded")).select("id").join(gone.select("id"), "id", "left_semi")).distinct()
    photos = merge_by_key(tables["photos"], gone.select("id"), ["id"], {"offloaded": F.lit(True)}, insert=False)
    return tables | {"locations": place(kept, shown, repoint_only=True), "photos": photos, "changed": changed}


def place(locations: DataFrame, placed: DataFrame, repoint_only: bool = False) -> DataFrame:
    """Upsert of places ``(source_id, path, photo_id, mtime, size)`` by source and path; new ones get the next ids."""
    key = ["source_id", "path"]
    changes = {"photo_id": F.col("new.photo_id")} if repoint_only else None
    moved = merge_by_key(locations, placed, key, changes, insert=False)
    return moved.unionByName(insert_new(moved, placed, key, key), allowMissingColumns=True).select(*locations.columns)


def ensure_deferred(tables: dict[str, DataFrame], wanted: DataFrame, source_id: int, queue: bool = True, now: str | None = None) -> dict[str, DataFrame]:
    """All tables after assets ``(uuid, path, derivative, hidden)`` whose original is elsewhere were registered.

    Identity is that of the asset until the content comes. With a preview it is queued, unless ``queue`` is false; without one
    it waits. The library's hidden flag comes along. An asset that is registered stays as it is; a path becomes its place.
    """
    rows = wanted.groupBy(deferred_key(F.col("uuid")).alias("sha256")).agg(F.min("path").alias("path"), F.max("derivative").alias("derivative"), F.max("hidden").alias("hidden"))
    photos = tables["photos"]
    given = {
        "byte_size": F.lit(0).cast("long"),
        "status": F.when(F.col("derivative") & F.lit(queue), "queued").otherwise("deferred"),
        "hidden_origin": F.when(F.col("hidden"), "library"),
        "attempts": F.lit(0),
        "first_seen_at": F.lit(now).cast("timestamp_ntz"),
    } | {c: F.lit(False) for c in ("tiled", "gated", "offloaded")}
    added = insert_new(photos, rows, ["sha256"], ["sha256"]).withColumns(given)
    after = photos.unionByName(added.select(*[(F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in photos.schema]))
    owner = after.select("sha256", F.col("id").alias("photo_id"))
    shown = rows.where("path is not null").join(owner, "sha256").select(F.lit(source_id).cast("long").alias("source_id"), "path", "photo_id", F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"))
    return tables | {"photos": after, "locations": place(tables["locations"], shown, repoint_only=True)}


def record_assets(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of ``(source_id, uuid, photo_id)``; uuids are trimmed and compare without case, and a known one keeps its spelling."""
    old = assets.withColumn("u_", F.lower("uuid"))
    new = seen.select("source_id", F.trim("uuid").alias("uuid"), "photo_id").withColumn("u_", F.lower("uuid"))
    new = new.groupBy("source_id", "u_").agg(F.max_by("uuid", "photo_id").alias("uuid"), F.max("photo_id").alias("photo_id"))
    return merge_by_key(old, new, ["source_id", "u_"], {"photo_id": F.col("new.photo_id")}).select(*assets.columns)


def spell_assets(assets: DataFrame, locations: DataFrame) -> DataFrame:
    """Uuids as the first 36 characters of a file name of the photo spell them, where these differ in case only."""
    name = F.substring_index("path", "/", -1)
    stems = locations.where(F.length(name) > 36).select("photo_id", F.substring(name, 1, 36).alias("stem"))
    stems = stems.groupBy("photo_id", F.lower("stem").alias("uuid")).agg(F.min("stem").alias("stem"))
    return assets.join(stems, ["photo_id", "uuid"], "left").withColumn("uuid", F.coalesce("stem", "uuid")).select(*assets.columns)
