"""All catalog queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import normalize as N
from cairn.operators import browse as B
from cairn.operators import cluster, filters, search, transitions, vectors
from cairn.sources import driver_views as D
from cairn.sources.export import FIELDS, export_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_VISIBLE = "deleted_at IS NULL AND NOT hidden"
_ALIVE = "deleted_at IS NULL"


def _add(name: str, query: Callable[[D.Catalog], DataFrame], sql: str, more: str = "", recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(D.catalog(spark, sf_dir))
    SQL[name] = f"WITH {'RECURSIVE ' * recursive}{D.VIEWS.strip()}{more and ', ' + more} {sql}"


# pages and lists

_PAGE = "SELECT p.id, status, category, finished_at, path FROM (SELECT * FROM photos WHERE {w} ORDER BY finished_at DESC NULLS LAST, id DESC LIMIT {n} OFFSET {o}) p LEFT JOIN first_location USING (id)"
_add("browse_page", lambda c: B.page(c.photos, c.locations, filters.browse()), _PAGE.format(w=f"status = 'done' AND {_VISIBLE}", n=48, o=0))
_add(
    "browse_page_filtered",
    lambda c: B.page(c.photos, c.locations, filters.browse("all", has_text=True, category="receipt", show_hidden=True, date_from="2014-01-01", date_to="2015-12-31T23:59:59")),
    _PAGE.format(w=f"{_ALIVE} AND has_text AND category = 'receipt' AND date_taken BETWEEN TIMESTAMP '2014-01-01' AND TIMESTAMP '2015-12-31 23:59:59'", n=48, o=0),
)
_add("browse_hidden_only", lambda c: B.page(c.photos, c.locations, filters.browse("all", hidden_only=True)), _PAGE.format(w=f"{_ALIVE} AND hidden", n=48, o=0))
_add("browse_deep_offset", lambda c: B.page(c.photos, c.locations, filters.browse("all"), 48, 240), _PAGE.format(w=_VISIBLE, n=48, o=240))
_add("browse_person", lambda c: filters.with_person(c.photos.where(filters.visible()), c.tags, c.people, " person 3 ").select("id"), f"SELECT id FROM photos WHERE {_VISIBLE} AND id IN (SELECT photo_id FROM tags WHERE person_id = 3 AND present)")
_add("browse_year", lambda c: c.photos.where(filters.browse("all", year="2014")).select("id"), f"SELECT id FROM photos WHERE {_VISIBLE} AND year(date_taken) = 2014")
_add("recent_results_nulls_first", lambda c: B.recent_results(c.photos, filters.browse("all"), 100), f"SELECT id, status, finished_at FROM photos WHERE {_VISIBLE} ORDER BY finished_at DESC NULLS FIRST, id DESC LIMIT 100")
_add("trash_list", lambda c: B.trash(c.photos, c.locations), "SELECT p.id, deleted_at, path FROM photos p LEFT JOIN first_location USING (id) WHERE deleted_at IS NOT NULL")
_add("claim_fifo", lambda c: B.claim(c.photos, 20), f"SELECT id, date_taken FROM photos WHERE {_ALIVE} AND status = 'queued' ORDER BY id LIMIT 20")
_add("claim_recent_first", lambda c: B.claim(c.photos, 20, recent_first=True), f"SELECT id, date_taken FROM photos WHERE {_ALIVE} AND status = 'queued' ORDER BY coalesce(date_taken, first_seen_at) DESC, id DESC LIMIT 20")

# aggregates

_add("status_counts_rollup", lambda c: B.status_counts(c.photos), f"SELECT coalesce(status, 'total') AS status, count(*) AS n FROM photos WHERE {_ALIVE} GROUP BY ROLLUP (status)")
_add("profile_summary", lambda c: c.photos.agg(F.count("*").alias("photos"), F.count_if(F.col("status") == "done").alias("done")), "SELECT count(*) AS photos, count(*) FILTER (status = 'done') AS done FROM photos")
_add("date_histogram", lambda c: B.date_histogram(c.photos), f"SELECT CAST(year(date_taken) AS INTEGER) AS year, count(*) AS n FROM photos WHERE {_VISIBLE} AND date_taken IS NOT NULL GROUP BY 1")
_add("categories", lambda c: B.categories(c.photos), "SELECT category, count(*) AS n FROM photos GROUP BY category")
_add("distinct_categories", lambda c: c.photos.select("category").distinct(), "SELECT DISTINCT category FROM photos")
_add("avg_recent_duration", lambda c: B.recent_duration(c.photos).select(F.round("avg_ms", 6).alias("avg_ms")), "SELECT round(avg(duration_ms), 6) AS avg_ms FROM (SELECT duration_ms FROM photos WHERE status = 'done' ORDER BY finished_at DESC, id DESC LIMIT 50)")
_add("eta_minutes", lambda c: B.eta_minutes(c.photos), f"SELECT queued, round(avg_ms / 1000 * queued / 60, 6) AS minutes FROM (SELECT count(*) AS queued FROM photos WHERE {_ALIVE} AND status = 'queued'), (SELECT avg(duration_ms) AS avg_ms FROM (SELECT duration_ms FROM photos WHERE status = 'done' ORDER BY finished_at DESC, id DESC LIMIT 50))")
_add("last_finished", lambda c: c.photos.agg(F.max("finished_at").alias("last")), "SELECT max(finished_at) AS last FROM photos")
_add("page_totals", lambda c: c.photos.agg(F.count_if(filters.visible()).alias("visible"), F.count_if(filters.alive() & F.col("hidden")).alias("hidden"), F.count_if(~filters.alive()).alias("trash")), f"SELECT count(*) FILTER ({_VISIBLE}) AS visible, count(*) FILTER ({_ALIVE} AND hidden) AS hidden, count(*) FILTER (deleted_at IS NOT NULL) AS trash FROM photos")
_add(
    "people_list_counts",
    lambda c: B.people_list(c.people, c.tags, c.photos),
    f"""SELECT p.id, p.name, count(*) FILTER (present AND there) AS tags, count(*) FILTER (present AND there AND origin <> 'model') AS confirmed,
    count(*) FILTER (present AND there AND origin = 'model' AND confidence >= 0.6) AS strong, count(*) FILTER (present AND there AND origin = 'model' AND confidence < 0.6) AS uncertain, count(*) FILTER (seed) AS seeds
    FROM people p LEFT JOIN (SELECT t.*, f.id IS NOT NULL AS there FROM tags t LEFT JOIN (SELECT id FROM photos WHERE {_ALIVE}) f ON f.id = t.photo_id) t ON t.person_id = p.id GROUP BY p.id, p.name""",
)
_add("person_photos_ranked", lambda c: B.person_photos(c.tags, c.photos, 3), f"SELECT photo_id, origin, confidence, CAST(row_number() OVER (ORDER BY origin = 'seed' DESC, confidence DESC, created_at DESC, photo_id) AS INTEGER) AS place FROM tags JOIN photos p ON p.id = photo_id WHERE person_id = 3 AND present AND {_VISIBLE}")
_add("people_for_photo", lambda c: B.people_for_photo(c.tags, c.people, 4), "SELECT person_id, name, origin, confidence FROM tags JOIN people p ON p.id = person_id WHERE photo_id = 4 AND present")
_add("person_seeds_top3", lambda c: B.seeds(c.tags), "SELECT * FROM (SELECT person_id, photo_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY coalesce(updated_at, created_at) DESC, photo_id DESC) AS INTEGER) AS place FROM tags WHERE seed) WHERE place <= 3")
_add("review_queue", lambda c: c.tags.where(F.col("present") & filters.review()).select("photo_id", "person_id", "confidence"), "SELECT photo_id, person_id, confidence FROM tags WHERE present AND origin = 'model' AND confidence < 0.6")
_add("people_candidates", lambda c: B.people_candidates(c.photos, c.people, c.tags), f"SELECT id FROM photos p WHERE {_VISIBLE} AND status <> 'deferred' AND EXISTS (SELECT 1 FROM people q WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.photo_id = p.id AND t.person_id = q.id))")

# joins

_add("missing_embeddings", lambda c: B.missing_embeddings(c.photos, c.embeddings, D.MODEL), f"SELECT id FROM photos p WHERE {_VISIBLE} AND NOT EXISTS (SELECT 1 FROM photo_embeddings e WHERE e.photo_id = p.id AND model = 'demo')")
_add("orphan_photos", lambda c: B.orphans(c.photos, c.locations), "SELECT id FROM photos p WHERE NOT EXISTS (SELECT 1 FROM locations l WHERE l.photo_id = p.id)")
_add("orphan_cache_files", lambda c: B.orphan_files(c.embeddings.select((F.col("photo_id") * 3).alias("id"), F.col("photo_id").alias("length")), c.photos), "SELECT count(*) AS files, CAST(coalesce(sum(photo_id), 0) AS BIGINT) AS bytes FROM photo_embeddings e WHERE NOT EXISTS (SELECT 1 FROM photos p WHERE p.id = e.photo_id * 3)")
_add("locations_with_sources", lambda c: B.locations_with_sources(c.locations, c.sources), "SELECT l.id, photo_id, path, kind, uri FROM locations l JOIN sources s ON s.id = l.source_id")
_add("photo_paths_array", lambda c: B.paths(c.locations).select("id", F.array_join("paths", "\x1f").alias("paths")), "SELECT photo_id AS id, string_agg(path, chr(31) ORDER BY id) AS paths FROM locations GROUP BY photo_id")
_add("first_locations", lambda c: B.first_location(c.locations), "SELECT id, path FROM first_location")
_add(
    "export_records",
    lambda c: export_records(c.photos.withColumn("error", F.expr("CASE WHEN id % 3 = 0 THEN 'slow' END")), c.locations, "all").select(*FIELDS).withColumn("paths", F.array_join("paths", "|")).withColumns({"text_kind": F.lit("none"), "text": F.sha2("text", 256)}),
    """SELECT p.id, sha256, status, has_text, 'none' AS text_kind, category, language, model, tiled, gated, derivative, duration_ms, first_seen_at, finished_at,
      CASE WHEN p.id % 3 = 0 THEN 'slow' END AS error, coalesce(q.paths, '') AS paths, sha256(text) AS text, context
    FROM photos p LEFT JOIN (SELECT photo_id, string_agg(path, '|' ORDER BY id) AS paths FROM locations GROUP BY photo_id) q ON q.photo_id = p.id WHERE deleted_at IS NULL""",
)
for _name, _value, _w in [
    ("errors", None, "status = 'error'"), ("no_text", None, "status = 'done' AND has_text = false"), ("tiled", None, "tiled"), ("gated", None, "gated"), ("derivative", None, "derivative"),
    ("done_with", "m1", "status = 'done' AND model = 'm1'"), ("done_before", "2024-02-01T06:00:00", "status = 'done' AND finished_at < TIMESTAMP '2024-02-01 06:00:00'"), ("category", "meme", "category = 'meme'"), ("all", None, "status <> 'deferred'"),
]:
    _add(f"reprocess_{_name}", lambda c, n=_name, v=_value: c.photos.where(filters.reprocess(n, v)).select("id"), f"SELECT id FROM photos WHERE {_VISIBLE} AND {_w}")
_add("slice_dates", lambda c: c.photos.where(filters.date_window(filters.parse_slice_date("2014-02", end=False).isoformat(), filters.parse_slice_date("2014-03", end=True).isoformat())).select("id"), "SELECT id FROM photos WHERE date_taken >= TIMESTAMP '2014-02-01' AND date_taken < TIMESTAMP '2014-04-01'")
_add("unknown_uuid_diff", lambda c: c.embeddings.select((F.col("photo_id") * 2).alias("id")).join(c.photos.select("id"), "id", "left_anti"), "SELECT photo_id * 2 AS id FROM photo_embeddings WHERE photo_id * 2 NOT IN (SELECT id FROM photos)")
_add("ids_concat_distinct", lambda c: c.photos.where(filters.reprocess("errors")).select("id").unionByName(c.photos.where(filters.reprocess("gated")).select("id")).distinct(), f"SELECT id FROM photos WHERE {_VISIBLE} AND (status = 'error' OR gated)")
_add("content_dedup", lambda c: c.photos.select("sha256", "id", "byte_size"), "SELECT sha256, id, byte_size FROM photos")

# full-text search

_TOKENS = f"""tok AS (
  SELECT *, len(wt) + len(wc) AS dl FROM (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS wt, regexp_extract_all(strip_accents(lower(coalesce(context, ''))), '[\\p{{L}}\\p{{N}}]+') AS wc FROM photos)
)"""


def _term(word: str, columns: str = "tc", prefix: bool = False) -> str:
    test = f"starts_with(x, '{word}')" if prefix else f"x = '{word}'"
    return " + ".join(f"len(list_filter(w{c}, lambda x: {test}))" for c in columns)


def _phrase(a: str, b: str) -> str:
    return " + ".join(f"len(list_filter(range(1, len(w{c})), lambda i: w{c}[i] = '{a}' AND w{c}[i + 1] = '{b}'))" for c in "tc")


def _near(a: str, b: str, k: int) -> tuple[str, str]:
    def part(x: str, y: str) -> str:
        near = f"len(list_filter(range(1, len(w{{c}}) + 1), lambda j: w{{c}}[j] = '{y}' AND abs(i - j) BETWEEN 1 AND {k + 1})) > 0"
        return " + ".join(f"len(list_filter(range(1, len(w{c}) + 1), lambda i: w{c}[i] = '{x}' AND {near.format(c=c)}))" for c in "tc")

    return part(a, b), part(b, a)


def _fts(name: str, query: str, scored: list[tuple[str, str]], condition: str, where: str = _VISIBLE, limit: int | None = None, **options) -> None:
    tf = ", ".join(f"{t} AS f{i}, {a} AS a{i}" for i, (t, a) in enumerate(scored))
    df = ", ".join(f"CAST(count(*) FILTER (a{i} > 0) AS DOUBLE) AS d{i}" for i in range(len(scored)))
    part = [f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(scored))]
    more = f"{_TOKENS}, tf AS (SELECT *, {tf} FROM tok), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM tf)"
    rank = f"-({' + '.join(part)})"
    page = f" ORDER BY {rank}, id LIMIT {limit}" if limit else ""
    _add(name, lambda c: search.search(c.photos, query, limit=limit, **options).select("id", F.round("rank", 6).alias("rank")), f"SELECT id, round({rank}, 6) AS rank FROM tf, st WHERE {where} AND {condition}{page}", more)


def _same(*terms: str) -> list[tuple[str, str]]:
    return [(t, t) for t in terms]


# without a limit: all matches, in no order
_fts("fts_term", "with", _same(_term("with")), "f0 > 0")
_fts("fts_and", "with from", _same(_term("with"), _term("from")), "f0 > 0 AND f1 > 0")
_fts("fts_or", "von OR pour", _same(_term("von"), _term("pour")), "(f0 > 0 OR f1 > 0)")
_fts("fts_not", "with NOT from", _same(_term("with")), f"f0 > 0 AND NOT ({_term('from')} > 0)")
_fts("fts_prefix", "lic*", _same(_term("lic", prefix=True)), "f0 > 0")
_fts("fts_column", "context:src1", _same(_term("src1", "c")), "f0 > 0")
_fts("fts_phrase", '"of the"', _same(_phrase("of", "the")), "f0 > 0")
_fts("fts_near", "NEAR(with from, 5)", [(_near("with", "from", 5)[0], _term("with")), (_near("with", "from", 5)[1], _term("from"))], "f0 > 0 AND f1 > 0")
_fts("fts_fallback", "of-the", _same(_phrase("of", "the")), "f0 > 0")
_fts("fts_accents", "CIÓN OR cion*", _same(_term("cion"), _term("cion", prefix=True)), "(f0 > 0 OR f1 > 0)")
_fts("fts_filtered", "with", _same(_term("with")), "f0 > 0", f"{_ALIVE} AND category = 'sign'", limit=50, category="sign", include_hidden=True)
_fts("fts_topk", "licensed under", _same(_term("licensed"), _term("under")), "f0 > 0 AND f1 > 0", limit=20)
_add("fts_count", lambda c: search.search_count(c.photos, "with OR avec"), f"SELECT count(*) AS n FROM tok WHERE {_VISIBLE} AND {_term('with')} + {_term('avec')} > 0", _TOKENS)
_add("fts_postings", lambda c: search.postings(c.photos).groupBy("token").agg(F.count_distinct("id").alias("df"), F.sum(F.size("positions")).alias("cf")), "SELECT token, count(DISTINCT id) AS df, CAST(count(*) AS BIGINT) AS cf FROM (SELECT id, unnest(list_concat(wt, wc)) AS token FROM tok) GROUP BY token", _TOKENS)

# vectors

_VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_QV = f"CAST([{', '.join(map(str, _VECTOR))}] AS DOUBLE[])"
_add("semantic_topk", lambda c: vectors.semantic(c.photos, c.embeddings, D.MODEL, _VECTOR).select("id", F.round("similarity", 6).alias("similarity")), f"SELECT id, round(s, 6) AS similarity FROM (SELECT p.id, list_cosine_similarity(CAST(vector AS DOUBLE[]), {_QV}) AS s FROM photo_embeddings e JOIN photos p ON p.id = e.photo_id WHERE {_VISIBLE}) ORDER BY s DESC, id LIMIT 50")
_add("semantic_filtered", lambda c: vectors.semantic(c.photos, c.embeddings, D.MODEL, _VECTOR, where=filters.date_window("2013-03-01", "2013-08-31"), limit=10).select("id", F.round("similarity", 6).alias("similarity")), f"SELECT id, round(s, 6) AS similarity FROM (SELECT p.id, list_cosine_similarity(CAST(vector AS DOUBLE[]), {_QV}) AS s FROM photo_embeddings e JOIN photos p ON p.id = e.photo_id WHERE {_VISIBLE} AND date_taken BETWEEN TIMESTAMP '2013-03-01' AND TIMESTAMP '2013-08-31') ORDER BY s DESC, id LIMIT 10")
_add("similar", lambda c: vectors.similar(c.embeddings, 7, D.MODEL).select("id", F.round("similarity", 6).alias("similarity")), "SELECT e.photo_id AS id, round(list_cosine_similarity(CAST(e.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6) AS similarity FROM photo_embeddings e, photo_embeddings q WHERE q.photo_id = 7 AND e.photo_id <> 7 ORDER BY list_cosine_similarity(CAST(e.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) DESC, id LIMIT 10")

# clusters

_PAIRS = "pairs AS (SELECT DISTINCT a.phash AS a, b.phash AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM hashed a JOIN hashed b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 16)"


def _reach(where: str) -> str:
    return f"""n AS (SELECT * FROM hashed WHERE {where}), e AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id <> y.id AND bit_count(xor(x.phash, y.phash)) <= 16),
    reach AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a), cl AS (SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM lab)"""


def _hashes(name: str, query: Callable[[DataFrame], DataFrame], sql: str, more: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(D.hashed(spark, sf_dir))
    SQL[name] = f"WITH {'RECURSIVE ' * recursive}{D.VIEWS.strip()}, {more} {sql}"


_hashes("hamming_pairs", lambda h: cluster.hamming_pairs(h, 16), "SELECT * FROM pairs", _PAIRS)
_hashes("meme_clusters", lambda h: cluster.clusters(h, 16), "SELECT id, cluster, size FROM cl WHERE size >= 2", _reach("true"), True)
_hashes("duplicate_keep_largest", lambda h: cluster.duplicates(h, 16), "SELECT cluster, id, size, row_number() OVER (PARTITION BY cluster ORDER BY byte_size DESC, id) = 1 AS keep FROM cl JOIN hashed USING (id) WHERE size >= 2", _reach("NOT derivative"), True)

# scalar functions

_add("normalize_category", lambda c: c.photos.select("id", N.category(F.concat(F.lit("  "), F.col("text"))).alias("category")), r"SELECT id, CASE WHEN c = '' THEN 'other' ELSE c END AS category FROM (SELECT id, trim(substring(trim(regexp_replace(lower('  ' || text), '\s+', ' ', 'g')), 1, 40)) AS c FROM photos)")
_add("snippet_text", lambda c: c.photos.select("id", N.snippet(F.col("text")).alias("snippet")), r"SELECT id, CASE WHEN length(f) <= 220 THEN f ELSE regexp_replace(substring(f, 1, 220), ' [^ ]*$', '') || ' ...' END AS snippet FROM (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM photos)")
_add("basename", lambda c: c.locations.select("id", N.basename(F.col("path")).alias("name")), "SELECT id, string_split(path, '/')[-1] AS name FROM locations")
_add("parse_box", lambda c: c.tags.select("photo_id", N.parse_box(F.when(F.col("photo_id") % 2 == 0, F.col("box")).otherwise("1,2,0,4"))["w"].alias("w")), "SELECT photo_id, CASE WHEN photo_id % 2 = 0 AND box IS NOT NULL THEN 30 END::INTEGER AS w FROM tags")
_add("parse_duration", lambda c: c.photos.select("id", N.parse_duration(F.concat((F.col("id") % 3).cast("string"), F.lit("h"), (F.col("id") % 60).cast("string"), F.lit("m"))).alias("seconds")), "SELECT id, nullif((id % 3) * 3600.0::DOUBLE + (id % 60) * 60.0::DOUBLE, 0) AS seconds FROM photos")
_ANSWERS = [
    '{"has_text": true, "text": "a\\n\\n\\n\\nb\\n", "text_kind": "Sign", "category": " Two  Words ", "context": "\\nc\\n\\n\\n\\nd"}',
    'Here: {"text": "x", "language": " "} done',
    "[1, 2]",
    '{"has_text": false, "text": "", "language": "en"}',
    '{"has_text": "false", "text": " y ", "text_kind": "poster", "context": null}',
    '{"has_text": "true", "text": "", "text_kind": "", "context": 7}',
]


def _answer():
    return F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("id") % len(_ANSWERS)).cast("int"))


def _by_answer(*values: str) -> str:
    return "CASE id % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_LF = "chr(10)"
_add("parse_json_repair", lambda c: c.photos.select("id", N.json_text(_answer()).isNotNull().alias("parsed")), "SELECT id, id % 6 <> 2 AS parsed FROM photos")
_add(
    "normalize_result",
    lambda c: c.photos.withColumn("r", N.result(_answer())).select("id", "r.*"),
    f"SELECT id, id % 6 IN (0, 1, 4) AS has_text, {_by_answer(f"'a' || {_LF} || {_LF} || 'b'", "'x'", "''", "''", "' y '", "''")} AS text, {_by_answer(f"{_LF} || 'c' || repeat({_LF}, 4) || 'd'", "''", "''", "''", "''", "'7'")} AS context, {_by_answer("'sign'", "'none'", "'none'", "'none'", "'other'", "'none'")} AS text_kind, {_by_answer("'unknown'", "'unknown'", "'unknown'", "'en'", "'unknown'", "'unknown'")} AS language, CASE id % 6 WHEN 0 THEN 'two words' ELSE 'other' END AS category FROM photos",
)
_add(
    "normalize_gate_result",
    lambda c: c.photos.withColumn("r", N.gate_result(_answer())).select("id", "r.*"),
    f"SELECT id, false AS has_text, '' AS text, {_by_answer(f"'c' || {_LF} || {_LF} || 'd'", "''", "''", "''", "''", "'7'")} AS context, 'none' AS text_kind, 'unknown' AS language, CASE id % 6 WHEN 0 THEN 'two words' ELSE 'other' END AS category FROM photos",
)
_add(
    "person_matches",
    lambda c: c.photos.select("id", F.explode(N.person_matches(F.concat(F.lit('{"matches": [{"person_id": 1, "present": true, "confidence": 1.7}, {"person_id": 9, "present": true}, {"person_id": "2", "present": "false"}, {"person_id": 1, "present": false}, {"person_id": 3, "present": false, "confidence": '), (F.col("id") % 10 / 10).cast("string"), F.lit("}]}")), F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))).alias("m")).select("id", "m.person_id", "m.present", "m.confidence"),
    "SELECT id, 1::BIGINT AS person_id, true AS present, 1.0::DOUBLE AS confidence FROM photos UNION ALL SELECT id, 2, true, 1.0 FROM photos UNION ALL SELECT id, 3, false, (id % 10) / 10.0::DOUBLE FROM photos",
)
_TILE = "struct(id AS n, id % 3 <> 0 AS has_text, CASE WHEN id % 5 = 0 THEN '  ' ELSE concat(' t', id) END AS text, CASE WHEN id % 4 = 0 THEN ' ' ELSE concat('c', id % 2) END AS context, concat('k', id % 2) AS text_kind, 'en' AS language, CASE WHEN id % 7 = 0 THEN '' ELSE 'sign' END AS category)"
_add(
    "merge_tiles",
    lambda c: c.locations.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.expr(_TILE))).alias("tiles")).withColumn("m", N.merge_tiles(F.col("tiles"))).select("photo_id", "m.*"),
    """SELECT photo_id, coalesce(bool_or(f), false) AS has_text, coalesce(string_agg('t' || id, chr(10) || chr(10) ORDER BY id) FILTER (f), '') AS text, coalesce(string_agg('c' || (id % 2), ' | ' ORDER BY id) FILTER (id % 4 <> 0), '') AS context,
    coalesce(arg_min('k' || (id % 2), id) FILTER (f), 'none') AS text_kind, CASE WHEN bool_or(f) THEN 'en' ELSE 'unknown' END AS language, arg_min(CASE WHEN id % 7 = 0 THEN 'other' ELSE 'sign' END, id) FILTER (f) AS category
    FROM (SELECT *, id % 3 <> 0 AND id % 5 <> 0 AS f FROM locations) GROUP BY photo_id""",
)

# transitions

_STATE = ["id", "status", "attempts", "hidden", "deleted_at"]
_FULL = ["id", "status", "attempts", "error", "started_at", "finished_at", "raw_response", "hidden", "deleted_at"]
_DONE_AT = "TIMESTAMP '2024-05-05 00:00:00'"


def _tried(c: D.Catalog) -> DataFrame:
    """Photos that all ended once, with an error and a raw response, in whatever state they are now."""
    return c.photos.withColumns({"error": F.concat(F.lit("e"), F.col("id").cast("string")), "raw_response": F.lit("old"), "finished_at": F.expr(_DONE_AT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))})


_TRIED = f"tried AS (SELECT * REPLACE ({_DONE_AT} AS finished_at), 'e' || id AS error, 'old' AS raw_response FROM photos)"


def _state(name: str, query: Callable[[D.Catalog], DataFrame], when: str, **changes: str) -> None:
    """A transition of all that a row's state is: ``changes`` where ``when`` holds."""
    columns = ", ".join(f"CASE WHEN {when} THEN {changes[c]} ELSE {c} END AS {c}" if c in changes else c for c in _FULL)
    _add(name, lambda c: query(c).select(*_FULL), f"SELECT {columns} FROM tried", _TRIED)


_state("reclaim_stale", lambda c: transitions.reclaim_stale(_tried(c), "2024-03-01T01:30:00"), f"status = 'processing' AND started_at <= TIMESTAMP '2024-03-01 00:30:00' AND {_ALIVE}", status="'queued'", error="NULL", started_at="NULL", finished_at="NULL")
_state("requeue_errors", lambda c: transitions.requeue_errors(_tried(c)), f"status = 'error' AND {_ALIVE}", status="'queued'", attempts="0", error="NULL", started_at="NULL", finished_at="NULL")
_state("requeue_photos", lambda c: transitions.requeue_photos(_tried(c), c.tags.select(F.col("photo_id").alias("id"))), "id IN (SELECT photo_id FROM tags)", status="'queued'", attempts="0", error="NULL", started_at="NULL", finished_at="NULL")
_state("requeue_stopped", lambda c: transitions.requeue(_tried(c), F.col("status") == "processing"), "status = 'processing'", status="'queued'", started_at="NULL", finished_at="NULL")
_state("reset_processing", lambda c: transitions.reset_processing(_tried(c)), f"status = 'processing' AND {_ALIVE}", status="'queued'", started_at="NULL")
_state("mark_error", lambda c: transitions.mark_error(_tried(c), c.tags.select(F.col("photo_id").alias("id"), F.lit("boom").alias("error"), F.when(F.col("present"), "new").alias("raw_response")), "2024-06-06"), "id IN (SELECT photo_id FROM tags)", status="'error'", attempts="attempts + 1", error="'boom'", finished_at="TIMESTAMP '2024-06-06'", raw_response="CASE WHEN id IN (SELECT photo_id FROM tags WHERE present) THEN 'new' ELSE 'old' END")
_state("mark_done", lambda c: transitions.mark_done(_tried(c), c.tags.select(F.col("photo_id").alias("id"), F.lit("r").alias("raw_response"))), "id IN (SELECT photo_id FROM tags)", status="'done'", error="NULL", raw_response="'r'")
_add("trash_restore_diff", lambda c: transitions.restore(transitions.trash(c.photos, F.col("id") % 5 == 0, "2025-01-01"), F.col("id") % 46 == 0).select(*_STATE), "SELECT id, status, attempts, CASE WHEN id % 5 = 0 AND deleted_at IS NULL THEN false ELSE hidden END AS hidden, CASE WHEN id % 46 = 0 THEN NULL WHEN deleted_at IS NULL AND id % 5 = 0 THEN TIMESTAMP '2025-01-01' ELSE deleted_at END AS deleted_at FROM photos")
_add(
    "hidden_sync",
    lambda c: transitions.sync_hidden(c.photos.withColumns({"hidden": F.expr("id % 4 < 2"), "hidden_origin": F.expr("CASE id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'library' WHEN 2 THEN 'library' END")}), c.photos.select("id", (F.col("id") % 3 == 0).alias("hidden"))).select("id", "hidden", "hidden_origin"),
    """SELECT id, CASE WHEN id % 3 = 0 AND o IS DISTINCT FROM 'user' THEN true WHEN id % 3 <> 0 AND o IS NOT DISTINCT FROM 'library' THEN false ELSE id % 4 < 2 END AS hidden,
    CASE WHEN id % 3 = 0 AND o IS DISTINCT FROM 'user' THEN 'library' WHEN id % 3 <> 0 AND o IS NOT DISTINCT FROM 'library' THEN NULL ELSE o END AS hidden_origin
    FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'library' WHEN 2 THEN 'library' END AS o FROM photos)""",
)
_add(
    "import_hidden",
    lambda c: transitions.import_hidden(c.photos, c.locations, 0, c.locations.where("photo_id % 2 = 0").select(F.upper("path").alias("path"))).select("id", "hidden", "hidden_origin"),
    """SELECT p.id, CASE WHEN h IS NULL THEN hidden WHEN h AND hidden_origin IS DISTINCT FROM 'user' THEN true WHEN NOT h AND hidden_origin IS NOT DISTINCT FROM 'library' THEN false ELSE hidden END AS hidden,
    CASE WHEN h IS NULL THEN hidden_origin WHEN h AND hidden_origin IS DISTINCT FROM 'user' THEN 'library' WHEN NOT h AND hidden_origin IS NOT DISTINCT FROM 'library' THEN NULL ELSE hidden_origin END AS hidden_origin
    FROM photos p LEFT JOIN (SELECT photo_id, bool_or(photo_id % 2 = 0) AS h FROM locations WHERE source_id = 0 GROUP BY photo_id) l ON l.photo_id = p.id""",
)
_add(
    "merge_tag_guard",
    lambda c: transitions.tag_people(c.tags, c.tags.where("photo_id % 2 = 0").select("photo_id", "person_id", F.lit(False).alias("present"), F.lit(0.25).alias("confidence"), F.lit("model").alias("origin"), F.lit(None).cast("string").alias("box"), F.lit(True).alias("seed"))).select("photo_id", "person_id", "present", "confidence", "origin", "box", "seed"),
    "SELECT photo_id, person_id, CASE WHEN f THEN false ELSE present END AS present, CASE WHEN f THEN 0.25::DOUBLE ELSE confidence END AS confidence, origin, box, f OR seed AS seed FROM (SELECT *, photo_id % 2 = 0 AND origin = 'model' AS f FROM tags)",
)
_add(
    "confirm_tags",
    lambda c: transitions.confirm_tags(c.tags, c.tags.where(filters.review()), "2024-07-07", add_seed=True).select("photo_id", "person_id", "present", "confidence", "origin", "seed", "updated_at"),
    "SELECT photo_id, person_id, present OR f AS present, CASE WHEN f THEN 1.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN f THEN 'user' ELSE origin END AS origin, seed OR f AS seed, CASE WHEN f THEN TIMESTAMP '2024-07-07' ELSE updated_at END AS updated_at FROM (SELECT *, origin = 'model' AND confidence < 0.6 AS f FROM tags)",
)
_add("untag", lambda c: transitions.untag(c.tags, c.tags.where(filters.review())).select("photo_id", "person_id"), "SELECT photo_id, person_id FROM tags WHERE NOT (origin = 'model' AND confidence < 0.6)")
_add("delete_person", lambda c: transitions.delete_person({"person_tags": c.tags, "people": c.people}, 3)["person_tags"].select("photo_id", "person_id"), "SELECT photo_id, person_id FROM tags WHERE person_id <> 3")
_add("rename_person", lambda c: transitions.rename_person(c.people.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), 3, "  Ann \t Lee ", "2024-07-07"), "SELECT id, CASE id WHEN 3 THEN 'Ann Lee' ELSE name END AS name, CASE id WHEN 3 THEN TIMESTAMP '2024-07-07' END AS updated_at FROM people")
_add("reset_person", lambda c: transitions.reset_person(c.tags, 3).select("photo_id", "person_id", "origin"), "SELECT photo_id, person_id, origin FROM tags WHERE NOT (person_id = 3 AND origin = 'model')")
_add("purge_cascade", lambda c: transitions.purge({"photos": c.photos, "locations": c.locations, "person_tags": c.tags}, c.photos.where("deleted_at is not null"))["locations"].select("id", "photo_id"), "SELECT id, photo_id FROM locations WHERE photo_id NOT IN (SELECT id FROM photos WHERE deleted_at IS NOT NULL)")
_add("remove_source", lambda c: transitions.remove_source({"photos": c.photos, "locations": c.locations, "sources": c.sources}, 0)["photos"].select("id"), "SELECT id FROM photos p WHERE EXISTS (SELECT 1 FROM locations l WHERE l.photo_id = p.id AND source_id <> 0) OR NOT EXISTS (SELECT 1 FROM locations l WHERE l.photo_id = p.id)")
_add(
    "promote_deferred",
    lambda c: transitions.promote_deferred(
        c.photos.withColumns({"sha256": F.when(F.col("status") == "deferred", F.concat(F.lit("deferred:u"), F.col("id").cast("string"))).otherwise(F.col("sha256")), "offloaded": F.lit(True)}),
        c.photos.where("status = 'deferred'").select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("sha256"), F.lit(7).cast("long").alias("byte_size")),
    ).select("id", "status", "byte_size", "offloaded"),
    "SELECT id, CASE status WHEN 'deferred' THEN 'queued' ELSE status END AS status, CASE status WHEN 'deferred' THEN 7 ELSE byte_size END AS byte_size, status <> 'deferred' AS offloaded FROM photos",
)
#: Deferred photos come with new or with known content; known and unknown content comes without a deferred row.
_ARRIVED = "CASE WHEN status = 'deferred' AND id % 20 = 3 THEN concat('new', id) WHEN status = 'deferred' THEN concat('c', id + 1) WHEN status = 'error' THEN concat('c', id) ELSE concat('fresh', id) END"
_CAME = "status IN ('deferred', 'error', 'queued')"
_add(
    "promote_deferred_all",
    lambda c: transitions.promote_deferred(
        c.photos.withColumns({"sha256": F.expr("concat(CASE status WHEN 'deferred' THEN 'deferred:u' ELSE 'c' END, id)"), "offloaded": F.lit(True)}),
        c.photos.where(_CAME).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uuid"), F.expr(_ARRIVED).alias("sha256"), F.lit(7).cast("long").alias("byte_size")),
    ).select("id", "sha256", "status", "attempts", "finished_at", "byte_size", "offloaded"),
    """SELECT b.id, coalesce(a.sha256, b.sha256) AS sha256, CASE WHEN a.uuid IS NULL THEN status ELSE 'queued' END AS status, CASE WHEN a.uuid IS NULL THEN attempts ELSE 0 END AS attempts, CASE WHEN a.uuid IS NULL THEN finished_at END AS finished_at,
    CASE WHEN a.uuid IS NULL THEN byte_size ELSE 7 END AS byte_size, a.uuid IS NULL AND b.sha256 NOT IN (SELECT sha256 FROM came) AS offloaded
    FROM base b LEFT JOIN came a ON b.sha256 = 'deferred:' || a.uuid WHERE a.uuid IS NULL OR a.sha256 NOT IN (SELECT sha256 FROM base)
    UNION ALL SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY sha256), sha256, 'queued', 0, NULL, 7, false FROM came WHERE sha256 NOT IN (SELECT sha256 FROM base) AND 'deferred:' || uuid NOT IN (SELECT sha256 FROM base)""",
    f"base AS (SELECT id, concat(CASE status WHEN 'deferred' THEN 'deferred:u' ELSE 'c' END, id) AS sha256, status, attempts, finished_at, byte_size FROM photos), came AS (SELECT concat('u', id) AS uuid, {_ARRIVED} AS sha256 FROM photos WHERE {_CAME})",
)
_add("upsert_photos", lambda c: transitions.insert_new(c.photos.where("id % 2 = 0").select("id", "sha256"), c.photos.select("sha256"), ["sha256"], ["sha256"]).select("id", "sha256"), "SELECT (SELECT max(id) FROM photos WHERE id % 2 = 0) + row_number() OVER (ORDER BY sha256) AS id, sha256 FROM photos WHERE id % 2 = 1")
_add("fill_dates", lambda c: transitions.fill_dates(c.photos, c.photos.select("id", F.lit("2020-01-01").cast("timestamp_ntz").alias("date_taken"))).select("id", "date_taken"), "SELECT id, coalesce(date_taken, TIMESTAMP '2020-01-01') AS date_taken FROM photos")
