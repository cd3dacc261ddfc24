"""Catalog tables derived from the test tables; ``VIEWS`` is the same derivation in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.normalize import photo_hash

MODEL = "demo"
#: Categories in turn by id.
CATEGORIES = ("document", "receipt", "sign", "scene", "meme", "screenshot", "other")


def _time(start: str, days: str = "0", seconds: str = "0") -> str:
    return f"TIMESTAMP_NTZ '{start}' + make_dt_interval(cast({days} as int), 0, 0, cast({seconds} as int))"


@dataclass(frozen=True)
class Catalog:
    photos: DataFrame
    sources: DataFrame
    locations: DataFrame
    embeddings: DataFrame
    people: DataFrame
    tags: DataFrame
    folder: str


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").withColumn("sha256", F.sha2("text", 256))
    rows = docs.groupBy("sha256").agg(F.min("doc_id").alias("id"), F.min("source").alias("context"), F.min("lang").alias("language"), F.min("n_chars").alias("byte_size"))
    rows = rows.join(docs.select(F.col("doc_id").alias("id"), "sha256", "text"), ["id", "sha256"])  # grouped by digest, so only one copy of a text moves
    status = "CASE id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'deferred' ELSE 'done' END"
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    return rows.withColumn("status", F.expr(status)).select(
        "*",
        F.expr("id % 17 = 0").alias("hidden"),
        F.expr("CASE WHEN id % 34 = 0 THEN 'user' WHEN id % 17 = 0 THEN 'library' END").alias("hidden_origin"),
        F.expr(f"CASE WHEN id % 23 = 0 THEN {_time('2024-06-01 00:00:00', 'id % 90')} END").alias("deleted_at"),
        F.expr("cast(id % 4 as int)").alias("attempts"),
        F.expr("CASE WHEN status IN ('done', 'error') THEN id % 5 <> 0 END").alias("has_text"),
        F.expr("id % 11 = 0").alias("derivative"),
        F.expr("id % 19 = 0").alias("gated"),
        F.expr("id % 13 = 1").alias("tiled"),
        F.expr(f"element_at(array({names}), cast(id % 7 as int) + 1)").alias("category"),
        F.expr("concat('m', id % 2)").alias("model"),
        F.expr(f"CASE WHEN id % 13 <> 0 THEN {_time('2013-01-01 00:00:00', 'id % 3650')} END").alias("date_taken"),
        F.expr(_time("2024-01-01 00:00:00", "0", "id")).alias("first_seen_at"),
        F.expr(f"CASE WHEN status = 'processing' THEN {_time('2024-03-01 00:00:00', '0', 'id % 7200')} END").alias("started_at"),
        F.expr(f"CASE WHEN status = 'done' THEN {_time('2024-02-01 00:00:00', '0', '(id * 37) % 100000')} END").alias("finished_at"),
        F.expr("CASE WHEN status = 'done' THEN (id * 37) % 5000 END").alias("duration_ms"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").select("source").distinct()
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("long")
    return names.select(number.alias("id"), F.col("source").alias("uri"), F.when(number % 4 == 0, "library").otherwise("folder").alias("kind"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: copies of a text are places of one photo."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and source is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    least = docs.groupBy("h").agg(F.min("doc_id").alias("photo_id"))
    return docs.join(least, "h").select(F.col("doc_id").alias("id"), "photo_id", F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("source_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    return rows.select(F.col("vec_id").alias("photo_id"), F.lit(MODEL).alias("model"), F.size("embedding").alias("dims"), F.col("embedding").alias("vector"), "label")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, phash, byte_size, derivative, deleted_at``: photos whose picture is their embedding."""
    vectors = embeddings(spark, sf_dir).select(F.col("photo_id").alias("id"), photo_hash(F.col("vector")).alias("phash"))
    return vectors.select("id", "phash", F.expr("(id * 7919) % 1000").alias("byte_size"), F.expr("id % 11 = 0").alias("derivative"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings(spark, sf_dir).where("label is not null").select(F.col("label").cast("long").alias("id")).distinct()
    return found.select("id", F.concat(F.lit("Person "), F.col("id").cast("string")).alias("name"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).where("label is not null").select("photo_id", F.col("label").cast("long").alias("person_id"))
    return rows.select(
        "*",
        F.expr("photo_id % 9 <> 0").alias("present"),
        F.expr("(photo_id % 100) / 100.0D").alias("confidence"),
        F.expr("CASE WHEN photo_id % 10 = 0 THEN 'seed' WHEN photo_id % 10 < 4 THEN 'user' ELSE 'model' END").alias("origin"),
        F.expr("photo_id % 10 = 0").alias("seed"),
        F.expr("CASE WHEN photo_id % 3 = 0 THEN '1,2,30,40' END").alias("box"),
        F.expr(_time("2024-04-01 00:00:00", "photo_id % 50")).alias("created_at"),
        F.expr(f"CASE WHEN photo_id % 4 = 0 THEN {_time('2024-05-01 00:00:00', 'photo_id % 20')} END").alias("updated_at"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(*(f(spark, sf_dir) for f in (photos, sources, locations, embeddings, people, tags)), sf_dir)


_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)
VIEWS = f"""
photos AS (
  SELECT *, id % 17 = 0 AS hidden, CASE WHEN id % 34 = 0 THEN 'user' WHEN id % 17 = 0 THEN 'library' END AS hidden_origin,
    CASE WHEN id % 23 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' + to_days(CAST(id % 90 AS INTEGER)) END AS deleted_at,
    CAST(id % 4 AS INTEGER) AS attempts, CASE WHEN status IN ('done', 'error') THEN id % 5 <> 0 END AS has_text,
    id % 11 = 0 AS derivative, id % 19 = 0 AS gated, id % 13 = 1 AS tiled, list_extract([{_NAMES}], CAST(id % 7 AS INTEGER) + 1) AS category,
    'm' || (id % 2) AS model, CASE WHEN id % 13 <> 0 THEN TIMESTAMP '2013-01-01 00:00:00' + to_days(CAST(id % 3650 AS INTEGER)) END AS date_taken,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id) AS first_seen_at,
    CASE WHEN status = 'processing' THEN TIMESTAMP '2024-03-01 00:00:00' + to_seconds(id % 7200) END AS started_at,
    CASE WHEN status = 'done' THEN TIMESTAMP '2024-02-01 00:00:00' + to_seconds((id * 37) % 100000) END AS finished_at,
    CASE WHEN status = 'done' THEN (id * 37) % 5000 END AS duration_ms
  FROM (
    SELECT *, CASE id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'deferred' ELSE 'done' END AS status
    FROM (SELECT text, min(doc_id) AS id, min(source) AS context, min(lang) AS language, min(n_chars) AS byte_size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY text)
  )
), sources AS (
  SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS id, source AS uri, CASE WHEN CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) % 4 = 0 THEN 'library' ELSE 'folder' END AS kind
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
), locations AS (
  SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS photo_id, CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS source_id, source || '/' || doc_id AS path
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
), first_location AS (SELECT photo_id AS id, arg_min(path, id) AS path FROM locations GROUP BY photo_id),
photo_embeddings AS (
  SELECT vec_id AS photo_id, '{MODEL}' AS model, embedding AS vector, label FROM embeddings WHERE embedding IS NOT NULL
), people AS (SELECT DISTINCT CAST(label AS BIGINT) AS id, 'Person ' || label AS name FROM photo_embeddings WHERE label IS NOT NULL),
tags AS (
  SELECT photo_id, CAST(label AS BIGINT) AS person_id, photo_id % 9 <> 0 AS present, (photo_id % 100) / 100.0::DOUBLE AS confidence,
    CASE WHEN photo_id % 10 = 0 THEN 'seed' WHEN photo_id % 10 < 4 THEN 'user' ELSE 'model' END AS origin, photo_id % 10 = 0 AS seed,
    CASE WHEN photo_id % 3 = 0 THEN '1,2,30,40' END AS box,
    TIMESTAMP '2024-04-01 00:00:00' + to_days(CAST(photo_id % 50 AS INTEGER)) AS created_at,
    CASE WHEN photo_id % 4 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' + to_days(CAST(photo_id % 20 AS INTEGER)) END AS updated_at
  FROM photo_embeddings WHERE label IS NOT NULL
), hashed AS (
  SELECT photo_id AS id, list_sum(list_transform(range(0, 63), lambda k: CASE WHEN vector[k + 1] > vector[k + 2] THEN CAST(1 AS BIGINT) << k ELSE 0 END))::BIGINT AS phash, (photo_id * 7919) % 1000 AS byte_size, photo_id % 11 = 0 AS derivative
  FROM photo_embeddings
)
"""
