"""Semantic search over stored vectors: cosine as an expression, filters first, top-k last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.normalize import cosine
from cairn.operators.filters import visible


def semantic(photos: DataFrame, embeddings: DataFrame, model: str, vector: list[float], *, where: Column | None = None, limit: int = 50) -> DataFrame:
    """``id, similarity`` of the nearest visible photos, ties by id; zero vectors are skipped."""
    rows = photos.where(visible() if where is None else visible() & where).select("id")
    near = embeddings.where(F.col("model") == model).select(F.col("photo_id").alias("id"), cosine(F.col("vector"), F.lit(vector).cast("array<double>")).alias("similarity"))
    return near.where(F.col("similarity").isNotNull()).join(rows, "id", "left_semi").orderBy(F.desc("similarity"), "id").limit(limit)


def similar(embeddings: DataFrame, photo_id: int, model: str, limit: int = 10) -> DataFrame:
    """Nearest other vectors of the same model, whether visible or not; empty without a vector of the photo."""
    mine = embeddings.where(F.col("model") == model)
    query = mine.where(F.col("photo_id") == photo_id).select(F.col("vector").alias("q")).limit(1)
    rows = mine.where(F.col("photo_id") != photo_id).crossJoin(F.broadcast(query))  # one row
    return rows.select(F.col("photo_id").alias("id"), cosine(F.col("vector"), F.col("q")).alias("similarity")).where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "id").limit(limit)
