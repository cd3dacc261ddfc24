"""Catalog tables, their defaults, and the migrations that lead to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of the work queue.
STATES = ("queued", "processing", "done", "error", "deferred")

#: Columns of each table, as DDL.
TABLES: dict[str, str] = {
    "sources": "id long, kind string, uri string, added_at timestamp_ntz",
    "photos": "id long, sha256 string, byte_size long, first_seen_at timestamp_ntz, status string, attempts int, error string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long, has_text boolean, text string, context string, text_kind string, language string, model string, raw_response string, tiled boolean, phash long, gated boolean, category string, hidden boolean, deleted_at timestamp_ntz, derivative boolean, date_taken timestamp_ntz, offloaded boolean, hidden_origin string, vision_text string",
    "locations": "id long, photo_id long, source_id long, path string, mtime long, size long",
    "photo_warnings": "id long, photo_id long, kind string, message string, created_at timestamp_ntz",
    "people": "id long, name string, description string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "person_tags": "photo_id long, person_id long, present boolean, confidence double, origin string, box string, seed boolean, created_at timestamp_ntz, updated_at timestamp_ntz",
    "photo_assets": "source_id long, uuid string, photo_id long",
    "photo_embeddings": "photo_id long, model string, dims int, vector array<float>, updated_at timestamp_ntz",
}
#: Columns that a migration adds to ``photos``, by version, with their value for old rows.
ADDED: dict[int, dict[str, object]] = {
    2: {"tiled": False},
    3: {"phash": None},
    4: {"gated": False, "category": None},
    5: {"hidden": False, "deleted_at": None},
    7: {"derivative": False},
    10: {"date_taken": None},
    11: {"offloaded": False, "hidden_origin": None},
    13: {"vision_text": None},
}
LATEST = 14


def migrations() -> dict[int, Callable[[DataFrame], DataFrame]]:
    """Every version up to the latest, as a function of the photos table; most leave it as it is."""
    types = dict(c.split(" ") for c in TABLES["photos"].split(", "))

    def step(version: int) -> Callable[[DataFrame], DataFrame]:
        added = ADDED.get(version, {})
        return lambda photos: photos.withColumns({c: F.lit(v).cast(types[c]) for c, v in added.items() if c not in photos.columns})

    return {v: step(v) for v in range(1, LATEST + 1)}


def pending(current: int) -> list[int]:
    """Versions that a table of version ``current`` still needs, in order."""
    return [v for v in sorted(migrations()) if v > current]


def migrate(photos: DataFrame, current: int) -> tuple[DataFrame, int]:
    """The table after all pending versions, and the version it then has."""
    steps = migrations()
    for version in pending(current):
        photos = steps[version](photos)
    return photos, max(current, LATEST)


def migrate_tables(tables: dict[str, DataFrame], current: int) -> tuple[dict[str, DataFrame], int]:
    """All tables after all pending versions: columns of photos, and the spelling of asset uuids that version 14 mends."""
    from cairn.operators.transitions import spell_assets

    photos, version = migrate(tables["photos"], current)
    out = tables | {"photos": photos}
    if 14 in pending(current) and {"photo_assets", "locations"} <= set(tables):
        out["photo_assets"] = spell_assets(tables["photo_assets"], tables["locations"])
    return out, version
