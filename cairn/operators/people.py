"""The people pass: which photos are looked at, what a model says about them, and the tags that follow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import normalize as N
from cairn.operators import transitions as T
from cairn.operators.browse import people_candidates
from cairn.operators.extract import FAILED, GONE, Model


def profiles_json(people: DataFrame) -> DataFrame:
    """One row, ``profiles``: id, name and description of all people, by id, as a JSON array; the people of a pass are few."""
    one = F.struct(F.col("id").alias("person_id"), "name", F.coalesce("description", F.lit("")).alias("recognition_profile"))
    return people.agg(F.to_json(F.array_sort(F.collect_list(one))).alias("profiles"))


def seed_boxes(tags: DataFrame, most: int = 3) -> DataFrame:
    """``person_id, photo_id, box``: of each person the newest seeds with a box, from which a profile is made."""
    newest = Window.partitionBy("person_id").orderBy(F.coalesce("updated_at", "created_at").desc(), F.desc("photo_id"))
    rows = tags.where(F.col("seed")).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    return rows.select("person_id", "photo_id", N.parse_box(F.col("box")).alias("box"))


def absent(candidates: DataFrame, people: DataFrame, tags: DataFrame, now: str) -> DataFrame:
    """Model tags that say no for every person on each candidate (id), but where a user or seed said yes."""
    sure = tags.where(F.col("present") & (F.col("origin") != "model")).select("photo_id", "person_id")
    pairs = candidates.select(F.col("id").alias("photo_id")).crossJoin(F.broadcast(people.select(F.col("id").alias("person_id"))))  # a pass names few people
    return _model_tags(pairs.join(sure, ["photo_id", "person_id"], "left_anti").withColumns({"present": F.lit(False), "confidence": F.lit(0.0)}), now)


def _model_tags(rows: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    return rows.select("photo_id", "person_id", "present", "confidence", F.lit("model").alias("origin"), F.lit(None).cast("string").alias("box"), F.lit(False).alias("seed"), at.alias("created_at"), at.alias("updated_at"))


def answers(rows: DataFrame, profiles: str, model: Model) -> DataFrame:
    """``photo_id, content`` of each row (photo_id, images); null where the model gave nothing usable, and once it is lost to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = False
        for batch in batches:
            said = []
            for images in batch.column(1).to_pylist():
                answer = None
                if not gone:
                    try:
                        answer = model.match_people(images or [], profiles)
                    except FAILED:
                        pass
                    except GONE:
                        gone = True
                said.append(answer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["photo_id", "content"])

    return rows.select("photo_id", "images").mapInArrow(run, "photo_id long, content string")


def tags_of(found: DataFrame, people: DataFrame, now: str) -> DataFrame:
    """Model tags of answers ``(photo_id, content)`` about these people, presences and absences."""
    ids = F.broadcast(people.agg(F.collect_set("id").alias("ids")))  # one row
    rows = found.where("content is not null").crossJoin(ids).select("photo_id", F.explode(N.person_matches(F.col("content"), F.col("ids"))).alias("m"))
    return _model_tags(rows.select("photo_id", "m.person_id", "m.present", "m.confidence"), now)


def match_people(photos: DataFrame, people: DataFrame, tags: DataFrame, faces: DataFrame | None, images: DataFrame, model: Model, now: str) -> DataFrame:
    """Tags after a pass over all photos that lack a tag for one of these people.

    ``faces`` (id, n) says how many faces a photo shows: where that is 0 nobody is there, and no model is asked. Photos that
    nobody has measured, and all without ``faces``, are asked about if they have images, and else stay candidates of a later pass. ``images`` (photo_id, images) is what the model is shown. Users' and seeds' tags stay as they are.
    """
    from cairn.workspace import cut

    candidates = people_candidates(photos, people, tags)
    asked, none = candidates, None
    if faces is not None:
        counted = candidates.join(faces.groupBy("id").agg(F.max("n").alias("n")), "id", "left")
        asked, none = counted.where("n IS NULL OR n > 0").select("id"), counted.where("n = 0").select("id")
    shown = images.join(asked.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")
    found = cut(answers(shown, profiles_json(people).first()["profiles"], model), "matches")
    new = tags_of(found, people, now)
    if none is not None:
        new = new.unionByName(absent(none, people, tags, now))
    return T.tag_people(tags, new)
