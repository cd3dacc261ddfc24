"""The extraction loop: gate, ladder and retries about a pluggable model, in Arrow batches; answers are normalised by expressions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import normalize as N
from cairn.operators import transitions as T
from cairn.operators.browse import missing_embeddings
from cairn.operators.filters import alive
from cairn.sources.walk import store_of


class BadAnswer(Exception):
    """The model answered, but with nothing usable; ``content`` is what it said."""

    def __init__(self, message: str, content: str | None = None) -> None:
        super().__init__(message)
        self.content = content


class ServerError(Exception):
    """The model's service failed at this call; the photo is tried again, then an error."""


class Unreachable(Exception):
    """The model can't be reached; its task asks nothing more, and what has no answer stays queued."""


class NotReady(Exception):
    """The model's own look at itself before a run found problems; nothing was begun."""


#: What one call may end in, and what ends all calls of a task. ``TimeoutError`` and ``ConnectionError`` are Python's own.
FAILED, GONE = (BadAnswer, ServerError, TimeoutError), (Unreachable, ConnectionError)


class Model(Protocol):
    """What a connector offers; every answer is the text that the model gave. Objects are pickled to the tasks."""

    name: str

    def gate(self, image: bytes) -> str: ...
    def extract(self, image: bytes, temperature: float) -> str: ...
    def tiles(self, image: bytes) -> list[bytes]: ...
    def match_people(self, images: list[bytes], profiles: str) -> str: ...
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Policy:
    """How often and how a photo is tried; temperatures are those of the first and the second look.

    Beyond ``deadline``, in seconds since 1970, and once a file ``stop_file`` is there, no photo is begun.
    """

    max_attempts: int = 3
    two_tier: bool = False
    transport_retries: int = 3
    backoff_seconds: float = 1.0
    temperatures: tuple[float, float] = (0.0, 0.7)
    deadline: float | None = None
    stop_file: str | None = None

    def ended(self) -> str | None:
        """Why no more photos are begun, if so."""
        if self.deadline is not None and time.time() >= self.deadline:
            return "time budget reached"
        if self.stop_file is not None and _exists(self.stop_file):
            return "stopped"
        return None


BOUNDARY = "\n\n-- tile boundary --\n\n"
OUTCOME = "id long, outcome string, error string, raw_response string, parts array<string>, tiled boolean, gated boolean, duration_ms long"


def _object(content: str) -> dict:
    """The object in an answer, all of it or from the first brace to the last."""
    for text in (content, content[content.find("{") : content.rfind("}") + 1]):
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise BadAnswer("no object in the answer", content)


def _look(model: Model, policy: Policy, image: bytes) -> str:
    """One image, with a second look at another temperature if the first gave nothing."""
    for last, temperature in enumerate(policy.temperatures):
        content = model.extract(image, temperature)
        try:
            _object(content)
            return content
        except BadAnswer:
            if last:
                raise
    raise BadAnswer("no look was asked for")


def _ladder(model: Model, policy: Policy, image: bytes) -> tuple[list[str], bool]:
    """Answers of the whole image, else of its tiles, those without an answer left out; none at all is an error."""
    try:
        return [_look(model, policy, image)], False
    except BadAnswer:
        answers, last = [], BadAnswer("tiles gave nothing usable")
        for tile in model.tiles(image):
            try:
                answers.append(_look(model, policy, tile))
            except BadAnswer as e:
                last = e
        if not answers:
            raise last from None
        return answers, True


def _reached(policy: Policy, call):
    """The result of ``call``, tried again for a while if the model can't be reached."""
    for k in range(policy.transport_retries + 1):
        try:
            return call()
        except GONE:
            if k == policy.transport_retries or policy.ended():
                raise
            time.sleep(policy.backoff_seconds)
    return None


def _one(model: Model, policy: Policy, attempts: int, image: bytes | None, recognised: str | None) -> tuple:
    """``outcome, error, raw_response, parts, tiled, gated`` of one photo."""
    if attempts >= policy.max_attempts:
        return "error", "max attempts exceeded", None, None, False, False
    if image is None:
        return "error", "no readable file", None, None, False, False
    if policy.two_tier and not recognised:
        try:
            content = _reached(policy, lambda: model.gate(image))
            if not _object(content).get("has_text"):
                return "done", None, content, [content], False, True
        except FAILED:
            pass  # the full look decides
    error: Exception = BadAnswer("not tried")
    for left in range(policy.max_attempts - attempts, 0, -1):
        try:
            answers, tiled = _reached(policy, lambda: _ladder(model, policy, image))
            return "done", None, BOUNDARY.join(answers), answers, tiled, False
        except FAILED as e:
            error = e
            if left > 1 and (why := policy.ended()):
                return "requeue", why, None, None, False, False
            if left > 1:
                time.sleep(min(30.0, policy.backoff_seconds * 2.0 ** (policy.max_attempts - left)))
    return "error", f"{type(error).__name__}: {error}", getattr(error, "content", None), None, False, False


_FIELDS = [c.split(" ")[0] for c in OUTCOME.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int64()]


def _exists(path: str) -> bool:
    store, place = store_of(path)
    return store.get_file_info(place).type != pyarrow.fs.FileType.NotFound


class Log:
    """Outcomes that are done or errors, a file for each photo and number of attempts before it, written as soon as they are known.

    A file appears whole or not at all, so a task that is run again, and a pass after one that broke off, take the
    answers that are there and ask for the others only. A log belongs to one pass: ``forget`` it once the photos
    are saved, for the same photo with as few attempts may be asked anew one day.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _place(self, photo: int, attempts: int) -> str:
        return f"{self.folder}/{photo % 997:03}/{photo}-{attempts}.json"

    def get(self, photo: int, attempts: int) -> tuple | None:
        store, place = store_of(self._place(photo, attempts))
        try:
            with store.open_input_stream(place) as stream:
                return tuple(json.loads(stream.read()))
        except FileNotFoundError:
            return None

    def put(self, photo: int, attempts: int, row: tuple) -> None:
        store, place = store_of(self._place(photo, attempts))
        store.create_dir(place.rpartition("/")[0], recursive=True)
        begun = f"{place}.{uuid.uuid4().hex}"
        with store.open_output_stream(begun) as sink:
            sink.write(json.dumps(row).encode())
        store.move(begun, place)

    def forget(self) -> None:
        store, place = store_of(self.folder)
        if _exists(self.folder):
            store.delete_dir(place)


def outcomes(claimed: DataFrame, model: Model, policy: Policy, log: str | None = None) -> DataFrame:
    """``OUTCOME`` of each of ``claimed`` (id, attempts, image, vision_text): ``done``, ``error``, or ``requeue`` with the reason.

    Rows are independent. A failed call is tried again and then an error; once the model is lost to a task, a deadline has passed or a
    stop is asked for, the rest of its rows are requeued without a call. The calls are not idempotent for whoever pays for them,
    so write the result (``cut``) before it is used twice, and give a ``log`` folder that all tasks share: what was answered there is not asked again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, gone = Log(log) if log else None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                photo, attempts, began = row["id"], row["attempts"] or 0, time.monotonic()
                known = kept.get(photo, attempts) if kept else None
                if known is None:
                    gone = gone or policy.ended()
                    try:
                        found = ("requeue", gone, None, None, False, False) if gone else _one(model, policy, attempts, row["image"], row["vision_text"])
                    except GONE as e:
                        gone = f"{type(e).__name__}: {e}"
                        found = ("requeue", gone, None, None, False, False)
                    known = (photo, *found, max(1, int((time.monotonic() - began) * 1000)))
                    if kept and found[0] != "requeue":
                        kept.put(photo, attempts, known)
                out.append(known)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_FIELDS)

    return claimed.select("id", "attempts", "image", "vision_text").mapInArrow(run, OUTCOME)


def results(found: DataFrame, model_name: str, now: str) -> DataFrame:
    """Photo columns of what is done: one answer normalised, those of tiles merged first, a gate's without text."""
    many = N.merge_tiles(F.transform("parts", N.result))
    one = F.when(F.col("gated"), N.gate_result(F.get("parts", F.lit(0)))).otherwise(N.result(F.get("parts", F.lit(0))))
    done = found.where("outcome = 'done'").withColumn("r", F.when(F.col("tiled"), many).otherwise(one))
    return done.select("id", "r.*", "raw_response", "tiled", "gated", "duration_ms", F.lit(model_name).alias("model"), F.lit(now).cast("timestamp_ntz").alias("finished_at"))


def apply_outcomes(photos: DataFrame, found: DataFrame, model_name: str, now: str) -> DataFrame:
    """Photos after their outcomes: done with what was read, or an error with one more attempt; requeued ones are as they were."""
    failed = found.where("outcome = 'error'").select("id", "error", "raw_response")
    return T.mark_error(T.mark_done(photos, results(found, model_name, now)), failed, now)


def process(photos: DataFrame, images: DataFrame, model: Model, now: str, policy: Policy = Policy(), limit: int | None = None, recent_first: bool = False, log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Photos after the queue was worked off as far as it went, and the outcomes; ``images`` holds (id, image).

    Interrupted rows are taken up again first. With a ``limit`` that many are claimed, oldest id or newest capture
    first. A photo without an image is an error, and so is one tried too often.
    """
    from cairn.operators.browse import claim
    from cairn.workspace import cut

    waiting = T.reset_processing(photos)
    rows = waiting.where(alive() & (F.col("status") == "queued"))
    if limit is not None:
        rows = rows.join(F.broadcast(claim(waiting, limit, recent_first).select("id")), "id", "left_semi")
    claimed = rows.select("id", "attempts", "vision_text" if "vision_text" in photos.columns else F.lit(None).cast("string").alias("vision_text")).join(images.select("id", "image"), "id", "left")
    found = cut(outcomes(cut(claimed, "claimed"), model, policy, log), "outcomes")
    return apply_outcomes(waiting, found, model.name, now), found


def embed(photos: DataFrame, model: Model, batch: int = 32) -> DataFrame:
    """``photo_id, model, dims, vector`` of each photo with anything to embed, in calls of ``batch`` texts in order."""
    rows = photos.select(F.col("id").alias("photo_id"), N.embedding_text(F.col("text"), F.col("context")).alias("content")).where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                vectors = model.embed(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([model.name] * len(vectors)), pa.array([len(v) for v in vectors], pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], names=["photo_id", "model", "dims", "vector"])

    return rows.mapInArrow(run, "photo_id long, model string, dims int, vector array<float>")


def store_embeddings(table: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by photo and model."""
    return T.merge_by_key(table, new, ["photo_id", "model"])


def embed_missing(photos: DataFrame, table: DataFrame, model: Model, everything: bool = False) -> DataFrame:
    """The table of embeddings with those that visible photos lacked, or with all of them anew."""
    wanted = photos.join(missing_embeddings(photos, table, model.name, everything), "id", "left_semi")
    return store_embeddings(table, embed(wanted, model))


def pack_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """``rows`` with the vector as little-endian 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            data = [None if v is None else np.array(v, "<f4").tobytes() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {'binary' if n == column else t}" for n, t in rows.dtypes))


def unpack_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    """``rows`` with little-endian 32-bit floats as an array again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            data = [None if b is None else np.frombuffer(b, "<f4") for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.list_(pa.float32())) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {'array<float>' if n == column else t}" for n, t in rows.dtypes))
