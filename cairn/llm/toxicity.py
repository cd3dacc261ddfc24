"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text are the sets of its hashed words, word pairs, and word pairs around one
skipped word. L1 leaves a few thousand weights, which are broadcast as places and values; their number is
bounded by ``2 ** BITS``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import Memo, append, raw
from cairn.llm.decontamination import item_words
from cairn.llm.language import held_out
from cairn.llm.linear import Ftrl, sigmoid

BITS = 18
#: Most labelled rows of each class that are fitted.
ROWS_PER_CLASS = 4000
EPOCHS = 4
#: Most bytes of features that the driver takes.
SAMPLE_BYTES = 128 << 20
#: Odd multipliers that mix two word hashes.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HASHES = Memo(lambda w: xxhash.xxh64_intdigest(w) - (1 << 63))


def features(text: bytes | None) -> np.ndarray:
    """Distinct feature places of a text, ascending; a text without words has none."""
    words = item_words(text)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)
    a, b, c, d = _MIX
    parts = [h * a]
    if len(h) > 1:
        parts.append((h[:-1] * b) ^ (h[1:] * c))
    if len(h) > 2:
        parts.append((h[:-2] * c) ^ (h[2:] * d))
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(31)
    return np.unique((mixed * a) >> np.uint64(64 - BITS)).astype(np.int64)


def draw(labels: DataFrame, *, key: str = "doc_id", label: str = "label", rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``key_, y, place``: at most ``rows_per_class`` ids of either class, those with the least hashes.

    Only ids and labels are looked at. Null ids and labels that are not 0 or 1 teach nothing; an id with several labels has
    the largest.
    """
    named = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key_")).agg(F.max(F.col(label).cast("int")).alias("y"))
    placed = named.withColumn("place", F.xxhash64(F.col("key_").cast("string"), F.lit("toxicity")))
    either = [placed.where(F.col("y") == y).orderBy("place", "key_").limit(rows_per_class) for y in (0, 1)]
    return either[0].unionByName(either[1])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label", rows_per_class: int = ROWS_PER_CLASS, epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES):
    """``(places, values, bias)`` fitted on the texts of at most ``rows_per_class`` labelled ids of either class.

    The ids are drawn from ``labels`` alone and broadcast (16 bytes each, so 128 kB at most), so no text is
    shuffled but those that are learned. Executors turn these into features; the driver takes them in the order of the
    draw until they fill ``sample_bytes``. Of rows with one id the least text is learned; null texts teach the bias. Without
    rows all weights are 0 and every score is 0.5.
    """
    drawn = draw(labels, key=key, label=label, rows_per_class=rows_per_class)
    met = docs.select(F.col(key).alias("key_"), F.col(text).alias("t")).join(F.broadcast(drawn), "key_")
    rows = met.groupBy("key_", "y", "place").agg(F.min("t").alias("t")).select("key_", "y", "place", "t")

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([features(t).astype("<i4").tobytes() for t in raw(batch, "t")], pa.binary())]

    learned = append(rows, "found binary", each).select("y", "place", "found").orderBy("place", "y")
    examples, size = [], 0
    for r in learned.toLocalIterator():
        size += len(r["found"])
        if size > sample_bytes:
            break
        examples.append((np.frombuffer(r["found"], "<i4").astype(np.int64), r["y"]))
    return fit(examples, epochs)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from (feature places, label), in an order that a fixed seed shuffles for each epoch."""
    model, rng = Ftrl(1 << BITS), np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            model.update(*examples[i])
    return model.sparse()


_DENSE: dict = {}


def score(docs: DataFrame, model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1, of each whole text; null and empty texts get the bias alone.

    Rows do not influence each other, so repeated ones score alike; a column named ``score`` gives way; an empty
    table gives an empty result.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        places, values, bias = shared.value
        if name not in _DENSE:
            _DENSE.clear()
            _DENSE[name] = dense = np.zeros(1 << BITS)
            dense[places] = values
        dense = _DENSE[name]
        return [pa.array(sigmoid(np.array([dense[features(t)].sum() + bias for t in raw(batch, text)])), pa.float64())]

    return append(docs, "score double", each)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: labels of two thirds of the documents are learned, all documents are scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 3, 1))
    model = train(docs, labels, label="toxic")
    found = score(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
