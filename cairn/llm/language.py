"""Language identification in two steps: the family first, then the language within its family.

Features are hashed byte bigrams and trigrams of the whole lower-cased text, by share of the text. Families are told
from each other by one linear support vector machine each, the languages of one family by a vote over one-versus-one
machines. Families that the table does not name hold one language each, so that the machines grow with the number of
languages, not with its square.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.batches import LOWER, append, raw, resident
from cairn.llm.linear import linear_svm, one_versus_rest, sigmoid

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
#: Most labelled rows of one language that are fitted.
ROWS_PER_LANGUAGE = 500
#: Most rows of all languages that are fitted, but for two of each.
MOST_ROWS = 8000
#: Most weights that are broadcast (8 bytes each): beyond it, of more than 2,048 machines, neighbouring features share weights.
MOST_WEIGHTS = 1 << 24
#: Bytes of a text that are turned into features at once, and texts that are predicted at once.
PIECE, TEXTS = 1 << 18, 64
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}").search


def gram_places(text: bytes) -> Iterator[np.ndarray]:
    """Feature places of a text with two spaces behind it, in pieces, so that a long text takes no more memory than ``PIECE``."""
    low = text.translate(LOWER)
    for at in range(0, len(low), PIECE):
        data = np.frombuffer(low[at : at + PIECE + 2] + b"  "[: max(0, at + PIECE + 2 - len(low))], dtype=np.uint8).astype(np.uint32)
        pair = data[:-2] | data[1:-1] << 8
        both = np.concatenate([pair | 1 << 24, pair | data[2:] << 16])
        yield ((both * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.intp)


def gram_counts(text: bytes) -> np.ndarray:
    """How often each place occurs."""
    return sum((np.bincount(piece, minlength=1 << BITS) for piece in gram_places(text)), np.zeros(1 << BITS, dtype=np.int64))


@dataclass
class Hierarchy:
    """What is broadcast: a weight column for each family, if there are several, then for each pair of languages in a family."""

    members: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.bias):
            return np.zeros((len(texts), 0))
        shares = np.stack([gram_counts(t) for t in texts]) / np.array([[2 * len(t)] for t in texts])
        return shares.reshape(len(texts), len(self.weights), -1).sum(axis=2) @ self.weights + self.bias

    def _vote(self, names: list[str], chances: dict) -> tuple[str, float]:
        share = {a: np.mean([chances[a, b] if (a, b) in chances else 1 - chances[b, a] for b in names if b != a]) if len(names) > 1 else 1.0 for a in names}
        best = max(names, key=share.__getitem__)
        return best, float(share[best])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        families, out = sorted(self.members), []
        for margins in self.margins(texts):
            row, best, sure, n = sigmoid(2 * margins), 0, 1.0, 0
            if len(families) > 1:  # against the strongest rival, so that more families don't lower it
                n = len(families)
                best = int(np.argmax(margins[:n]))
                sure = float(row[best] / (row[best] + np.delete(row[:n], best).max()))
            language, more = self._vote(self.members[families[best]], dict(zip(self.pairs, row[n:], strict=True)))
            out.append((language, sure * more))
        return out


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of a text, ascending, and the share of each; at most ``2 ** BITS`` however long the text."""
    times = gram_counts(text)
    found = np.flatnonzero(times)
    return found, times[found] / (2 * len(text))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Hierarchy:
    """Fit all machines on rows of ``grams``; languages of the table's families are told apart within them only."""
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(f"family:{_FAMILY.get(lang.lower(), lang)}", []).append(lang)
    model, families = Hierarchy(members, [p for _, many in sorted(members.items()) for p in combinations(many, 2)]), sorted(members)
    alone = len(families) == 1
    machines = len(model.pairs) + (0 if alone else len(families))
    if not machines:
        return model
    shift = 0
    while machines << (BITS - shift) > MOST_WEIGHTS and shift < BITS:
        shift += 1
    size = 1 << (BITS - shift)
    scale = 1.0 / max(float(np.mean([np.linalg.norm(shares) for _, shares in rows])), 1e-9)
    rows = [(at >> shift, shares * scale) for at, shares in rows]
    if shift:
        rows = [(places, np.bincount(back, weights=shares)) for (at, shares) in rows for places, back in [np.unique(at, return_inverse=True)]]
    languages, number = np.array(langs), {lang: i for i, name in enumerate(families) for lang in members[name]}
    columns = [np.zeros((size + 1, 0))]
    if not alone:
        columns.append(one_versus_rest(rows, np.array([number[lang] for lang in langs]), len(families), size))
    for a, b in model.pairs:
        some = np.flatnonzero((languages == a) | (languages == b))
        x = np.zeros((len(some), size + 1), dtype=np.float32)
        for i, j in enumerate(some):
            x[i, rows[j][0]] = rows[j][1]
        x[:, -1] = 1.0
        columns.append(linear_svm(x, np.where(languages[some] == a, 1.0, -1.0))[:, None])
    w = np.concatenate(columns, axis=1)
    model.weights, model.bias = np.ascontiguousarray(w[:-1] * scale), w[-1]
    return model


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Hierarchy:
    """Fit on at most ``rows_per_language`` rows of each language, ``most_rows`` in all but at least two of each, drawn by hash.

    Every language is learned, however rare. Rows without a language or a letter teach nothing. Languages are counted first,
    so that about as many rows as are used become gram shares, whose size doesn't grow with the text; only those that are used
    reach the driver. The hash is of key, text and the row's place, so that rows with null or equal keys are drawn one by one; the
    same rows in other files may fit another model.
    """
    named = rows.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count()
    counts = {r["l"]: r["count"] for r in named.collect()}
    if not counts:
        return Hierarchy({})
    most = max(2, min(rows_per_language, most_rows // len(counts)))
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.monotonically_increasing_id(), F.lit("language")), F.lit(1 << 40))
    labelled = rows.select(F.col(text).alias("t"), F.col(lang).alias("l"), draw.alias("d")).where("l is not null and t is not null and t <> ''")
    limits = rows.sparkSession.createDataFrame([(name, int(min(1.0, (1.3 * most + 30) / n) * (1 << 40))) for name, n in sorted(counts.items())], "l string, until long")
    drawn = labelled.join(F.broadcast(limits), "l").where("d < until").select("l", "d", "t")

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        places, shares = [], []
        for body in raw(batch, "t"):
            found = grams(body) if _LETTER(body.decode()) else None
            places.append(found and found[0].astype("<u2").tobytes())
            shares.append(found and found[1].astype("<f4").tobytes())
        return [pa.array(places, pa.binary()), pa.array(shares, pa.binary())]

    learned = append(drawn, "places binary, shares binary", each).select("l", "d", "places", "shares").where("places is not null")
    order = Window.partitionBy("l").orderBy("d", "places", "shares")
    used = learned.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("l", "nth", "places", "shares")
    fitted = sorted(used.toLocalIterator(), key=lambda r: (r["l"], r["nth"]))
    return fit([(np.frombuffer(r["places"], "<u2").astype(np.intp), np.frombuffer(r["shares"], "<f4")) for r in fitted], [r["l"] for r in fitted])


def identify(docs: DataFrame, model: Hierarchy, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Rows do not
    influence each other, so repeated ones get the same; columns named like a result give way; an empty table gives
    an empty result.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * batch.num_rows
        known: Hierarchy = resident(("language", name), lambda: shared.value)
        texts = raw(batch, text)
        some = [i for i, body in enumerate(texts) if body and known.members and _LETTER(body.decode())]
        for a in range(0, len(some), TEXTS):
            part = some[a : a + TEXTS]
            for i, result in zip(part, known.predict([texts[i] for i in part]), strict=True):
                found[i] = result
        return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

    return append(docs, "lang_pred string, score double", each)


def held_out(key: str, folds: int, fold: int):
    """Whether crc32 of the key as text leaves ``fold``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: learned from four fifths of the documents, predicted for all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
