"""Repeated passages by sparse suffix arrays over content-selected minimiser positions.

Words are those of ``near_dedup``. A passage is a run of ``length`` words (50) that stands at two places or
more of the corpus. Of every such run the least hash among its 16-word grams selects a position; equal runs
select equal grams, so suffixes are retained at selected positions only, about one word in eighteen,
and all whose gram occurs once are dropped before any text is moved. What is left is a sparse suffix array in parts:
suffixes of one gram lie together, are extended left to each start of a run that selected them and
right to its end, and sorted by that content; neighbours that agree over all ``length`` words repeat.
Runs that overlap or touch make up longer passages.

Rows of a frequent gram never meet by gram: those with more suffixes than ``LIST_LIMIT``, and than their share of all, are
taken apart by run and compared by aggregation, with partial results before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import append, raw, shielded, values, words
from cairn.llm.near_dedup import in_sample, mix, repeated_keys, word_hashes
from cairn.operators.joins import hot_limit, spread_join
from cairn.workspace import cut

LENGTH, GRAM = 50, 16
#: Suffixes of one gram that are compared in one task.
LIST_LIMIT = 512
#: Fixed value: an odd multiplier, and its inverse by Newton's rule, for hashes of runs from prefix sums.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words from prefix sums, in time that does not depend on ``size``."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _powers(_STEP, len(h)), dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * _powers(_BACK, len(h) - size + 1))


def selected(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For the run at each start, the least gram hash within it."""
    low, have, want = run_hashes(h, gram), 1, length - gram + 1
    while len(low) and have < want:
        step = min(have, want - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return low if len(h) >= length else np.zeros(0, dtype=np.uint64)


def _starts(chosen: np.ndarray) -> np.ndarray:
    """Where a new gram is selected: the starts of retained suffixes' runs."""
    return np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(chosen) else np.zeros(0, dtype=np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def owner_of(doc: int, tag: int) -> int:
    """64 bits by which the grams of a document find its text again."""
    return xxhash.xxh3_64_intdigest(f"{doc} {tag}") - (1 << 63)


def passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, owner: Callable[[int, int], int] = owner_of) -> DataFrame:
    """``doc, hash, n_words, runs``: documents, by id and text hash, that hold repeated runs of ``length`` words.

    ``runs`` is an array of (start, stop, first): ranges of words at which repeated runs begin, split by whether the
    run is the first of its kind by id, text hash and place. Ids are integers. Rows equal in id and text are one
    document; a null id counts as the least long, -2**63, and sorts first. Texts of fewer words, nulls among them, hold no
    runs; an empty table gives an empty result; other columns are not looked at. Documents of one ``owner`` value are
    read for each other's grams too, and stay apart.
    """
    source = docs.where(F.col(text).isNotNull()).select(_doc(F.col(key)).alias("doc"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, owners = [], []
            for doc, tag, body in zip(values(batch, "doc"), values(batch, "hash"), raw(batch, "text"), strict=True):
                h = word_hashes(body)
                chosen = selected(h, length, gram)
                found = chosen[_starts(chosen)]
                if len(found):  # runs with one gram may repeat within it where the gram has several places
                    places = np.sort(run_hashes(h, gram))
                    found = np.append(found, np.intersect1d(found, places[1:][places[1:] == places[:-1]]))
                grams.append(found)
                owners.append(np.full(len(found), owner(doc, tag), dtype=np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(grams))), pa.array(np.concatenate(owners))], names=["key", "rep"])

    def owners_of(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([owner(d, t) for d, t in zip(values(batch, "doc"), values(batch, "hash"), strict=True)], pa.int64())]

    once, some = (d.mapInArrow(retain, "key long, rep long") for d in (source, source.where(in_sample(F.xxhash64("doc", "hash")))))
    repeated = cut(repeated_keys(once, some), "grams")
    wanted = repeated.groupBy("rep").agg(F.collect_set("key").alias("grams"))
    owned = append(source, "rep long", owners_of)
    # by shuffle at every size: what is wanted grows with the documents
    held = owned.hint("merge").join(wanted, "rep").dropDuplicates(["rep", "doc", "hash"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, tag, body, grams in zip(values(batch, "doc"), values(batch, "hash"), raw(batch, "text"), batch.column(3), strict=True):
                h = word_hashes(body)
                chosen, whole = _signed(selected(h, length, gram)), _signed(run_hashes(h, length))
                begin = _starts(chosen)
                end = np.append(begin[1:], len(chosen))
                take = np.isin(chosen[begin], grams.values.to_numpy())
                for a, b in zip(begin[take].tolist(), end[take].tolist(), strict=True):
                    for column, x in zip(out, (int(chosen[a]), doc, tag, a, whole[a:b].tobytes(), len(h)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["key", "doc", "hash", "at", "whole", "n"])

    suffixes = cut(held.select("doc", "hash", "text", "grams").mapInArrow(extend, "key long, doc long, hash long, at long, whole binary, n long"), "suffixes")
    total = suffixes.count()
    # fewer than HOT_SHARE grams at any size
    frequent = F.broadcast(suffixes.groupBy("key").count().where(F.col("count") > max(LIST_LIMIT, hot_limit(total))).select("key"))
    few = suffixes.drop("n").join(frequent, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "doc long, hash long, start long, stop long, first boolean")
    runs = few.union(_compare_frequent(suffixes.join(frequent, "key", "left_semi"), total * (length - gram + 1)).select("doc", "hash", "start", "stop", "first"))
    spans = runs.groupBy("doc", "hash").agg(F.collect_list(F.struct("start", "stop", "first")).alias("runs"))
    sizes = suffixes.groupBy("doc", "hash").agg(F.max("n").alias("n_words"))
    return spans.join(sizes, ["doc", "hash"]).select("doc", "hash", "n_words", "runs")


def _doc(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(-(1 << 63)).cast("long"))


def _intervals(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Consecutive run starts of a document as ranges of starts."""
    order = np.lexsort((at, tag, doc, first))
    doc, tag, at, first = doc[order], tag[order], at[order], first[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] != first[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1
    return [doc[begin], tag[begin], at[begin], at[end] + 1, first[begin]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort the extended suffixes of each gram by content and compare neighbours; rows come sorted by gram."""
    held: list[pa.RecordBatch] = []

    def ready(table: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = table.column("whole").to_pylist()
        sizes = np.array([len(w) // 8 for w in whole])
        runs = np.frombuffer(b"".join(whole), dtype=np.int64)
        doc, tag, at = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("doc", "hash", "at"))
        at = at + np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((at, tag, doc, runs))
        runs, doc, tag, at = runs[order], doc[order], tag[order], at[order]
        same = runs[1:] == runs[:-1]
        repeats = np.append(False, same) | np.append(same, False)
        first = ~np.append(False, same)
        if repeats.any():
            columns = _intervals(doc[repeats], tag[repeats], at[repeats], first[repeats])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "hash", "start", "stop", "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        border = int(np.searchsorted(keys, keys[-1]))  # the last gram may go on in the next batch
        if border or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            done = [*held, batch.slice(0, border)] if border else held
            yield from ready(pa.Table.from_batches(done))
            held = []
        held.append(batch.slice(border))
    if held:
        yield from ready(pa.Table.from_batches(held))


def _compare_frequent(suffixes: DataFrame, most: int) -> DataFrame:
    """Runs of frequent grams, at most ``most`` of them, that are repeated, by counts; no task needs all places of a run."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = values(batch, "whole")
            sizes = np.array([len(w) // 8 for w in whole], dtype=np.int64)
            starts = np.repeat(np.array(values(batch, "at"), dtype=np.int64) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            doc, tag = (np.repeat(np.array(values(batch, c), dtype=np.int64), sizes) for c in ("doc", "hash"))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(whole), dtype=np.int64)), pa.array(doc), pa.array(tag), pa.array(starts)], names=["run", "doc", "hash", "start"])

    runs = cut(suffixes.select("doc", "hash", "at", "whole").mapInArrow(apart, "run long, doc long, hash long, start long"), "runs")
    here = F.struct("doc", "hash", "start")
    least = runs.groupBy("run").agg(F.min(here).alias("least"), F.count("*").alias("times")).where("times > 1")
    return spread_join(runs, least, "run", "times", most).select("doc", "hash", "start", (F.col("start") + 1).alias("stop"), (here == F.col("least")).alias("first"))


def coverage(n: int, runs: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word masks: in a repeated run, and in one that is the first of its kind."""
    marks = np.zeros((2, n + length + 1), dtype=np.int64)
    for r in runs:
        for row in (0, 1) if r["first"] else (0,):
            marks[row, r["start"]] += 1
            marks[row, r["stop"] - 1 + length] -= 1
    inside = np.cumsum(marks, axis=1)[:, :n] > 0
    return inside[0], inside[1]


def without_words(text: bytes, gone: np.ndarray) -> str | None:
    """The text without these words and the white space between two of them; None if no word is left."""
    if gone.all():
        return None
    spans, at = [], 0
    for word in text.split():
        at = text.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for i in np.flatnonzero(gone & ~np.append(False, gone[:-1])).tolist():
        j = i
        while j + 1 < len(gone) and gone[j + 1]:
            j += 1
        out.append(text[at : spans[i][0]])
        at = spans[j][1]
    return b"".join([*out, text[at:]]).decode()


def report(docs: DataFrame, *, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_words, n_repeated, n_removed, n_passages`` for each document that holds a repeated passage.

    n_repeated counts words within repeated runs, n_removed those of them that are in no run that is the first of its
    kind, n_passages the unbroken stretches of repeated words. Rows equal in id and text give one row; an empty table none.
    """
    found = passages(docs, length=length, **options)

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for n, runs in zip(values(batch, "n_words"), values(batch, "runs"), strict=True):
            inside, first = coverage(n, runs, length)
            rows.append((int(inside.sum()), int((inside & ~first).sum()), int((inside & ~np.append(False, inside[:-1])).sum())))
        return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]

    counted = append(found, "n_repeated long, n_removed long, n_passages long", each)
    return counted.select(F.nullif("doc", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "n_words", "n_repeated", "n_removed", "n_passages")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with every repeated run cut out of ``text`` but the first of its kind.

    Documents of which no word is left go; all others stay, with a text that holds no repeat as it is, null and empty ones
    among them. Rows equal in id and text are cut alike. An empty table gives an empty result. Columns are those of
    ``docs``, whatever their names.
    """
    names, docs = docs.columns, shielded(docs, key, text)
    found = passages(docs, key=key, text=text, length=length, **options).select(F.col("doc").alias("doc_"), F.col("hash").alias("hash_"), F.col("runs").alias("runs_"))
    met = docs.hint("merge").join(found, (_doc(docs[key]) == found["doc_"]) & (F.xxhash64(docs[text]) == found["hash_"]), "left").drop("doc_", "hash_")

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, gone = [], []
        for body, runs in zip(raw(batch, text), values(batch, "runs_"), strict=True):
            new = body and body.decode()
            if runs and body:
                inside, first = coverage(len(words(body)), runs, length)
                if (inside & ~first).any():
                    new = without_words(body, inside & ~first)
            texts.append(new)
            gone.append(new is None and body is not None)
        return [pa.array(texts, pa.string()), pa.array(gone, pa.bool_())]

    changed = append(met, "new_text_ string, gone_ boolean", each).where("not gone_")
    return changed.withColumn(text, F.col("new_text_")).select(*docs.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: documents with passages of 50 words or more that stand elsewhere too."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), r AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), m AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS times, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) = 1 AS first FROM r
), p AS (
  SELECT doc_id, p, bool_or(first) AS first FROM (SELECT doc_id, first, unnest(range(i, i + 50)) AS p FROM m WHERE times > 1) GROUP BY doc_id, p
), s AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_repeated, CAST(count(*) FILTER (NOT first) AS BIGINT) AS n_removed,
  CAST(count(*) FILTER (before IS NULL OR before <> p - 1) AS BIGINT) AS n_passages
FROM s JOIN d USING (doc_id) GROUP BY doc_id, w
"""
