"""Fill-in-the-middle: texts rearranged about a seeded cut, from an index of distinct texts.

Identical texts are brought together by hash and told apart by content. Of each distinct text the places at which code points
begin are listed once, as an Elias-Fano list of some two bits a code point; its documents are joined to it, and each
selects the byte offsets of its own cut from the list. Each task sends a text once for all documents that it holds with
it. A text of very many documents is dealt out in blocks of them, each with an index of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.batches import raw, values
from cairn.operators.joins import hot_limit

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
#: Percent of documents that are rearranged, and of these such that begin with the suffix.
FORMED, SUFFIX_FIRST = 90, 20
#: Bytes of output that are handed on at once, and bytes of a text that are listed at once.
OUT_BYTES, SLICE = 4 << 20, 1 << 20


class Boundaries:
    """Elias-Fano list of the byte offsets at which the code points of a UTF-8 text begin, and of its end."""

    def __init__(self, text: bytes) -> None:
        view = np.frombuffer(text, dtype=np.uint8)
        starts = (view & 0xC0) != 0x80
        self.n = int(np.count_nonzero(starts))
        self.shift = max(0, ((len(text) + 1) // (self.n + 1)).bit_length() - 1)
        bits = np.zeros(self.n + 2 + (len(text) >> self.shift) + 63 & ~63, dtype=bool)
        self.low = np.zeros(self.n + 1 if self.shift else 0, dtype=np.uint8)
        done = 0
        for at in range(0, len(text) + 1, SLICE):
            found = np.flatnonzero(starts[at : at + SLICE]) + at
            if at + SLICE > len(text):
                found = np.append(found, len(text))
            bits[(found >> self.shift) + np.arange(done, done + len(found))] = True
            if self.shift:
                self.low[done : done + len(found)] = found & ((1 << self.shift) - 1)
            done += len(found)
        self.high = np.packbits(bits, bitorder="little").view("<u8")
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def __getitem__(self, i: int) -> int:
        """Byte offset of code point i, or of the end where i is their number."""
        word = int(np.searchsorted(self.ones, i, side="right"))
        left = int(self.high[word])
        for _ in range(i - (int(self.ones[word - 1]) if word else 0)):
            left &= left - 1
        upper = word * 64 + (left & -left).bit_length() - 1 - i
        return upper << self.shift | (int(self.low[i]) if self.shift else 0)


def arranged(key: object, text: bytes, index: Boundaries, marked: bool, seed: int) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of prefix and middle, and output for the document ``key``, a null key counting as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))
    if not text or marked or h3 % 100 >= FORMED:
        return "plain", None, None, text
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    begin, end = index[a], index[b]
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    p, s, m = MARKS
    if h4 % 100 < SUFFIX_FIRST:
        return "spm", a, b - a, b"".join([s, suffix, p, prefix, m, middle])
    return "psm", a, b - a, b"".join([p, prefix, s, suffix, m, middle])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a batch once, with the keys of its documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, blocks = values(batch, "hash"), values(batch, "block")
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(zip(hashes, blocks, raw(batch, "text"), strict=True)):
            groups.setdefault(row, []).append(i)
        order = pa.array([i for rows in groups.values() for i in rows], pa.int64())
        ends = np.cumsum([0, *map(len, groups.values())])
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), batch.column(batch.schema.get_field_index("key")).take(order))
        columns = [pa.array([g[0] for g in groups], pa.int64()), pa.array([g[1] for g in groups], pa.int64()), pa.array([g[2] for g in groups], pa.binary()), keys]
        yield pa.RecordBatch.from_arrays(columns, names=["hash", "block", "text", "keys"])


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``hash, block, text, keys``: texts with the keys of documents that hold them, rows of one text together and in a few rows only."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    limit = hot_limit(docs.count())
    # fewer than HOT_SHARE rows of two numbers at any size
    hot = F.broadcast(rows.groupBy("hash").count().where(F.col("count") > limit).select("hash", F.ceil(F.col("count") / limit).alias("blocks")))
    dealt = rows.join(hot, "hash", "left").withColumn("block", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("blocks")), F.lit(0)).cast("long"))
    schema = T.StructType([*T.StructType.fromDDL("hash long, block long, text binary").fields, T.StructField("keys", T.ArrayType(docs.schema[key].dataType))])
    sent = dealt.select("hash", "block", "text", "key").mapInArrow(_gather, schema)
    return sent.repartition("hash", "block").sortWithinPartitions("hash", "block")


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every document; the key's column keeps its name.

    n counts code points. Prefix ends after the smaller of two seeded numbers of them and middle after the larger. A
    text that is empty or null, holds a mark, or is not among the rearranged ones is output as it is (form ``plain``). Rows
    with equal keys are cut alike, null keys as if they were empty; each row gives one, an empty table none. Other columns are not looked at.
    """
    texts = grouped(docs, key, text)
    fields = [T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output binary").fields]

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            keys, rows, size = batch.column(3), [], 0

            def ready(rows: list, kind: pa.DataType = keys.type.value_type) -> pa.RecordBatch:
                kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.name for f in fields])

            for i, (tag, block, body) in enumerate(zip(values(batch, "hash"), values(batch, "block"), batch.column(2), strict=True)):
                if (tag, block) != at:
                    at, known = (tag, block), {}
                body = body.as_py()
                if body not in known:
                    known[body] = Boundaries(body), any(m in body for m in MARKS)
                index, marked = known[body]
                for k in keys[i].values.to_pylist():
                    found = arranged(k, body, index, marked, seed)
                    rows.append((k, index.n, *found))
                    size += len(found[3]) + 64
                    if size > OUT_BYTES:
                        yield ready(rows)
                        rows, size = [], 0
            if rows:
                yield ready(rows)

    made = texts.mapInArrow(cut_all, T.StructType(fields))
    return made.withColumn("output", F.col("output").cast("string")).withColumnRenamed("key", key)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>", -1)  # a formed text holds no mark, and none arises where its parts meet one
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document's form, cut, digest of the output, and digest of the text read back from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM x
), q AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM q
"""
