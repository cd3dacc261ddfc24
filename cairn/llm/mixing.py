"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every row gets a random key from its id and text, so an order is the same in each run. Rows are range-sorted by source and
key, so a source of any share of them spreads over many tasks. Sums within each sorted part, and the sums of the parts
before it, give each row the words of its source that stand before it; no task sees a whole source. A source's budget is
met by whole epochs first; of what remains rows are taken in that order, and the row at the cut gives just the words
that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cairn.llm.batches import append, raw, shielded, values
from cairn.workspace import cut

#: Shares of the sources in their order, repeating; and how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, in memory of its size; null has none."""
    marks = F.regexp_replace(text, f"[^{_SPACE}]++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{_SPACE}]++", "")), F.lit(0)).cast("long")


def measured(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` with ``size``, the number of words, and ``draw``, a random key of seed, id and text; nulls count as empty."""
    of_text = F.coalesce(F.md5(text), F.lit(""))
    draw = F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), of_text))
    return docs.withColumns({"size": word_count(F.col(text)), "draw": draw})


def _sums_before(part: int, batches: Iterator[pa.RecordBatch], group: str, of: list[str]) -> Iterator[pa.RecordBatch]:
    """Each batch with the part and, for each column of ``of``, the sum over earlier rows of the same part and group."""
    held: tuple | None = None
    sums = [0] * len(of)
    for batch in batches:
        if not batch.num_rows:
            continue
        tags = batch.column(batch.schema.get_field_index(group))
        codes = tags.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        lengths = np.diff(np.append(first, len(codes)))
        goes_on = held == (tags[0].as_py(),)
        before = []
        for i, name in enumerate(of):
            x = batch.column(batch.schema.get_field_index(name)).to_numpy()
            running = np.cumsum(x)
            base = running[first] - x[first]
            base[0] = -sums[i] if goes_on else 0
            before.append(pa.array(running - x - np.repeat(base, lengths)))
            sums[i] = int(running[-1] - base[-1])
        held = (tags[-1].as_py(),)
        parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, *before], names=[*batch.schema.names, "part_", *[f"within_{n}" for n in of]])


def sorted_parts(rows: DataFrame, group: str, order: list, of: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` range-sorted by ``order``, which begins with ``group``, as a table with ``part_`` and ``within_X``, the sum
    of each X of ``of`` over earlier rows of the same part and group; and a table ``group, part_, before_X`` of
    the sums over earlier parts of the group, which has a row for each group and each border of parts.

    What stands before a row is ``before_X + within_X``. Values are longs and not null. Rows that ``order`` does not tell
    apart are spread too, and stand in any order.
    """
    tied = rows.withColumn("tie_", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "tie_").sortWithinPartitions(*order, "tie_").drop("tie_")
    schema = T.StructType([*ranged.schema.fields, T.StructField("part_", T.IntegerType()), *[T.StructField(f"within_{n}", T.LongType()) for n in of]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums_before(TaskContext.get().partitionId(), batches, group, of)

    table = cut(ranged.mapInArrow(run, schema), "sorted")
    parts = table.groupBy(group, "part_").agg(*[F.sum(n).alias(n) for n in of])
    earlier = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return table, parts.select(group, "part_", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in of])


def with_sums(rows: DataFrame, group: str, order: list, of: list[str]) -> DataFrame:
    """``rows`` with ``before_X``: for each X of ``of``, its sum over the rows that stand before in the group."""
    table, offsets = sorted_parts(rows, group, order, of)
    there = offsets.select(F.col(group).alias("group_"), F.col("part_").alias("at_"), *[F.col(f"before_{n}").alias(f"start_{n}") for n in of])
    met = table.join(there, table[group].eqNullSafe(there["group_"]) & (table["part_"] == there["at_"]))
    return met.select(*rows.columns, *[(F.col(f"start_{n}") + F.col(f"within_{n}")).alias(f"before_{n}") for n in of])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` of a table ``source, source_size`` of one row a source.

    Sources by code point, null last, take the weights in turn, repeating, and share the sum of all sizes by them; no target is above ``most``
    times its source's size, and what that leaves over is shared by weight again. In the order of cap by weight the capped sources come
    first, so prefix sums of caps and weights tell for each source alone whether it is one of them. Without sources there are no
    rows; where all sizes are 0, so are the targets.
    """
    if most < 1 or not weights or min(weights) < 1:
        raise ValueError("weights are positive integers, and a source may be taken once at least")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), (F.col("before_one") % len(weights) + 1).cast("int"))
    level = lcm(*weights)
    one = sizes.select("source", "source_size", F.lit(1).cast("long").alias("one"), F.lit(0).alias("all_"))
    ranked = with_sums(one, "all_", ["all_", F.col("source").asc_nulls_last()], ["one"])
    capped = ranked.select("source", "source_size", "all_", (F.col("source_size") * most).alias("cap"), pick(weights).alias("weight"), pick([level // w for w in weights]).alias("by_"))
    filled = with_sums(capped.withColumn("level_", F.col("cap") * F.col("by_")), "all_", ["all_", "level_", F.col("source").asc_nulls_last()], ["cap", "weight"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    total = F.broadcast(filled.agg(F.sum("source_size").alias("total_"), F.sum("weight").alias("weights_")))  # one row
    above = (wide("total_") - wide("before_cap")) * wide("weight") > wide("cap") * (wide("weights_") - wide("before_weight"))
    marked = cut(filled.crossJoin(total).withColumn("above_", above), "targets")
    rest = F.broadcast(marked.agg((F.max("total_") - F.coalesce(F.sum(F.when(F.col("above_"), F.col("cap"))), F.lit(0))).alias("rest_"), F.sum(F.when(~F.col("above_"), F.col("weight"))).alias("shared_")))
    share = (F.col("rest_") * F.col("weight")).cast("double") / F.col("shared_").cast("double")
    return marked.crossJoin(rest).select("source", "source_size", F.when(F.col("above_"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(rows: DataFrame, *, source: str = "source", size: str = "size", draw: str = "draw", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``epochs`` (whole ones) and ``taken``, the words that the mix takes of the row.

    Rows are those of ``measured``, texts and other columns with them or not: what is there moves once, in the range
    sort. The words taken of a source are its target without fraction, exactly; no row is taken more than ``most`` times. A null size counts as 0. Rows equal
    in source, draw and size are exchangeable. An empty table gives an empty result; columns of these names give way.
    """
    names = [c for c in rows.columns if c not in ("source_size", "target", "epochs", "taken")]
    kept = shielded(rows.select(*names), source, size, draw).withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    kept = kept.withColumnsRenamed({source: "source_", size: "size_", draw: "draw_"})
    table, offsets = sorted_parts(kept, "source_", [F.col("source_").asc_nulls_last(), "draw_"], ["size_"])
    goal = targets(table.groupBy(F.col("source_").alias("source")).agg(F.sum("size_").alias("source_size")), weights, most)
    # a row for each source and border of parts, so that a large source is no hot key
    plan = offsets.join(goal, offsets["source_"].eqNullSafe(goal["source"])).select(
        F.col("source_").alias("of_"), F.col("part_").alias("at_"), F.col("before_size_").alias("start_"), "source_size", "target"
    )
    met = table.join(plan, table["source_"].eqNullSafe(plan["of_"]) & (table["part_"] == plan["at_"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("start_") - F.col("within_size_")
    taken = F.col("epochs") * F.col("size_") + F.greatest(F.lit(0), F.least(F.col("size_"), left))
    found = met.withColumn("epochs", epochs).withColumn("taken", taken.cast("long"))
    return found.select(*kept.columns, "source_size", "target", "epochs", "taken").toDF(*names, "source_size", "target", "epochs", "taken")


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    rest = text.split(None, n)
    return text[: len(text) - len(rest[n])].rstrip() if len(rest) > n else text


def written_out(mixed: DataFrame, *, text: str = "text", size: str = "size") -> DataFrame:
    """The mix itself: a row for each time that a row of ``mixed``, texts with it, is taken, with ``epoch`` from 1.

    The last may hold the first words of a text only. Rows of which nothing is taken, texts without a word among them, are left out.
    """
    times = F.ceil(F.col("taken") / F.col(size)).cast("int")
    each = mixed.where(F.col("taken") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col(size), F.col("taken") - (F.col("epoch") - 1) * F.col(size))

    def cut_texts(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([first_words(t, n).decode() if n < full else t.decode() for t, n, full in zip(raw(batch, text), values(batch, "words_"), values(batch, size), strict=True)], pa.string())]

    changed = append(each.withColumn("words_", words), "text_ string", cut_texts)
    return changed.withColumn(text, F.col("text_")).drop("text_", "words_")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents, with the words that a mix of their sources takes of each."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mix(docs.select("doc_id", "source", "size", "draw")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS draw FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS ws,
    coalesce(sum(3 * source_size) OVER p, 0) AS caps, coalesce(sum(w) OVER p, 0) AS capped
  FROM s WINDOW p AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (SELECT *, (total - caps) * w > 3 * source_size * (ws - capped) AS above FROM o),
t AS (
  SELECT source, source_size, CASE WHEN above THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((total - coalesce(sum(3 * source_size) FILTER (above) OVER (), 0)) * w AS DOUBLE) / CAST(sum(w) FILTER (NOT above) OVER () AS DOUBLE) END AS target FROM a
), e AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM e
"""
