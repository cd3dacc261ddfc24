"""Clusters of perceptual hashes: exact Hamming join, components, keep-largest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.components import connected_components
from cairn.operators.filters import alive
from cairn.operators.joins import spread_join
from cairn.workspace import cut

BITS = 63
#: Values of a block: 1/32 of all within these bounds, so that there is work for many tasks and no block is sent too often.
LEAST_BLOCK, MOST_BLOCK = 8_192, 131_072
#: So many comparisons of two values in a block cost as much as one row that a join makes.
A_ROW = 500
#: Pairs to a batch that leaves a task, values that are compared with one at once.
BATCH, STRIP = 65_536, 16_384


def _banded_cost(distance: int, values: int, bands: int) -> float:
    near, width = distance // bands, BITS / bands
    keys = sum(comb(round(width), k) for k in range(near + 1))
    return bands * (values * (1.0 + keys) + values * values / 2 * min(1.0, keys / 2**width))


def bands_for(distance: int, values: int) -> int:
    """How many bands cost least: the keys that are enumerated, and the pairs that random values would make."""
    allowed = (b for b in range(1, min(distance, BITS - 1) + 2) if comb(BITS // b + 1, distance // b) < 5000)
    return min(allowed, key=lambda b: _banded_cost(distance, values, b))


def selective(distance: int, values: int) -> bool:
    """Whether the join by bands makes so few rows that comparing all values in blocks costs more."""
    return _banded_cost(distance, values, bands_for(distance, values)) < values * values / 2 / A_ROW


def hamming_pairs(hashes: DataFrame, distance: int, column: str = "phash") -> DataFrame:
    """``a, b, distance``: pairs of distinct values, a < b, that differ in at most ``distance`` bits; exact.

    Nulls take no part. Values are compared in blocks or joined by bands, whichever costs less at their number.
    """
    values, count = _values(hashes, column)
    return _banded(values, distance, count) if selective(distance, count) else _in_blocks(values, count, _near_pairs(distance), "a long, b long, distance int")


def _values(hashes: DataFrame, column: str) -> tuple[DataFrame, int]:
    values = cut(hashes.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v")).distinct(), "values")
    return values, values.count()


def _in_blocks(values: DataFrame, count: int, compare: Callable, schema: str) -> DataFrame:
    """What ``compare`` yields of each two blocks of values, and of each block with itself.

    A block is one row, sent once for each block, so few rows are moved, however many values are near to each other.
    """
    blocks = max(1, ceil(count / min(MOST_BLOCK, max(LEAST_BLOCK, ceil(count / 32)))))
    packed = values.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("n")).agg(F.collect_list("v").alias("block"))
    with_others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda m: F.least("n", m) * blocks + F.greatest("n", m))
    sent = packed.select("block", F.explode(with_others).alias("two")).repartition(min(blocks * (blocks + 1) // 2, 2048), "two")
    return sent.groupBy("two").agg(F.collect_list("block").alias("blocks")).select("blocks").mapInArrow(_each(compare), schema)


def _each(compare: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for two in batch.column(0):
                blocks = [np.sort(b.values.to_numpy()).view(np.uint64) for b in two.values]
                yield from compare(blocks[0], blocks[-1], len(blocks) == 1)

    return run


def _hits(x: np.ndarray, y: np.ndarray, distance: int, itself: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each place in ``x``: the places in ``y`` (of a block itself: the later ones) within ``distance``, and how far they are."""
    apart, bits, near = np.empty(STRIP, np.uint64), np.empty(STRIP, np.uint8), np.empty(STRIP, bool)
    for begin in range(0, len(y), STRIP):
        strip = y[begin : begin + STRIP]
        for i in range(min(len(x), begin + len(strip)) if itself else len(x)):
            skip = max(0, i + 1 - begin) if itself else 0
            size = len(strip) - skip
            np.bitwise_xor(strip[skip:], x[i], out=apart[:size])
            np.bitwise_count(apart[:size], out=bits[:size])
            found = np.flatnonzero(np.less_equal(bits[:size], distance, out=near[:size]))
            if len(found):
                yield i, found + (begin + skip), bits[found]


def _near_pairs(distance: int) -> Callable:
    def compare(x: np.ndarray, y: np.ndarray, itself: bool) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            one, other = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
            far = np.concatenate([p[2] for p in parts]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)), pa.array(far)], ["a", "b", "distance"])

        for i, found, far in _hits(x, y, distance, itself):
            parts.append((np.full(len(found), x[i]), y[found], far))
            held += len(found)
            if held >= BATCH:
                yield batch()
                parts, held = [], 0
        if parts:
            yield batch()

    return compare


def near_links(hashes: DataFrame, distance: int, column: str = "phash") -> DataFrame:
    """``a, b``: links that join the values which ``hamming_pairs`` does, directly or through others; of each value one a block at most.

    Of two blocks come the components of their own pairs, each value with the least of its component, not the pairs:
    these grow with the square of a group of near values.
    """
    values, count = _values(hashes, column)
    return _banded(values, distance, count).select("a", "b") if selective(distance, count) else _in_blocks(values, count, _near_stars(distance), "a long, b long")


def _near_stars(distance: int) -> Callable:
    def compare(x: np.ndarray, y: np.ndarray, itself: bool) -> Iterator[pa.RecordBatch]:
        one, other = x.view(np.int64), y.view(np.int64)
        nodes = one if itself else np.sort(np.concatenate([one, other]))
        of_x, of_y = np.searchsorted(nodes, one), np.searchsorted(nodes, other)
        above = np.arange(len(nodes))
        for i, found, _ in _hits(x, y, distance, itself):
            met = np.append(of_y[found], of_x[i])
            tops = _tops(above, met)
            least = tops.min()
            if (tops != least).any():
                above[tops] = above[met] = least
        tops = _tops(above, np.arange(len(nodes)))
        linked = np.flatnonzero(tops != np.arange(len(nodes)))
        for begin in range(0, len(linked), BATCH):
            part = linked[begin : begin + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[tops[part]])], ["a", "b"])

    return compare


def _tops(above: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places at which the ways up from ``places`` end."""
    now = above[places]
    while ((following := above[now]) != now).any():
        now = following
    return now


def _banded(values: DataFrame, distance: int, count: int) -> DataFrame:
    """The pairs by a join of bands, for distances at which it is selective.

    Of ``m`` bands of such a pair one at least differs in ``distance // m`` bits or fewer. One side is posted under every
    band, the other under all that near to each of its bands, and a pair counts only in its first such band, so
    nothing needs to be made distinct. How many bands there are is chosen by the number of values.
    """
    bands = bands_for(distance, count)
    near = distance // bands
    edges = [BITS * i // bands for i in range(bands + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]

    def band(x: Column, i: int) -> Column:
        return F.shiftright(x, edges[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))

    def masks(i: int) -> Column:
        found = [sum(1 << bit for bit in bits) for k in range(near + 1) for bits in combinations(range(widths[i]), k)]
        return F.array(*[F.lit(m).cast("long") for m in found])

    def around(i: int) -> Column:
        return F.transform(masks(i), lambda m: F.struct(F.lit(i).alias("n"), band(F.col("a"), i).bitwiseXOR(m).alias("x")))

    left = values.select(F.col("v").alias("a")).select("a", F.explode(F.concat(*[around(i) for i in range(bands)])).alias("k"))
    right = values.select(F.col("v").alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("n"), band(F.col("v"), i).alias("x")) for i in range(bands)])).alias("k"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(F.bit_count(band(apart, i)) <= near, i) for i in range(bands)])
    met = left.join(right, "k").where("a < b").where(F.bit_count(apart) <= distance).where(F.col("k.n") == first)
    return met.select("a", "b", F.bit_count(apart).alias("distance"))


def clusters(photos: DataFrame, distance: int = 8, min_size: int = 2, exclude_derivatives: bool = False) -> DataFrame:
    """``id, cluster, size``: photos not trashed in groups of near hashes, transitively; cluster is the least id.

    Equal hashes are one node each, so that many copies of one picture cost one value.
    """
    return _sized(_labelled(photos, distance, exclude_derivatives), min_size).select("id", "cluster", "size")


def _labelled(photos: DataFrame, distance: int, exclude_derivatives: bool, *more: str) -> DataFrame:
    """``id``, the columns ``more`` and ``c``, the least hash of the photo's component."""
    rows = photos.where(alive() & F.col("phash").isNotNull())
    if exclude_derivatives:
        rows = rows.where(~F.col("derivative"))
    rows = cut(rows.select("id", "phash", *more), "hashes")
    labels = connected_components(near_links(rows, distance), "a", "b")
    return cut(rows.join(labels, rows["phash"] == labels["node"], "left").select("id", *more, F.coalesce("component", "phash").alias("c")), "named")


def _sized(named: DataFrame, min_size: int, *more: Column) -> DataFrame:
    """Rows of ``named`` in components of that size, with ``cluster``, ``size`` and what else is to be known of a component."""
    facts = named.groupBy("c").agg(F.min("id").alias("cluster"), F.count("*").alias("n"), *more).where(F.col("n") >= min_size).withColumn("size", F.col("n"))
    return spread_join(named, facts, "c", "n", named.count())


def duplicates(photos: DataFrame, distance: int = 4) -> DataFrame:
    """Clusters without derivatives, each with its largest file (ties: least id) marked to keep.

    The largest is found with the size, by one aggregation, and joined back in spread, so no task has all of a cluster.
    """
    named = _labelled(photos, distance, True, "byte_size")
    found = _sized(named, 2, F.max_by("id", F.struct("byte_size", -F.col("id"))).alias("largest"))
    return found.select("cluster", "id", "size", (F.col("id") == F.col("largest")).alias("keep"))


def groups(found: DataFrame, photos: DataFrame, members: int = 12) -> DataFrame:
    """``cluster, size, largest, sample, members, place``: groups by size, ties by least id.

    ``largest`` is the member with the most bytes (ties: least id), ``sample`` the text of the least id that has any, ``members`` the first
    ids. Members are cut to that many before they are collected. ``found`` is read twice, so it is written out first.
    """
    found = cut(found, "found")
    rows = found.join(photos.select("id", "byte_size", "text"), "id")
    some = F.col("text").isNotNull() & (F.col("text") != "")
    facts = rows.groupBy("cluster").agg(F.max("size").alias("size"), F.max_by("id", F.struct("byte_size", -F.col("id"))).alias("largest"), F.min_by("text", F.when(some, F.col("id"))).alias("sample"))
    order = Window.partitionBy("cluster").orderBy("id")
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= members).groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return facts.join(first, "cluster")


def top_groups(grouped: DataFrame, limit: int = 10) -> DataFrame:
    """The largest groups, ties by least id."""
    return grouped.orderBy(F.desc("size"), "cluster").limit(limit)
