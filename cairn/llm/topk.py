"""Exact top-k search by inner product with MaxScore: queries in bounded groups, candidates streamed past them.

A term of a query is a dimension; its postings are the candidates of a shard with a component there, and its bound is its
largest contribution in the shard. Terms ordered by bound split in two: the run of least bounds that together
stay below a share of the query's threshold is non-essential, for a candidate in those postings alone cannot get in. The essential
postings are traversed and add up to a partial score; a candidate whose partial score and the bounds of the
rest still reach the threshold is probed in the other dimensions. The threshold is the k-th best score so far, and a
task carries it from shard to shard. Lists that hold few candidates are kept as positions and values, and
only those of essential terms are touched. Lists that hold most candidates are kept as columns and traversed
together as one product. Results of the tasks are merged by score and id.

No candidate is ever shuffled: each task reads its part of the candidates once for a group of queries, which is
broadcast and bounded by ``GROUP_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.workspace import cut

SCALE, EVERY, K = 64, 20, 20
#: Queries that are broadcast at once, queries of one block, and candidates of one shard.
GROUP_ROWS, BLOCK_ROWS, SHARD_ROWS = 32_768, 512, 4096
#: Of the threshold, what the bounds of non-essential terms may add up to; less than 1 so that few candidates are probed.
SPARE = 0.25
#: Lists with a larger share of the shard's candidates are columns.
DENSE = 0.25


def quantise(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(64 * x) as double of each vector, short ones filled up with 0, and which of the vectors take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    part = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(part, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    x = np.floor(SCALE * flat.cast(pa.float64()).to_numpy(zero_copy_only=False))  # a null becomes NaN
    if len(x) and (np.abs(x[np.isfinite(x)]).max(initial=0) >= 2.0**62):
        raise OverflowError("a component beyond 2**62 / 64 has no integer score")
    owner, width = np.repeat(np.arange(len(part)), sizes), int(sizes.max(initial=0))
    part[owner[~np.isfinite(x)]] = False
    out = np.zeros((len(part), width), dtype=np.int64)
    out[owner, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(np.isfinite(x), x, 0).astype(np.int64)
    return out, part


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Shard:
    """Candidates by dimension: postings of rare dimensions, columns of frequent ones, and the extremes that bound a term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.x = ids, vectors
        self.high, self.low = self.x.max(axis=0, initial=-(2**62)), self.x.min(axis=0, initial=2**62)
        share = np.count_nonzero(self.x, axis=0) / max(1, len(ids))
        self.columns, rare = np.flatnonzero(share > DENSE), np.flatnonzero((share > 0) & (share <= DENSE))
        self.postings = {int(d): np.flatnonzero(self.x[:, d]) for d in rare}

    def arithmetic(self, queries: np.ndarray):
        """The fastest type in which every sum of products is an exact integer."""
        peak = int(np.abs(queries).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * max(1, self.x.shape[1])
        return np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64 if peak < 2**63 else object

    def partial(self, q: np.ndarray, essential: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of all candidates over the essential terms of each query."""
        masked = np.where(essential, q, q.dtype.type(0) if q.dtype != object else 0)
        part = masked[:, self.columns] @ x[:, self.columns].T
        for d, at in self.postings.items():
            if len(mine := np.flatnonzero(masked[:, d])):
                part[np.ix_(mine, at)] += masked[mine, d][:, None] * x[at, d][None, :]
        return part


class Best:
    """The ``k`` best candidates so far of each query of a block, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.query_ids, self.q, self.k = ids, vectors, k
        self.score = np.zeros((len(ids), k), dtype=np.int64)
        self.id, self.own = np.zeros((len(ids), k), dtype=np.int64), np.zeros((len(ids), k), dtype=bool)
        self.filled = np.zeros(len(ids), dtype=np.int64)
        self.pairs = self.probed = 0  # what was there, and what had to be looked at in all dimensions

    def look(self, shard: Shard) -> None:
        width = max(self.q.shape[1], shard.x.shape[1])
        if shard.x.shape[1] != width:
            shard = Shard(shard.ids, _widened(shard.x, width))
        kind = shard.arithmetic(self.q)
        q, x = _widened(self.q, width).astype(kind), shard.x.astype(kind)
        full = self.filled == self.k
        least = np.where(full, self.score[:, -1], 0).astype(kind)
        bound = np.where(q > 0, q * shard.high.astype(kind), q * shard.low.astype(kind))
        gain = np.maximum(bound, 0)  # of terms that can only lower a score, none counts
        by_gain = np.argsort(gain, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(gain, by_gain, axis=1), axis=1)
        spare = ((reach <= SPARE * np.maximum(least, 0)[:, None]) & full[:, None]).sum(axis=1)
        rank = np.empty_like(by_gain)
        np.put_along_axis(rank, by_gain, np.arange(width)[None, :], axis=1)
        essential = rank >= spare[:, None]
        rest = np.where(spare > 0, np.take_along_axis(reach, np.maximum(spare - 1, 0)[:, None], axis=1)[:, 0] if width else 0, 0)
        part = shard.partial(q, essential, x)
        self.pairs += part.size
        need = least - rest
        if not full.all() and part.shape[1] > self.k:  # no threshold yet: that of this shard alone, over all terms
            fresh = np.flatnonzero(~full)
            mine = np.sort(part[fresh], axis=1) if kind is object else np.partition(part[fresh], part.shape[1] - self.k, axis=1)
            need[fresh] = mine[:, part.shape[1] - self.k]
        take = part >= need[:, None]
        if part.shape[1] <= self.k:
            take |= ~full[:, None]
        at_q, at_x = np.nonzero(take)
        self.probed += len(at_q)
        exact = part[at_q, at_x]
        left = np.where(essential, q.dtype.type(0) if kind is not object else 0, q)
        for a in range(0, len(at_q), 65_536):
            i, j = at_q[a : a + 65_536], at_x[a : a + 65_536]
            exact[a : a + 65_536] += (left[i] * x[j]).sum(axis=1)
        if kind is object and len(exact) and max(map(abs, exact)) >= 2**63:
            raise OverflowError("a score does not fit 64 bits")
        exact = exact.astype(np.int64)
        some = ~full[at_q] | (exact >= self.score[at_q, -1])
        at_q, at_x, exact = at_q[some], at_x[some], exact[some]
        own = (shard.ids[at_x] == self.query_ids[at_q]) & (q[at_q] == x[at_x]).all(axis=1)
        self._take(at_q, exact, shard.ids[at_x], own)

    def _take(self, at_q: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        touched = np.unique(at_q)
        before = np.arange(self.k)[None, :] < self.filled[touched][:, None]
        row = np.append(np.repeat(touched, self.filled[touched]), at_q)
        score, ids, own = (np.append(old[touched][before], new) for old, new in ((self.score, score), (self.id, ids), (self.own, own)))
        order = np.lexsort((~own, ids, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        row, place, order = row[keep], place[keep], order[keep]
        self.score[row, place], self.id[row, place], self.own[row, place] = score[order], ids[order], own[order]
        self.filled[touched] = np.bincount(row, minlength=len(self.filled))[touched]


def _pack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and quantised vectors of the rows that take part."""
    x, part = quantise(batch.column(1))
    part &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    return batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[part], x[part]


def _groups(queries: DataFrame, rows: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries as packed arrays, at most ``rows`` of them on the driver at once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _pack(batch)
            if len(ids):
                peak = np.abs(x).max(initial=0)
                small = x.astype("<i2" if peak < 2**15 else "<i4" if peak < 2**31 else "<i8")
                columns = [pa.array([ids.tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary()), pa.array([small.dtype.str])]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "x", "kind"])

    held, count = [], 0
    for r in cut(queries.mapInArrow(pack, "ids binary, x binary, kind string"), "queries").toLocalIterator():
        ids = np.frombuffer(r["ids"], dtype=np.int64)
        x = np.frombuffer(r["x"], dtype=r["kind"]).reshape(len(ids), -1)
        for at in range(0, len(ids), BLOCK_ROWS):
            if held and count + len(ids[at : at + BLOCK_ROWS]) > rows:
                yield held
                held, count = [], 0
            held.append((ids[at : at + BLOCK_ROWS], x[at : at + BLOCK_ROWS]))
            count += len(held[-1][0])
    if held:
        yield held


def top_k(queries: DataFrame, candidates: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = K, group_rows: int = GROUP_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query row, ties to the smaller id.

    Ids are integers. Vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    vectors of unequal length are compared as far as both reach. A query's own row (same id and vector) is left out once, so
    that repeated rows of one id find each other, and repeated query rows give repeated results. Components from 2**62 / 64
    on, and a score that does not fit 64 bits, are errors. Empty tables give an empty result; other columns
    are not looked at. One pass over the candidates is made for every ``group_rows`` queries.
    """
    spark = candidates.sparkSession
    rows = candidates.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    found = None
    groups = _one_ahead(_groups(queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), group_rows))
    schema = "query_id long, row long, vec_id long, score long, own boolean"
    parts = []
    for number, (group, more) in enumerate(groups):
        shared = spark.sparkContext.broadcast(group)
        part = rows.mapInArrow(_pass(shared, number << 32, k + 1, shard_rows), schema)
        if more or number:
            part = cut(part, "best")
            shared.destroy()
        parts.append(part)
    for part in parts:
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    each = Window.partitionBy("row", "query_id")
    first = found.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), F.asc("vec_id"), F.desc("own")))).where(F.col("place") <= k + 1)
    itself = F.min(F.when(F.col("own"), F.col("place"))).over(each)
    ranked = first.withColumn("itself", itself).where(F.col("itself").isNull() | (F.col("place") != F.col("itself")))
    rank = (F.col("place") - F.when(F.col("itself") < F.col("place"), 1).otherwise(0)).cast("int")
    return ranked.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _one_ahead(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether another follows."""
    items = iter(items)
    for item in items:
        break
    else:
        return
    for following in items:
        yield item, True
        item = following
    yield item, False


def _pass(shared, first: int, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Best(ids, x.astype(np.int64), k) for ids, x in shared.value]
        for batch in batches:
            ids, x = _pack(batch)
            for at in range(0, len(ids), shard_rows):
                shard = Shard(ids[at : at + shard_rows], x[at : at + shard_rows])
                for block in blocks:
                    block.look(shard)
        row = first
        for block in blocks:
            there = np.arange(k)[None, :] < block.filled[:, None]
            at, _ = np.nonzero(there)
            if len(at):
                columns = (block.query_ids[at], at + row, block.id[there], block.score[there], block.own[there])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "row", "vec_id", "score", "own"])
            row += len(block.query_ids)

    return run


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the 20 best rows for every vector whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
