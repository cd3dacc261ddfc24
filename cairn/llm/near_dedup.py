"""Near-duplicate classes by MinHash and a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles. Sets that are equal collapse to one class each.
Of ``coordinates`` minima, two sets of similarity t differ in a binomial number, so a ``prefix`` of them is
chosen such that more than ``prefix - 1`` differ with a chance of at most ``miss``; pairs with fewer share a value
in the prefix and collide in at least ``coordinates - prefix + 1`` places. Only the prefix is posted
under (coordinate, value); the other lists are never merged but skipped, and their
collisions are counted by probing the pair's signatures.

Lists stay whole but no task needs all of one: rows of a frequent key never meet by key, and a list beyond a block is
dealt out as pairs of blocks. Out of each comes a spanning forest of the pairs over the match threshold, never all pairs
of a group; its components are candidate groups. There pairs are confirmed by exact count on full sets of hashed shingles,
and only what stays outside the largest component of a group is compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.batches import Memo, append, raw, resident, shielded, values, words
from cairn.operators.components import connected_components
from cairn.operators.joins import hot_limit, spread_join
from cairn.workspace import cut

WORDS, COORDINATES, MISS = 5, 64, 1e-6
#: Rows of a posting list, documents of a group, and shingles of a group in one block.
LIST_BLOCK, GROUP_BLOCK, SHINGLE_BLOCK = 2048, 512, 1_000_000
#: Posting rows for each task that merges lists; its work grows faster than its bytes.
LIST_ROWS = 16_384
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64)


def word_hashes(text: bytes | None) -> np.ndarray:
    found = words(text)
    hashes = resident(("word hashes",), lambda: Memo(lambda w: xxhash.xxh64_intdigest(w) - (1 << 63)))
    return np.fromiter(map(hashes.__getitem__, found), dtype=np.int64, count=len(found)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in order."""
    n = len(h) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += h[j : n + j] * _ODD[j]
    return mix(total)


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; of a text of fewer words, one for all of them together."""
    h = word_hashes(text)
    if len(h) == 0:
        return h
    return np.unique(runs(h, size)) if len(h) >= size else mix(runs(h, len(h)) + np.uint64(len(h)))


def signature(shingle: np.ndarray, k: int) -> np.ndarray:
    low = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingle), 4096):
        part = shingle[at : at + 4096]
        low = np.minimum(low, (part[None, :] * _MULTIPLY[:k, None] + _ADD[:k, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def prefix_length(k: int, threshold: float, miss: float) -> int:
    """Least p such that at least p of k coordinates differ with a chance of at most ``miss``."""
    q, tail, p = 1 - threshold, 0.0, k + 1
    while p > 0:
        tail += comb(k, p - 1) * q ** (p - 1) * (1 - q) ** (k - p + 1)
        if tail > miss:
            return min(p, k)
        p -= 1
    return 1


class Forest:
    """Union-find over positions; keeps the edges that joined something."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if (old := self.label[b]) != (new := self.label[a]):
                self.label[self.label == old] = new
                self.edges.append((a, b))


def colliding(signatures: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in ``least`` columns or more."""
    forest = Forest(len(signatures))
    for a in range(len(signatures) - 1):
        other = np.flatnonzero(forest.label[a + 1 :] != forest.label[a]) + a + 1
        if len(other):
            forest.join(a, other[(signatures[other] == signatures[a]).sum(axis=1) >= least])
    return forest.edges


def similar(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with den * intersection >= num * union."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if den * both >= num * (sizes.sum() - both) else []
    forest = Forest(len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    both, width = np.zeros((len(sets), len(sets)), dtype=np.float64), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held @ held.T
    linked = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
    for a in range(len(sets) - 1):
        forest.join(a, np.flatnonzero(linked[a, a + 1 :]) + a + 1)
    return forest.edges


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rep, hot) sorted by key, those that are hot or whose key another row has too; holds one row between batches."""
    last_key = last_rep = None
    given = True
    for batch in batches:
        key, rep, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        again = np.append(last_key is not None and key[0] == last_key, key[1:] == key[:-1])
        more = np.append(key[:-1] == key[1:], False)
        take = again | more | hot
        out = [key[take], rep[take], hot[take]]
        if again[0] and not given:
            out = [np.append(x, y) for x, y in zip((last_key, last_rep, hot[0]), out, strict=True)]
        last_key, last_rep, given = key[-1], rep[-1], bool(take[-1])
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(bool))], names=["key", "rep", "hot"])


#: One owner in so many shows which keys are hot.
SAMPLED = 16


def in_sample(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner, F.lit("hot keys")), F.lit(SAMPLED)) == 0


def repeated_keys(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``key, rep, hot``: the ``rows`` (key, rep) whose key at least one other row has.

    ``sample`` holds the rows of one owner in ``SAMPLED`` and only decides how rows travel: keys with
    many rows there are broadcast (fewer than ``SAMPLED * HOT_SHARE`` longs, 6.4 MB, at any size), and
    their rows, which are repeated for certain, are dealt out by owner; all others meet by key.
    """
    few = cut(sample, "sample")
    least = hot_limit(SAMPLED * few.count()) // SAMPLED
    hot = F.broadcast(few.groupBy("key").count().where(F.col("count") > max(1, least)).select("key", F.lit(True).alias("hot")))
    marked = rows.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by = F.when(F.col("hot"), F.xxhash64("rep")).otherwise(F.col("key"))
    return marked.select("key", "rep", "hot").repartition(by).sortWithinPartitions("key").mapInArrow(_drop_single, "key long, rep long, hot boolean")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns behind the first ``keys`` ones, of each run of rows equal in those; holds one run."""
    held, held_key = [], None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        ids = list(zip(*columns[:keys], strict=True))
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                part = [c[start:i] for c in columns[keys:]]
                if held and held_key == ids[start]:
                    held = [a + b for a, b in zip(held, part, strict=True)]
                else:
                    if held:
                        yield held
                    held, held_key = part, ids[start]
                start = i
    if held:
        yield held


def _edges(batches: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for edges in batches:
        out += edges
        if len(out) >= 10_000:
            yield _edge_batch(out)
            out = []
    if out:
        yield _edge_batch(out)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])


def _blocks(count: Column, shingles_: Column | None = None) -> Column:
    """How many blocks so many documents with so many shingles take."""
    by_count = F.ceil(count / GROUP_BLOCK)
    return F.greatest(by_count, F.lit(1) if shingles_ is None else F.ceil(shingles_ / SHINGLE_BLOCK), F.lit(1)).cast("int")


def _block_pairs(own: Column, blocks: Column) -> Column:
    """Both ends of every pair of blocks that ``own`` is in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(own, other.cast("int")).alias("bi"), F.greatest(own, other.cast("int")).alias("bj")))


def _signatures(source: DataFrame, k: int, size: int) -> DataFrame:
    """``doc_id, n_shingles, name, sign``: how many shingles a text has, a digest of their set, and its minima."""

    def sign(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, names, signs = [], [], []
        for body in raw(batch, "text"):
            found = shingles(body, size)
            counts.append(len(found))
            names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signs.append(signature(found, k).tobytes() if len(found) else None)
        return [pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())]

    return append(source, "n_shingles long, name binary, sign binary", sign).drop("text")


def _candidates(classes: DataFrame, k: int, p: int) -> DataFrame:
    """``src, dst``: out of each pair of blocks of each list a spanning forest of the pairs over the match threshold."""
    least = k - p + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(values(batch, "sign")), dtype="<u4").reshape(-1, k)[:, :p]
            posted = m.astype(np.int64) | (np.arange(p, dtype=np.int64) << 32)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(posted.ravel()), pa.array(np.repeat(rep, p))], names=["key", "rep"])

    def postings(some: DataFrame) -> DataFrame:
        return some.select("sign", "rep").mapInArrow(post, "key long, rep long")

    lists = cut(repeated_keys(postings(classes), postings(classes.where(in_sample(F.col("rep"))))), "postings")
    # near copies share most coordinates, so many lists hold the same documents: one of those is merged, the others are skipped
    content = F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit("again"))).alias("y"), F.count("*").alias("n")
    merged = lists.groupBy("key").agg(*content).groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("nb"))
    listed = cut(spread_join(lists.select("key", "rep"), merged, "key", "n", lists.count()), "lists")
    pairs = _block_pairs(F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), F.col("nb"))
    dealt = listed.select("key", "rep", F.explode(pairs).alias("b")).select("key", "b.bi", "b.bj", "rep")

    def short_signs(batch: pa.RecordBatch) -> list[pa.Array]:
        m = np.frombuffer(b"".join(values(batch, "sign")), dtype="<u4").reshape(-1, k).astype(np.uint8)
        return [pa.array([r.tobytes() for r in m], pa.binary())]

    probes = append(classes.select("rep", "sign"), "probe binary", short_signs).select("rep", "probe")

    def count_collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple[int, int]]]:
            for rep, probe in _groups(batches, 3):
                m = np.frombuffer(b"".join(probe), dtype=np.uint8).reshape(-1, k)
                yield [(rep[a], rep[b]) for a, b in colliding(m, least)]

        return _edges(found())

    met = dealt.join(probes, "rep").select("key", "bi", "bj", "rep", "probe")
    met = met.repartition(1 + listed.count() // LIST_ROWS, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return met.mapInArrow(count_collisions, "src long, dst long").distinct()


def _confirmed(placed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``node, least``: each name in a block of ``placed`` (grp, bi, bj, rep, name), and the least one it is linked with there.

    Rows of one name are linked. ``sets`` holds rows (rep, shingles) of sorted 64-bit hashes; what holds candidates grows
    with the documents, so the two meet by shuffle at every size.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list[tuple[int, int]]]:
            for names, bodies in _groups(batches, 3):
                yield linked(np.array(names), similar([np.frombuffer(b, dtype=np.uint64) for b in bodies], num, den))

        return _edges(found())

    full = placed.join(sets.hint("merge"), "rep").select("grp", "bi", "bj", "name", "shingles").repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj")
    return full.mapInArrow(verify, "src long, dst long").withColumnsRenamed({"src": "node", "dst": "least"})


def linked(names: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each name and the least one that it reaches over the edges, which are of places, or equal names."""
    distinct, at = np.unique(names, return_inverse=True)
    forest = Forest(len(distinct))
    for a, b in edges:
        forest.join(at[a], np.array([at[b]]))
    least = np.full(len(distinct), len(distinct))
    np.minimum.at(least, forest.label, np.arange(len(distinct)))
    return list(zip(distinct.tolist(), distinct[least[forest.label]].tolist(), strict=True))


def _labels(member: DataFrame, source: DataFrame, num: int, den: int, size: int) -> tuple[DataFrame, DataFrame | None]:
    """``rep, label`` of each of ``member`` (rep, grp, n), and further ``src, dst`` links between labels, if any may be.

    A group of one block is compared there, and a label is the least document reached. Of a larger group each document is
    compared within its own block first, then one document of each component that came out, again within blocks. The largest
    component of a group then need not be compared with itself, and only the documents outside of it meet all others,
    as pairs of blocks.
    """

    def hashed(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shingles(b, size).tobytes() for b in raw(batch, "text")], pa.binary())]

    texts = source.select(F.col("doc_id").alias("rep"), "text").hint("merge").join(member.select("rep"), "rep", "left_semi")
    sets = cut(append(texts, "shingles binary", hashed).drop("text").where(F.length("shingles") > 0), "sets")
    total = member.count()
    groups = member.groupBy("grp").agg(F.count("*").alias("docs"), _blocks(F.count("*"), F.sum("n")).alias("nb"))
    placed = cut(spread_join(member, groups, "grp", "docs", total), "members")
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    within = cut(_confirmed(placed.select("grp", own.alias("bi"), own.alias("bj"), "rep", F.col("rep").alias("name")), sets, num, den), "within")
    many = placed.where("nb > 1").select("rep", "grp", "n")
    total = many.count()
    if not total:
        return within.select(F.col("node").alias("rep"), F.col("least").alias("label")), None
    first = cut(many.join(within.select(F.col("node").alias("rep"), F.col("least").alias("part")), "rep"), "parts")
    heads = cut(first.groupBy("grp", "part").agg(F.count("*").alias("docs"), F.max("n").alias("n")), "heads")
    # heads of components of several documents meet first of all, those of one document apart from them
    named = heads.withColumn("large", F.col("docs") > 1).withColumn("key", F.xxhash64("grp", "large"))
    sized = named.groupBy("key").agg(F.count("*").alias("heads"), _blocks(F.count("*"), F.sum("n")).alias("nb"))
    dealt = spread_join(named, sized, "key", "heads", total)
    at = F.pmod(F.xxhash64("part"), F.col("nb")).cast("int") * 2 + F.col("large").cast("int")
    between = _confirmed(dealt.select("grp", at.alias("bi"), at.alias("bj"), F.col("part").alias("rep"), F.col("part").alias("name")), sets, num, den)
    wholes = cut(heads.join(between, F.col("part") == F.col("node")).select("grp", "part", "docs", F.col("least").alias("whole")), "wholes")
    by_whole = wholes.groupBy("grp", "whole").agg(F.sum("docs").alias("docs")).groupBy("grp")
    largest = by_whole.agg(F.max_by("whole", F.struct("docs", "whole")).alias("main"), F.max("docs").alias("in_main"), F.sum("docs").alias("docs")).where("docs > in_main")
    open_ones = largest.select("grp", "main", "docs", _blocks(F.col("in_main")).alias("mains"), _blocks(F.col("docs") - F.col("in_main")).alias("rests"))
    parts = cut(spread_join(first, wholes.select("part", "whole", "docs"), "part", "docs", total), "parts")
    left = spread_join(parts, open_ones, "grp", "docs", total)
    inside = F.col("whole") == F.col("main")
    i, r = (F.pmod(F.xxhash64("rep"), F.col(c)).cast("int") for c in ("mains", "rests"))
    # blocks of the largest component are numbered from 0 on, those of the rest behind them
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(i.alias("bi"), (F.col("mains") + x).cast("int").alias("bj")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda x: F.struct(x.cast("int").alias("bi"), (F.col("mains") + r).cast("int").alias("bj")))
    of_rest = F.transform(_block_pairs(r, F.col("rests")), lambda x: F.struct((F.col("mains") + x["bi"]).cast("int").alias("bi"), (F.col("mains") + x["bj"]).cast("int").alias("bj")))
    pairs = left.select("grp", "rep", "whole", F.explode(F.when(inside, with_rest).otherwise(F.concat(with_main, of_rest))).alias("b"))
    last = _confirmed(pairs.select("grp", "b.bi", "b.bj", "rep", F.col("whole").alias("name")), sets, num, den).where("node <> least")
    single = placed.where("nb = 1").select("rep").join(within, F.col("rep") == F.col("node")).select("rep", F.col("least").alias("label"))
    return single.union(parts.select("rep", "whole")), last.select(F.col("node").alias("src"), F.col("least").alias("dst"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, size: int = WORDS, coordinates: int = COORDINATES, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Ids are integers. Documents are linked where den * intersection >= num * union of their shingle sets; component_id is
    the least id reachable, ``kept`` marks the document that has it. Null and empty texts have no
    shingles and no links. Rows of one id are one document with several texts, each of which may link;
    a row with a null id is linked with nothing and kept. An empty table gives an empty result; other columns are not looked at.
    """
    p = prefix_length(coordinates, num / den, miss)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(_signatures(source, coordinates, size), "signatures")
    some = signed.where("doc_id is not null and name is not null")
    classes = cut(some.groupBy("name", "n_shingles", "sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    total = signed.count()
    sizes = classes.groupBy("rep").agg(F.max("n_shingles").alias("n"))
    candidates = connected_components(_candidates(classes, coordinates, p))
    member = cut(candidates.join(sizes, F.col("node") == F.col("rep")).select("rep", F.col("component").alias("grp"), "n"), "groups")
    labels, links = _labels(member, source, num, den, size)
    named = classes.select("name", "rep", "copies").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    if not some.groupBy("doc_id").count().where("count > 1").isEmpty():  # texts of one id are linked
        own = cut(spread_join(some.select("doc_id", "name"), named.select("name", "label", "copies"), "name", "copies", total).select("doc_id", "label").distinct(), "named")
        lows = own.groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").drop("high")
        ties = own.join(lows, "doc_id").where("label <> low").select(F.col("label").alias("src"), F.col("low").alias("dst"))
        links = ties if links is None else links.union(ties)
    if links is not None:
        found = named.groupBy("label").agg(F.count("*").alias("n")).join(connected_components(links), F.col("label") == F.col("node"), "left")
        of_label = found.select("label", F.coalesce("component", "label").alias("component_id"), "n")
        named = spread_join(named, of_label, "label", "n", total).drop("label").withColumnRenamed("component_id", "label")
    of_class = named.select("name", F.col("label").alias("component_id"), "copies")
    found = spread_join(some.select("doc_id", "n_shingles", "name"), of_class, "name", "copies", total).drop("name")
    alone = signed.where("doc_id is null or name is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _one_text_an_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with a ``row_`` that ascends with the id and differs between texts; of rows equal in id and text one stays."""
    marked = docs.withColumn("text_hash_", F.xxhash64(text))
    pairs = marked.where(F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.col("text_hash_").alias("hash_")).distinct()
    numbered = cut(pairs.repartitionByRange("key_", "hash_").sortWithinPartitions("key_", "hash_").withColumn("row_", F.monotonically_increasing_id()), "rows")
    met = marked.hint("merge").join(numbered, (F.col(key) == F.col("key_")) & (F.col("text_hash_") == F.col("hash_")), "left").drop("key_", "hash_", "text_hash_")
    return cut(met.where("row_ is not null").dropDuplicates(["row_"]).unionByName(met.where("row_ is null")), "texts")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that of the least id; all columns stay.

    Where ids repeat, each text of an id is a document of its own, and rows equal in id and text are one. Rows with a null
    id and null or empty texts all stay; an empty table gives an empty result; columns may have any names.
    """
    names, docs = docs.columns, shielded(docs, key, text)
    kept = docs.columns
    if not docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        docs, key = _one_text_an_id(docs, key, text), "row_"
    gone = near_duplicates(docs, key=key, text=text, **options).where("not kept").select(F.col("doc_id").alias("gone_id_")).distinct()
    return docs.hint("merge").join(gone, docs[key] == gone["gone_id_"], "left_anti").select(*kept).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: classes of documents with a similarity of 0.85 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), num=85)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
