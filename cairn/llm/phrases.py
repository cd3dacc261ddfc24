"""Collocations: count-min sketches first, exact counts of what they leave second, then scores and subsumption.

In the first pass each task adds its n-grams up in a count-min sketch and sends it in compressed blocks; blocks are
merged by sum, and a cell keeps one bit, whether it came to ``least``. A sketch overestimates, so an n-gram one of whose
cells has no such bit is surely rare. The second pass counts all others exactly, by their words and not by a hash,
and drops those that are rare after all: nothing frequent is lost, nothing rare stays. The bits are all
that is broadcast, 8 MB at any size of the corpus. A sketch of so many cells holds back most rare n-grams of some 10^9 words; of far
larger corpora it lets more through to the exact count, which combines before its shuffle, or takes a larger ``width``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.batches import raw
from cairn.llm.near_dedup import mix
from cairn.operators.joins import spread_join
from cairn.workspace import cut

LEAST, LONGEST, KEPT, COVERED = 10, 3, 2000, 50
DEPTH = 2
#: Cells of a sketch row, and cells that are sent and merged together.
WIDTH, BLOCK = 1 << 25, 1 << 16
#: Parts of a language of which the best phrases are found first.
PARTS = 64
#: Words that are counted at once, and bytes of a text that are split at once.
CHUNK, SLICE = 1 << 19, 1 << 21
UNKNOWN = "und"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_RNG = np.random.default_rng(20250117)
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROWS = _RNG.integers(0, 1 << 63, DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Ids(dict):
    """Numbers of words in order of their first occurrence; an empty string is 0 and the end of a piece 1."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Chunk:
    """Words of some texts as numbers, with a 1 at the end of every piece; ``fresh`` is false for words that an earlier chunk has counted."""

    def __init__(self) -> None:
        self.ids, self.langs = _Ids(), {}
        self.parts: list[np.ndarray] = []
        self.of: list[np.ndarray] = []
        self.new: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes], lang: bytes, carried: int = 0) -> None:
        found = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        found = found[found > 0]
        fresh = np.ones(len(found), dtype=bool)
        fresh[:carried] = False
        self.parts.append(found)
        self.of.append(np.full(len(found), self.langs.setdefault(lang, len(self.langs)), dtype=np.int64))
        self.new.append(fresh)
        self.size += len(found)

    def close(self) -> Chunk:
        self.word, self.lang, self.fresh = (np.concatenate(x) for x in (self.parts, self.of, self.new))
        self.words = list(self.ids)
        return self

    def places(self, n: int) -> np.ndarray:
        """Where n-grams begin whose last word is fresh and that no piece's end cuts."""
        last = len(self.word) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        inside = self.fresh[n - 1 :].copy()
        for j in range(n):
            inside &= self.word[j : j + last] != 1
        return np.flatnonzero(inside)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.fromiter(map(_hash, x), dtype=np.uint64, count=len(x)) for x in (self.words, self.langs))


def slices(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in lower case as slices of whole words, pieces ended by a line feed; and whether a slice goes on in the next, within a piece."""
    text = text.translate(_TABLE)
    at = 0
    while len(text) - at > SLICE:
        found = re.compile(rb"[ \n]").search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.end()], found[0] == b" "
        at = found.end()
    yield text[at:], False


def _tail(words: list[bytes], n: int) -> list[bytes]:
    """The last n words, or fewer where a piece begins."""
    found: list[bytes] = []
    for w in reversed(words):
        if w == b"\n" or len(found) == n:
            break
        if w:
            found.append(w)
    return found[::-1]


def chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Chunk]:
    """Columns are lang and text; chunks go over the borders of batches."""
    now = Chunk()
    for batch in batches:
        for lang, text in zip(raw(batch, "lang"), raw(batch, "text"), strict=True):
            carry: list[bytes] = []
            for part, goes_on in slices(text):
                words = part.replace(b"\n", b" \n ").split(b" ")
                now.add([*carry, *words, b"\n"], lang, len(carry))
                carry = _tail(carry + words, longest - 1) if goes_on else []
                if now.size >= CHUNK:
                    yield now.close()
                    now = Chunk()
    if now.size:
        yield now.close()


def gram_hashes(chunk: Chunk, n: int, at: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash of language and words of each n-gram that begins ``at``; the number of words counts too."""
    words, langs = hashes
    total = langs[chunk.lang[at]] * _ODD[15] + np.uint64(n)
    for j in range(n):
        total += words[chunk.word[at + j]] * _ODD[j]
    return mix(total)


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((mix(h * _ROWS[row]) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def sketch(texts: DataFrame, least: int, longest: int, width: int) -> list[np.ndarray]:
    """For each row of a count-min sketch of ``width`` cells, whole blocks, packed bits of the cells that come to ``least``.

    Tasks count up to ``least``, below 256, in a cell, which is all that is asked; so cells are small and sums can't overflow.
    """
    if not 0 < least < 256:
        raise ValueError("least is from 1 to 255")
    blocks = width // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((DEPTH, width), dtype=np.uint8)
        for chunk in chunks(batches, longest):
            hashes = chunk.hashes()
            found = np.concatenate([gram_hashes(chunk, n, chunk.places(n), hashes) for n in range(1, longest + 1)])
            grams, times = np.unique(found, return_counts=True)
            times = np.minimum(times, least)
            for row in range(DEPTH):
                both = np.sort(cells(grams, row, width) << 8 | times)  # cells in order, each with what it gets
                first = np.flatnonzero(np.diff(both >> 8, prepend=-1))
                where, sums = both[first] >> 8, np.add.reduceat(both & 255, first) if len(first) else first
                have[row][where] = np.minimum(have[row][where] + sums, least)
        packed = pa.Codec("zstd", 1)
        for row in range(DEPTH):
            at = np.flatnonzero(have[row])
            ends, rows = np.searchsorted(at, np.arange(blocks + 1) * BLOCK), []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                here = at[ends[b] : ends[b + 1]]
                gaps = np.diff(here - b * BLOCK, prepend=0)
                planes = np.stack([gaps & 255, gaps >> 8, have[row][here]]).astype(np.uint8)  # what is alike lies together
                rows.append((row * blocks + b, len(here), packed.compress(planes, asbytes=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "n", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        packed = pa.Codec("zstd")
        for batch in batches:
            for block, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high, times = np.frombuffer(packed.decompress(counts, 3 * n), dtype=np.uint8).reshape(3, n).astype(np.int64)
                part, at = sums.setdefault(block, np.zeros(BLOCK, dtype=np.uint16)), np.cumsum(low + 256 * high)
                part[at] = np.minimum(part[at] + times, least)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], names=["block", "bits"])

    out = [np.zeros(width // 8, dtype=np.uint8) for _ in range(DEPTH)]
    merged = texts.mapInArrow(count, "block int, n int, counts binary").repartition("block").mapInArrow(merge, "block int, bits binary")
    for r in merged.toLocalIterator():  # each block once: DEPTH * width / 8 bytes
        row, b = divmod(r.block, blocks)
        out[row][b * BLOCK // 8 : (b + 1) * BLOCK // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def frequent(texts: DataFrame, least: int, longest: int, width: int = WIDTH) -> DataFrame:
    """``lang, k, phrase, f``: exact counts of all n-grams, by their number k of words, that occur ``least`` times in a language;
    with k = 0 and an empty phrase, the number of all its words."""
    bits = texts.sparkSession.sparkContext.broadcast(sketch(texts, least, longest, width))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, longest):
            hashes, langs, size = chunk.hashes(), list(chunk.langs), len(chunk.words)
            tags, counts, phrases, lengths = [], [], [], []
            for n in range(1, longest + 1):
                at = chunk.places(n)
                if n == 1:
                    for code, times in enumerate(np.bincount(chunk.lang[at], minlength=len(langs)).tolist()):
                        tags.append(langs[code]), counts.append(times), phrases.append(b""), lengths.append(0)
                h = gram_hashes(chunk, n, at, hashes)
                for row in range(DEPTH):
                    cell = cells(h, row, width)
                    alive = bits.value[row][cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0
                    at, h = at[alive], h[alive]
                code, last = chunk.lang[at], None
                for j in range(n):  # dense numbers of what is read so far keep the codes below 63 bits
                    code = np.unique(code, return_inverse=True)[1] * size + chunk.word[at + j]
                _, first, last = np.unique(code, return_index=True, return_counts=True)
                for i, times in zip(at[first].tolist(), last.tolist(), strict=True):
                    tags.append(langs[chunk.lang[i]])
                    phrases.append(b" ".join([chunk.words[w] for w in chunk.word[i : i + n].tolist()]))
                counts += last.tolist()
                lengths += [n] * len(last)
            columns = [pa.array(tags, pa.binary()), pa.array(lengths, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])

    counted = texts.mapInArrow(survivors, "lang binary, k int, phrase binary, f long")
    named = counted.select(F.col("lang").cast("string"), "k", F.col("phrase").cast("string"), "f")
    return named.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


def _looked_up(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked`` with ``f`` of its ``lang, part``, which all are in ``counts``; frequent parts are asked for by very many phrases."""
    keyed = asked.withColumn("ask_", F.struct("lang", "part"))
    times = keyed.groupBy("ask_").agg(F.count("*").alias("times_"))
    table = counts.where("k > 0").select(F.struct("lang", F.col("phrase").alias("part")).alias("ask_"), F.col("f").alias("f"))
    return spread_join(keyed, times.join(table, "ask_"), "ask_", "times_", asked.count()).drop("ask_")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, kept: int = KEPT, covered: int = COVERED, width: int = WIDTH) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``kept`` phrases of two to ``longest`` words in each language.

    a counts all occurrences of the phrase within pieces of texts, l and r those of its parts at the cut that scores
    lowest (ties: the shortest first part), n all words of the language; score is floor(1000000 * a * a / (l * r)). A phrase
    that stands in a longer one which occurs at least ``covered`` percent as often is dropped. Null texts are empty, null
    languages ``und``. Equal rows count each. An empty table gives an empty result; other columns are not looked at.
    """
    texts = docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    counts = cut(frequent(texts, least, longest, width), "counts")
    phrases = counts.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.select("lang", "phrase", "k", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit(True).alias("left"), joined(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))
    asked = cut(cuts.select("lang", "phrase", "a", "cut", F.inline(sides)), "cuts")
    both = _looked_up(asked, counts).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    wide = lambda c: f"cast({c} as decimal(15,0))"
    scored = both.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})").cast("long"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    # every shorter phrase within a longer one, with the largest count of such a one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: joined(s, m))))
    covers = phrases.where("k > 2").select("lang", F.col("f").alias("over"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = best.join(covers, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # Spark keeps the first rows of each task before it shuffles; parts keep what meets at last to PARTS * kept rows
    parted = left.withColumn("part_", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best_of = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part_").orderBy(*order))).where(F.col("rank") <= kept)
    ranked = best_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= kept)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the first 2000 collocations of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
w AS (
  SELECT lang, word, lead(word, 1) OVER t AS second, lead(word, 2) OVER t AS third
  FROM (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM q) WINDOW t AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS k, word AS phrase FROM w UNION ALL SELECT lang, 2, word || ' ' || second FROM w WHERE second IS NOT NULL
  UNION ALL SELECT lang, 3, word || ' ' || second || ' ' || third FROM w WHERE third IS NOT NULL
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(x.w, 1, cut), ' ') AND l.k = cut
    JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(x.w, cut + 1, x.k), ' ') AND r.k = x.k - cut
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, a, array_to_string(list_slice(w, 1, 2), ' ') AS phrase FROM c WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(list_slice(w, 2, 3), ' ') FROM c WHERE k = 3) GROUP BY ALL
), z AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.over IS NULL OR 100 * o.over < 50 * a
)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
