"""Full-text search: MATCH over three columns, ranked by BM25.

Whether and how often a leaf of the query matches is an expression over the tokens of one row, so the scan stays
narrow; the counts are written once, and document frequencies and lengths come out of one global aggregation of them, which is
the only exchange besides the final top-k. ``postings`` gives the inverted form for catalogs that are searched often.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.normalize import spelled, tokens
from cairn.operators.browse import first_location
from cairn.operators.filters import alive, date_window, every, visible, with_person
from cairn.plans.match import COLUMNS, Near, Op, Phrase, leaves, parse_or_phrase
from cairn.workspace import cut

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: What stands before the first word of a sentence.
SENTENCE_END = r"[.:][ \t\r\n]+\z"


def postings(photos: DataFrame) -> DataFrame:
    """``token, id, col, positions``: the inverted index; partition it by token when it is written."""
    listed = [photos.select("id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "token")) for c in COLUMNS if c in photos.columns]
    return reduce(DataFrame.unionByName, listed).groupBy("token", "id", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def refresh_postings(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after these rows changed: their old postings go, their new ones come; others are not read anew."""
    return index.join(changed.select("id").distinct(), "id", "left_anti").unionByName(postings(changed))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(words: Column, phrase: Phrase) -> Column:
    """Positions (from 0) at which the phrase occurs in an array of tokens."""
    if not phrase.words:
        return F.array().cast("array<int>")

    def at(i: Column) -> Column:
        parts = [F.get(words, i + k) == w for k, w in enumerate(phrase.words[:-1])]
        last = F.get(words, i + (len(phrase.words) - 1))
        parts.append(last.startswith(phrase.words[-1]) if phrase.prefix else last == phrase.words[-1])
        return F.coalesce(every(*parts), F.lit(False))

    found = F.sequence(F.lit(0), F.size(words) - 1)
    if phrase.initial:
        found = F.slice(found, 1, 1)
    return F.when(F.size(words) > 0, F.filter(found, at)).otherwise(F.array().cast("array<int>"))


def _count(leaf: Phrase | Near, words: dict[str, Column]) -> list[tuple[Column, Column, Phrase]]:
    """(occurrences that count, occurrences at all) of each scored phrase of a leaf."""

    def total(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)

    if isinstance(leaf, Phrase):
        n = total([F.size(_starts(words[c], leaf)) for c in leaf.columns])
        return [(n, n, leaf)]
    out = []
    for k, phrase in enumerate(leaf.phrases):
        near, every_ = [], []
        for c in phrase.columns:
            starts = [_starts(words[c], p) for p in leaf.phrases]
            every_.append(F.size(starts[k]))
            near.append(F.size(F.filter(starts[k], _part_test(leaf, starts, k))))
        out.append((total(near), total(every_), phrase))
    return out


def _part_test(leaf: Near, starts: list[Column], k: int):
    return lambda q: _takes_part(leaf, starts, k, q)


def _takes_part(leaf: Near, starts: list[Column], k: int, q: Column) -> Column:
    """Whether the occurrence at ``q`` lies in a window in which all phrases occur within the gap."""

    def begins(i: int, p: Column) -> Column:
        reach = p + (len(leaf.phrases[i].words) + leaf.gap)
        return every(*[F.exists(starts[j], lambda x: (x >= p) & (x <= reach)) for j in range(len(starts)) if j != i])

    def inside(i: int):
        size = len(leaf.phrases[i].words) + leaf.gap
        return lambda p: (q == p if i == k else (q >= p) & (q <= p + size)) & begins(i, p)

    return reduce(lambda a, b: a | b, [F.exists(starts[i], inside(i)) for i in range(len(starts))])


def _matches(tree, counted: dict[int, Column]) -> Column:
    if isinstance(tree, Op):
        left, right = _matches(tree.left, counted), _matches(tree.right, counted)
        return left & right if tree.kind == "AND" else left | right if tree.kind == "OR" else left & ~right
    return counted[id(tree)]


def match(photos: DataFrame, query: str, where: Column | None = None, candidates: Callable | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``id, rank`` of matching rows; rank is negative BM25, best least.

    Statistics are those of all rows of ``photos``, filters apply after. A syntax error turns the whole query into
    one phrase. An empty catalog or a query without a token gives no rows. ``candidates`` gives the ids that may match a
    query, so that only these are read; ``sizes`` (id, dl) then holds the token counts of all rows.
    """
    tree, _ = parse_or_phrase(query)
    here = [c for c in COLUMNS if c in photos.columns]
    scored: list[str] = []
    conditions: dict[int, Column] = {}
    counting: dict[str, tuple] = {}  # name of a phrase's counts: its leaf and place there
    adding = leaves(tree)

    def walk(node) -> None:
        if isinstance(node, Op):
            walk(node.left)
            walk(node.right)
            return
        names = [f"tf_{len(counting) + k}" for k in range(len(node.phrases) if isinstance(node, Near) else 1)]
        counting.update({name: (node, k) for k, name in enumerate(names)})
        conditions[id(node)] = every(*[F.col(f"m_.{n}") > 0 for n in names])
        if any(node is x for x in adding):
            scored.extend(names)

    walk(tree)

    def measure(found: Column) -> Column:
        words = {c: found[c] if c in here else F.array().cast("array<string>") for c in COLUMNS}
        fields = [sum((F.size(words[c]) for c in COLUMNS[1:]), F.size(words[COLUMNS[0]])).alias("dl")]
        for name, (node, k) in counting.items():
            counts, anywhere, _ = _count(node, words)[k]
            fields += [counts.alias(name), anywhere.alias(f"{name}_all")]
        return F.struct(*fields)

    rows = photos if candidates is None else photos.join(candidates(tree), "id", "left_semi")
    measured = rows.select("id", F.coalesce(where, F.lit(False)).alias("shown") if where is not None else F.lit(True).alias("shown"), _let(F.struct(*[tokens(F.col(c)).alias(c) for c in here]), measure).alias("m_"))
    measured = cut(measured, "measured")  # each text is tokenised once, and its counts are used twice
    everything = measured if sizes is None else sizes
    stats = everything.agg(F.count("*").cast("double").alias("n_rows"), F.avg("m_.dl" if sizes is None else "dl").alias("avgdl"))
    held = measured.agg(*[F.sum(F.when(F.col(f"m_.{p}_all") > 0, 1).otherwise(0)).cast("double").alias(f"df_{p}") for p in scored], F.count("*").alias("any_"))
    found = measured.where("shown").where(_matches(tree, conditions)).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(held))  # one row each
    rank = F.lit(0.0)
    for p in scored:
        df = F.coalesce(f"df_{p}", F.lit(0.0))
        idf = F.log((F.col("n_rows") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, FLOOR).otherwise(idf)
        tf = F.col(f"m_.{p}").cast("double")
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("m_.dl") / F.col("avgdl")))
    return found.select("id", rank.alias("rank"))


@dataclass(frozen=True)
class Index:
    """Written postings and sizes of a catalog that is searched often."""

    postings: DataFrame
    sizes: DataFrame

    def candidates(self, tree) -> DataFrame:
        """Rows that hold a token of some leaf that can match; the others are never read."""
        wanted = [w for x in leaves(tree) for p in (x.phrases if isinstance(x, Near) else (x,)) for w in [(p.words[0], p.prefix and len(p.words) == 1)] if p.words]
        tests = [F.col("token").startswith(w) if prefix else F.col("token") == w for w, prefix in wanted]
        hit = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        return self.postings.where(hit).select("id").distinct()


def build_index(photos: DataFrame, parts: int = 64) -> Index:
    """Postings written by hash of the token and sorted by it within files, so that a search reads few row groups; and token counts."""
    here = [c for c in COLUMNS if c in photos.columns]
    listed = cut(postings(photos).repartition(parts, "token").sortWithinPartitions("token", "id"), "postings")
    count = sum((F.size(tokens(F.col(c))) for c in here[1:]), F.size(tokens(F.col(here[0]))))
    return Index(listed, cut(photos.select("id", count.alias("dl")), "sizes"))


def search_index(photos: DataFrame, index: Index, query: str, *, limit: int | None = 50, where: Column | None = None) -> DataFrame:
    """As ``search`` over visible rows, by the postings: only rows that hold a token of the query are read and counted."""
    found = match(photos, query, every(visible(), where), index.candidates, index.sizes)
    return found if limit is None else found.orderBy("rank", "id").limit(limit)


def results(photos: DataFrame, locations: DataFrame, query: str, *, limit: int = 50, offset: int = 0, marks: tuple[str, str] = ("[", "]"), tags: DataFrame | None = None, people: DataFrame | None = None, person: str | None = None, category: str | None = None, include_hidden: bool = False, **dates: str | None) -> DataFrame:
    """A page of matches as shown: rank, state, first path, and snippets of 10 tokens of the text and 6 of the context.

    A person is looked up by name, dates bound the capture. Snippets and paths are made for the page's rows only.
    """
    pool = photos
    if person:
        shown = with_person(photos, tags, people, person).select("id", F.lit(True).alias("with_person_"))
        pool = photos.join(shown, "id", "left")
    conditions = [date_window(**dates) if any(dates.values()) else None, F.coalesce("with_person_", F.lit(False)) if person else None]
    page = cut(search(pool, query, limit=limit, offset=offset, category=category, include_hidden=include_hidden, where=every(*conditions)), "page")
    rows = photos.join(F.broadcast(page), "id")  # at most ``limit`` rows
    text, context = (snippets(rows, query, c, n, marks).withColumnRenamed("snippet", f"{c}_snippet") for c, n in (("text", 10), ("context", 6)))
    return rows.select("id", "rank", "status", "category", F.length("text").alias("text_len")).join(text, "id").join(context, "id").join(first_location(locations), "id", "left")


def search(photos: DataFrame, query: str, *, limit: int | None = 50, offset: int = 0, category: str | None = None, include_hidden: bool = False, where: Column | None = None) -> DataFrame:
    """The best matches among rows not trashed, ties by id; without a limit all of them, in no order unless some are skipped."""
    shown = every(alive() if include_hidden else visible(), F.col("category") == category if category else None, where)
    found = match(photos, query, shown)
    if limit is None:
        return found.orderBy("rank", "id").offset(offset) if offset else found
    return found.orderBy("rank", "id").offset(offset).limit(limit)


def search_count(photos: DataFrame, query: str, *, category: str | None = None, include_hidden: bool = False) -> DataFrame:
    shown = every(alive() if include_hidden else visible(), F.col("category") == category if category else None)
    return match(photos, query, shown).agg(F.count("*").alias("n"))


def _found(words: Column, leaf: Phrase | Near, column: str) -> list[tuple[Column, int]]:
    """Places at which each phrase of a leaf counts in a column, and the phrase's number of words."""
    phrases = leaf.phrases if isinstance(leaf, Near) else (leaf,)
    starts = [_starts(words, p) for p in phrases]
    if isinstance(leaf, Near):
        starts = [F.filter(s, _part_test(leaf, starts, k)) for k, s in enumerate(starts)]
    return [(s, len(p.words)) for s, p in zip(starts, phrases, strict=True) if column in p.columns]


def _hit(phrase: int, n: int):
    return lambda at: F.struct(at.alias("at"), F.lit(phrase).alias("phrase"), F.lit(n).alias("n"))


def _best_window(x: Column, size: int, phrases: int) -> Column:
    """First word of the best window of ``size`` words; null without a hit.

    A window scores 1000 for each phrase in it and 1 for each further hit. Windows begin at a hit, and are then moved so
    that their hits stand in the middle, or at the sentence of a hit, which adds 100, or 120 for the first sentence. The
    first of equal ones wins. Hits come by place, so that those of a window lie next to each other in the list.
    """
    hits, count = x["hits"], F.size(x["words"])

    def inside(at: Column, k: Column) -> Column:
        near = F.slice(hits, F.greatest(k - phrases, F.lit(0)) + 1, F.lit((size + 2) * phrases))
        return F.filter(near, lambda h: (h["at"] >= at) & (h["at"] < at + size))

    def score(held: Column) -> Column:
        return F.size(held) + F.size(F.array_distinct(F.transform(held, lambda h: h["phrase"]))) * 999

    def window(points: Column, order: Column, begin: Column) -> Column:
        return F.struct(points.alias("points"), (-order).alias("order"), begin.alias("begin"))

    def middle(h: Column, k: Column) -> Column:
        def moved(held: Column) -> Column:
            last = F.element_at(held, -1)
            room = ((F.lit(size) - (last["at"] + last["n"] - h["at"])) / 2).cast("int")
            return window(score(held), k * 2, F.greatest(F.least(h["at"] - room, count - size), F.lit(0)))

        return _let(inside(h["at"], k), moved)

    def sentence(h: Column, k: Column) -> Column:
        def begun(s: Column) -> Column:
            # a later hit of the sentence can't win: the window is the same
            new = (s < h["at"]) & (count > size) & ((k == 0) | (F.get(hits, k - 1)["at"] <= s))
            return F.when(new, window(score(inside(s, k)) + F.when(s == 0, 120).otherwise(100), k * 2 + 1, s))

        return _let(F.array_max(F.filter(x["opens"], lambda o: o <= h["at"])), begun)

    return F.array_max(F.concat(F.transform(hits, middle), F.filter(F.transform(hits, sentence), lambda w: w.isNotNull())))["begin"]


def _shown(x: Column, text: Column, size: int, marks: tuple[str, str], dots: str) -> Column:
    """The text of a window as it stands there, hits marked; hits that overlap share marks, and none does that begins before the window."""
    begin, count = x["begin"], F.size(x["words"])
    last = F.least(begin + size, count) - 1

    def cover(i: Column, to: Column) -> Column:
        """Whether one hit holds all words from ``i`` to ``to``."""
        return F.exists(x["hits"], lambda h: (h["at"] <= i) & (h["at"] + h["n"] > to))

    def opens(i: Column) -> Column:
        return F.exists(x["hits"], lambda h: h["at"] == i) & ~cover(i - 1, i)

    def body(first: Column) -> Column:
        def word(i: Column) -> Column:
            before = F.when((i > begin) | (begin == 0), F.get(x["gaps"], i)).otherwise("")
            closes = (first <= i) & cover(i, i) & ((i == last) | ~cover(i, i + 1))
            return F.concat(before, F.when(opens(i), marks[0]).otherwise(""), F.get(x["words"], i), F.when(F.coalesce(closes, F.lit(False)), marks[1]).otherwise(""))

        return F.array_join(F.transform(F.sequence(begin, last), word), "")

    first = F.array_min(F.filter(F.sequence(begin, last), opens))
    used = F.aggregate(F.concat(x["gaps"], x["words"]), F.lit(0), lambda n, part: n + F.length(part))
    rest = F.when(begin + size < count, F.lit(dots)).otherwise(F.substr(text, used + 1))
    whole = F.concat(F.when(begin > 0, dots).otherwise(""), _let(F.struct(first.alias("v")), lambda v: body(v["v"])), rest)
    return F.when(count == 0, text).otherwise(whole)


def snippets(photos: DataFrame, query: str, column: str = "text", size: int = 10, marks: tuple[str, str] = ("[", "]"), dots: str = " ... ") -> DataFrame:
    """``id, snippet`` of each row: the best ``size`` words of a column as they stand in its text, hits marked.

    The window is the one with the most distinct phrases of the query, then the most hits, preferring the starts of
    sentences (see ``_best_window``); sides that are cut get ``dots``. A row without a hit shows its first words, a
    text without words is shown whole, and a null text gives null. Of NEAR only the occurrences count that take part
    in a match; phrases behind NOT never count. A text with very many hits in as many sentences takes time by their product.
    """
    tree, _ = parse_or_phrase(query)

    def show(x: Column) -> Column:
        found = [f for leaf in leaves(tree) for f in _found(x["folded"], leaf, column) if f[1]]
        hits = F.array_sort(F.concat(*[F.transform(s, _hit(k, n)) for k, (s, n) in enumerate(found)])) if found else F.array().cast("array<struct<at:int,phrase:int,n:int>>")
        words = F.filter(F.sequence(F.lit(0), F.size(x["words"]) - 1), lambda i: (i == 0) | F.get(x["gaps"], i).rlike(SENTENCE_END))
        opens = F.when(F.size(x["words"]) > 0, words).otherwise(F.array().cast("array<int>"))
        parts = F.struct(x["words"].alias("words"), x["gaps"].alias("gaps"), hits.alias("hits"), opens.alias("opens"))

        def placed(y: Column) -> Column:
            begin = F.coalesce(_best_window(y, size, max(1, len(found))), F.lit(0))
            return _let(F.struct(*[y[c].alias(c) for c in ("words", "gaps", "hits")], begin.alias("begin")), lambda z: _shown(z, F.col(column), size, marks, dots))

        return _let(parts, placed)

    gaps, words = spelled(F.col(column))
    read = F.struct(words.alias("words"), gaps.alias("gaps"), tokens(F.col(column)).alias("folded"))
    return photos.select("id", F.when(F.col(column).isNotNull(), _let(read, show)).alias("snippet"))
