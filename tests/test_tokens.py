"""Words of texts and queries against those of SQLite's full-text index."""

import sqlite3

import numpy as np

from cairn.functions import normalize as N
from cairn.operators import search
from cairn.plans.match import words_of

#: Letters and marks that the index's Unicode tables knew, white space, signs, and marks that part words.
RANGES = [(0x20, 0x7E), (0xA0, 0x24F), (0x300, 0x34E), (0x391, 0x3FF), (0x400, 0x481), (0x48A, 0x523), (0x5D0, 0x5EA), (0x5B0, 0x5BD), (0x621, 0x64A), (0x64B, 0x652), (0x904, 0x94D), (0x1E00, 0x1EFF), (0x1F00, 0x1F15), (0x2010, 0x2027), (0x2160, 0x2188), (0x3041, 0x3096), (0x4E00, 0x4EFF), (0xAC00, 0xACFF), (0xFF21, 0xFF5A), (0x1F600, 0x1F610)]


def _texts(n):
    rng = np.random.default_rng(11)
    letters = [chr(i) for a, b in RANGES for i in range(a, b + 1)]
    plain = [*"aAeEiIzZ  ", "́", "̇", "̌", "̣", "İ", "Ł"]
    out = ["".join(rng.choice(letters if i % 2 else plain + letters[95:500], rng.integers(1, 9))) for i in range(n)]
    return out + ["İstanbul", "żaba", "cafés ǎ", "ộ", "́x", "straße Σς", "ſhip"]


def test_tokens_are_those_of_the_index(spark):
    texts = _texts(50_000)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    want = [[] for _ in texts]
    for term, doc in con.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, x string").repartition(4)
    got = {r.id: r.w for r in rows.select("id", N.tokens(rows.x).alias("w")).collect()}
    wrong = [(texts[i], got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]]
    assert not wrong, (len(wrong), wrong[:5])
    assert [words_of(t) for t in texts[-3000:]] == want[-3000:]


QUERIES = ["alpha", "alpha beta", "beta alpha gamma", '"alpha beta"', '"alpha beta" OR gamma', "al* OR gamma", "NEAR(alpha beta, 2)", "alpha OR NEAR(beta gamma, 1)", "text : alpha OR context : beta", "alpha NOT delta", '"beta beta" OR beta', '"alpha beta gamma beta alpha gamma beta beta alpha beta alpha gamma" OR alpha', "^alpha OR gamma", "café"]


def _prose(n):
    rng = np.random.default_rng(5)
    common = ["alpha", "beta", "gamma", "Alpha", "BETA", "Café", "café", "ḍelta", "x̣y"]
    joins = [" ", " ", " ", "  ", ". ", ": ", "\n", ".\n", "-", ", ", "? ", ".", " (", " ", ". ", " ̣", ":\t\r\n"]
    out = []
    for _ in range(n):
        share = rng.choice([0.02, 0.15, 0.6])
        words = [rng.choice(common) if rng.random() < share else f"w{rng.integers(40)}" for _ in range(rng.integers(0, 60))]
        text = "".join(w + rng.choice(joins) for w in words)
        out.append(str(rng.choice(["", " ", "¿", "... "])) + (text if rng.random() < 0.5 else text.rstrip()))
    return out


def test_snippets_are_those_of_the_index(spark):
    texts, others = _prose(400), _prose(400)[::-1]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, context, vision_text)")
    con.executemany("INSERT INTO t(rowid, text, context, vision_text) VALUES (?, ?, ?, '')", [(i, *pair) for i, pair in enumerate(zip(texts, others, strict=True))])
    rows = spark.createDataFrame([(i, *pair, "") for i, pair in enumerate(zip(texts, others, strict=True))], "id long, text string, context string, vision_text string").repartition(4).cache()
    seen = 0
    for query in QUERIES:
        for column, at, size in (("text", 0, 10), ("context", 1, 6)):
            want = dict(con.execute(f"SELECT rowid, snippet(t, {at}, '[', ']', ' ... ', {size}) FROM t WHERE t MATCH ?", (query,)))
            got = {r.id: r.snippet for r in search.snippets(rows, query, column, size).collect()}
            wrong = [(query, texts[i] if at == 0 else others[i], got[i], w) for i, w in want.items() if got[i] != w]
            assert not wrong, (len(wrong), len(want), wrong[:3])
            seen += len(want)
    assert seen > 1000


def test_snippets_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "one"), (4, "one"), (5, "w " * 100_000 + "one. Two")], "id long, text string")
    got = sorted(((r.id, r.snippet) for r in search.snippets(rows, "one").collect()), key=str)
    assert got[:5] == [(1, None), (2, ""), (3, "?!"), (4, "[one]"), (4, "[one]")]
    assert got[5] == (5, " ... " + "w " * 8 + "[one]. Two")
    assert {r.snippet for r in search.snippets(rows.where("id = 4"), '""').collect()} == {"one"}
    assert search.snippets(rows.limit(0), "one").count() == 0
