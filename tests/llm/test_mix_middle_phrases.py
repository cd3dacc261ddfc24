"""Mixing, fill-in-the-middle and phrases against SQL, plain versions and odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from cairn.llm import fill_middle, mixing, phrases, registry  # noqa: E402

ODD = [None, "", " ", "a", "a  b ", "\n\t", "é́ 日本 🙂", "x <P> y", "Of " * 300, "z" * 3000, "\x0b\x0c a\x1cb c", "a b, a b. A B", "<P", "M>"]


@pytest.mark.parametrize("name", ["op11_mixing", "op12_fill_middle", "op13_phrases"])
def test_query_equals_sql(name, spark, sf, oracle, same):
    same(registry.queries()[name](spark, sf), oracle.sql(registry.oracle_sql()[name]))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "xx", [None, "s", ""][i % 3], "clash", "c") for i, t in enumerate(ODD)]
    rows += [(None, "some text", None, None, None, None)] * 2 + [(3, "other words here", "xx", "s", None, None), (3, None, "xx", "big", None, None)]
    rows += [(100 + i % 2, "the same words of many copies", "xx", "big", None, None) for i in range(900)]
    names = "doc_id long, text string, lang string, source string, size string, target string"
    return spark.createDataFrame(rows, names).repartition(7), rows


def _targets(sizes):
    """Shares by weight, capped again and again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, free = total - sum(3 * sizes[s] for s in capped), [s for s in order if s not in capped]
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: share.get(s, Fraction(3 * sizes[s])) for s in order}
        capped |= above


def test_targets_equal_repeated_sharing(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        sizes = {(None if i == 3 else f"s{i}"): int(x) for i, x in enumerate((rng.pareto(0.5, n) * 50).astype(int))}
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = _targets(sizes)
        assert len(found) == n and all(abs(r.target - float(want[r.source])) < 1e-6 for r in found)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0
    assert [r.target for r in mixing.targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.targets(spark.createDataFrame([], "source string, source_size long"), most=0)


def test_mix_is_exact_and_repeats(spark, odd):
    frame, rows = odd
    frame = mixing.measured(frame.withColumnRenamed("size", "kept"))
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows) and {r.kept for r in found} == {None, "clash"}
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = _targets(sizes)
    assert all(taken[s] == floor(want[s]) and abs(target[s] - float(want[s])) < 1e-6 for s in sizes)
    key = lambda rs: sorted((r.doc_id or -1, r.text or "", r.source or "", r.taken) for r in rs)
    assert key(mixing.mix(frame.repartition(3)).collect()) == key(found)
    out = mixing.written_out(mixing.mix(frame)).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert +words == +taken and max(r.epoch for r in out) <= 3
    assert mixing.mix(frame.limit(0)).count() == 0


def test_sums_of_a_source_spread_over_parts(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", i, f"{i * 7919 % 3001:05}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "source string, v long, draw string")
    found = mixing.with_sums(frame, "source", ["source", "draw"], ["v"]).collect()
    want, at = {}, Counter()
    for s, v, d in sorted(rows, key=lambda r: (r[0], r[2])):
        want[v] = at[s]
        at[s] += v
    assert {r.v: r.before_v for r in found} == want


def _middle(i, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_boundaries_select_every_code_point():
    for t in ("", "a", "é", "日本語" * 40, "🙂é a" * 50, "x" * 63, "x" * 64, "é" * 600_000):
        index, ends = fill_middle.Boundaries(t.encode()), np.cumsum([0, *[len(c.encode()) for c in t]])
        picks = range(len(t) + 1) if len(t) < 1000 else [0, 1, 599_999, 600_000, 524_288, 524_287]
        assert index.n == len(t) and [index[i] for i in picks] == [ends[i] for i in picks]


def test_middles_equal_a_plain_version(spark, odd):
    frame, rows = odd
    rows = rows + [(2000 + i, "<" * (i % 4) + "S>é🙂 <P" * 3 + "<M" * (i % 3), None, None, None, None) for i in range(150)]
    frame = spark.createDataFrame(rows, frame.schema).repartition(5)
    out = fill_middle.fill_in_middle(frame)
    found = out.withColumn("back", fill_middle.restore(out.output, out.form)).collect()
    key = lambda rs: sorted(rs, key=repr)
    assert key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == key((r[0], *_middle(r[0], r[1])) for r in rows)
    assert Counter(r.back for r in found) == Counter(r[1] or "" for r in rows)
    assert {"psm", "spm", "plain"} == {r.form for r in found}
    assert fill_middle.fill_in_middle(frame.limit(0)).count() == 0
    text_ids = spark.createDataFrame([("a", "some text"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in fill_middle.fill_in_middle(text_ids).collect()} == {"a", None}


def test_a_text_of_many_documents_is_dealt_out(spark, odd):
    sent = fill_middle.grouped(odd[0], "doc_id", "text").collect()
    copies = [r for r in sent if bytes(r.text) == b"the same words of many copies"]
    assert {r.block for r in copies} == {0, 1} and sum(len(r["keys"]) for r in copies) == 900
    assert len(sent) < 100


def _grams(text, longest):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        w = re.findall(r"[^\x20\x09]+", piece)
        for n in range(1, longest + 1):
            for i in range(len(w) - n + 1):
                yield n, " ".join(w[i : i + n])


def _collocations(rows, least, longest, covered):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for k, g in _grams(text, longest):
            counts[lang or "und"][g] += 1
            n[lang or "und"] += k == 1
    out = []
    for lang, f in counts.items():
        cands, found = {g: a for g, a in f.items() if a >= least and " " in g}, []
        for g, a in cands.items():
            w = g.split(" ")
            if any(100 * b >= covered * a and any(h.split(" ")[i : i + len(w)] == w for i in range(len(h.split(" ")))) for h, b in cands.items() if h.count(" ") > g.count(" ")):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, g.encode(), l, r))
        out += [(lang, i + 1, g.decode(), -a, l, r, n[lang], -s) for i, (s, a, g, l, r) in enumerate(sorted(found)[:2000])]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_a_plain_version(spark, odd, longest):
    rng = np.random.default_rng(longest)
    vocabulary = ["a", "b", "C", "c", "d", "é", "日本", "x y", "\x1c", "B"]
    texts = [" ".join(rng.choice(vocabulary, 40)) + rng.choice([".", " , ", "\t", "\n"]) + "a b c d" * int(rng.integers(0, 3)) for _ in range(60)]
    rows = [(t, [None, "xx", "und", "yy"][i % 4]) for i, t in enumerate(texts)] + [(r[1], r[2]) for r in odd[1]]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4).selectExpr("*", "1 AS phrase", "2 AS k")
    found = phrases.collocations(frame, least=4, longest=longest, covered=60, width=phrases.BLOCK).collect()
    assert sorted(tuple(r) for r in found) == _collocations(rows, 4, longest, 60)
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_chunks_cut_long_texts_without_loss(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 40)
    monkeypatch.setattr(phrases, "CHUNK", 25)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice([*"abc  ,\n\t", "dd ", "   "], 400)) for _ in range(20)] + ["a" * 300, " " * 200 + "x y z", "", "p q r " * 50]
    batch = pa.RecordBatch.from_pydict({"lang": ["xx"] * len(texts), "text": texts})
    got = Counter()
    for chunk in phrases.chunks(iter([batch.slice(0, 9), batch.slice(9)]), 3):
        for n in (1, 2, 3):
            for i in chunk.places(n).tolist():
                got[n, b" ".join(chunk.words[w] for w in chunk.word[i : i + n]).decode()] += 1
    assert got == Counter(g for t in texts for g in _grams(t, 3))


def test_a_sketch_never_undercounts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 60)) for _ in range(200)]
    frame = spark.createDataFrame([("xx", t) for t in texts], "lang string, text string").repartition(6)
    bits = phrases.sketch(frame, 10, 2, phrases.BLOCK)
    true, batch = Counter(g for t in texts for g in _grams(t, 2)), pa.RecordBatch.from_pydict({"lang": ["xx"] * 200, "text": texts})
    for chunk in phrases.chunks(iter([batch]), 2):
        for n in (1, 2):
            at = chunk.places(n)
            h = phrases.gram_hashes(chunk, n, at, chunk.hashes())
            said = np.all([bits[r][(c := phrases.cells(h, r, phrases.BLOCK)) >> 3] >> (c & 7).astype(np.uint8) & 1 for r in range(phrases.DEPTH)], axis=0)
            often = [true[n, b" ".join(chunk.words[w] for w in chunk.word[i : i + n]).decode()] >= 10 for i in at.tolist()]
            assert not (np.array(often) & ~said).any() and said.mean() < np.mean(often) + 0.05 and len(bits) == phrases.DEPTH
