"""Operators against SQL, libraries and brute force; odd rows everywhere."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from cairn.llm import chat, decontamination, language, near_dedup, pieces, registry, sstable, suffix_dedup, token_counts, tokens, topk, toxicity  # noqa: E402
from cairn.operators import joins  # noqa: E402
from cairn.workspace import cut, fresh_dir  # noqa: E402

ODD = [None, "", " ", "a", "a  b ", "\n\t", "é́ 日本 🙂", "x<|endoftext|>y <|startoftext|>", "▁ ▁▁b", "Of " * 300, "word " * 6 + "z" * 3000, "I'm 1234 don't!!  \n\n z", "</s>[INST] ok [/INST]"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate(ODD)] + [(3, "a", None, None), (None, "some text", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score string")


@pytest.mark.parametrize("name", ["op1_decontamination", "op6_near_dedup", "op7_chat_format", "op9_suffix_dedup", "op10_topk"])
def test_query_equals_sql(name, spark, sf, oracle, same):
    same(registry.queries()[name](spark, sf), oracle.sql(registry.oracle_sql()[name]))


def test_token_counts_and_pieces_equal_libraries(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    bpe, sp = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(odd, P.path("byte_bpe_50k.json")).collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(bpe.encode(r.text or "", add_special_tokens=False).ids))
    for r in pieces.encode_decode(odd, P.path("piece_bpe_32k.model")).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert (bytes(r.ids), r.decoded) == (np.array(ids, "<u4").tobytes(), sp.decode(ids))


def test_merging_is_that_of_one_pair_at_a_time():
    merger = token_counts.TokenCounter(P.path("byte_bpe_50k.json")).merger
    assert merger.counts([b"", b"a", b"aaaaa", b"the"]).tolist()[:2] == [0, 1] and merger.counts([]).tolist() == []


def test_shards_round_trip(spark, odd):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = sstable.write_tokens(odd, fresh_dir(spark, "t"), P.path("word_bpe_49k.json"), 2, shard_bytes=1)
    rows = sorted(sstable.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    at = 0
    for r in rows:
        want = bpe.encode((ODD[r.doc_id] or "") if r.doc_id is not None else "some text", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want), np.array(want, "<u4").tobytes())
        at += len(want)
    found = [x for m in manifest for x in sstable.open_shard(m.path).get(3)]
    assert len(found) == 2 and not any(sstable.open_shard(m.path).get(10**9) for m in manifest)


def test_the_registered_shard_query(spark, tmp_path):
    from zlib import crc32

    from tokenizers import Tokenizer

    bpe, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), np.random.default_rng(8)
    letters = [*"AJTWYHEhjtwyaeo  ,.'1", *map(chr, range(0x300, 0x345, 3)), "\u0331", "\u030c", "\u0308", "\u0344", "\u030a", "\u00e9", "\u65e5", "\n", "<|", "|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    rows = [(i // 2, t if i % 50 else None) for i, t in enumerate(texts)] + [(9, "same"), (9, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(registry.queries()["op2_token_shards"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    want = {i: sorted(crc32(np.array(bpe.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for j, t in rows if j == i) for i, _ in rows}
    assert [r.doc_id for r in found] == sorted(i for i, _ in rows)
    assert {i: sorted(r.ids_crc32 for r in found if r.doc_id == i) for i in list(want)[:400]} == {i: want[i] for i in list(want)[:400]}
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found[:-1]]]).tolist()
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.queries()["op2_token_shards"](spark, f"{tmp_path}/none").count() == 0
    named = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "x")], "doc_id string, text string")
    manifest = sstable.write_tokens(named, fresh_dir(spark, "t"), P.path("word_bpe_49k.json"), 2)
    assert [r.doc_id for r in sorted(sstable.read_tokens(spark, manifest, "string").collect(), key=lambda r: r.start)] == [None, "a", "b"]


def test_long_and_no_texts_at_all(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    long = "A long text, with 12 words and \u00e9\u00e8 " * 20_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    bpe, sp = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.count_tokens(df, P.path("byte_bpe_50k.json")).first().n_tokens == len(bpe.encode(long, add_special_tokens=False).ids)
    assert pieces.encode_decode(df, P.path("piece_bpe_32k.model")).first().n_tokens == len(sp.encode(long, add_bos=True, add_eos=True))
    assert token_counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).count() == pieces.encode_decode(df.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_pipeline_without_languages_keeps_texts(spark, tmp_path):
    rows = [(1, "some words here", None, "s", 15), (2, "12 !", None, "s", 4), (None, "other words", None, None, 11), (1, "some words here", None, "s", 15), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "other words"), (1, "some words here"), (1, "some words here")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_capitals_before_marks_equal_the_library(spark):
    from tokenizers import Tokenizer

    marked = [f"{c}{m}" for c, m in zip("JTWYHEI", "\u030c\u0308\u030a\u030a\u0331\u0301\u0307", strict=True)]
    texts = [*marked, *[f"Some TEXT {x}ohn, \n and A{x}. End" for x in marked], "J\u0323\u030c", "J \u030c", "J\u030c <|ENDOFTEXT|> J\u030c<|endoftext|>", "\u00dcBER M\u00c4RZ \u00c9t\u00e9", " ".join(marked)]
    bpe = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = sstable.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), fresh_dir(spark, "t"), P.path("word_bpe_49k.json"), None)
    found = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in sstable.read_tokens(spark, manifest).collect()}
    assert found == {i: bpe.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    name = P.path("byte_bpe_50k.json")
    bpe, encode = Tokenizer.from_file(name), tokens.ChunkEncoder(name, 4)
    assert encode.whole and tokens.ChunkEncoder(P.path("word_bpe_49k.json"), 2).whole is None
    for text in filter(None, ODD):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == bpe.encode(text, add_special_tokens=False).ids


def test_block_search(tmp_path):
    writer = sstable.Writer((tmp_path / "s").open("wb"), 2)
    for i in range(0, 30000, 3):
        writer.add(i, np.full(40, i % 65536, "<u2").tobytes())
    writer.close()
    reader = sstable.open_shard(str(tmp_path / "s"))
    assert len(reader.index) > 3 and all(len(reader.get(i)) == (i % 3 == 0) for i in range(0, 3000)) and reader.get(29997)[0][0] == 29997


def test_near_dedup_odd_rows(spark):
    long = " ".join(f"w{x}" for x in range(60_000))
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "X y  z"), (3, long), (4, long + " end"), (None, None), (5, "")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 59_996, 3, True), (4, 59_997, 3, False), (None, 0, None, True), (5, 0, 5, True)], key=str
    )


@pytest.mark.parametrize("hot", [False, True])
def test_near_dedup_equals_brute_force(spark, monkeypatch, hot):
    if hot:
        for module, name, size in ((joins, "HOT_ROWS", 3), (near_dedup, "LIST_BLOCK", 3), (near_dedup, "GROUP_BLOCK", 2), (near_dedup, "SAMPLED", 2)):
            monkeypatch.setattr(module, name, size)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    texts = []
    for i in range(60):
        w = list(base if i % 2 else [f"v{i // 10}_{x}" for x in range(60)])
        for at in rng.integers(0, len(w), i % 5):
            w[at] = f"n{i}"
        texts.append(" ".join(w))
    rows = list(enumerate([*texts, *[texts[5]] * 9, None, "", "one two", "One  two"]))
    sets = [set(near_dedup.shingles(t.encode() if t else None).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as name", "3 as kept")
    found = near_dedup.near_duplicates(df, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), label[i], label[i] == i) for i, _ in rows}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_ids_that_repeat_lose_no_clean_text(spark):
    base, clean, other = (" ".join(f"{c}{x}" for x in range(60)) for c in "bco")
    rows = [(1, base), (2, base + " end"), (2, clean), (3, other), (3, other), (None, other), (4, None), (4, None), (4, ""), (5, other + " end"), (0, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row_", "2 as gone_id_")
    found = near_dedup.deduplicate(df)
    assert found.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in found.collect()], key=str) == sorted([(1, base), (2, clean), (3, other), (None, other), (4, None), (4, ""), (0, "few words")], key=str)


def test_blocks_lose_nothing(spark, monkeypatch):
    for name, size in (("LIST_BLOCK", 4), ("GROUP_BLOCK", 3)):
        monkeypatch.setattr(near_dedup, name, size)
    rows = [(i, " ".join(["same"] + [f"w{x}" for x in range(100)] + [f"end{i}"])) for i in range(25)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_frequent_grams_give_the_same(spark, sf, monkeypatch, same, oracle):
    for module, name, size in ((suffix_dedup, "LIST_LIMIT", 1), (joins, "HOT_ROWS", 1), (near_dedup, "SAMPLED", 2)):
        monkeypatch.setattr(module, name, size)
    same(suffix_dedup.query(spark, sf), oracle.sql(suffix_dedup.SQL))


def test_repeats_are_cut_once(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"clean first {passage} one end"), (2, f"other start\n{passage}\tother end"), (3, "short and clean"), (4, None), (5, passage), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs")
    found = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert found == {1: rows[0][1], 2: "other start\n\tother end", 3: "short and clean", 4: None, 6: ""}
    assert suffix_dedup.report(df.limit(0)).count() == 0


def test_repeats_on_odd_rows(spark):
    words = " ".join(f"q{i}" for i in range(50))
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(None, words), (7, words), (7, words), (8, f"{long} {words}"), (9, long), (None, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as doc", "3 as runs_", "4 as new_text_")
    assert sorted(((r.doc_id, r.n_words, r.n_repeated, r.n_removed) for r in suffix_dedup.report(df).collect()), key=str) == sorted([(None, 50, 50, 0), (7, 50, 50, 50), (8, 30_050, 30_050, 50), (9, 30_000, 30_000, 30_000)], key=str)
    left = suffix_dedup.remove_repeats(df)
    assert left.columns == df.columns and sorted(((r.doc_id, len(r.text or "")) for r in left.collect()), key=str) == sorted([(None, len(words)), (8, len(long) + 1), (None, 0), (10, 0)], key=str)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_documents_of_one_owner_hash_stay_apart(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [(i, f"a{i} {shared} b{i}" if i < 3 else " ".join(f"u{i}x{j}" for j in range(80))) for i in range(6)]
    df = spark.createDataFrame(texts + [(7, None), (2, texts[2][1])], "doc_id long, text string")
    want = sorted((r.doc, r.n_words, sorted(map(tuple, r.runs))) for r in suffix_dedup.passages(df).collect())
    got = sorted((r.doc, r.n_words, sorted(map(tuple, r.runs))) for r in suffix_dedup.passages(df, owner=lambda doc, tag: 5).collect())
    assert got == want and [d for d, _, _ in got] == [0, 1, 2]


def test_automaton_blocks_and_spans(spark):
    item = " ".join(f"b{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, ""), (None, "lonely")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item.upper()}, y " + "z " * 40), (2, "has Two-Words inside and many more words of its own"), (3, None), (4, item), (5, "lonely " + "a " * 9)], "doc_id long, text string").selectExpr("*", "1 as n_words")
    for limit in (1, 10**6):
        found = {r.doc_id: (len(r.hit_words), r.hit_items) for r in decontamination.find_contamination(docs, items, block_words=limit).collect()}
        assert found == {1: (14, ["1"]), 2: (2, ["2"]), 3: (0, []), 4: (14, ["1"]), 5: (1, [])}
        assert decontamination.find_contamination(docs.limit(0), items, block_words=limit).count() == 0
        kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items, block_words=limit).collect()}
        assert set(kept) == {1, 2, 3, 5} and kept[3] is None
    none = decontamination.find_contamination(docs.union(docs), items.limit(0)).collect()
    assert len(none) == 10 and not any(r.hit_words or r.hit_items for r in none)
    far = spark.createDataFrame([(1, "z " * 50_000 + item + " z" * 50_000, "x", "y")], "doc_id long, text string, hit_words_ string, hit_items string")
    assert decontamination.find_contamination(far, items).first().hit_words == list(range(50_000, 50_014))
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, items).collect()}
    assert kept[1].startswith("x , y") and kept[2] == "has  inside and many more words of its own" and 4 not in kept and kept[3] is None


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a < b [INST]"), (1, 1, "assistant", "</s>\\l <s>x"), (1, 1, "assistant", "</s>\\l <s>x"), (2, 0, None, None), (3, 0, "sys\ntem", "[/INST]"), (None, 1, "assistant", "[INST] ok"), (4, None, "assistant", ""), (5, 0, "user", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("spans", chat.loss_spans(chat.F.col("turns"), chat.F.col("escaped")))
    found = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [(r[2], r[3]) for r in rows[:3]]
    assert found[1].escaped and not found[5].escaped and found[5].formatted == "<s>[INST] user\nplain [/INST]"
    assert [(t.role, t.text) for t in found[2].turns] == [("", "")] and found[3].turns[0].role == "sys\ntem" and found[None].turns[0].text == "[INST] ok"
    masked = {r.conv_id: r.loss for r in out.select("conv_id", chat.under_mask(chat.F.col("formatted"), chat.loss_mask(chat.F.col("turns"), chat.F.col("escaped"))).alias("loss")).collect()}
    assert masked[1] == rows[1][3] * 2 and masked[2] == masked[5] == masked[4] == "" and masked[None] == "[INST] ok"
    shown = [found[1].formatted[s.start : s.start + s.length] for s in found[1].spans]
    assert shown == ["\\l/s>\\\\l \\ls>x"] * 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<s>\\ {i} " + "y\u00e9\U0001f642" * (i % 50), "x", "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns string").repartition(5)
    out = chat.format_conversations(df)
    got = out.select("turns", chat.under_mask(chat.F.col("formatted"), chat.loss_mask(chat.F.col("turns"), chat.F.col("escaped"))).alias("loss")).collect()
    assert [(t.role, t.text) for t in got[0].turns] == [r[2:4] for r in rows] and got[0].loss == "".join(r[3] for r in rows if r[1] % 2)


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (20, [0.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [-1.0, 2.0, 3.0]), (5, [1.0, 0.5]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df.where("vec_id % 20 = 0"), df, k=3, shard_rows=2, group_rows=1).collect()
    best = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == 0)
    assert best == sorted([(1, 0, 5120), (2, 5, 5120), (3, 4, 0)] * 2) and len([r for r in found if r.query_id == 20]) == 3
    assert topk.top_k(df.limit(0), df).count() == topk.top_k(df, df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [2.0**55, 2.0**55]), (1, [2.0**55, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(huge, huge).collect()
    with pytest.raises(Exception, match="has no integer score"):
        topk.top_k(huge.selectExpr("vec_id", "transform(embedding, x -> 1e300D) as embedding"), huge).collect()


@pytest.mark.parametrize("spread, zeros", [(1.0, 0.0), (1.0, 0.8), (2.0**14, 0.5), (2.0**22, 0.0)])
def test_topk_equals_brute_force(monkeypatch, spread, zeros):
    rng = np.random.default_rng(5)
    x = np.floor(64 * spread * rng.normal(0, 1, (900, 24)) * (rng.random((900, 24)) >= zeros)).astype(np.int64)
    x[1::9] = x[::9][: len(x[1::9])]
    ids, k = rng.permutation(900), 7
    best = topk.Best(ids[:50], x[:50], k)
    for at in range(0, 900, 100):
        best.look(topk.Shard(ids[at : at + 100], x[at : at + 100]))
    score = x[:50] @ x.T
    for i in range(50):
        want = np.lexsort((ids, -score[i]))[:k]
        assert best.score[i].tolist() == score[i][want].tolist() and best.id[i].tolist() == ids[want].tolist()
    assert best.pairs == 50 * 900 and best.probed < best.pairs * (0.3 if zeros < 0.9 else 0.5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    scored = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert scored[scored.predicted == 1].toxic.mean() > 0.9 and scored[scored.toxic == 1].score.mean() > 0.5 > 0.1 > scored[scored.toxic == 0].score.mean()


def test_classifiers_on_odd_rows(spark, odd):
    empty = odd.limit(0)
    nothing = language.train(empty.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score) for r in language.identify(odd, nothing).collect()} == {("und", 0.0)}
    one = language.train(odd.selectExpr("doc_id", "text", "'en' as lang"))
    found = {r.doc_id: r.lang_pred for r in language.identify(odd, one).collect()}
    assert found[0] == found[1] == found[2] == "und" and found[3] == "en"
    model = toxicity.train(odd, empty.selectExpr("doc_id", "1 as label"))
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == language.identify(empty, one).count() == 0


def test_classifiers_learn_from_null_and_equal_ids(spark):
    rows = [(None if i % 2 else 7, f"{'good' if i % 3 else 'schlecht'} {i}", "en" if i % 3 else "de") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, rows_per_language=60)
    assert model.pairs and {(r.lang, r.lang_pred) for r in language.identify(df, model).collect()} == {("en", "en"), ("de", "de")}
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words") for i in range(40)] * 2 + [(None, "vile"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(None, 0), (50, None), (3, 5)], "doc_id long, label int")
    assert sorted((r.y, r.key_) for r in toxicity.draw(labels, rows_per_class=40).collect()) == sorted((i % 2, i) for i in range(40))
    assert toxicity.draw(labels, rows_per_class=5).count() == 10
    fitted = toxicity.fit([(toxicity.features(b"vile words" if i % 2 else b"kind words"), i % 2) for i in range(40)] * 20)
    scores = {r.text: r.score for r in toxicity.score(docs, fitted).collect()}
    assert scores["vile words"] > 0.9 and scores["kind words"] < 0.1 and 0 < scores[None] < 1
    assert toxicity.train(docs, labels, rows_per_class=40) and toxicity.train(docs, labels, sample_bytes=0)[2] == 0


def many_languages(n, each):
    """Rows of ``n`` languages, each with forty words of its own; a tenth has two rows only."""
    rng = np.random.default_rng(5)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(40)] for _ in range(n)]
    return [(f"x{i:03d}", " ".join(rng.choice(words[i], 60))) for i in range(n) for _ in range(2 if i % 10 == 0 else each)]


def test_every_language_is_learned(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(many_languages(420, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.members) == 420 and len(model.bias) == 420
    found = language.identify(df, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.99 * len(found)
    assert {r.lang for r in found if r.lang == r.lang_pred} == {r[2] for r in rows}
    assert min(r.score for r in found) > 0.3


def test_shared_weights_are_the_sums_of_features(monkeypatch):
    rows = many_languages(8, 6)
    for most in (8 << language.BITS, 8 << 11):
        monkeypatch.setattr(language, "MOST_WEIGHTS", most)
        model = language.fit([language.grams(text.encode()) for _, text in rows], [lang for lang, _ in rows])
        assert model.weights.size == most
        assert [x for x, _ in model.predict([text.encode() for _, text in rows])] == [lang for lang, _ in rows]


def test_one_versus_rest_meets_plain_machines():
    rng = np.random.default_rng(2)
    x, names = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)
    x[np.arange(60), names] += 3
    rows = [(np.arange(4), v) for v in x]
    w = language.one_versus_rest(rows, names, 3, 4, cost=1.0, epochs=400)
    for k in range(3):
        plain = language.linear_svm(np.hstack([x, np.ones((60, 1))]), np.where(names == k, 1.0, -1.0), cost=1.0, epochs=400)
        assert np.allclose(w[:, k], plain, atol=2e-2)


def test_models_equal_plain_versions(monkeypatch):
    rng = np.random.default_rng(1)
    examples = [(np.unique(rng.integers(0, 30, 6)), int(rng.integers(0, 2))) for _ in range(60)]
    model = toxicity.Ftrl(30, l1=0.5)
    z, n = [0.0] * 31, [0.0] * 31
    for places, label in examples:
        model.update(places, label)
        w = {}
        for i in [*places.tolist(), 30]:
            l1 = 0.0 if i == 30 else 0.5
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((1.0 + n[i] ** 0.5) / 1.0 + 0.1)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i, x in w.items():
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) * x
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    x = np.vstack([rng.normal(2, 1, (30, 3)), rng.normal(-2, 1, (30, 3))])
    y = np.repeat([1.0, -1.0], 30)
    w = language.linear_svm(x, y, cost=1.0, epochs=200)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in rng.normal(0, 0.05, (200, 3)))
    docs, langs = [b"the cat and the dog", b"der hund und die katze"] * 10, ["en", "de"] * 10
    for t in docs[:2]:
        at, share = language.grams(t)
        low = np.frombuffer(t + b"  ", np.uint8).astype(int).tolist()
        plain = [(x * 0x9E3779B1 % 2**32) >> (32 - language.BITS) for i in range(len(t)) for x in (low[i] | low[i + 1] << 8 | 1 << 24, low[i] | low[i + 1] << 8 | low[i + 2] << 16)]
        assert {a: round(b * len(plain)) for a, b in zip(at.tolist(), share.tolist(), strict=True)} == Counter(plain)
    for size in (1, 5, 100):
        monkeypatch.setattr(language, "PIECE", size)
        assert (language.gram_counts(docs[1]) == np.bincount(plain, minlength=1 << language.BITS)).all()
    assert [x for x, _ in language.fit([language.grams(t) for t in docs], langs).predict(docs[:2])] == ["en", "de"]


def test_pipeline_keeps_clean_and_cuts_the_rest(spark, tmp_path):
    clean = {i: " ".join(f"word{'abcdefghij'[x % 10]}{i * 1000 + x}" for x in range(80)) for i in range(1, 9)}
    passage, item = " ".join(f"shared{x}" for x in range(60)), " ".join(f"item{x}" for x in range(12))
    texts = clean | {9: clean[1] + " tail", 10: f"{clean[8][:200]} other {passage} x1", 11: f"begin {passage} {' '.join(f'own{x}' for x in range(90))}", 12: f"{' '.join(f'mine{x}' for x in range(50))} {item} last", 13: "12 34 !!", 14: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = cut(docs, "t")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    stages = list(seen.values())
    assert set(stages[0]) == set(texts) - {13, 14} and set(stages[1]) == set(stages[0]) - {9}
    assert passage in stages[2][10] and passage not in stages[2][11] and item not in stages[3][12] and stages[3][12].startswith("mine0")
    assert all(stages[3][i] == clean[i] for i in clean)
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(last) == set(stages[3]) and last[1].decoded_sha256 == hashlib.sha256(clean[1].encode()).hexdigest()
