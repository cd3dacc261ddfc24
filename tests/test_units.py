import sys
from math import comb

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cairn.functions import normalize as N
from cairn.operators import browse, cluster, extract, filters, joins, transitions
from cairn.operators.cluster import bands_for, hamming_pairs
from cairn.operators.components import connected_components
from cairn.operators.filters import parse_slice_date
from cairn.plans.match import QuerySyntaxError, parse, parse_or_phrase
from cairn.plans.stub_model import StubModel
from cairn.schema import TABLES, migrate, migrate_tables, pending
from cairn.sources import export, files, library
from cairn.streaming import queue, run
from cairn.streaming.queue import drain
from cairn.workspace import diagnose, let_go, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def test_components_chain_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 120)} == {100} and found[201] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hubs_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(200, 230)] + [(230, 59), (300, 301)]
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert found == {n: 300 if n > 299 else 0 for n in {x for e in edges for x in e}}


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    context = SimpleNamespace(master="yarn", getConf=lambda: {})
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_letting_go_needs_no_command(spark):
    assert "version" in diagnose(spark, "vmVersion")
    assert diagnose(spark, "noSuchCommand") is None
    let_go(spark)
    assert spark.range(3).count() == 3


@pytest.mark.parametrize("query", ["", "AND", "a NOT", "OR OR", '"x', ".", "zz:q", "foo-bar", "a AND"])
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_fallback_is_one_phrase():
    tree, effective = parse_or_phrase("foo-bar")
    assert tree.words == ("foo", "bar") and effective == '"foo-bar"'


def test_hamming_is_exact(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(60)]
    values = sorted({*base, *[b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]})
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    rows = spark.createDataFrame([(v,) for v in [*values, None, values[0]]], "phash long")
    found = [(r.a, r.b) for r in hamming_pairs(rows, 4).collect()]
    assert set(found) == want and len(found) == len(want)
    for distance, share in ((8, 0.05), (16, 0.3)):  # of all pairs of random values, how many meet
        bands = bands_for(distance, 15_000)
        keys = sum(comb(round(63 / bands), k) for k in range(distance // bands + 1))
        assert bands * keys / 2 ** (63 / bands) < share


def _near(values, distance):
    found = ((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in values for b in values if a < b)
    return {pair for pair in found if pair[2] <= distance}


def test_blocks_find_the_pairs_that_bands_find(spark, monkeypatch):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(64) - 2**63 for _ in range(40)]  # with the sign bit
    values = sorted({*base, *[b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(20))) for b in base * 5]})
    want = _near(values, 16)
    rows = spark.createDataFrame([(v,) for v in [*values, None, values[0]]], "phash long")
    for least, strip, batch in ((8_192, 16_384, 65_536), (30, 7, 5), (1, 16_384, 1)):
        for name, value in (("LEAST_BLOCK", least), ("STRIP", strip), ("BATCH", batch)):
            monkeypatch.setattr(cluster, name, value)
        found = [tuple(r) for r in hamming_pairs(rows, 16).collect()]
        assert set(found) == want and len(found) == len(want)
    assert not hamming_pairs(spark.createDataFrame([(None,)], "phash long"), 16).collect()
    monkeypatch.setattr(cluster, "A_ROW", 1e-9)
    assert cluster.selective(16, len(values)) and {tuple(r) for r in hamming_pairs(rows, 16).collect()} == want


def test_a_distance_that_is_not_selective_joins_no_bands(spark):
    import random

    rng = random.Random(7)
    values = [rng.getrandbits(63) for _ in range(2000)]
    found = hamming_pairs(spark.createDataFrame([(v,) for v in values], "phash long"), 16)
    assert {tuple(r) for r in found.collect()} == _near(values, 16)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert not cluster.selective(16, 10_000_000) and cluster.selective(2, 10_000_000)


@pytest.mark.parametrize("block", [8_192, 150])
def test_clusters_move_no_pairs_of_a_group(spark, monkeypatch, block):
    import random

    rng, linked = random.Random(8), []
    group = [5 << 40 | k for k in range(600)]  # all within 10 bits of each other
    chain = [7 << 50 | (1 << 16 * k) - 1 for k in range(1, 4)]
    values = group + chain + [rng.getrandbits(63) for _ in range(300)]
    want = {v: v for v in values}
    for a, b, _ in sorted(_near(values, 16)):
        old, new = sorted((want[a], want[b]), reverse=True)
        want = {v: new if c == old else c for v, c in want.items()}
    monkeypatch.setattr(cluster, "LEAST_BLOCK", block)
    monkeypatch.setattr(cluster, "connected_components", lambda edges, *ends: linked.append(edges.count()) or connected_components(edges, *ends))
    rng.shuffle(values)
    photos = spark.createDataFrame([(i, v, None) for i, v in enumerate([*values, *values[:50], None])], "id long, phash long, deleted_at timestamp")
    found = {r.id: (r.cluster, r.size) for r in cluster.clusters(photos, 16).collect()}
    groups = {}
    for i, v in enumerate([*values, *values[:50]]):
        groups.setdefault(want[v], []).append(i)
    assert found == {i: (g[0], len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert linked[0] <= len(values) * -(-len(values) // block)  # of pairs there are 180,000


def test_duplicates_keep_the_largest_in_one_pass_over_clusters(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(cluster, "cut", lambda df, tag, keep=cluster.cut: tables.append(tag) or keep(df, tag))
    rows = [(1, 5, 10, False, None), (2, 7, 30, False, None), (3, 5, 30, False, None), (4, 5, None, False, None), (5, 5, 99, True, None), (6, 1 << 40, 1, False, None), (7, 1 << 40, None, False, None)]
    rows += [(8, (1 << 63) - 1, 4, False, None), (9, None, 4, False, None)]
    photos = spark.createDataFrame(rows, "id long, phash long, byte_size long, derivative boolean, deleted_at timestamp")
    found = sorted(tuple(r) for r in cluster.duplicates(photos, 1).select("cluster", "id", "size", "keep").collect())
    assert found == [(1, 1, 4, False), (1, 2, 4, True), (1, 3, 4, False), (1, 4, 4, False), (6, 6, 2, True), (6, 7, 2, False)]
    assert "sized" not in tables


def test_groups_compute_their_clusters_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([(i, i % 2, 20) for i in range(40)], "id long, cluster long, size long").mapInArrow(counted, "id long, cluster long, size long")
    photos = spark.createDataFrame([(i, i % 7, f"t{i}" if i > 3 else "") for i in range(40)], "id long, byte_size long, text string")
    rows = {r.cluster: (r.size, r.largest, r.sample, r.members) for r in cluster.groups(found, photos).collect()}
    assert rows == {0: (20, 6, "t4", list(range(0, 24, 2))), 1: (20, 13, "t5", list(range(1, 25, 2)))}
    assert calls.value == 40


def test_durations_and_boxes(spark):
    rows = spark.createDataFrame([("45",), ("90m",), ("1h30m",), ("2d",), ("nope",), ("0",), (None,)], "x string")
    assert [r[0] for r in rows.select(N.parse_duration(F.col("x"))).collect()] == [45.0, 5400.0, 5400.0, 172800.0, None, None, None]
    boxes = spark.createDataFrame([("1, 2,3,4",), ("",), (None,), ("1,2,0,4",), ("a,b,c,d",), ("1,2,3",)], "x string")
    assert [r[0] is not None for r in boxes.select(N.parse_box(F.col("x"))).collect()] == [True, False, False, False, False, False]


def test_slice_dates_are_leap_aware():
    assert parse_slice_date("2024-02", end=True).isoformat() == "2024-02-29T23:59:59.999999"
    assert parse_slice_date("2013", end=False).isoformat() == "2013-01-01T00:00:00"


def test_migrations_add_columns_once(spark):
    old = spark.createDataFrame([(1, "x")], "id long, sha256 string")
    new, version = migrate(old, 0)
    again, _ = migrate(new, version)
    assert version == 14 and pending(14) == [] and {"phash", "hidden", "vision_text"} <= set(new.columns) and again.columns == new.columns


def test_backups_and_asset_spelling(spark, tmp_path):
    name = "ABCDEFAB-0000-0000-0000-000000000001"
    tables = {
        "photos": spark.createDataFrame([(1, "x")], "id long, sha256 string"),
        "photo_assets": spark.createDataFrame([(1, name.lower(), 1), (1, "other", 1)], TABLES["photo_assets"]),
        "locations": spark.createDataFrame([(1, 1, 1, f"/a/{name}.jpg", 0, 0)], TABLES["locations"]),
    }
    export.backup(tables, str(tmp_path), 13)
    old = export.restore(spark, str(tmp_path), list(tables), 13)
    new, version = migrate_tables(old, 13)
    assert version == 14 and {r.uuid for r in new["photo_assets"].collect()} == {name, "other"}
    assert {r.uuid for r in migrate_tables(old, 14)[0]["photo_assets"].collect()} == {name.lower(), "other"}


def test_scan_reads_only_what_is_new(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.jpg").write_bytes(b"\xff\xd8\xffone")
    (tmp_path / "two.png").write_bytes(b"\xff\xd8\xffone")
    (tmp_path / "noext").write_bytes(b"\x89PNGother")
    (tmp_path / "movie.mov").write_bytes(b"mov")
    (tmp_path / ".hidden.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "text").write_bytes(b"plain")
    (tmp_path / "zero.jpg").write_bytes(b"")
    tables = {n: spark.createDataFrame([], TABLES[n]) for n in ("photos", "locations")}
    listing = files.list_files(spark, str(tmp_path)).cache()
    assert files.hash_files(listing).where(files.is_image(F.col("path"), F.col("head"))).count() == 4
    once = files.scan(tables, listing, 1)
    assert once["photos"].count() == 2 and once["locations"].count() == 3 and once["stats"].first()[:5] == (4, 2, 1, 0, 0)
    again = files.scan_all(once, {1: listing, 2: listing})
    assert again["photos"].count() == 2 and again["locations"].count() == 6 and again["stats"].first()[:5] == (8, 0, 3, 3, 0)
    assert files.scan(tables, listing, 1, limit=1)["locations"].count() in (1, 2)
    lost = spark.createDataFrame([(f"{tmp_path}/gone.jpg", 1, 5)], "path string, mtime long, size long")
    assert files.scan(tables, lost, 1)["stats"].first()[:5] == (1, 0, 0, 0, 1)


def test_sources_and_libraries(spark, tmp_path):
    (tmp_path / "x.photoslibrary/Masters").mkdir(parents=True)
    (tmp_path / "bare.photolibrary").mkdir()
    assert files.resolve_source(spark, f"{tmp_path}/x.photoslibrary/") == (f"{tmp_path}/x.photoslibrary/Masters", "library") and files.resolve_source(spark, str(tmp_path))[1] == "folder"
    for wrong, error in ((f"{tmp_path}/none", FileNotFoundError), (f"{tmp_path}/bare.photolibrary", ValueError)):
        with pytest.raises(error):
            files.resolve_source(spark, wrong)
    (tmp_path / "assets.json").write_text('[["A", "/a.jpg", true], ["B", null, false]]')
    assert [tuple(r) for r in library.read_assets(spark, f"{tmp_path}/assets.json").collect()] == [("A", "/a.jpg", True), ("B", None, False)]
    with pytest.raises(ValueError):
        library.pick(spark.range(1), "nothing")
    with pytest.raises(ValueError):
        transitions.rename_person(spark.range(1), 1, " ", "2024-01-01")
    with pytest.raises(ValueError):
        filters.bulk(None)


def _queued(spark, n):
    photos = spark.createDataFrame([(i, "queued", 0, "old", None) for i in range(1, n + 1)], "id long, status string, attempts int, raw_response string, error string")
    images = spark.createDataFrame([(i, str(i).encode()) for i in range(1, n + 1)], "id long, image binary")
    return photos.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("deleted_at", "started_at", "finished_at")}).coalesce(1), images.coalesce(1)


class _Counting(StubModel):
    """Writes down every call; fails as it is told, by id."""

    def __init__(self, folder, fails):
        super().__init__()
        object.__setattr__(self, "folder", str(folder))
        object.__setattr__(self, "fails", fails)

    def extract(self, image, temperature):
        with open(f"{self.folder}/calls", "ab") as f:
            f.write(image + b"\n")
        if image.decode() in self.fails:
            raise self.fails[image.decode()]
        return '{"has_text": true, "text": "t"}'


def _calls(folder):
    return (folder / "calls").read_text().split() if (folder / "calls").exists() else []


def test_a_lost_model_keeps_what_it_answered(spark, tmp_path):
    photos, images = _queued(spark, 6)
    policy = extract.Policy(backoff_seconds=0.0, transport_retries=1)
    model = _Counting(tmp_path, {"4": extract.Unreachable("no service")})
    after, found = extract.process(photos, images, model, "2024-01-01", policy)
    states = {r.id: (r.status, r.attempts) for r in after.collect()}
    done = [i for i, s in states.items() if s[0] == "done"]
    asked = _calls(tmp_path)
    assert asked.count("4") == 2 and sorted(map(int, set(asked) - {"4"})) == sorted(done) and len(asked) == len(done) + 2  # nothing is asked after it is lost
    assert {s for i, s in states.items() if i not in done} == {("queued", 0)} and {r.error for r in found.where("outcome = 'requeue'").collect()} == {"Unreachable: no service"}
    missing, found = extract.process(photos, images.limit(0), StubModel(), "2024-01-01", policy)
    assert {(r.status, r.attempts, r.raw_response) for r in missing.collect()} == {("error", 1, "old")} and found.count() == 6


def test_timeouts_and_server_errors_are_errors_of_a_photo(spark, tmp_path):
    photos, images = _queued(spark, 4)
    model = _Counting(tmp_path, {"2": TimeoutError("slow"), "3": extract.ServerError("503")})
    after, _ = extract.process(photos, images, model, "2024-01-01", extract.Policy(backoff_seconds=0.0, max_attempts=2))
    assert {r.id: (r.status, r.attempts, r.error) for r in after.collect() if r.id in (2, 3)} == {2: ("error", 1, "TimeoutError: slow"), 3: ("error", 1, "ServerError: 503")}
    assert {r.status for r in after.collect() if r.id in (1, 4)} == {"done"} and _calls(tmp_path).count("2") == 2


def test_a_log_outlives_a_broken_pass(spark, tmp_path):
    photos, images = _queued(spark, 5)
    policy, log = extract.Policy(backoff_seconds=0.0), f"file:{tmp_path}/log"
    with pytest.raises(Exception, match="burnt"):
        extract.process(photos, images, _Counting(tmp_path, {"3": RuntimeError("burnt")}), "2024-01-01", policy, log=log)
    before = _calls(tmp_path)
    kept = [i for i in set(before) if extract.Log(log).get(int(i), 0)]
    assert "3" not in kept and all(before.count(i) == 1 for i in kept) and len(kept) == len(set(before)) - 1
    after, _ = extract.process(photos, images, _Counting(tmp_path, {}), "2024-01-01", policy, log=log)
    assert {r.status for r in after.collect()} == {"done"}
    later = _calls(tmp_path)[len(before) :]
    assert sorted(later + kept) == ["1", "2", "3", "4", "5"]  # nothing is paid for twice
    extract.Log(log).forget()
    assert extract.Log(log).get(1, 0) is None


def test_stops_and_deadlines_begin_nothing(spark, tmp_path):
    photos, images = _queued(spark, 3)
    (tmp_path / "stop").write_text("")
    for policy, why in ((extract.Policy(stop_file=f"{tmp_path}/stop"), "stopped"), (extract.Policy(deadline=1.0), "time budget reached")):
        after, found = extract.process(photos, images, _Counting(tmp_path, {}), "2024-01-01", policy)
        assert {r.status for r in after.collect()} == {"queued"} and {(r.outcome, r.error) for r in found.collect()} == {("requeue", why)}
    assert not _calls(tmp_path)

    class Down(StubModel):
        def preflight(self):
            return ["not installed"]

    with pytest.raises(extract.NotReady, match="not installed"):
        run.run_once({"photos": photos}, {}, lambda t: images, Down(), "2024-01-01")


def test_stream_equals_batch(spark, tmp_path, monkeypatch):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(seconds=i % 7), i % 3, ["view", "click", "purchase", "odd", None][i % 5]) for i in range(30)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    found = {r.photo_id: (r.event_id, r.n) for r in drain(spark, str(tmp_path / "log"), log.schema, str(tmp_path / "state")).collect()}
    assert found == {r.photo_id: (r.event_id, r.n) for r in drain(spark, str(tmp_path / "log"), log.schema, str(tmp_path / "state")).collect()}
    log.limit(0).write.mode("append").parquet(str(tmp_path / "log"))
    monkeypatch.setattr(queue, "MOST_DELTAS", 0)
    spark.createDataFrame([(99, day, 7, "view")], log.schema).write.mode("append").parquet(str(tmp_path / "log"))
    later = {r.photo_id: (r.event_id, r.n) for r in drain(spark, str(tmp_path / "log"), log.schema, str(tmp_path / "state")).collect()}
    assert later == found | {7: (99, 1)} and len(queue._numbers(spark, f"{tmp_path}/state/folded")) == 1 and not queue._numbers(spark, f"{tmp_path}/state/delta")
    known = [r for r in rows if r[3] in ("view", "click", "purchase")]
    assert found == {u: (max((r[1], r[0]) for r in known if r[2] == u)[1], sum(r[2] == u for r in known)) for u in range(3)}


def test_arrivals_with_and_without_a_deferred_row(spark):
    rows = [(1, "deferred:a", "deferred"), (2, "deferred:b", "deferred"), (3, "known", "done"), (4, "alone", "done"), (5, "deferred:c", "deferred"), (6, "other", "error"), (7, "deferred:d", "deferred")]
    photos = spark.createDataFrame([(*r, 1, 3, "e", True, True) for r in rows], "id long, sha256 string, status string, byte_size long, attempts int, error string, derivative boolean, offloaded boolean")
    photos = photos.withColumns({"finished_at": F.lit("2024-01-01").cast("timestamp_ntz"), "hidden": F.lit(False)})
    locations = spark.createDataFrame([(10, 2, 1, "old", 0, 0), (11, 6, 1, "p3", 0, 0)], TABLES["locations"])
    assets = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 5)], TABLES["photo_assets"])
    came = [("a", "new", "p1"), ("b", "known", "p2"), ("x", "alone", "p3"), ("y", "fresh", "p4"), ("c", "new", "p5"), ("z", "fresh", "p6")]
    arrived = spark.createDataFrame([(u, h, 7, 1, p, 9) for u, h, p in came], "uuid string, sha256 string, byte_size long, source_id long, path string, mtime long")
    out = transitions.promote_arrivals({"photos": photos, "locations": locations, "photo_assets": assets}, arrived)
    found = {r.id: (r.sha256, r.status, r.byte_size, r.attempts, r.error, r.derivative, r.offloaded, r.finished_at is None) for r in out["photos"].collect()}
    queued = ("queued", 7, 0, None, False, False, True)
    assert found == {
        1: ("new", *queued), 3: ("known", "done", 1, 3, "e", True, False, False), 4: ("alone", "done", 1, 3, "e", True, False, False),
        6: ("other", "error", 1, 3, "e", True, True, False), 7: ("deferred:d", "deferred", 1, 3, "e", True, True, False), 8: ("fresh", *queued),
    }
    assert sorted(tuple(r) for r in out["locations"].collect()) == [(11, 4, 1, "p3", 9, 7), *[(12 + i, o, 1, p, 9, 7) for i, (p, o) in enumerate([("p1", 1), ("p2", 3), ("p4", 8), ("p5", 1), ("p6", 8)])]]
    assert {r.uuid: r.photo_id for r in out["photo_assets"].collect()} == {"A": 1, "B": 3, "C": 1}
    assert {r.status for r in transitions.promote_deferred(photos, arrived, requeue=False).where("id = 1").collect()} == {"done"}


def test_all_cases_of_arrivals_equal_sql(spark, sf, oracle, same):
    from cairn.plans.queries import QUERIES, SQL

    found = QUERIES["promote_deferred_all"](spark, sf)
    same(found, oracle.sql(SQL["promote_deferred_all"]))
    assert found.where("sha256 like 'fresh%'").count() and found.where("sha256 like 'c%' and not offloaded").count()


def test_candidates_lack_some_person_and_orphans_every_place(spark):
    photos = spark.createDataFrame([(i, "deferred" if i == 6 else "done", i == 5) for i in range(1, 7)], "id long, status string, hidden boolean").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    people = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    tags = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 0), (2, 2), (3, 0), (3, 9), (3, 8)], "photo_id long, person_id long")
    assert {r.id for r in browse.people_candidates(photos, people, tags).collect()} == {2, 3, 4}
    places = spark.createDataFrame([(i, i % 4 + 1) for i in range(1, 8)], "id long, photo_id long")
    assert {r.id for r in browse.orphans(photos, places).collect()} == {5, 6}


def test_category_is_that_of_the_whole_text(spark, tmp_path):
    from cairn.plans.queries import QUERIES

    spark.createDataFrame([(1, f"{' ' * 70}\n{'Blue ' * 20}"), (2, f"One{' ' * 60}Two")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'src1' as source", "9L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0], 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert dict(QUERIES["normalize_category"](spark, str(tmp_path)).select("id", "category").collect()) == {1: ("blue " * 8).strip(), 2: "one two"}


def test_all_matches_come_without_a_cap(spark, sf):
    from cairn.plans.queries import QUERIES, SQL

    for name in ("fts_term", "fts_near"):
        assert not any(x in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString() for x in ("Limit", "Sort ")), name
    assert "Limit" in QUERIES["fts_topk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_keep_the_largest_with_nulls_and_ties(spark):
    rows = [(1, 0, 5), (2, 1, 9), (3, 3, 9), (4, 0xFFFFF << 20, None), (5, 0xFFFFF << 20, None), (6, (1 << 62) - 1, 7)]
    photos = spark.createDataFrame(rows, "id long, phash long, byte_size long").withColumns({"derivative": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    found = {(r.cluster, r.id, r.size): r.keep for r in cluster.duplicates(photos, 2).collect()}
    assert found == {(1, 1, 3): False, (1, 2, 3): True, (1, 3, 3): False, (4, 4, 2): True, (4, 5, 2): False}
    assert cluster.duplicates(photos.limit(0)).count() == 0


def test_albums_refer_to_versions_either_way_without_a_nested_loop(spark):
    tables = {
        "versions": spark.createDataFrame([("A", 1, "m1", True), ("B", 2, "m2", True), (None, 3, "m3", None)], "uuid string, modelId long, masterUuid string, isFavorite boolean"),
        "masters": spark.createDataFrame([("m1", "one.jpg"), ("m2", "/abs/two.jpg"), ("m3", "three.jpg")], "uuid string, imagePath string").withColumn("modelId", F.lit(None).cast("long")),
        "albums": spark.createDataFrame([("a1", 7, "Trip")], "uuid string, modelId long, name string"),
        "members": spark.createDataFrame([(7, 1), (7, 3)], "albumId long, versionId long"),
    }
    found = library.library_paths(tables, "/lib", album="trip")
    assert sorted(r.path for r in found.collect()) == ["/lib/one.jpg", "/lib/three.jpg"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
