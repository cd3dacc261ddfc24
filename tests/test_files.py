"""Listing, headers, pixels and exports of files that the tests write."""

import csv
import glob
import json
import os
import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cairn.operators import people
from cairn.plans.pictures import exif_block, png
from cairn.schema import TABLES
from cairn.sources import exif, export, files, pixels, walk

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def _tree(root):
    names = ["_DSC1.jpg", "b/_MG_1.png", "_edited/x.jpg", "a.jpg", ".dot.jpg", ".d/y.jpg", "b/c/z.jpg", "b-1.jpg", "B.jpg", "b/a b+c%20[1].jpg"]
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        open(f"{root}/{n}", "wb").write(b"\xff\xd8\xff" + n.encode())
    with open(os.fsencode(str(root)) + b"/bad\xff.jpg", "wb") as f:
        f.write(b"\xff\xd8\xff")
    os.symlink(f"{root}/nowhere.jpg", f"{root}/lost.jpg")
    os.symlink(f"{root}/a.jpg", f"{root}/link.jpg")
    os.symlink(f"{root}/b", f"{root}/linked")


def _walked(root):
    out = []
    for folder, inner, names in os.walk(os.fsencode(str(root))):
        inner[:] = sorted(d for d in inner if not d.startswith(b"."))
        out += [os.path.join(folder, n).decode("utf-8", "backslashreplace") for n in sorted(names) if not n.startswith(b".")]
    return out


def test_listing_finds_every_name_in_order_of_the_walk(spark, tmp_path):
    _tree(tmp_path)
    found = walk.list_files(spark, str(tmp_path)).orderBy("walk").collect()
    assert [r.path.removeprefix("file:") for r in found] == _walked(tmp_path)
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in found if r.problem} == {"bad\\xff.jpg": walk.BAD_NAME, "lost.jpg": walk.LOST}
    gone = walk.list_files(spark, f"{tmp_path}/none")
    assert [r.path for r in walk.walk_errors(gone).collect()] == [f"file:{tmp_path}/none"]
    tables = {n: spark.createDataFrame([], TABLES[n]) for n in ("photos", "locations")}
    stats = files.scan(tables, walk.list_files(spark, str(tmp_path)), 1)["stats"].first()
    assert (stats.images_found, stats.new_photos, stats.updated, stats.errors, stats.bad_names) == (len(found), len(found) - 3, 1, 1, 1)


def test_a_limit_reads_few_files_and_follows_the_walk(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i:03}.jpg").write_bytes(b"\xff\xd8\xff%d" % (i // 2))
    tables = {n: spark.createDataFrame([], TABLES[n]) for n in ("photos", "locations")}
    read = spark.sparkContext.accumulator(0)

    def digest(rows):
        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        kept = rows.mapInArrow(count, rows.schema)
        return files.hash_files(kept)

    found = files.scan(tables, walk.list_files(spark, str(tmp_path)), 1, digest=digest, limit=5)
    assert sorted(r.path[-7:-4] for r in found["locations"].collect()) == [f"{i:03}" for i in range(9)]
    assert read.value <= 64
    every = files.scan(tables, walk.list_files(spark, str(tmp_path)), 1, limit=150)  # a second range is needed
    assert every["photos"].count() == 150 and every["stats"].first().images_found == 299


def test_headers_of_both_orders_cut_and_wrong():
    when = "2011:03:15 08:00:00"
    for order in "<>":
        block = exif_block(when, order)
        assert exif.tiff(block).original == when
        for n in range(len(block)):
            assert exif.tiff(block[:n]).original in (None, when)
        head = {"<": b"II*\0", ">": b"MM\0*"}[order]
        text = b"2020:01:01 00:00:00\0"
        main = struct.pack(f"{order}HHHIIHHIHHHHIIHHII", 4, 0x0132, 2, 20, 62, 0x0112, 3, 1, 6, 0, 0x0100, 9, 7, 0xFFFF, 0x8769, 4, 1, 5)
        found = exif.tiff(head + struct.pack(f"{order}I", 8) + main + text)
        assert found.orientation == 6 and found.original is None and found.width is None  # a wrong type, and a directory that lies in the head
        jpeg = b"\xff\xd8\xff\xe0\x00\x04JF" + b"\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block + b"\xff\xff\xc0\x00\x08\x08\x00\x10\x00\x20\x03"
        assert exif.header(jpeg)[:2] == (when, None) and exif.header(jpeg)[3:] == (32, 16)
        assert exif.header(png(np.zeros((3, 5)), block))[:1] == (when,) and exif.header(png(np.zeros((3, 5))))[3:] == (5, 3)
    assert exif.header(b"") == exif.header(b"\xff\xd8\xff") == exif.header(b"plain") == exif.Header()
    assert exif.shown_size(exif.Header(orientation=6, width=3, height=2)) == (2, 3) and exif.shown_size(exif.Header()) is None
    assert exif.header(b"GIF89a\x03\0\x02\0")[3:] == (3, 2)


def _plain_hash(gray):
    """The same picture and bits, a value at a time."""

    def line(values, want):
        have = len(values)
        if have == want:
            return list(values)
        scale, out = have / want, []
        wide = max(scale, 1.0)
        for i in range(want):
            middle = (i + 0.5) * scale
            low, high = max(0, int(middle - 2 * wide + 0.5)), min(have, int(middle + 2 * wide + 0.5))
            ws = []
            for j in range(low, high):
                x = abs((j - middle + 0.5) / wide)
                ws.append((1.5 * x - 2.5) * x * x + 1 if x < 1 else -0.5 * (((x - 5) * x + 8) * x - 4) if x < 2 else 0.0)
            fixed = [int(w / sum(ws) * 2**22 + (-0.5 if w < 0 else 0.5)) for w in ws]
            out.append(max(0, min(255, (sum(w * int(values[j]) for w, j in zip(fixed, range(low, high), strict=True)) + 2**21) >> 22)))
        return out

    rows = [line(r, 9) for r in gray]
    columns = [line([r[c] for r in rows], 8) for c in range(9)]
    bits = "".join("1" if columns[c][r] > columns[c + 1][r] else "0" for r in range(8) for c in range(8))
    return int(bits, 2) & (2**63 - 1)


def _java_picture(spark, path, pixels_, kind):
    jvm = spark.sparkContext._jvm
    h, w, _ = pixels_.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in pixels_[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(path))
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(path))
    return np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])


def test_hashes_of_pictures_equal_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(6)
    want = {}
    for name, (h, w) in {"a.png": (8, 9), "_b.png": (40, 61), "c [x] d.png": (7, 100), "d.png": (3, 2), "e%20e.png": (9, 9)}.items():
        gray = rng.integers(0, 256, (h, w))
        (tmp_path / name).write_bytes(png(gray))
        want[name] = _plain_hash(gray)
    for name, kind in (("f.jpg", "jpg"), ("_g.png", "png")):
        rgb = _java_picture(spark, f"{tmp_path}/{name}", rng.integers(0, 256, (17, 23, 3)), kind)
        want[name] = _plain_hash((rgb[..., 0] * 19595 + rgb[..., 1] * 38470 + rgb[..., 2] * 7471 + 0x8000) >> 16)
    (tmp_path / "broken.png").write_bytes(png(np.zeros((50, 50)))[:60])
    (tmp_path / "large.png").write_bytes(png(np.zeros((200, 200))))
    listing = exif.with_headers(walk.list_files(spark, str(tmp_path)))
    found = {r.path.rsplit("/", 1)[1]: r.phash for r in pixels.picture_hashes(listing, most_pixels=30_000).collect()}
    assert found == want
    assert pixels.picture_hashes(listing.limit(0)).count() == 0
    assert pixels.difference_hash(np.full((20, 20), 9, dtype=np.uint8)) == 0


def test_scans_and_backfills_take_dates_and_hashes_from_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    for i, when in enumerate(["2011:03:15 08:00:00", "2023:05:01 10:00:00.5", None]):
        (tmp_path / f"_{i}.png").write_bytes(png(rng.integers(0, 256, (12, 14)), exif_block(when, "<>"[i % 2]) if when else None))
        os.utime(tmp_path / f"_{i}.png", (1262304000, 1262304000))
    tables, listing = {n: spark.createDataFrame([], TABLES[n]) for n in ("photos", "locations")}, walk.list_files(spark, str(tmp_path))
    done = files.scan(tables, listing, 1)
    rows = done["photos"].orderBy("id").collect()
    assert [str(r.date_taken) for r in rows] == ["2011-03-15 08:00:00", "2023-05-01 10:00:00", "None"] and all(r.phash for r in rows)
    in_2010 = files.scan(tables, listing, 1, date_from="2010-01-01", date_to="2010-12-31T23:59:59")
    assert in_2010["stats"].first().slice_skipped == 2 and in_2010["photos"].count() == 1
    old = done["photos"].withColumns({"date_taken": F.lit(None).cast("timestamp_ntz"), "phash": F.lit(None).cast("long")})
    dates = files.find_dates(old, done["locations"], listing)
    assert files.date_counts(old, dates).first()[:] == (2, 0, 1) and files.date_counts(old, dates, True).first()[:] == (2, 1, 0)
    filled = files.fill_missing(files.backfill_dates(old, dates, True), files.find_hashes(old, done["locations"], listing), "phash").orderBy("id").collect()
    assert [r.phash for r in filled] == [r.phash for r in rows] and [r.date_taken.year for r in filled] == [2011, 2023, 2010]


def test_exports_are_read_back(spark, tmp_path):
    columns = "id long, sha256 string, status string, has_text boolean, text string, tiled boolean, finished_at timestamp_ntz, deleted_at timestamp_ntz"
    photos = spark.sql("SELECT 2L AS id, 'x' AS sha256, 'done' AS status, CAST(NULL AS BOOLEAN) AS has_text, 'a \"b\", c' AS text, true AS tiled, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS finished_at, CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at UNION ALL SELECT 1L, 'y', 'error', false, NULL, NULL, NULL, NULL UNION ALL SELECT 3L, 'z', 'done', true, NULL, NULL, NULL, TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert [c.split()[0] for c in columns.split(", ")] == photos.columns
    places = spark.createDataFrame([(1, 2, "it's"), (2, 2, "b")], "id long, photo_id long, path string")
    assert export.export_records(photos, places).count() == 1 and export.export_records(photos, places, None).count() == 2
    records = export.export_records(photos, places, "all")
    export.write_jsonl(records, f"{tmp_path}/j")
    export.write_csv(records, f"{tmp_path}/c")
    objects = [json.loads(line) for f in sorted(glob.glob(f"{tmp_path}/j/part-*")) for line in open(f)]
    assert [list(o) for o in objects] == [list(export.FIELDS)] * 2 and [o["id"] for o in objects] == [1, 2]
    assert objects[1]["paths"] == ["it's", "b"] and objects[1]["finished_at"] == "2024-01-02T03:04:05" and objects[1]["has_text"] is None and objects[0]["paths"] == [] and objects[0]["tiled"] is False
    rows = [r for f in sorted(glob.glob(f"{tmp_path}/c/part-*")) for r in csv.DictReader(open(f, newline=""))]
    assert [r["id"] for r in rows] == ["1", "2"] and rows[1]["paths"] == str(["it's", "b"]) and rows[1]["text"] == 'a "b", c' and (rows[1]["tiled"], rows[1]["has_text"], rows[0]["has_text"]) == ("True", "", "False")
    groups = spark.createDataFrame([(1, 1), (1, 2)], "cluster long, id long")
    made = export.duplicates_json(groups, photos.withColumns({"byte_size": F.lit(5), "date_taken": F.col("finished_at")}), places).first().members
    assert json.loads(made) == [{"id": 1, "path": None, "byte_size": 5, "date_taken": None}, {"id": 2, "path": "it's", "byte_size": 5, "date_taken": "2024-01-02T03:04:05"}]


class _Nobody:
    """A model that sees no one."""

    def match(self, *_):
        return '{"matches": []}'


def test_photos_that_nobody_measured_stay_candidates(spark):
    photos = spark.sql("SELECT id, 'done' AS status, false AS hidden, CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at FROM range(1, 4)")
    who = spark.createDataFrame([(1, "Ann", "tall")], "id long, name string, description string")
    tags = spark.createDataFrame([], TABLES["person_tags"])
    faces = spark.createDataFrame([(1, 0)], "id long, n int")
    images = spark.createDataFrame([], "photo_id long, images array<binary>")
    after = people.match_people(photos, who, tags, faces, images, _Nobody(), "2024-01-01T00:00:00")
    assert [(r.photo_id, r.present) for r in after.collect()] == [(1, False)]
    assert sorted(r.id for r in people.people_candidates(photos, who, after).collect()) == [2, 3]


@pytest.mark.parametrize("path,place", [("/a b/c", "/a b/c"), ("file:/a/%20", "/a/%20"), ("file:///a", "/a"), ("/x:y/z", "/x:y/z")])
def test_names_need_no_quoting(path, place):
    assert walk.store_of(path)[1] == place
