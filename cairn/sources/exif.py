"""Capture times, sizes and orientation of pictures from the first bytes of their files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.sources.walk import store_of

#: Bytes of a file that are read for its header.
HEAD = 1 << 18
#: Tags of a picture directory.
ORIENTATION, CHANGED, DETAILS, ORIGINAL, WIDTH, HEIGHT = 0x0112, 0x0132, 0x8769, 0x9003, 0x0100, 0x0101
#: Bytes a value, by its type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
COLUMNS = "original string, changed string, orientation int, width int, height int"


class Header(NamedTuple):
    original: str | None = None
    changed: str | None = None
    orientation: int | None = None
    width: int | None = None
    height: int | None = None


def _directory(data: bytes, at: int, order: str) -> dict[int, int | str]:
    """Short, long and text values of a directory; entries that lead out of the data, or are of other types, are left out."""
    if at < 8 or at + 2 > len(data):
        return {}
    found: dict[int, int | str] = {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        size = _SIZES.get(kind, 0) * count
        start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        if not size or start + size > len(data):
            continue
        if kind == 2:
            found.setdefault(tag, data[start : start + size].split(b"\0")[0].decode("latin-1"))
        elif kind in (3, 4):
            found.setdefault(tag, struct.unpack_from(order + ("H" if kind == 3 else "I"), data, start)[0])
    return found


def tiff(data: bytes) -> Header:
    """What a TIFF file, or a block of Exif data, says of its picture; nothing if it is cut or wrong."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        return Header()
    main = _directory(data, struct.unpack_from(f"{order}I", data, 4)[0], order)
    inner = main.get(DETAILS)
    more = _directory(data, inner, order) if isinstance(inner, int) else {}
    text = lambda v: v if isinstance(v, str) and v else None
    number = lambda v: v if isinstance(v, int) else None
    return Header(text(more.get(ORIGINAL)), text(main.get(CHANGED)), number(main.get(ORIENTATION)), number(main.get(WIDTH)), number(main.get(HEIGHT)))


def _jpeg(data: bytes) -> Header:
    found, at = Header(), 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
        if mark == 0xFF:  # a filling byte
            at += 1
            continue
        if mark in (0xD9, 0xDA):
            break
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0" and found.original is found.changed is found.orientation is None:
            found = tiff(body[6:])._replace(width=found.width, height=found.height)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            found = found._replace(height=int.from_bytes(body[1:3]), width=int.from_bytes(body[3:5]))
        at += 2 + size
    return found


def _png(data: bytes) -> Header:
    found, at = Header(), 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) >= 8:
            found = found._replace(width=int.from_bytes(body[:4]), height=int.from_bytes(body[4:8]))
        elif kind == b"eXIf":
            found = tiff(body)._replace(width=found.width, height=found.height)
        at += 12 + size
    return found


def header(data: bytes) -> Header:
    """Of JPEG, PNG, TIFF, GIF and BMP data, which may end anywhere; of all else nothing is known."""
    if data[:3] == b"\xff\xd8\xff":
        return _jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:4] in (b"GIF8",) and len(data) >= 10:
        return Header(width=int.from_bytes(data[6:8], "little"), height=int.from_bytes(data[8:10], "little"))
    if data[:2] == b"BM" and len(data) >= 26:
        return Header(width=int.from_bytes(data[18:22], "little"), height=abs(int.from_bytes(data[22:26], "little", signed=True)))
    return tiff(data)


def shown_size(found: Header) -> tuple[int, int] | None:
    """Width and height as the picture is shown."""
    if not found.width or not found.height:
        return None
    return (found.height, found.width) if found.orientation in (5, 6, 7, 8) else (found.width, found.height)


def read_header(path: str) -> Header:
    """From the first bytes of a file; nothing if it can't be read."""
    try:
        store, place = store_of(path)
        with store.open_input_stream(place) as stream:
            return header(stream.read(HEAD))
    except OSError:
        return Header()


def with_headers(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``original, changed, orientation, width, height``, nulls where the file does not say; only heads are read."""
    columns = [c for c in files.columns if c not in Header._fields]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_header(p) for p in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            added = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *Header._fields])

    kept = files.select(*columns)
    return kept.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), COLUMNS]))
