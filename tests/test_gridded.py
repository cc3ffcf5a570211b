"""GRIB files that the test writes decode to what went in; pruned messages are not read."""

from __future__ import annotations

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.functions import grib
from windrose.sources import gridded

RUN = dt.datetime(2024, 5, 1, 6)


def signed(n, size):
    return (abs(n) | (1 << (8 * size - 1) if n < 0 else 0)).to_bytes(size, "big")


def section(number, body):
    return struct.pack(">IB", len(body) + 5, number) + body


def packed(values, bits=12, decimal=1):
    """Sections 5 to 7 for values, NaN being outside the bitmap."""
    known = ~np.isnan(values)
    scaled = values[known] * 10.0**decimal
    low = float(np.float32(scaled.min())) if scaled.size else 0.0
    spread = scaled.max() - low if scaled.size else 0
    binary = math.ceil(math.log2(max(spread, 1e-9) / (2**bits - 1))) if bits else 0
    whole = np.round((scaled - low) / 2.0**binary).astype(np.int64)
    rows = (whole[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    data = np.packbits(rows.astype(np.uint8).ravel()).tobytes()
    body = struct.pack(">IHf", int(known.sum()), 0, low) + signed(binary, 2) + signed(decimal, 2) + bytes([bits, 0])
    bitmap = b"\xff" if known.all() else b"\x00" + np.packbits(known.ravel().astype(np.uint8)).tobytes()
    return section(5, body) + section(6, bitmap) + section(7, data)


def lattice(rows, cols, south_first=False):
    body = bytes([0]) + struct.pack(">I", rows * cols) + bytes([0, 0]) + struct.pack(">H", 0) + bytes([6]) + bytes(15) + struct.pack(">II", cols, rows) + bytes(8)
    first = 40_000_000 - (0 if not south_first else 500_000 * (rows - 1))
    return section(3, body + signed(first, 4) + signed(-170_500_000, 4) + b"\x30" + bytes(8) + struct.pack(">II", 500_000, 500_000) + bytes([0x40 if south_first else 0]))


def item(category, number, hour, height=10, surface=103, unit=1):
    body = bytes(2) + struct.pack(">H", 0) + bytes([category, number, 2, 0, 0]) + bytes(3) + bytes([unit]) + struct.pack(">I", hour) + bytes([surface, 0]) + struct.pack(">i", height) + b"\xff" * 6
    return section(4, body)


def message(*parts):
    head = section(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, RUN.year, RUN.month, RUN.day, RUN.hour, 0, 0, 0, 1))
    body = head + b"".join(parts) + b"7777"
    return b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", 16 + len(body)) + body


def wave(k, holes=False):
    values = np.add.outer(np.arange(5) * 1.5 + k, np.arange(7) * -0.3)
    if holes:
        values[1, 2:4] = np.nan
    return values


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("grib")
    messages = [message(lattice(5, 7), item(2, n, h), packed(wave(10 * n + h, h == 2))) for n in (2, 3) for h in (1, 2)]
    offsets = np.cumsum([0, *map(len, messages)])
    (top / "a.grib2").write_bytes(b"".join(messages))
    names = [("UGRD", 1), ("UGRD", 2), ("VGRD", 1), ("VGRD", 2)]
    (top / "a.grib2.idx").write_text("".join(f"{i + 1}:{o}:d=2024050106:{n}:10 m above ground:{h} hour fcst:\n" for i, (o, (n, h)) in enumerate(zip(offsets, names))))
    # two fields in one message, rows from the south, minutes, a constant field, and bytes between messages
    both = message(lattice(5, 7, True), item(2, 22, 90, 0, 1, 0), packed(wave(3)), item(0, 0, 120, 2, 103, 0), packed(np.full((5, 7), 4.5), 0))
    (top / "b.grb2").write_bytes(b"header" + both + b"tail")
    (top / "note.txt").write_text("not read")
    return str(top)


@pytest.fixture(scope="module")
def source(spark):
    gridded.register(spark)
    return lambda path: spark.read.format("gridded").load(path)


def test_fields_come_back(source, folder):
    rows = source(folder).collect()
    assert len(rows) == 6 * 35 and {r.run for r in rows} == {RUN}
    by = {(r.variable, r.level, r.hour): {} for r in rows}
    for r in rows:
        by[r.variable, r.level, r.hour][r.row, r.col] = r
    for n, name in ((2, "UGRD"), (3, "VGRD")):
        for h in (1, 2):
            want = wave(10 * n + h, h == 2)
            for (i, j), r in by[name, "10 m above ground", float(h)].items():
                assert (r.value is None) == bool(np.isnan(want[i, j])) and (r.value is None or abs(r.value - want[i, j]) < 0.05)
                assert abs(r.lat - (40 - 0.5 * i)) < 1e-9 and abs(r.lon - (-170.5 + 0.5 * j)) < 1e-9
    gust = by["GUST", "surface", 1.5]
    assert abs(gust[0, 0].lat - 38.0) < 1e-9 and abs(gust[4, 6].value - wave(3)[4, 6]) < 0.05
    assert {r.value for r in by["TMP", "2 m above ground", 2.0].values()} == {4.5}


def test_pruned_messages_are_not_read(source, folder, tmp_path):
    import shutil

    broken = f"{tmp_path}/c"
    shutil.copytree(folder, broken)
    with open(f"{broken}/a.grib2", "r+b") as file:  # the first message can no longer be decoded
        file.seek(4)
        file.write(b"\xff" * 40)
    wanted = source(broken).where("variable = 'VGRD' and hour in (2, 9)").select("row", "col", "value")
    assert wanted.count() == 35 and wanted.where("value is null").count() == 2
    with pytest.raises(Exception, match="a.grib2"):
        source(broken).where("variable = 'UGRD' and hour = 1").count()
    reader = gridded.Reader(folder)
    reader.wanted = {"variable": {"VGRD"}, "hour": {2.0}}
    assert len(reader.partitions()) == 2  # one message of the file with an inventory, the whole of the other


def test_wind_of_two_fields(source, folder):
    both = source(folder).where(F.col("variable").isin("UGRD", "VGRD")).groupBy("hour", "row", "col").pivot("variable", ["UGRD", "VGRD"]).agg(F.first("value"))
    assert both.where("UGRD is not null and VGRD is not null").count() == 68


def test_odd_files(source, tmp_path):
    assert source(str(tmp_path)).count() == 0
    whole = message(lattice(2, 2), item(2, 2, 1), packed(np.ones((2, 2))))
    for cut, fault in ((whole[:-9], "no whole message"), (whole.replace(struct.pack(">IHf", 4, 0, 10.0), struct.pack(">IHf", 4, 3, 10.0)), "simple packing")):
        with pytest.raises(ValueError, match=fault):
            [f.values() for f in grib.fields(cut)]
    assert list(grib.fields(b"nothing here")) == []


def test_inventory_lines():
    text = "1:0:d=2024:TMP:2 m above ground:anl:\n2:9:d=2024:GUST:surface:15 min fcst:\n3:20:d=2024:APCP:surface:0-1 hour acc fcst:\n4:30:d=2024:X:y:odd:\nbroken\n"
    assert gridded.inventory(text) == [(0, "TMP", "2 m above ground", 0.0), (9, "GUST", "surface", 0.25), (20, "APCP", "surface", 1.0), (30, "X", "y", None)]
