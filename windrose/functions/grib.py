"""Decoding of GRIB edition 2 messages with simple packing: what a message holds, and its values as arrays."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Short names of (discipline, category, number), seconds of the units of forecast time, and names of surfaces.
NAMES = {
    (0, 0, 0): "TMP", (0, 0, 6): "DPT", (0, 1, 1): "RH", (0, 1, 7): "PRATE", (0, 1, 8): "APCP", (0, 2, 2): "UGRD", (0, 2, 3): "VGRD", (0, 2, 22): "GUST",
    (0, 3, 0): "PRES", (0, 3, 5): "HGT", (0, 4, 7): "DSWRF", (0, 7, 6): "CAPE", (0, 19, 0): "VIS", (0, 19, 2): "TSTM",
}
SECONDS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}
SURFACES = {1: "surface", 103: "m above ground", 200: "entire atmosphere", 215: "cloud ceiling"}


@dataclass
class Field:
    """One field of a message; offsets are within the bytes that were read."""

    variable: str
    level: str
    run: dt.datetime
    hour: float
    rows: int = 0
    cols: int = 0
    latitudes: np.ndarray | None = None  # of the rows, for grids of latitudes and longitudes
    longitudes: np.ndarray | None = None
    sections: dict | None = None

    def values(self) -> np.ndarray:
        """(rows, cols), from the first scanned row; NaN where the bitmap has no value."""
        packing, bitmap, data = (self.sections[n] for n in (5, 6, 7))
        count, template = struct.unpack(">IH", packing[5:11])
        if template != 0:
            raise ValueError(f"packing template {template} is not simple packing")
        reference, bits = struct.unpack(">f", packing[11:15])[0], packing[19]
        binary, decimal = signed(packing[15:17]), signed(packing[17:19])
        if bits:
            raw = np.unpackbits(np.frombuffer(data[5:], np.uint8), count=count * bits).reshape(count, bits)
            packed = np.zeros(count, np.float64)
            for column in raw.T:
                packed = packed * 2 + column
        else:
            packed = np.zeros(count, np.float64)
        known = (reference + packed * 2.0**binary) / 10.0**decimal
        n = self.rows * self.cols
        if bitmap[5] == 255:
            out = known
        elif bitmap[5] == 0:
            out = np.full(n, np.nan)
            out[np.unpackbits(np.frombuffer(bitmap[6:], np.uint8), count=n).astype(bool)] = known
        else:
            raise ValueError("bitmaps of other messages are not read")
        return out.reshape(self.rows, self.cols)


def signed(data: bytes) -> int:
    """A number whose first bit is its sign."""
    n = int.from_bytes(data, "big")
    top = 1 << (8 * len(data) - 1)
    return -(n - top) if n & top else n


def grid(field: Field, section: bytes) -> None:
    template = int.from_bytes(section[12:14], "big")
    if template == 0:
        field.cols, field.rows = struct.unpack(">II", section[30:38])
        first, west, di, dj, mode = signed(section[46:50]) / 1e6, signed(section[50:54]) / 1e6, *(int.from_bytes(section[i : i + 4], "big") / 1e6 for i in (63, 67)), section[71]
        if mode & 0x3F:
            raise ValueError(f"scanning mode {mode} is not by rows")
        field.latitudes = first + (1 if mode & 0x40 else -1) * dj * np.arange(field.rows)
        field.longitudes = (west + (-1 if mode & 0x80 else 1) * di * np.arange(field.cols) + 180) % 360 - 180
    elif template in (20, 30):  # polar stereographic and Lambert grids: rows and columns only
        field.cols, field.rows = struct.unpack(">II", section[30:38])
        if section[64] & 0x3F:
            raise ValueError(f"scanning mode {section[64]} is not by rows")
    else:
        raise ValueError(f"grid template {template} is not read")


def product(field: Field, section: bytes, discipline: int) -> None:
    key = (discipline, section[9], section[10])
    field.variable = NAMES.get(key, "{}.{}.{}".format(*key))
    unit, ahead, surface = section[17], int.from_bytes(section[18:22], "big"), section[22]
    if unit not in SECONDS:
        raise ValueError(f"unit {unit} of forecast time is not read")
    field.hour = ahead * SECONDS[unit] / 3600
    height = signed(section[24:28]) / 10.0 ** signed(section[23:24]) if section[24:28] != b"\xff" * 4 else 0
    name = SURFACES.get(surface, f"surface {surface}")
    field.level = f"{height:g} {name}" if height else name


def fields(data: bytes) -> Iterator[Field]:
    """The fields of all messages in some bytes; bytes between messages are skipped, a message that is cut off raises."""
    at = 0
    while (at := data.find(b"GRIB", at)) >= 0:
        edition, total = data[at + 7], int.from_bytes(data[at + 8 : at + 16], "big")
        if edition != 2 or at + total > len(data) or data[at + total - 4 : at + total] != b"7777":
            raise ValueError(f"no whole message of edition 2 at byte {at}")
        own, place, run = {}, at + 16, None
        while data[place : place + 4] != b"7777":
            size, number = int.from_bytes(data[place : place + 4], "big"), data[place + 4]
            if size < 5:
                raise ValueError(f"broken section at byte {place}")
            own[number] = data[place : place + size]
            if number == 1:
                year, month, day, hour, minute, second = struct.unpack(">HBBBBB", own[1][12:19])
                run = dt.datetime(year, month, day, hour, minute, second)
            if number == 7:  # ends a field; what comes next may share the sections before
                field = Field("", "", run, 0.0, sections=dict(own))
                grid(field, own[3])
                product(field, own[4], data[at + 6])
                yield field
            place += size
        at += total
