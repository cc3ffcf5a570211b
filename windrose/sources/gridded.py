"""A Spark data source of GRIB edition 2 files: a row for each grid point, with pruning by variable, level and hour before files are opened.

    register(spark)
    spark.read.format("gridded").load(folder).where("variable = 'UGRD' and hour in (1, 2)")

``load`` takes a file, a folder or a URI that pyarrow's file systems know. A file with an inventory beside it (``<file>.idx``: lines of number:offset:date:variable:
level:time) is cut into one partition for each wanted message, which reads that message's bytes only; a file without one is a single
partition, whose messages are told apart by their headers and unpacked only if wanted. Inventories are small text: the driver reads them to plan.

Equality and IN filters on variable, level and hour are pushed down. Values outside a bitmap are null. A folder without GRIB files gives no rows; a
broken file raises with its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions.grib import Field, fields

SCHEMA = "file string, variable string, level string, run timestamp_ntz, hour double, row int, col int, lat double, lon double, value double"
#: Grid points in one batch.
POINTS = 1 << 18
_AHEAD = re.compile(r"^(\d+)(?:-(\d+))? (min|hour|day)\b")


@dataclass
class Part(InputPartition):
    file: str
    offset: int = 0
    size: int | None = None  # to the end


def system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def inventory(text: str) -> list[tuple[int, str, str, float | None]]:
    """(offset, variable, level, hour) of each line; the hour is null where the line states none."""
    out = []
    for line in text.splitlines():
        part = line.split(":")
        if len(part) >= 6:
            ahead = _AHEAD.match(part[5])
            hour = 0.0 if part[5].startswith("anl") else float(ahead[2] or ahead[1]) * {"min": 1 / 60, "hour": 1, "day": 24}[ahead[3]] if ahead else None
            out.append((int(part[1]), part[3], part[4], hour))
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in ("variable", "level", "hour"):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def wants(self, **known) -> bool:
        return all(known[c] is None or known[c] in v for c, v in self.wanted.items() if c in known)

    def partitions(self) -> list[Part]:
        store, path = system(self.path)
        info = store.get_file_info(path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        names = {f.path for f in found if f.type == fs.FileType.File}
        out = []
        for name in sorted(n for n in names if re.search(r"\.(grib2|grb2|grb)$", n)):
            if f"{name}.idx" not in names:
                out.append(Part(name))
                continue
            with store.open_input_stream(f"{name}.idx") as lines:
                known = inventory(lines.read().decode())
            offsets = sorted({k[0] for k in known})
            ends = dict(zip(offsets, offsets[1:]))
            for offset in offsets:  # a message may hold several fields
                if any(self.wants(variable=v, level=level, hour=hour) for at, v, level, hour in known if at == offset):
                    out.append(Part(name, offset, ends[offset] - offset if offset in ends else None))
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        with system(self.path)[0].open_input_file(partition.file) as file:
            file.seek(partition.offset)
            data = file.read(partition.size)
        try:
            for field in fields(data):
                if self.wants(variable=field.variable, level=field.level, hour=field.hour):
                    yield from self.batches(partition.file, field)
        except ValueError as fault:
            raise ValueError(f"{partition.file}: {fault}") from fault

    def batches(self, name: str, field: Field) -> Iterator[pa.RecordBatch]:
        values, step = field.values(), max(1, POINTS // max(field.cols, 1))
        for first in range(0, field.rows, step):
            part = values[first : first + step]
            n = part.size
            rows, cols = np.repeat(np.arange(first, first + len(part), dtype=np.int32), field.cols), np.tile(np.arange(field.cols, dtype=np.int32), len(part))
            place = lambda axis, at: pa.array(axis[at]) if axis is not None else pa.nulls(n, pa.float64())
            flat = part.ravel()
            yield pa.record_batch(
                [pa.array([x] * n, t) for x, t in ((name, pa.string()), (field.variable, pa.string()), (field.level, pa.string()), (field.run, pa.timestamp("us")), (field.hour, pa.float64()))]
                + [pa.array(rows), pa.array(cols), place(field.latitudes, rows), place(field.longitudes, cols), pa.array(flat, mask=np.isnan(flat))],
                ["file", "variable", "level", "run", "hour", "row", "col", "lat", "lon", "value"],
            )


class Gridded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Name the source ``gridded`` and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Gridded)
