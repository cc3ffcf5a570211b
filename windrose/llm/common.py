"""What several operators share: shared-folder tables and whole-batch hashing of byte strings."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine is set once on a local master, as in tests; on a cluster that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("windrose.local.shared", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="windrose-")
        spark.conf.set("windrose.local.shared", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: One odd 64-bit value for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept for the next, shorter call."""
    have = powers.__dict__.setdefault("kept", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            have[k] = np.multiply.accumulate(step)
    return have[0], have[1]


class RollingHash:
    """Hashes of any windows of one sequence of 64-bit codes, from prefix sums."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = powers(n)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def windows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets) of a string or binary column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


#: Bytes that end a word: blank, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of one text."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of one text."""
    start, end = word_bounds(data)
    return RollingHash(BYTE_CODES[data]).windows(start, end)
