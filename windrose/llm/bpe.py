"""Byte-level BPE by a monoid tree: halves are encoded on their own and joined at the boundary.

Encodings of byte strings form a monoid under ``join``. A sequence of tokens is the encoding of its
bytes exactly when each two neighbours are the encoding of their own concatenation, so a join only
has to find a window around the boundary whose new encoding keeps its first and its last token: the
tokens outside then keep all their neighbours and stay as they are.

Within a task the distinct pieces of a slice of rows go up their trees together: a level's leaves and windows are rows of
numpy matrices, and nothing but the vocabulary is remembered from slice to slice.

Cases: a null or empty text has no tokens and decodes to an empty text; null ids decode to null;
equal texts get equal ids; other columns of the input are kept, and an existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import threading
import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import byte_strings

#: Halves of at most so many bytes are merged directly.
LEAF = 6
#: Strings of at most so many bytes are merged side by side as rows of a matrix, longer ones one by one.
WIDE = 64
#: Cells of such a matrix, and bytes of text whose pieces and tokens a task holds at once: bounds of a worker's memory.
CELLS = 1 << 20
SLICE = 4 << 20

#: Neighbouring tokens whose bytes are a leaf of the decoding tree.
RUN = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run of the given size."""
    return np.repeat(begin, size) + within(size)


class Sequences(NamedTuple):
    """Sequences of tokens or bytes, all in one array."""

    values: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, size: np.ndarray) -> Sequences:
        """Of sequences that follow each other without gaps."""
        return cls(values, np.cumsum(size) - size, size)

    def take(self, at: np.ndarray) -> Sequences:
        """No value is copied."""
        return Sequences(self.values, self.begin[at], self.size[at])

    def first(self, size: np.ndarray) -> Sequences:
        return Sequences(self.values, self.begin, size)

    def last(self, size: np.ndarray) -> Sequences:
        return Sequences(self.values, self.begin + self.size - size, size)

    def flat(self) -> np.ndarray:
        return self.values[runs(self.begin, self.size)]

    def __add__(self, other: Sequences) -> Sequences:
        """Each sequence followed by that of the other."""
        size = self.size + other.size
        begin = np.cumsum(size) - size
        values = np.empty(size.sum(), self.values.dtype)
        values[runs(begin, self.size)] = self.flat()
        values[runs(begin + self.size, other.size)] = other.flat()
        return Sequences(values, begin, size)


class Encoder:
    """Encodes many byte strings at once by merge ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, max(ranks.values()) + 1
        by_rank = [b""] * self.none
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.tokens = Sequences.of(np.frombuffer(b"".join(by_rank), np.uint8), np.array([len(t) for t in by_rank]))
        self.known = pa.array(ranks, pa.large_binary())
        self.rank_of_known = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # each way to make a token of two
        pairs = {ranks[t[:i]] * self.none + ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        pairs[-1] = self.none  # so that there is one
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens' merged one; ``none`` if there is none, or if one is missing (negative)."""
        pairs = left * np.int64(self.none) + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pairs) & (left >= 0) & (right >= 0), self.made[at], np.int32(self.none))

    def merge(self, text: bytes) -> list[int]:
        """The plain definition: merge the leftmost pair of lowest rank until none has a rank."""
        ranks, none, parts = self.ranks, self.none, [text[i : i + 1] for i in range(len(text))]
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            # only the merged part's own two pairs have changed
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for each row of single bytes' tokens, filled up with -1: (tokens, their number)."""
        out, row = np.full_like(ids, -1), np.arange(len(ids))
        scores = self.joint(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = scores.argmin(1) if scores.shape[1] else np.zeros(len(row), int)
            best = scores[np.arange(len(row)), at] if scores.shape[1] else np.full(len(row), self.none)
            over = best == self.none
            if over.any():
                out[row[over], : ids.shape[1]] = ids[over]
                ids, scores, row, at, best = (x[~over] for x in (ids, scores, row, at, best))
                if not len(row):
                    break
            each = np.arange(len(row))
            ids[each, at] = best
            stay = np.ones(ids.shape, bool)
            stay[each, at + 1] = False
            ids = ids[stay].reshape(len(row), -1)
            scores = scores[stay[:, 1:]].reshape(len(row), -1)
            # only the merged token's own two pairs have changed
            right = np.flatnonzero(at < scores.shape[1])
            scores[right, at[right]] = self.joint(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            scores[left, at[left] - 1] = self.joint(ids[left, at[left] - 1], ids[left, at[left]])
        return out, (out >= 0).sum(1)

    def merged(self, texts: Sequences) -> Sequences:
        """The encoding of short byte strings; equal ones are merged once."""
        ends = np.append(0, np.cumsum(texts.size))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts.size), [None, pa.py_buffer(ends), pa.py_buffer(texts.flat())])
        kinds = column.dictionary_encode()
        data, ends = byte_strings(kinds.dictionary)
        if (self.bytes[data] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        size = np.diff(ends)
        order, found, sizes, at = np.argsort(size, kind="stable"), [], [], 0
        while at < len(order):
            if size[order[at]] > WIDE:
                one = self.merge(data[ends[order[at]] : ends[order[at] + 1]].tobytes())
                found.append(np.array(one, np.int32))
                sizes.append(np.array([len(one)]))
                at += 1
                continue
            # rows of like lengths
            width = max(4, -(-size[order[at]] // 4) * 4)
            rows = order[at : np.searchsorted(size[order], width, "right")][: CELLS // width]
            cells = np.full((len(rows), width), -1, np.int32)
            cells[np.arange(width) < size[rows, None]] = self.bytes[data[runs(ends[rows], size[rows])]]
            tokens, counts = self.merge_rows(cells)
            found.append(tokens[tokens >= 0])
            sizes.append(counts)
            at += len(rows)
        sorted_ = Sequences.of(np.concatenate(found), np.concatenate(sizes)) if found else Sequences.of(np.empty(0, np.int32), np.empty(0, np.int64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return sorted_.take(place[kinds.indices.to_numpy()])

    def join(self, left: Sequences, right: Sequences) -> Sequences:
        """Each left encoding joined with its right one; none is empty."""
        n = len(left.size)
        a, b = np.ones(n, np.int64), np.ones(n, np.int64)
        begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found, length, open_ = [], 0, np.arange(n)
        while len(open_):
            l, r, i, j = left.take(open_), right.take(open_), a[open_], b[open_]
            window = l.last(i) + r.first(j)
            tokens = self.tokens.take(window.values)
            new = self.merged(Sequences.of(tokens.flat(), np.add.reduceat(tokens.size, window.begin)))
            whole_left, whole_right = i == l.size, j == r.size
            first = whole_left | (new.values[new.begin] == l.values[l.begin + l.size - i])
            last = whole_right | (new.values[new.begin + new.size - 1] == r.values[r.begin + j - 1])
            single = new.size == 1
            done = first & last & (~single | (whole_left & whole_right))
            kept = new.take(done)
            found.append(kept.flat())
            size[open_[done]] = kept.size
            begin[open_[done]] = length + np.cumsum(kept.size) - kept.size
            length += len(found[-1])
            a[open_] = np.where(done, i, np.minimum(l.size, i + 2 * (~first | single)))
            b[open_] = np.where(done, j, np.minimum(r.size, j + 2 * (~last | single)))
            open_ = open_[~done]
        middle = Sequences(np.concatenate(found), begin, size)
        return left.first(left.size - a) + middle + right.last(right.size - b)

    def tree(self, texts: Sequences) -> Sequences:
        """Encode both halves of each, level by level, and join them."""
        long = np.flatnonzero(texts.size > LEAF)
        if not len(long):
            return self.merged(texts)
        halves, half = texts.take(long), texts.size[long] // 2
        short = texts.take(np.flatnonzero(texts.size <= LEAF))
        left, right = halves.first(half), halves.last(halves.size - half)
        parts = self.tree(Sequences(texts.values, *map(np.concatenate, zip(left[1:], right[1:], short[1:]))))
        n = np.arange(len(long))
        joined = self.join(parts.take(n), parts.take(n + len(long)))
        rest = parts.take(np.arange(2 * len(long), len(parts.size)))
        place = np.argsort(np.concatenate([long, np.flatnonzero(texts.size <= LEAF)]))
        return Sequences.of(np.concatenate([joined.values, rest.flat()]), np.concatenate([joined.size, rest.size])).take(place)

    def __call__(self, texts: pa.Array) -> Sequences:
        """The encodings of texts; one that is a token itself is that token."""
        texts = texts.cast(pa.large_binary())
        rank = pc.index_in(texts, self.known)
        whole = rank.is_valid().to_numpy(zero_copy_only=False)
        data, ends = byte_strings(texts)
        other = np.flatnonzero(~whole)
        found = self.tree(Sequences.of(data, np.diff(ends)).take(other))
        ids = self.rank_of_known[rank.drop_null().to_numpy()]
        size, begin = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[other], begin[other] = found.size, found.begin
        begin[whole] = len(found.values) + np.arange(len(ids))
        return Sequences(np.concatenate([found.values, ids]), begin, size)


class TextEncoder:
    """Encodes each match of the pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = Encoder(ranks)
        self.matches = regex.compile(pattern).findall

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; equal pieces are encoded once."""
        rows = [pa.array(self.matches(text.as_py() or ""), pa.large_string()) for text in texts]
        kinds = pa.concat_arrays([pa.array([], pa.large_string()), *rows]).dictionary_encode()
        known = self.encoder(kinds.dictionary).take(kinds.indices.to_numpy())
        ends = np.append(0, np.cumsum(known.size))[np.cumsum([0, *map(len, rows)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(known.flat()))


def slices(texts: pa.Array) -> Iterator[slice]:
    """The rows in parts of about ``SLICE`` bytes of text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
    return (slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:]))


class TokenBytes:
    """Decodes by concatenating up a tree: leaves are the bytes of up to ``RUN`` neighbouring tokens, and each level joins neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        by_rank: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.tokens = pa.array(by_rank, pa.large_binary())

    def __call__(self, rows: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids; all rows go up their trees together."""
        found = self.tokens.take(rows.flatten())  # raises for an id beyond the last
        if found.null_count:
            raise ValueError("unknown token id")
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(counts) - counts
        size = -(-counts // RUN)
        leaf = np.repeat(begin, size) + RUN * within(size)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
        bounds = ends[np.append(leaf, len(found))]
        nodes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(leaf), [None, pa.py_buffer(bounds.tobytes()), found.buffers()[2]])
        empty = pa.array([b""], pa.large_binary())
        while size.max(initial=0) > 1:
            half = -(-size // 2)
            left = np.repeat(np.cumsum(size) - size, half) + 2 * within(half)
            last = np.repeat(np.cumsum(size), half) - 1
            right = np.where(left < last, left + 1, len(nodes))  # the last of an odd number joins nothing
            nodes = pc.binary_join_element_wise(nodes.take(pa.array(left)), pa.concat_arrays([nodes, empty]).take(pa.array(right)), pa.scalar(b"", pa.large_binary()))
            size = half
        at = np.where(size > 0, np.cumsum(size) - size, len(nodes))
        out = pa.concat_arrays([nodes, empty]).take(pa.array(at, mask=~pc.is_valid(rows).to_numpy(zero_copy_only=False)))
        return out.cast(pa.binary())


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


#: By the vocabulary's digest: objects of a worker's earlier jobs may not be taken for this one's.
_ENCODERS: dict[tuple, TextEncoder] = {}
_DECODERS: dict[str, TokenBytes] = {}
#: Seconds without a batch after which a worker, which Spark keeps for other stages, lets go of both.
IDLE = 2.0


class Kept:
    """What a worker remembers from task to task, until no batch has used it for ``IDLE`` seconds."""

    def __init__(self) -> None:
        self.lock, self.used, self.watch = threading.Lock(), 0.0, None

    def __enter__(self) -> None:
        self.lock.acquire()
        if self.watch is None:
            self.watch = threading.Thread(target=self.wait, daemon=True)
            self.watch.start()

    def __exit__(self, *fault: object) -> None:
        self.used = time.monotonic()
        self.lock.release()

    def wait(self) -> None:
        while True:
            time.sleep(IDLE)
            with self.lock:
                if time.monotonic() - self.used >= IDLE:
                    _ENCODERS.clear()
                    _DECODERS.clear()
                    self.watch = None
                    return


_KEPT = Kept()


def digest(ranks: dict[bytes, int]) -> str:
    return hashlib.sha256(b"".join(b"%d %s\n" % (rank, base64.b64encode(token)) for token, rank in ranks.items())).hexdigest()


def _encoder(ranks: Broadcast, name: str, pattern: str) -> TextEncoder:
    key = (name, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(ranks.value, pattern)
    return _ENCODERS[key]


def _ids_of(column: pa.Array, ranks: Broadcast, name: str, pattern: str) -> pa.ListArray:
    with _KEPT:
        encoder = _encoder(ranks, name, pattern)
        return pa.concat_arrays([encoder(column[part]) for part in slices(column)])


def _bytes_of(column: pa.ListArray, ranks: Broadcast, name: str) -> pa.Array:
    with _KEPT:
        if name not in _DECODERS:
            _DECODERS.clear()
            _DECODERS[name] = TokenBytes(ranks.value)
        return _DECODERS[name](column)


def _vocabulary(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """The vocabulary and its digest. It goes to every executor once: its size is that of the file, not of the data."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast(ranks), digest(ranks)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids array<int>``: the tokens of the whole text of each row. No shuffle."""
    ranks, name = _vocabulary(df.sparkSession, path)

    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        return _ids_of(column, ranks, name, pattern)

    # Spark would encode again for each column made of the ids, and again within ``decode``; it doesn't repeat what may not repeat itself
    return df.withColumn(ids, encoded.asNondeterministic()(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded binary``: the bytes of each row's tokens, in order. An unknown id raises. No shuffle."""
    ranks, name = _vocabulary(df.sparkSession, path)

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        return _bytes_of(column, ranks, name)

    return df.withColumn(decoded, bytes_of(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What ``decode`` makes of ``encode``, in one pass of the rows through one Python worker a task. No shuffle."""
    ranks, name = _vocabulary(df.sparkSession, path)
    # by any case, as Spark finds columns
    column = df.columns.index(text) if text in df.columns else [c.lower() for c in df.columns].index(text.lower())
    rest = df.drop(ids, decoded).schema.fields
    others = [df.columns.index(field.name) for field in rest]
    schema = StructType([*rest, StructField(ids, ArrayType(IntegerType())), StructField(decoded, BinaryType())])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(column)):
                some = batch[part]
                tokens = _ids_of(some.column(column), ranks, name, pattern)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in others), tokens, _bytes_of(tokens, ranks, name)], names=schema.names)

    return df.mapInArrow(both, schema)
