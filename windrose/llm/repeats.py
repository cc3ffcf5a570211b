"""Finding repeated windows of symbol sequences: what the two substring operators share.

A *window* is ``width`` consecutive symbols (bytes or words) of one document. Its *anchor* is the
leftmost smallest hash among its strings of ``reach`` symbols; equal windows
have their anchor at the same offset. The anchors therefore are a content-defined difference cover:
any two equal windows meet in a sampled position at one common offset, wherever they start.

Documents whose whole text a smaller document has are answered as a whole and take no part in the search.
Six exchanges, all of packed arrays, and one exchange of the texts that Spark reuses:

1. each block of documents sends its distinct anchor hashes to buckets by hash range;
2. a bucket answers each block which of its hashes occur elsewhere, and which occur in very many blocks;
3. a block sends, for each repeated anchor, a hash of its surroundings (*context*) and its place, no text;
4. a bucket finds anchors with equal contexts. All but the earliest document's are decided; an anchor
   with one context needs nothing more; of the others one place for each context is asked for;
5. a block sends the text of these contexts to the anchor's bucket. Anchors of very many blocks send the
   hash (96 bits) and place of each window, to a bucket by that hash, so that no bucket gathers the surroundings of
   a passage which a third of all documents share (their contexts were dealt by context in step 3);
6. a bucket sorts its contexts, decides which windows occur earlier, and answers spans to the blocks.

Memory per task: one block's texts (``BLOCK_BYTES``, or one document) or one bucket's arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, RollingHash, byte_strings, mix, word_bounds

#: Text of one block of documents, and of the pieces in which it is hashed.
BLOCK_BYTES, PIECE_BYTES = 3 << 20, 1 << 20
#: An anchor in more blocks than this sends its windows one by one.
HOT_BLOCKS = 48
MESSAGE = "key int, origin int, kind int, blob binary"
SPAN = np.dtype([("row", "u4"), ("start", "u4"), ("end", "u4")])
#: A context by its hash, and where it is.
CLASS = np.dtype([("context", "u8"), ("anchor", "u4"), ("doc", "i8"), ("row", "u4"), ("pos", "i4"), ("lo", "u1"), ("hi", "u1"), ("hot", "?")])
PLACE = np.dtype([("row", "u4"), ("pos", "i4"), ("lo", "u1"), ("hi", "u1"), ("hot", "?"), ("anchor", "u8")])
#: Bits and bytes of an anchor's name in the screen. Names that agree by chance only cost a context hash.
NAME_BITS, NAME_BYTES = 47, 6
#: Kind of the messages with windows of hot anchors.
HOT = 4


class Windows:
    """Which windows: symbols (``bytes`` or ``words``), window width, anchor length, and what counts as earlier."""

    def __init__(self, kind: str, width: int, reach: int, within: bool):
        self.kind, self.width, self.reach, self.within = kind, width, reach, within
        self.left = width - reach
        self.context = np.dtype(
            [("hash", "u8"), ("doc", "i8"), ("row", "u4"), ("pos", "i4"), ("lo", "u1"), ("hi", "u1"), ("hot", "?"),
             ("text", "u1" if kind == "bytes" else "u8", self.left + width)]
        )

    def symbols(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(64-bit codes, context symbols, number of symbols before each document) of joined texts."""
        if self.kind == "bytes":
            return BYTE_CODES[data], data, ends
        start, end = word_bounds(data)
        codes = RollingHash(BYTE_CODES[data]).windows(start, end)
        return codes, codes, np.searchsorted(start, ends)

    def anchors(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash, position, first window, last window) of each anchor, by position."""
        n = len(codes) - self.width + 1
        if n <= 0:
            return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        at = np.arange(len(codes) - self.reach + 1)
        low = RollingHash(codes).windows(at, at + self.reach)
        hashes, where, have, want = low, at.astype(np.int32), 1, self.left + 1
        while have < want:
            step = min(have, want - have)
            left = low[:-step] <= low[step:]
            low, where = np.where(left, low[:-step], low[step:]), np.where(left, where[:-step], where[step:])
            have += step
        inside = np.zeros(len(codes) + 1, np.int32)  # windows that would run into the next document are none
        np.add.at(inside, np.maximum(end - self.width + 1, begin), 1)
        np.add.at(inside, begin[1:], -1)
        fits = np.flatnonzero(np.cumsum(inside)[:n] == 0)
        if not len(fits):
            return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        chosen = where[fits]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (fits[1:] != fits[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(fits)]]) - 1
        pos = chosen[new].astype(np.int64)
        return hashes[pos], pos, fits[new], fits[last]


def blocks(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, int]:
    """Columns (block, doc, text) and the number of blocks; a null id counts as the largest, a null text as empty.

    Rows go to blocks by id and text, so that many rows without an id, or of one id, don't meet in one block.
    """
    plain = docs.select(F.coalesce(F.col(id), F.lit(2**63 - 1)).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id).isNull().alias("no_id"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, size // BLOCK_BYTES + 1)
    return plain.withColumn("block", F.pmod(F.xxhash64("doc", "text"), F.lit(n)).cast("int")).select("block", "doc", "text", "no_id"), n


def copies(docs: DataFrame) -> DataFrame:
    """Messages to each block with its documents whose whole text is that of a smaller document. docs: of ``blocks``."""
    name = [F.octet_length("text").alias("size"), F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.crc32(F.col("text").cast("binary")).alias("c")]
    named = docs.select("block", "doc", *name)
    keys = ["size", "a", "b", "c"]
    first = named.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    later = named.join(first, keys).where("doc > least")
    return later.select(F.col("block").alias("key"), F.lit(0).alias("origin"), F.lit(2).alias("kind"), F.concat_ws(",", "doc", "size", "c").cast("binary").alias("blob"))


def ordered(table: pa.Table) -> pa.Table:
    """A block's documents in an order that each pass over it finds again."""
    return table.sort_by([("doc", "ascending"), ("text", "ascending")])


def pieces(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, joined bytes, offsets) of runs of documents; a blank ends each document."""
    rows, start, size = table.column("text"), 0, 0
    sizes = pc.binary_length(rows).to_numpy().astype(np.int64)
    for i in range(len(sizes)):
        size += sizes[i] + 1
        if size >= PIECE_BYTES or i == len(sizes) - 1:
            data, ends = byte_strings(rows.slice(start, i + 1 - start))
            joined = np.full(len(data) + len(ends) - 1, 32, np.uint8)
            gaps = np.arange(len(ends))
            keep = np.ones(len(joined), bool)
            keep[ends[1:] + gaps[:-1]] = False
            joined[keep] = data
            yield start, joined, ends + gaps
            start, size = i + 1, 0


def pack(rows: np.ndarray) -> bytes:
    """Rows by column, compressed: texts have far fewer bits than their bytes."""
    return zstandard.ZstdCompressor(1).compress(b"".join(rows[c].tobytes() for c in rows.dtype.names))


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    data, at = zstandard.ZstdDecompressor().decompress(blob), 0
    out = np.empty(len(data) // kind.itemsize, kind)
    for c in kind.names:
        size = out[c].nbytes
        out[c] = np.frombuffer(data[at : at + size], kind[c].base).reshape(out[c].shape)
        at += size
    return out


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    key, origin, kind, blob = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"key": pa.array(key, pa.int32()), "origin": pa.array(origin, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def narrow(values: np.ndarray, size: int) -> bytes:
    """The lower ``size`` bytes of 64-bit numbers, byte by byte: those that all share are squeezed out by Spark's codec."""
    return values.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def widen(blobs: list[bytes], size: int) -> np.ndarray:
    """The numbers of several blobs of ``narrow``, joined."""
    out = np.zeros((sum(map(len, blobs)) // size, 8), np.uint8)
    at = 0
    for blob in blobs:
        n = len(blob) // size
        out[at : at + n, :size] = np.frombuffer(blob, np.uint8).reshape(size, n).T
        at += n
    return out.view(np.uint64).ravel()


def by_bucket(values: np.ndarray, bucket: np.ndarray, origin: int, code: Callable[[np.ndarray], bytes] = np.ndarray.tobytes, kind: int = 0) -> list[tuple[int, int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    return [(int(bucket[a]), origin, kind, code(values[a:b])) for a, b in zip(cut, [*cut[1:], len(bucket)])]


def repeated_keys(sent: DataFrame, size: int = 8) -> DataFrame:
    """Of messages with sorted distinct keys of ``size`` bytes (lowest bit: repeats within its sender): to each sender those that repeat.

    In the answer the lowest bit tells that more than ``HOT_BLOCKS`` senders have the key.
    """

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        blobs = table.column("blob").to_pylist()
        stop = np.cumsum([0, *(len(b) // size for b in blobs)])
        values = widen(blobs, size)
        name, inverse, count = np.unique(values >> np.uint64(1), return_inverse=True, return_counts=True)
        twice = np.bincount(inverse, (values & np.uint64(1)).astype(float), len(name)) > 0
        repeats, hot = (count > 1) | twice, (count > HOT_BLOCKS).astype(np.uint64)
        out = []
        for origin, a, b in zip(table.column("origin").to_pylist(), stop[:-1], stop[1:]):
            own = inverse[a:b][repeats[inverse[a:b]]]
            if len(own):
                out.append((origin, key[0].as_py(), 0, narrow(name[own] << np.uint64(1) | hot[own], size)))
        return messages(out)

    return sent.groupBy("key").applyInArrow(answer, MESSAGE)


def earlier_contexts(rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's context, whether an earlier row has it and so decides it); rows are in order of place."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((rows["anchor"], rows["context"]))
    context, anchor = rows["context"][order], rows["anchor"][order]
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (anchor[1:] != anchor[:-1])])
    name = np.empty(len(rows), np.int64)
    name[order] = np.cumsum(new) - 1
    head = np.empty(name.max() + 1, np.int64)
    head[name[::-1]] = np.arange(len(rows))[::-1]
    head = head[name]
    return name, (np.arange(len(rows)) != head) if within else rows["doc"] > rows["doc"][head]


def decide_contexts(rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a bucket, in order of place: (whether decided as earlier, whether its text is needed)."""
    name, known = earlier_contexts(rows, within)
    anchor = np.unique(rows["anchor"], return_inverse=True)[1]
    least, most = np.full(len(rows) + 1, len(rows)), np.full(len(rows) + 1, -1)
    np.minimum.at(least, anchor, name)
    np.maximum.at(most, anchor, name)
    # contexts of a hot anchor are in several buckets, so that its windows are needed even if one context is here
    return known, ~known & (rows["hot"] | (least < most)[anchor])


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each row without overlaps."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["row"]))]
    base = spans["row"].astype(np.int64) << 32
    start, end = base + spans["start"], np.maximum.accumulate(base + spans["end"])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    out = spans[at]
    out["end"] = end[np.concatenate([at[1:], [len(spans)]]) - 1] - base[at]
    return out


def window_runs(rows: np.ndarray, width: int) -> np.ndarray:
    """A span over all windows of each row."""
    out = np.empty(len(rows), SPAN)
    out["row"], out["start"], out["end"] = rows["row"], rows["pos"] + rows["lo"], rows["pos"] + rows["hi"].astype(np.int64) + width
    return out


def group_rows(table: np.ndarray) -> np.ndarray:
    """A number for each distinct row of a byte matrix."""
    width = -table.shape[1] % 8
    words = np.ascontiguousarray(np.pad(table, ((0, 0), (0, width)))).view(np.uint64)
    order = np.lexsort(words.T)
    new = np.zeros(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new)
    return name


def same_context(rows: np.ndarray) -> np.ndarray:
    """A number for each distinct pair of anchor and context."""
    n = len(rows)
    parts = [np.ascontiguousarray(rows[c]).view(np.uint8).reshape(n, -1) for c in ("hash", "text")]
    return group_rows(np.concatenate(parts, 1))


def spans_of(rows: np.ndarray, flags: np.ndarray, width: int) -> np.ndarray:
    """Spans (row, start, end) of the flagged windows; flags has a column for each offset of a window in a context."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    out = np.empty(len(i), SPAN)
    out["row"], out["start"], out["end"] = rows["row"][i], rows["pos"][i] + a, rows["pos"][i] + b - 1 + width
    return out


def valid(rows: np.ndarray, left: int) -> np.ndarray:
    offset = np.arange(left + 1)
    return (offset >= rows["lo"][:, None]) & (offset <= rows["hi"][:, None])


def repeated_spans(
    docs: DataFrame, n: int, windows: Windows, resolve: Callable[[np.ndarray, Windows], np.ndarray]
) -> DataFrame:
    """Messages to each block with the spans of windows that occur earlier. docs: of ``blocks``."""
    width, left, cut = windows.width, windows.left, np.uint64(64 - NAME_BITS)

    def told(messages: pa.Table) -> tuple[set[bytes], list[bytes]]:
        """(names of documents that are copies of smaller ones, other messages)."""
        pairs = list(zip(messages.column("kind").to_pylist(), messages.column("blob").to_pylist()))
        return {blob for kind, blob in pairs if kind == 2}, [blob for kind, blob in pairs if kind != 2]

    def copied_rows(table: pa.Table, known: set[bytes]) -> list[tuple[int, bytes]]:
        """(row, text) of the copies in an ordered block."""
        ids, texts = {int(x.split(b",")[0]) for x in known}, table.column("text")
        rows = [(i, texts[i].as_py().encode()) for i, doc in enumerate(table.column("doc").to_pylist()) if doc in ids]
        return [(i, x) for i, x in rows if b"%d,%d,%d" % (table.column("doc")[i].as_py(), len(x), zlib.crc32(x)) in known]

    def found(table: pa.Table, known: set[bytes]) -> Iterator[tuple]:
        """Anchors of the documents that are no copies; the rows of copies count as empty."""
        table = ordered(table)
        if known:
            gone = {i for i, _ in copied_rows(table, known)}
            text = pa.array(["" if i in gone else x for i, x in enumerate(table.column("text").to_pylist())], pa.string())
            table = table.set_column(table.column_names.index("text"), "text", text)
        ids = table.column("doc").to_numpy()
        for row, data, ends in pieces(table):
            codes, symbols, starts = windows.symbols(data, ends)
            begin, end = starts[:-1], starts[1:] - (windows.kind == "bytes")  # the blank after a text is no byte of it
            yield row, ids, codes, symbols, begin, end, windows.anchors(codes, begin, end)

    def screen(key: tuple, table: pa.Table, copied: pa.Table) -> pa.Table:
        name, doc = [], []
        for row, ids, _, _, begin, _, (hashes, pos, _, _) in found(table, told(copied)[0]):
            name.append(hashes)
            doc.append(ids[row + np.searchsorted(begin, pos, "right") - 1])
        if not name:
            return messages([])
        name, doc = np.concatenate(name), np.concatenate(doc)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        first = np.concatenate([[True], name[1:] >> cut != name[:-1] >> cut]) if len(name) else np.empty(0, bool)
        again = ~first
        if not windows.within:
            again[1:] &= doc[1:] != doc[:-1]
        group = np.cumsum(first) - 1
        twice = np.bincount(group, again, group[-1] + 1 if len(group) else 0) > 0
        sent = name[first] >> cut << np.uint64(1) | twice.astype(np.uint64)
        return messages(by_bucket(sent, bucket_of(name[first], n), key[0].as_py(), lambda x: narrow(x, NAME_BYTES)))

    def contexts(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = key[0].as_py()
        known, blobs = told(answers)
        local = [whole_spans(ordered(table), known)] if known else []
        wanted = np.sort(widen(blobs, NAME_BYTES))
        wanted, hot = wanted >> np.uint64(1), (wanted & np.uint64(1)).astype(bool)
        parts, hashed = [], []
        for row, ids, codes, _, begin, _, (hashes, pos, a, b) in found(table, known) if len(wanted) and table.num_rows else ():
            at = np.minimum(np.searchsorted(wanted, hashes >> cut), len(wanted) - 1)
            use = np.flatnonzero(wanted[at] == hashes >> cut)
            hashes, pos, a, b = hashes[use], pos[use], a[use], b[use]
            own = np.searchsorted(begin, pos, "right") - 1
            rows = np.zeros(len(pos), CLASS)
            rows["anchor"], rows["doc"], rows["row"], rows["pos"], rows["hot"] = hashes & np.uint64(0xFFFFFFFF), ids[row + own], row + own, pos - left - begin[own], hot[at[use]]
            rows["lo"], rows["hi"] = a - pos + left, b - pos + left
            place = (rows["lo"].astype(np.uint64) << np.uint64(8)) + rows["hi"]
            rows["context"] = mix(RollingHash(codes).windows(a, b + width) + mix(place))
            parts.append(rows)
            hashed.append(hashes)
        out = []
        if parts:
            rows, hashed = np.concatenate(parts), np.concatenate(hashed)
            order = np.lexsort((rows["pos"], rows["row"], rows["doc"]))
            rows, hashed = rows[order], hashed[order]
            again = earlier_contexts(rows, windows.within)[1]
            local.append(window_runs(rows[again], width))
            rows, hashed = rows[~again], hashed[~again]
            out = by_bucket(rows, bucket_of(np.where(rows["hot"], rows["context"], hashed), n), block, pack)
        spans = merged(np.concatenate(local)) if local else np.empty(0, SPAN)
        return messages(out + ([(block % n, block, 1, spans.tobytes())] if len(spans) else []))

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        out, joined = received(table, {0: CLASS}, 1)
        rows, origin = joined[0]
        known, needed = decide_contexts(rows, windows.within)
        places = np.zeros(len(rows), PLACE)
        for c in ("row", "pos", "lo", "hi", "hot"):
            places[c] = rows[c]
        places["anchor"] = (rows["anchor"].astype(np.uint64) << np.uint64(32)) | rows["anchor"]
        for block in np.unique(origin):
            own = origin == block
            spans = window_runs(rows[own & known], width)
            out += [(int(block), key[0].as_py(), kind, blob) for kind, blob in ((1, merged(spans).tobytes()), (3, places[own & needed].tobytes())) if blob]
        return messages(out)

    def received(table: pa.Table, kinds: dict[int, np.dtype], passed: int) -> tuple[list[tuple], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """(spans on their way to a block, for each kind of packed rows in order of place: rows and their origins)."""
        out, parts = [], {k: ([np.empty(0, kind)], [np.empty(0, np.int64)]) for k, kind in kinds.items()}
        for origin, code, blob in zip(*(table.column(c).to_pylist() for c in ("origin", "kind", "blob"))):
            if code in kinds:
                parts[code][0].append(unpack(blob, kinds[code]))
                parts[code][1].append(np.full(len(parts[code][0][-1]), origin))
            else:
                out.append((origin, table.column("key")[0].as_py(), passed, blob))
        joined = {}
        for k, (rows, origin) in parts.items():
            rows, origin = np.concatenate(rows), np.concatenate(origin)
            order = np.lexsort((rows["pos"], rows["row"], origin, rows["doc"]))
            joined[k] = rows[order], origin[order]
        return out, joined

    def surroundings(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block, table = key[0].as_py(), ordered(table)
        blobs = {kind: [b for k, b in zip(answers.column("kind").to_pylist(), answers.column("blob").to_pylist()) if k == kind] for kind in (1, 3)}
        places = np.frombuffer(b"".join(blobs[3]), PLACE)
        places = places[np.lexsort((places["pos"], places["row"]))]
        spans = [np.frombuffer(b"".join(blobs[1]), SPAN)]
        ids, parts = table.column("doc").to_numpy(), [np.empty(0, windows.context)]
        for row, data, ends in pieces(table) if len(places) else ():
            mine = places[slice(*np.searchsorted(places["row"], [row, row + len(ends) - 1]))]
            if not len(mine):
                continue
            _, symbols, starts = windows.symbols(data, ends)
            rows = np.zeros(len(mine), windows.context)
            for c in ("row", "pos", "lo", "hi", "hot"):
                rows[c] = mine[c]
            rows["hash"], rows["doc"] = mine["anchor"], ids[mine["row"]]
            view = np.lib.stride_tricks.sliding_window_view(np.pad(symbols, (left, left + width)), left + width)
            text, column = view[starts[mine["row"] - row] + mine["pos"] + left].copy(), np.arange(left + width)
            text[(column < rows["lo"][:, None]) | (column >= rows["hi"][:, None].astype(int) + width)] = 0  # what none of its windows needs
            rows["text"] = text
            parts.append(rows)
        rows = np.concatenate(parts)
        single = alone(rows[rows["hot"]])
        single = single[np.lexsort((single["pos"], single["row"], single["doc"]))]
        again = earlier_contexts(single, windows.within)[1]
        local = merged(np.concatenate([*spans, window_runs(single[again], width)]))
        single, rows = single[~again], rows[~rows["hot"]]
        out = by_bucket(single, bucket_of(single["context"], n), block, pack, HOT)
        bucket = bucket_of(rows["hash"], n)
        rows["hash"] = 0  # the bucket tells anchors apart by their symbols
        out += by_bucket(rows, bucket, block, pack)
        return messages(out + ([(block % n, block, 1, local.tobytes())] if len(local) else []))

    def whole_spans(table: pa.Table, known: set[bytes]) -> np.ndarray:
        """A span over each copy that has a window at all."""
        sizes = [(i, len(x) if windows.kind == "bytes" else len(x.split())) for i, x in copied_rows(table, known)]
        return np.array([(i, 0, k) for i, k in sizes if k >= width], SPAN)

    def alone(rows: np.ndarray) -> np.ndarray:
        """A row for each window, named by the window's own hash and its anchor's."""
        count = rows["hi"].astype(int) - rows["lo"] + 1
        i = np.repeat(np.arange(len(rows)), count)
        offset = rows["lo"][i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        if not len(rows):
            return np.zeros(0, CLASS)
        view = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(rows["text"]), width, 1)
        out = np.zeros(len(i), CLASS)
        out["anchor"] = rows["hash"][i] & np.uint64(0xFFFFFFFF)
        out["doc"], out["row"], out["pos"] = rows["doc"][i], rows["row"][i], rows["pos"][i] + offset
        for k in range(0, len(i), 1 << 14):
            some = slice(k, k + (1 << 14))
            codes = mix((view[i[some], offset[some]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            start = np.arange(len(codes)) * width
            out["context"][some] = RollingHash(codes.ravel()).windows(start, start + width)
        return out

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        out, joined = received(table, {0: windows.context, HOT: CLASS}, 0)
        rows, origin = joined[HOT]
        again = earlier_contexts(rows, windows.within)[1]
        for block in np.unique(origin[again]):
            out.append((int(block), key[0].as_py(), 0, merged(window_runs(rows[again & (origin == block)], width)).tobytes()))
        rows, origin = joined[0]
        if len(rows):
            anchor = np.ascontiguousarray(rows["text"][:, left : left + windows.reach])
            rows["hash"] = group_rows(anchor.view(np.uint8).reshape(len(rows), -1))
            own_row = rows["row"].copy()
            _, rows["row"] = np.unique(origin.astype(np.int64) << 32 | own_row, return_inverse=True)  # rows of several blocks apart
            flags = resolve(rows, windows) & valid(rows, left)
            rows["row"] = own_row
            some = flags.any(1)
            rows, origin, flags = rows[some], origin[some], flags[some]
            for block in np.unique(origin):
                own = origin == block
                out.append((int(block), key[0].as_py(), 0, spans_of(rows[own], flags[own], width).tobytes()))
        return messages(out)

    copied = copies(docs)
    sent = docs.groupBy("block").cogroup(copied.groupBy("key")).applyInArrow(screen, MESSAGE)
    answers = repeated_keys(sent, NAME_BYTES).unionByName(copied)
    sent = docs.groupBy("block").cogroup(answers.groupBy("key")).applyInArrow(contexts, MESSAGE)
    judged = sent.groupBy("key").applyInArrow(judge, MESSAGE)
    sent = docs.groupBy("block").cogroup(judged.groupBy("key")).applyInArrow(surroundings, MESSAGE)
    return sent.groupBy("key").applyInArrow(settle, MESSAGE)


def with_spans(
    docs: DataFrame, spans: DataFrame, finish: Callable[[bytes, np.ndarray], tuple[int, int, list, bytes]]
) -> DataFrame:
    """(doc, n, n_removed, spans, kept) of every document; finish gets a text and its spans."""
    kinds = "doc long, n long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def removed(key: tuple, table: pa.Table, verdicts: pa.Table) -> pa.Table:
        table = ordered(table)
        values, _ = byte_strings(verdicts.column("blob"))
        rows = np.sort(values.view(SPAN), order="row") if len(values) else np.empty(0, SPAN)
        cut = np.searchsorted(rows["row"], np.arange(table.num_rows + 1))
        n, gone, where, kept = [], [], [], []
        for i, text in enumerate(table.column("text").cast(pa.large_binary()).to_pylist()):
            a, b, c, d = finish(text, rows[cut[i] : cut[i + 1]])
            n.append(a), gone.append(b), where.append(c), kept.append(d)
        doc = [None if no else d for d, no in zip(table.column("doc").to_pylist(), table.column("no_id").to_pylist())]
        return pa.table([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, span), pa.array(kept, pa.binary())], ["doc", "n", "n_removed", "spans", "kept"])

    return docs.groupBy("block").cogroup(spans.groupBy("key")).applyInArrow(removed, kinds)


def covered(n: int, spans: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """(whether each of n symbols is covered, the maximal covered runs)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans["start"], 1)
    np.add.at(edge, spans["end"], -1)
    inside = np.cumsum(edge)[:n] > 0
    turn = np.diff(np.pad(inside.astype(np.int8), 1))
    return inside, [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
