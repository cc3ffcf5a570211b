"""Exact substring removal by blockwise suffix sorting over a content-defined difference cover.

The suffixes that start at cover positions (the anchors of ``repeats``) are sorted one bucket at a
time. Ties are long by nature here; they are resolved by precomputed ranks of cover samples: equal
windows meet a cover position at one common offset, so two windows are equal exactly when the
ranks of their samples agree, forwards from the sample to the window's end and backwards to its
start. Ranks at each depth come from one sort in each direction and the common prefixes of neighbours.
A classical cover fixes sample positions by residue. It too would serve any two positions, but finding which
are equal would mean to sort all suffixes of the corpus; see the README.

Removed is each byte covered by a ``width``-byte string that also starts in a document of smaller
``doc_id``, judged on the input.

Cases: a null or empty text, or one shorter than ``width``, loses nothing; ``doc_id`` null counts
as the largest id; rows that share a ``doc_id`` are one document to each other and stay, every row is
returned; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Windows, blocks, covered, repeated_spans, with_spans

WIDTH, SAMPLE = 50, 24


def big_endian(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows as 64-bit numbers whose order is that of (hash, bytes)."""
    padded = np.ascontiguousarray(np.pad(text, ((0, 0), (0, -text.shape[1] % 8))))
    return np.concatenate([hashes[:, None], padded.view(">u8").astype(np.uint64)], 1)


class Ranks:
    """One sort of strings; ``at(depth)`` numbers their classes by hash and the first ``depth`` bytes."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray):
        self.order = np.lexsort(big_endian(hashes, text).T[::-1])
        text, hashes = text[self.order], hashes[self.order]
        differs = text[1:] != text[:-1]
        self.common = np.where(differs.any(1), differs.argmax(1), text.shape[1])
        self.common[hashes[1:] != hashes[:-1]] = -1

    def at(self, depth: int) -> np.ndarray:
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < depth)
        return out


def earlier_documents(rows: np.ndarray, windows: Windows) -> np.ndarray:
    """For each context (in order of document) and offset: whether that window is in an earlier document."""
    left, n = windows.left, len(rows)
    forward = Ranks(rows["hash"], rows["text"][:, left:])
    back = Ranks(rows["hash"], rows["text"][:, :left][:, ::-1])
    flags = np.zeros((n, left + 1), bool)
    for offset in range(left + 1):
        use = np.flatnonzero((rows["lo"] <= offset) & (rows["hi"] >= offset))
        if len(use) < 2:
            continue
        name = forward.at(windows.reach + offset)[use] * n + back.at(left - offset)[use]
        _, first, group = np.unique(name, return_index=True, return_inverse=True)
        doc = rows["doc"][use]
        flags[use, offset] = doc > doc[first][group]
    return flags


def cut_bytes(text: bytes, spans: np.ndarray) -> tuple[int, int, list, bytes]:
    if not len(spans):
        return len(text), 0, [], text
    inside, runs = covered(len(text), spans)
    return len(text), int(inside.sum()), runs, np.frombuffer(text, np.uint8)[~inside].tobytes()


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<start,end>>, kept binary) of every row of ``docs``."""
    own, n = blocks(docs, id, text)
    spans = repeated_spans(own, n, Windows("bytes", width, sample, within=False), earlier_documents)
    return with_spans(own, spans, cut_bytes).withColumnsRenamed({"doc": "doc_id", "n": "n_bytes"})
