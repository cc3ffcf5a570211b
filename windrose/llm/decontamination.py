"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by ``budget`` = floor(m * ``rate``) edits. Cut into
``budget`` + 1 pieces, at least one piece is in the passage unchanged. All pieces are looked up in the whole
texts by one Aho-Corasick automaton; where a piece is found, Myers' bit-parallel algorithm
finds the least edit distance of the whole item around that place. Texts and items are compared in lower case
with runs of white space as one blank.

The items are a stated query set. They go to the tasks in blocks of at most ``ITEM_BYTES``; each block is one pass over the
documents, without a shuffle of texts.

Cases: null or empty texts and items match nothing; items of fewer than 1 / ``rate`` characters have no budget and match only as whole;
repeated items or rows match each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, ITEM_BYTES = 0.08, 16 << 20
MATCH = "doc_id long, item_id long, distance int, at long"


def plain(text: str) -> str:
    return " ".join(text.lower().split())


class Item:
    """A pattern with its bit masks for Myers' algorithm."""

    def __init__(self, id: int, text: str, rate: float):
        self.id, self.text, self.m = id, text, len(text)
        self.budget = int(self.m * rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        n = self.budget + 1
        cut = [self.m * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:])]

    def nearest(self, text: str) -> int | None:
        """The least distance of the item to any part of ``text``, if within the budget."""
        if self.text in text:
            return 0
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best = full, 0, self.m, self.m
        masks, left = self.masks, len(text)
        for c in text:
            left -= 1
            equal = masks.get(c, 0)
            vertical = equal | down
            across = (((equal & up) + up) ^ up) | equal
            rise, fall = down | (full & ~(across | up)), up & across
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                best = min(best, score)
            elif score - left > self.budget and best > self.budget:
                return None
            rise, fall = rise << 1 & full, fall << 1 & full
            up, down = fall | (full & ~(vertical | rise)), rise & vertical
        return best if best <= self.budget else None


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [Item(id, plain(text), rate) for id, text in items]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for k, item in enumerate(self.items):
            for at, piece in item.pieces():
                found.setdefault(piece, []).append((k, at, len(piece)))
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> dict[int, tuple[int, int]]:
        """item number -> (distance, place) of its best match."""
        text, out, tried = plain(text), {}, set()
        for end, places in self.automaton.iter(text):
            for k, at, size in places:
                item = self.items[k]
                begin = end + 1 - size - at
                spot = k, begin // (item.budget + 1)
                if spot in tried or (k in out and not out[k][0]):
                    continue
                tried.add(spot)
                # the spot's starts lie within one budget; the window covers them all
                low = max(0, spot[1] * (item.budget + 1) - item.budget)
                best = item.nearest(text[low : low + item.m + 3 * item.budget + 1])
                if best is not None and (k not in out or best < out[k][0]):
                    out[k] = best, max(begin, 0)
        return out


def matches(docs: DataFrame, items: list[tuple[int, str]], rate: float, id: str, text: str) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)  # at most ITEM_BYTES, sent to each executor once instead of with each task

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block.value, rate)
        for batch in batches:
            rows = [
                (doc, finder.items[k].id, distance, at)
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if value
                for k, (distance, at) in finder(value).items()
            ]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "item_id", "distance", "at"])

    return docs.select(id, text).mapInArrow(search, MATCH)


def decontamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, at) of each document and item that match; ``at`` counts characters of the compared text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // ITEM_BYTES + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    blocks = [[tuple(r) for r in items.where(part == k).collect()] for k in range(n)]
    found = [matches(docs, [x for x in block if plain(x[1])], rate, id, text) for block in blocks if any(plain(x[1]) for x in block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], MATCH)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` without the rows whose text matches an item, whatever their ids; null texts are kept."""
    named = docs.select(F.xxhash64(text).alias("__name"), F.col(text).alias("__text"))
    leaks = decontamination(named, benchmark, "__name", "__text", rate).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, docs[text].isNotNull() & (F.xxhash64(docs[text]) == leaks["__leak"]), "left_anti")
