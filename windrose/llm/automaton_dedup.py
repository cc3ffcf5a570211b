"""Removal of repeated word passages by suffix automata of reference shards.

A reference shard is what one bucket of anchors (see ``repeats``) holds: the surroundings of the
same repeated word string. Sending every shard of the corpus to every document would
cost the square of the corpus, so each shard goes only to where the documents' matching contexts are
gathered, and its size is bounded. There contexts are streamed in corpus order through a suffix automaton of
the ones before them; the matching statistic at each word is the longest earlier match that ends
there, and windows at or above ``width`` words are removed. The contexts of one anchor that are equal
are answered by their first.

Removed is each word covered by a window of ``width`` words whose word sequence also starts earlier
(smaller ``doc_id``, or same document and earlier start), judged on the input.

Cases: a null text has no words; a text with fewer than ``width`` words keeps them all; words
are joined by one blank also where nothing is removed; ``doc_id`` null counts as the largest; of rows
that share a ``doc_id``, later ones in order of text count as its later part; an empty table gives no rows;
further columns are dropped.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Windows, blocks, covered, repeated_spans, same_context, valid, with_spans

WIDTH, ANCHOR = 20, 7


class SuffixAutomaton:
    """Of several word strings; each state keeps where the first occurrence of its strings ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def _state(self, step: dict[int, int], link: int, length: int, first: tuple) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A state for the strings of ``to`` that are one word longer than ``state``'s."""
        copy = self._state(dict(self.next[to]), self.link[to], self.length[state] + 1, self.first[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[int], place: int) -> None:
        last = 0
        for i, word in enumerate(words):
            to = self.next[last].get(word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
                continue
            new = self._state({}, 0, self.length[last] + 1, (place, i))
            state, last = last, new
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                to = self.next[state][word]
                self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)

    def matches(self, words: list[int], width: int) -> list[tuple[int, tuple]]:
        """(end, place of the first occurrence) of each match of ``width`` words."""
        out, state, length = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= width:
                at = state
                while self.length[self.link[at]] >= width:
                    at = self.link[at]
                out.append((i, self.first[at]))
        return out


def earlier_windows(rows: np.ndarray, windows: Windows) -> np.ndarray:
    """For each context (in corpus order) and offset: whether that window's words start earlier."""
    size = windows.left + windows.width
    flags = np.zeros((len(rows), windows.left + 1), bool)
    name = same_context(rows)
    _, first = np.unique(name, return_index=True)
    later = np.ones(len(rows), bool)
    later[first] = False
    flags[later] = valid(rows[later], windows.left)
    heads = np.sort(first)
    heads = heads[np.argsort(rows["hash"][heads], kind="stable")]
    hashes = rows["hash"][heads]
    cut = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(heads) else []
    for a, b in zip(cut, [*cut[1:], len(heads)]):
        if b - a < 2:
            continue
        automaton = SuffixAutomaton()
        for i in heads[a:b]:
            row = rows[i]
            words = row["text"].tolist()
            low, high = int(row["lo"]), int(row["hi"])
            for end, (place, at) in automaton.matches(words, windows.width):
                start = end - windows.width + 1
                if low <= start <= high:
                    other = rows[place]
                    same = other["doc"] == row["doc"] and other["row"] == row["row"]
                    flags[i, start] |= not same or other["pos"] + at - windows.width + 1 < row["pos"] + start
            if i != heads[b - 1]:
                automaton.add(words[:size], int(i))
    return flags


def cut_words(text: bytes, spans: np.ndarray) -> tuple[int, int, list, bytes]:
    words = text.split()
    if not len(spans):
        return len(words), 0, [], b" ".join(words)
    inside, runs = covered(len(words), spans)
    return len(words), int(inside.sum()), runs, b" ".join(compress(words, (~inside).tolist()))


def automaton_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, spans of word positions, kept binary) of every row of ``docs``."""
    own, n = blocks(docs, id, text)
    spans = repeated_spans(own, n, Windows("words", width, anchor, within=True), earlier_windows)
    return with_spans(own, spans, cut_words).withColumnsRenamed({"doc": "doc_id", "n": "n_words"})
