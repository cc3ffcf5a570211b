"""The conversation trie against brute force on the smallest tables, on long and hot conversations and on edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare  # noqa: E402

from windrose.llm import conversation_trie, queries  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, bytes int, names string, depth string"


def ordered(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(x)] for c, x in own.items()}


def regrown(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def brute(built):
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], digest(n)) for n, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_prefix_trie(spark, sf_dir)
    assert rows_of(out) == brute(regrown(ordered(rows)))
    compare(out, queries.TRIE_SQL, sf_dir)


def edge_rows():
    rng = random.Random(3)
    rows = [(None, 1, "user", "no id"), (7, None, None, None), (7, None, "user", None), (7, 1, None, "x"), (7, 1, None, "x"), (7, 1, None, "w"), (-7, 1, "user", "a"), (-5, 1, "user", "b"), (-3, None, "user", "é"), (0, 1, "user", "é"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    rows += [(c, t, "user", f"same {t}") for c in range(10, 40) for t in range(5)]
    rows += [(50, t, "user", "deep") for t in range(70)] + [(55, t, "user", "deep" if t < 60 else f"other {t}") for t in range(90)]
    rows += [(c, t, rng.choice("ab"), rng.choice(["p", "q", "pq"])) for c in range(100, 180) for t in range(rng.randrange(12))]
    return [(*r, 0, "n", "d") for r in rows]


@pytest.mark.parametrize("height", [3, 8])
def test_edge_cases_and_band_heights(spark, height):
    rows = edge_rows()
    turns = conversation_trie.keyed(spark.createDataFrame(rows, SCHEMA))
    own = ordered([r[:4] for r in rows])
    assert rows_of(conversation_trie.trie(turns, turns.select("conv_id"), height)) == brute(own)
    if height == 8:
        assert rows_of(conversation_trie.trie(queries.regrown(turns), turns.select("conv_id"), height)) == brute(regrown(own))


def test_blocks_of_bands(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "BUCKET", 8)
    rows = edge_rows()
    turns = conversation_trie.keyed(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(conversation_trie.trie(turns, turns.select("conv_id"))) == brute(ordered([r[:4] for r in rows]))


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    turns = conversation_trie.keyed(none)
    assert conversation_trie.trie(turns, turns.select("conv_id")).isEmpty()
    got = rows_of(conversation_trie.trie(turns, spark.createDataFrame([(4,), (2,), (None,)], "conv_id long")))
    assert got == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
