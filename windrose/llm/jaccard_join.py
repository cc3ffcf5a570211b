"""Jaccard join of n-gram sets by vertical partitioning of the global n-gram order.

The order is that of 64-bit hashes, cut into fragments. Two sets of similarity ``percent`` differ in at most D n-grams (D from
their sizes), and each of these spoils one fragment: of D + D/4 + 2 fragments, at least D/4 + 2 agree. A document of which fewer
fragments occur elsewhere (or are empty) is linked with nothing and goes no further. The rest are joined inside their
agreeing fragments, but for the most common ones that each can spare. Overlaps of the pairs are counted fragment by fragment, separately, and summed per pair. Sizes are put in
classes so narrow that only neighbouring classes can link; each class is cut for itself and for its lower neighbour.

Documents of equal sets are one node. A group of nodes never makes all its pairs: in each round a few leaders are compared with those
of other components only, and pairs whose sizes or parities prove them too different fall in the join's condition; a
group is done when its nodes are one component or all have led. No cap loses a link.

Cases: texts that are null or have no words have an empty set and no link; fewer words than ``n``
make one n-gram of all; repeated rows are copies; the links of a ``doc_id`` are those of all its rows with words; rows without ``doc_id``
link others, and come back with their set size and no component; an empty table gives no rows; further columns are dropped.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, RollingHash, materialize, mix, word_bounds
from .components import connected
from .repeats import MESSAGE, blocks, bucket_of, by_bucket, messages, narrow, ordered, pieces, repeated_keys, widen

#: Fragments of the order in which overlaps are counted.
COUNTED = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PROFILE = "doc long, no_id boolean, n long, low long, high long, keys array<struct<key:long,cut:int,need:int>>, parities array<array<long>>, fragments array<array<long>>"
_KEY = pa.struct([("key", pa.int64()), ("cut", pa.int32()), ("need", pa.int32())])


def ngram_sets(table: pa.Table, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a block."""
    out = []
    for _, data, ends in pieces(table):
        start, end = word_bounds(data)
        words = RollingHash(BYTE_CODES[_LOWER[data]]).windows(start, end)
        cut = np.searchsorted(start, ends)
        at = np.arange(max(len(words) - n + 1, 0))
        grams, rolling = np.empty(0, np.uint64), RollingHash(words)
        if len(at):
            grams = rolling.windows(at, at + n)
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            else:
                out.append(mix(rolling.windows(np.array([a]), np.array([b])) + np.uint64(b - a)) if b > a else grams[:0])
    return out


class Cut:
    """A set's fragments: their names, which are empty, and how many must agree in a link."""

    def __init__(self, grams: np.ndarray, size_class: int, differ: int):
        c, self.need = size_class, differ // 4 + 2
        parts = differ + self.need
        at = np.searchsorted(bucket_of(grams, parts), np.arange(parts + 1))
        worth = mix(grams + np.uint64(c))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(worth)])
        salt = mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32))
        names = mix(sums[at[1:]] - sums[at[:-1]] + salt)
        full = at[1:] > at[:-1]
        self.names, gaps = names[full] >> np.uint64(1), np.flatnonzero(~full)
        self.empty, self.spare = len(gaps), self.names[:0]
        if self.empty >= self.need:
            # Sets may agree in nothing but empty fragments. Then each other fragment differs by one n-gram, and in one that both
            # fill, one of them without one n-gram is the other's.
            part = bucket_of(grams, parts)
            one = mix(sums[at[part + 1]] - sums[at[part]] - worth + salt[part])
            near = np.concatenate([names[full], one])
            a, b = np.triu_indices(len(gaps), 1)
            self.spare = np.unique(mix(near[:, None] + mix(salt[gaps[a]] * np.uint64(3) + salt[gaps[b]])[None]).ravel() >> np.uint64(1))


class Sizes:
    """Classes of set sizes: sizes two classes apart can't reach ``percent``."""

    def __init__(self, percent: int, most: int):
        self.low = [1]
        self.differ = []  # most n-grams in which sets differ, where the smaller is of the class
        while self.low[-1] <= most:
            self.low.append(self.low[-1] * 100 // percent + 1)
            self.differ.append((self.low[-1] - 1) * (100 - percent) // percent)

    def cuts(self, grams: np.ndarray) -> list[tuple[int, Cut]]:
        """(class, fragments) for the set's own class and for the one below; classes in which sets can't differ have none."""
        if not len(grams):
            return []
        own = int(np.searchsorted(self.low, len(grams), "right")) - 1
        return [(c, Cut(grams, c, self.differ[c])) for c in (own, own - 1) if c >= 0 and self.differ[c]]

    def parity(self, grams: np.ndarray, c: int) -> np.ndarray:
        """For each of at least four times as many bits as n-grams of the class: whether an odd number of n-grams falls on it."""
        bits = max(256, 1 << (4 * self.low[c] - 1).bit_length())
        odd = (np.bincount((mix(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)
        return np.packbits(odd).view(np.int64)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Those of ``values`` that are in ``known``, which is sorted and not empty."""
    return values[known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values]


def totals(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for the set."""
    return tuple(int(np.int64(np.add.reduce(mix(grams + np.uint64(k)), dtype=np.uint64).view(np.int64))) if len(grams) else 0 for k in (1, 2))


def heads_of(table: pa.Table, n: int) -> tuple[list[np.ndarray], list[tuple], list[bool]]:
    """Sets, their sums, and whether the row is the block's first of its set."""
    sets = ngram_sets(table, n)
    seen: set[tuple] = set()
    sums, first = [(len(s), *totals(s)) for s in sets], []
    for name in sums:
        first.append(name[0] > 0 and name not in seen)
        seen.add(name)
    return sets, sums, first


def candidates(docs: DataFrame, id: str, text: str, n: int, percent: int) -> DataFrame:
    """A row for each document; keys, parities and fragments are null for all but those of which enough fragments occur elsewhere."""
    own, buckets = blocks(docs, id, text)

    def screen(key: tuple, table: pa.Table) -> pa.Table:
        sets, _, first = heads_of(ordered(table), n)
        sizes = Sizes(percent, max(map(len, sets), default=0))
        found = [np.concatenate([cut.names, cut.spare]) for s, head in zip(sets, first) if head for _, cut in sizes.cuts(s)]
        if not found:
            return messages([])
        name, count = np.unique(np.concatenate(found), return_counts=True)
        sent = name << np.uint64(1) | (count > 1).astype(np.uint64)
        return messages(by_bucket(sent, bucket_of(sent, buckets), key[0].as_py(), lambda x: narrow(x, 8)))

    def profile(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = ordered(table)
        sets, sums, first = heads_of(table, n)
        sizes = Sizes(percent, max(map(len, sets), default=0))
        wanted = np.sort(widen(answers.column("blob").to_pylist(), 8) >> np.uint64(1))
        keys, fragments, parities = [], [], []
        for grams, head in zip(sets, first):
            mine, odd = [], []
            for k, (c, cut) in enumerate(sizes.cuts(grams) if head and len(wanted) else ()):
                again = among(cut.names, wanted)
                odd.append((c, grams))
                if len(again) + cut.empty >= cut.need:
                    mine += [{"key": x, "cut": k, "need": cut.need - cut.empty} for x in np.concatenate([again, among(cut.spare, wanted)]).view(np.int64).tolist()]
            keys.append(mine or None), parities.append([sizes.parity(s, c) for c, s in odd] if mine else None)
            cut = np.searchsorted(bucket_of(grams, COUNTED), np.arange(COUNTED + 1))
            fragments.append([grams[a:b].view(np.int64) for a, b in zip(cut[:-1], cut[1:])] if mine else None)
        size, low, high = zip(*sums) if sums else ((), (), ())
        lists = pa.list_(pa.list_(pa.int64()))
        return pa.table(
            [table.column("doc"), table.column("no_id"), pa.array(size, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
             pa.array(keys, pa.list_(_KEY)), pa.array(parities, lists), pa.array(fragments, lists)],
            ["doc", "no_id", "n", "low", "high", "keys", "parities", "fragments"],
        )

    answers = repeated_keys(own.groupBy("block").applyInArrow(screen, MESSAGE))
    return own.groupBy("block").cogroup(answers.groupBy("key")).applyInArrow(profile, PROFILE)


def differing(a: Column, b: Column) -> Column:
    """Bits in which parities differ: no more than n-grams that only one of two sets has, since each turns one bit."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def count_overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b, shared) of pairs (a, b); fragments: (node, part, grams). Each fragment is joined and counted on its own."""
    left = fragments.select(F.col("node").alias("a"), "part", F.col("grams").alias("left"))
    right = fragments.select(F.col("node").alias("b"), "part", F.col("grams").alias("right"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"))
    return partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def linked(members: DataFrame, fragments: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, root) of nodes in one component with a smaller one. members: (key, node, n, parity); known: edges (a, b) to begin with."""
    spark = members.sparkSession
    edges = materialize(known)
    tested = spark.createDataFrame([], "a long, b long")
    roots, few = connected(edges), 1
    while True:
        named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least < most")
        members = materialize(named.join(open_.select("key", "size"), "key"))
        if members.isEmpty():
            return roots
        # leaders are drawn by hash, about ``few`` of each group: the leaders of a group lead in smaller ones as well
        leads = F.pmod(F.xxhash64("node", F.lit(few)), F.lit(1 << 31)) * F.col("size") <= few << 31
        lead = members.where(leads).select("key", F.col("node").alias("a"), F.col("n").alias("size_a"), F.col("parity").alias("left"), F.col("root").alias("own"))
        sizes = F.col("n") + F.col("size_a")
        near = [F.col("root") != F.col("own"), 100 * F.least("n", "size_a") >= percent * F.greatest("n", "size_a"), (100 + percent) * differing(F.col("left"), F.col("parity")) <= (100 - percent) * sizes]
        met = members.join(lead, (members["key"] == lead["key"]) & reduce(Column.__and__, near))
        pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), sizes.alias("sizes")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"))
        whole = count_overlaps(pairs.select("a", "b"), fragments).join(pairs, ["a", "b"])
        found = materialize(whole.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b"))
        tested = tested.unionByName(pairs.select("a", "b"))
        members = members.where(~leads).drop("root", "size")
        few *= 8
        if not found.isEmpty():
            edges = edges.unionByName(found)
            roots = connected(edges)


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest document that links reach."""
    table = materialize(candidates(docs, id, text, n, percent))
    heads = table.where(F.col("keys").isNotNull()).dropDuplicates(["n", "low", "high"])
    heads = materialize(heads.select(F.col("low").alias("node"), "n", "keys", "parities", "fragments"))
    keyed = heads.select(F.explode("keys").alias("k"), "node").select("k.*", "node")
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
    groups = materialize(groups.where("size > 1"))
    one = groups.groupBy("size", "least", "all").agg(F.min("key").alias("rep"))  # stands for keys with the same members
    groups = groups.join(one, ["size", "least", "all"]).select("key", "size", "rep")
    # linked sets share ``need`` keys at least: each can spare its need - 1 largest groups and still meets the other in the first they share
    own = keyed.join(groups, "key").groupBy("node", "cut").agg(F.sort_array(F.collect_list(F.struct("size", "key", "rep"))).alias("own"), F.max("need").alias("need"))
    kept = own.select("node", "cut", F.explode(F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - F.greatest(F.lit(0), F.col("need") - 1)))).alias("k")).select(F.col("k.rep").alias("key"), "node", "cut")
    chosen = kept.distinct()
    members = materialize(chosen.join(heads.select("node", "n", "parities"), "node").select("key", "node", "n", F.get("parities", F.col("cut")).alias("parity")))
    fragments = heads.select("node", F.posexplode("fragments").alias("part", "grams"))
    # rows that share an id are linked
    worded = table.where("n > 0")
    ids = worded.where("not no_id").groupBy("doc").agg(F.min("low").alias("a"), F.max("low").alias("most")).where("a < most").select("doc", "a")
    same = worded.where("not no_id").join(ids, "doc").where("low != a").select("a", F.col("low").alias("b")).distinct()
    roots = linked(members, fragments, same, percent)
    classes = worded.groupBy("low").agg(F.min(F.when(~F.col("no_id"), F.col("doc"))).alias("least"))
    classes = classes.join(roots, classes["low"] == roots["node"], "left").select("low", "least", F.coalesce("root", "low").alias("root"))
    whole = classes.groupBy("root").agg(F.min("least").alias("component"))
    out = table.select("doc", "no_id", "n", "low").join(classes.join(whole, "root").select("low", "component"), "low", "left")
    known = ~F.col("no_id")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(F.when(known, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, component).alias("component_id"))
