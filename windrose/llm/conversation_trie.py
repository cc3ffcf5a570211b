"""Prefix trie of conversations with subtree totals by a depth-band rollup. DataFrame functions but for the digests of member lists.

``keyed`` orders the turns of each conversation and gives them places and two 64-bit hashes; ``trie`` makes a node of each
distinct sequence of first turns. A node's name is its depth and the exclusive-or of its turns' hashes with their places
(2 x 64 bits), so a parent's name follows from its child's, and names of long conversations come from sums of blocks.

Rollup: depths are cut into bands of ``height``. A node's values go to its ancestors within its band only, whose names its smallest
member's path has. Band roots with what their bands hold are a tree of their own, ``height`` times as flat, which is rolled up in
the same way; its totals then go from each band root to the nodes of its path in the band above. So a value is copied at most
2 x ``height`` times, and rounds grow with the logarithm of the depth.

Scale: turns are ordered by a range sort, so a conversation may span tasks; names, nodes, children and totals come from aggregations that
combine before the shuffle; joins that a node with very many children makes uneven are plain equi-joins, which AQE splits. Lists of ended
members are joined in buckets of at most ``BUCKET`` ids, and a node's buckets are streamed through one digest, which is sequential by definition.

Cases: rows without a conversation id belong to none; a null role or text is an empty one; turns sort nulls first, equal ones by
role and text, and repeated rows are turns of their own; a conversation of any length goes through; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ids joined into one text, and bands whose names one window sums.
BUCKET, BLOCK = 1 << 16, 1024
NODE = ["depth", "a", "b"]
_ENDS = "depth long, a long, b long, ends_sha256 string"


def keyed(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, a, b, bytes): the place of each turn from 1 on, two hashes of its role and text, the UTF-8 bytes of its text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # rows of a partition are numbered without gaps, and a conversation's rows lie together in each of its partitions
    marked = materialize(
        ordered.select(
            "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"),
            F.xxhash64(F.lit("a"), "role", "text").alias("a"), F.xxhash64(F.lit("b"), "role", "text").alias("b"), F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    parts = marked.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return marked.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "a", "b", "bytes")


def xor_before(rows: DataFrame, key: str, index: str, values: list[str]) -> DataFrame:
    """``rows`` with the exclusive-or of each of ``values`` over the key's rows of smaller index, as ``before_<value>``; blocks of indices first, then what precedes each block."""
    rows = rows.withColumn("__block", F.floor(F.col(index) / BLOCK))
    preceding = lambda c, w: F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = rows.groupBy(key, "__block").agg(*[F.bit_xor(v).alias(v) for v in values])
    across = Window.partitionBy(key).orderBy("__block")
    blocks = blocks.select(key, "__block", *[preceding(v, across).alias(f"__{v}") for v in values])
    within = Window.partitionBy(key, "__block").orderBy(index)
    own = rows.select("*", *[preceding(v, within).alias(f"before_{v}") for v in values]).join(blocks, [key, "__block"])
    summed = [F.col(f"before_{v}").bitwiseXOR(F.col(f"__{v}")).alias(f"before_{v}") for v in values]
    return own.select(*[c for c in rows.columns if c != "__block"], *summed)


def paths_of(turns: DataFrame, height: int) -> DataFrame:
    """(conv_id, band, names): the nodes that each conversation passes in each band, from above: depth, name, parent's name, bytes. The root is left out."""
    steps = turns.select("conv_id", "at", F.xxhash64("a", "at").alias("a"), F.xxhash64("b", "at").alias("b"), "bytes")
    bands = steps.groupBy("conv_id", F.floor(F.col("at") / height).alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("at", "a", "b", "bytes"))).alias("turns"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb")
    )
    known = xor_before(bands, "conv_id", "band", ["xa", "xb"])

    def name(t: Column, i: Column) -> Column:
        upto = F.slice("turns", F.lit(1), i + 1)
        a, b = [F.aggregate(F.transform(upto, lambda x: x[c]), F.col(f"before_x{c}"), lambda s, x: s.bitwiseXOR(x)) for c in "ab"]
        return F.struct(t["at"].alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(t["a"]).alias("up_a"), b.bitwiseXOR(t["b"]).alias("up_b"), t["bytes"].alias("bytes"))

    return known.select("conv_id", "band", F.transform("turns", name).alias("names"))


def rolled_up(nodes: DataFrame, paths: DataFrame, values: list[str], height: int, last_band: int) -> DataFrame:
    """(node, values): sums of the values over each node's subtree.

    nodes: (node, k, rep, values), k being the node's depth in this tree and rep a key of ``paths`` that passes it; paths: (rep, band, path),
    path holding the nodes of that band from above.
    """
    sums = [F.sum(v).alias(v) for v in values]
    own = nodes.withColumn("band", F.floor(F.col("k") / height)).join(paths, ["rep", "band"])
    lifted = own.select(F.explode(F.slice("path", F.lit(1), (F.col("k") - F.col("band") * height + 1).cast("int"))).alias("node"), *values)
    inside = lifted.groupBy("node").agg(*sums)
    if last_band <= 0:
        return inside
    inside = materialize(inside)  # read twice below, and so at each level
    roots = nodes.where(F.col("k") % height == 0).select("node", (F.col("k") / height).cast("long").alias("k"), "rep").join(inside, "node")
    above = paths.groupBy("rep", F.floor(F.col("band") / height).alias("upper")).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", F.element_at("path", 1).alias("node")))), lambda x: x["node"]).alias("path"))
    totals = rolled_up(roots, materialize(above.withColumnRenamed("upper", "band")), values, height, last_band // height)
    passed = roots.select("node", "rep", (F.col("k") - 1).alias("band")).where("band >= 0").join(totals, "node").join(paths, ["rep", "band"])
    return inside.unionByName(passed.select(F.explode("path").alias("node"), *values)).groupBy("node").agg(*sums)


def ended(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of each node at which conversations end: the digest of their ids, ascending, joined by commas."""
    bucket = F.floor(F.col("conv_id") / BUCKET).alias("bucket")
    texts = ends.groupBy(*NODE, bucket).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for *at, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if at != node:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.record_batch(list(zip(*out)) if out else [[]] * 4, schema=schema)
        if node is not None:
            yield pa.record_batch([[x] for x in (*node, digest.hexdigest())], schema=schema)

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "bucket").select(*NODE, "ids").mapInArrow(digests, _ENDS)


def trie(turns: DataFrame, ids: DataFrame, height: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    turns: as ``keyed`` gives them, places from 1 without gaps; ids: (conv_id) of all conversations, those without turns too. A node is named by
    its smallest member and its depth; saved_tokens counts bytes that members after the first share with it.
    """
    ids = ids.select("conv_id").where("conv_id is not null").distinct()
    paths = materialize(paths_of(turns, height))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    rows = paths.select("conv_id", F.explode("names").alias("x")).select("conv_id", "x.*")
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"))
    zero = F.lit(0).cast("long")
    nodes = nodes.unionByName(root.select(*[zero.alias(c) for c in (*NODE, "bytes")], "conv_id", "n_convs", F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b")))
    nodes = materialize(nodes)

    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))

    # the root begins the path of every conversation
    node = lambda x: F.struct(x["depth"].alias("depth"), x["a"].alias("a"), x["b"].alias("b"))
    passed = F.transform("names", node)
    top = F.array(F.struct(*[zero.alias(c) for c in NODE]))
    found = paths.select(F.col("conv_id").alias("rep"), "band", F.when(F.col("band") == 0, F.concat(top, passed)).otherwise(passed).alias("path"))
    # a conversation that has no turn in the first band passes the root alone
    first = paths.where("band = 0").select("conv_id")
    found = found.unionByName(ids.join(first, "conv_id", "left_anti").select(F.col("conv_id").alias("rep"), zero.alias("band"), top.alias("path")))
    last = paths.agg(F.max("band")).first()[0] or 0
    values = ["n_leaves", "saved_tokens"]
    weighed = counted.select(
        F.struct(*NODE).alias("node"), F.col("depth").alias("k"), F.col("conv_id").alias("rep"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = rolled_up(weighed, found, values, height, last).select("node.*", *values)

    lasts = paths.groupBy("conv_id").agg(F.max(F.struct(*[F.element_at("names", -1)[c].alias(c) for c in NODE])).alias("end"))
    ends = ids.join(lasts, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in NODE])
    parents = nodes.select(F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = counted.withColumn("up_depth", F.col("depth") - 1).join(parents, ["up_depth", "up_a", "up_b"], "left").join(totals, NODE).join(ended(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
