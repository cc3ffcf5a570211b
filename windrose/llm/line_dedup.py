"""Removal of repeated lines by overlapping windows of three lines. DataFrame functions only.

Each three consecutive lines of a document are a window, named by two independent hashes of the whole lines. The
first occurrence of a window (smaller ``doc_id``, then position) stays; the lines that later occurrences
cover are removed, the covered positions of a document being merged. Windows are judged on the input.

Plan: one aggregation by window that combines before the shuffle, one join of the windows with those
found more than once (AQE splits its hot keys), one join of documents with their own positions.

Cases: a null text stays null; fewer than three lines keep all; a window of three lines without a word
is none; rows sharing a ``doc_id`` are documents of their own, in the order of their texts' hashes (rows equal in id and text are one, and
lose lines alike); a null ``doc_id`` counts as the largest; an empty table gives no rows; other columns are kept, also by clashing names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a line without a word is made of.
BLANKS = " \t\n\v\f\r"


def windows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(name, check, doc, row, at) of each window; ``row`` tells rows of one id apart, ``at`` is its first line."""
    lines = docs.select(F.coalesce(F.col(id), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines")).where(F.size("lines") >= 3)
    hashed = lines.select(
        "doc", "row",
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"), (F.length(F.trim(x, F.lit(BLANKS))) > 0).alias("word"))).alias("h"),
    )
    spread = hashed.select("doc", "row", F.posexplode(F.arrays_zip(F.slice("h", 1, F.size("h") - 2).alias("x"), F.slice("h", 2, F.size("h") - 2).alias("y"), F.slice("h", 3, F.size("h") - 2).alias("z"))).alias("at", "w"))
    three = [F.col(f"w.{c}") for c in "xyz"]
    return spread.where(three[0]["word"] | three[1]["word"] | three[2]["word"]).select(
        F.xxhash64(*[w["a"] for w in three]).alias("name"), F.hash(*[w["b"] for w in three]).alias("check"), "doc", "row", "at"
    )


def repeated_lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, row, gone): the positions of lines that later occurrences of windows cover."""
    windows = windows_of(docs, id, text)
    first = windows.groupBy("name", "check").agg(F.count("*").alias("n"), F.min(F.struct("doc", "row", "at")).alias("first")).where("n > 1")
    later = windows.join(first, ["name", "check"]).where(F.struct("doc", "row", "at") > F.col("first"))
    return later.groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_set(F.array(F.col("at"), F.col("at") + 1, F.col("at") + 2)))).alias("gone"))


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", removed: str = "n_lines_removed") -> DataFrame:
    """``docs`` with ``text`` without the removed lines, and their number in ``removed``."""
    gone = repeated_lines(docs, id, text).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.array_sort("gone").alias("__gone"))
    joined = docs.drop(removed).withColumn("__doc", F.coalesce(F.col(id), F.lit(2**63 - 1))).withColumn("__row", F.xxhash64(text)).join(gone, ["__doc", "__row"], "left")
    # keep what lies between covered positions: each gap is one slice of the lines
    lines, gone_ = F.col("__lines"), F.col("__gone")
    marked = joined.withColumn("__lines", F.when(gone_.isNotNull(), F.split(text, "\n")))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone_, lambda x: x + 1))
    ends = F.concat(gone_, F.array(F.size(lines)))
    gaps = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"])
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"]))), "\n")
    out = marked.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    return out.withColumn(removed, F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).select(*docs.drop(removed).columns, removed)
