"""Quality rules with columns of the operator's own names, and leaks in rows without an id or with an id of a clean row."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrose.llm import decontamination, quality_outliers

CLASHES = ("by", "x0", "g0", "g1", "m0", "l00", "d2", "s", "distance", "kept", "n", "fits", "o0", "__row", "n_words", "a.b")


def test_quality_rules_ignore_further_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    wide = docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in CLASHES], "lang", "source")
    plain, out = quality_outliers.quality_outliers(docs), quality_outliers.quality_outliers(wide)
    own = [c for c in plain.columns if c not in docs.columns]
    assert out.columns == ["doc_id", *[c for c in CLASHES if c not in own], "lang", "source", *own]
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "lang", "source", *own).collect()), key=repr)
    assert rows(out) == rows(plain) and {r["a.b"] for r in out.select("`a.b`").collect()} == {"a.b"}


def test_leaks_go_by_text_and_not_by_id(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly boxed"
    rows = [(None, f"so {item} end"), (1, f"so {item.upper()}"), (1, "a clean text of the same id"), (None, "clean and without an id"), (2, None), (3, ""), (4, f"so {item} end")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontamination.without_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(1, "a clean text of the same id"), (None, "clean and without an id"), (2, None), (3, "")], key=repr)
    assert decontamination.without_leaks(docs.limit(0), bench).isEmpty()
