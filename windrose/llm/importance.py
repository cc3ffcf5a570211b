"""Quality selection by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target texts and one of all raw texts, give each document a log
importance weight, the sum over its n-grams of the log ratio. Gumbel noise drawn from a hash of the id makes
the largest keys a sample without replacement in proportion to the weights.

The raw model counts all documents; the target model counts the documents of at most ``TARGETS`` labelled ids, smallest
hash first. Both are vectors of ``BUCKETS`` numbers, whatever the data's size. The threshold of the top k is found
by four histograms of 65,536 bins over the sortable bits of the keys, never by a global sort.

Cases: null or empty texts have weight 0; without target documents all weights are 0; equal keys at the threshold
(repeated rows) are kept together; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, RollingHash, byte_strings, materialize, word_bounds

BUCKETS, TARGETS, SHARE, SEED = 1 << 14, 20_000, 0.85, 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buckets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each unigram and bigram, its row) of a batch of texts."""
    data, ends = byte_strings(texts)
    joined = np.full(len(data) + len(ends) - 1, 32, np.uint8)  # a blank after each text
    gaps = np.arange(len(ends))
    keep = np.ones(len(joined), bool)
    keep[ends[1:] + gaps[:-1]] = False
    joined[keep] = _LOWER[data]
    start, end = word_bounds(joined)
    words = RollingHash(BYTE_CODES[joined]).windows(start, end)
    row = np.searchsorted(ends + gaps, start, "right") - 1
    two = np.flatnonzero(row[1:] == row[:-1])
    pairs = words[two] * np.uint64(0x9E3779B97F4A7C15) + words[two + 1]
    return np.concatenate([words, pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1), np.concatenate([row, row[two]])


def slices(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def count_model(docs: DataFrame, targets: np.ndarray, id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                found, row = buckets_of(part.column(1))
                found = found.astype(np.int64)
                raw += np.bincount(found, minlength=BUCKETS)
                own = np.isin(part.column(0).to_numpy(zero_copy_only=False), targets)
                target += np.bincount(found[own[row]], minlength=BUCKETS)
        yield pa.record_batch([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    sums = docs.select(F.coalesce(F.col(id), F.lit(-(2**63))).alias(id), text).mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = sums.toPandas().set_index("bucket").reindex(range(BUCKETS), fill_value=0)
    return table["raw"].to_numpy(np.float64), table["target"].to_numpy(np.float64)


def log_weights(docs: DataFrame, ratio: np.ndarray, id: str, text: str) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, row = buckets_of(part.column(1))
                weight = np.bincount(row, ratio[found.astype(np.int64)], part.num_rows)
                yield pa.record_batch([part.column(0), pa.array(np.round(weight, 9) + 0.0)], ["doc_id", "log_weight"])

    return docs.select(F.col(id).cast("long").alias(id), text).mapInArrow(score, "doc_id long, log_weight double")


def threshold(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, from four histograms."""
    prefix, within = 0, rows
    for shift in (48, 32, 16, 0):
        bins = F.shiftright(F.col(column), shift) if shift == 48 else F.shiftright(F.col(column), shift).bitwiseAND(F.lit(65535))
        for value, n in sorted(within.groupBy(bins.alias("bin")).count().collect(), reverse=True):
            if k <= n:
                break
            k -= n
        prefix = prefix << 16 | value if shift != 48 else value
        within = rows.where(F.shiftright(F.col(column), shift) == prefix)
    return prefix


def importance(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of every row. targets: column doc_id of good documents."""
    ids = targets.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS)
    chosen = np.array(sorted(r[0] for r in ids.collect()), np.int64)
    raw, target = count_model(docs, chosen, id, text)
    ratio = np.zeros(BUCKETS)
    if target.sum():
        ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12).cast("double") + 0.5) / F.lit(2.0**52)
    keyed = log_weights(docs, ratio, id, text).withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(uniform)), 9))
    # keys as integers of the same order, in steps of 1e-9
    scored = materialize(keyed.withColumn("__order", F.round(F.col("gumbel_key") * 1e9).cast("long")))
    total = scored.count()
    k = int(np.ceil(total * share))
    if not k:
        return scored.withColumn("kept", F.lit(False)).drop("__order")
    return scored.withColumn("kept", F.col("__order") >= threshold(scored, "__order", k)).drop("__order")
