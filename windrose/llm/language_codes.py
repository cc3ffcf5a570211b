"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed byte trigrams separates the languages whose bit is 1
from the others: its weights are the log ratio of the two sides' mean trigram distributions. A text's margin
for a bit is the mean weight of its trigrams. Decoding sums the logistic loss of the margins against each
codeword, weighted by how well the bit separates the training data, and chooses the least; the score is the
share of the best codeword in the softmax of the negated losses, and texts whose two best are close are ambiguous.

Training counts are sums by language and bucket over all training rows, combined before the shuffle; the model is
``BUCKETS`` numbers for each bit. Prediction is one pass without a shuffle.

Cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every text is ``und``;
rows without language don't train; an empty table gives no rows; further columns are dropped; more than
``LANGUAGES`` languages raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_strings

BUCKETS, LANGUAGES, SHARPNESS, CLOSE = 1 << 14, 512, 6.0, 0.6
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def codewords(n: int) -> np.ndarray:
    """A row of bits for each of n classes: all splits for few classes, else pseudo-random ones.

    No column is constant, equal to another or its complement, and rows differ in at least an eighth of the bits.
    """
    if n <= 5:
        splits = np.arange(1, max(2 ** (n - 1), 2))
        return np.array([[1 if i == n - 1 else s >> i & 1 for s in (2 ** (n - 1) - 1 - splits)] for i in range(n)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    draw = np.random.default_rng(n)
    while True:
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            column = draw.integers(0, 2, n).astype(np.int8)
            column ^= column[0]
            if column.any():
                columns[column.tobytes()] = column
        code = np.stack(list(columns.values()), 1).astype(int)
        apart = code @ (1 - code).T + (1 - code) @ code.T  # bits in which two rows differ
        if (apart + bits * np.eye(n, dtype=np.int8)).min() >= bits / 8:
            return code.astype(np.int8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, offsets of the texts) of a batch."""
    data, ends = byte_strings(texts)
    codes = _LOWER[data]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.zeros(len(ends), np.int64)
    mixed = ((codes[:-2] << np.uint32(16) | codes[1:-1] << np.uint32(8) | codes[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    inside = np.ones(len(mixed), bool)
    for k in (1, 2):
        edge = ends[1:-1] - k
        inside[edge[(edge >= 0) & (edge < len(mixed))]] = False
    return mixed[inside].astype(np.int64), np.concatenate([[0], np.cumsum(inside)])[np.minimum(ends, len(mixed))]


def slices(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


class Codes:
    """A fitted model: language names, codewords, and weights by bucket and bit."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.code = names, codewords(len(names)) * 2.0 - 1
        shares = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
        bits = self.code.shape[1] if names else 0
        weights, self.trust = np.zeros((BUCKETS, bits)), np.ones(bits)
        for b in range(bits):
            one, none = self.code[:, b] > 0, self.code[:, b] < 0
            if one.any() and none.any():
                weights[:, b] = np.log(shares[one].mean(0)) - np.log(shares[none].mean(0))
                # how far the bit's mean margins stand apart in the training counts
                self.trust[b] = max(1e-3, float((self.code[:, b] * (shares @ weights[:, b])).mean()))
        self.trust /= max(self.trust.sum(), 1e-9)
        self.weights = weights.astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, score, whether the next is close)."""
        found, ends = trigrams(texts)
        margins = np.zeros((len(ends) - 1, self.code.shape[1]))
        for b in range(margins.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[found, b], dtype=np.float64)])
            margins[:, b] = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(ends[1:] - ends[:-1], 1)
        losses = np.stack([(np.logaddexp(0, -SHARPNESS * margins * c) * self.trust).sum(1) for c in self.code], 1)
        share = np.exp(SHARPNESS * (losses.min(1, keepdims=True) - losses))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        score = share[np.arange(len(best)), best]
        return best, np.round(score, 6), score < CLOSE


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Codes:
    """docs: the training rows."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = sorted(r[0] for r in known.select(lang).distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not names:
        return Codes([], np.zeros((0, BUCKETS)))
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch):
                found, ends = trigrams(part.column(0))
                own = np.array([number[x] for x in part.column(1).to_pylist()])
                sums += np.bincount(np.repeat(own, np.diff(ends)) * BUCKETS + found, minlength=sums.size).reshape(sums.shape)
        at, bucket = np.nonzero(sums)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[at, bucket])], ["lang", "bucket", "n"])

    rows = known.select(text, lang).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Codes(names, counts)


def predict(docs: DataFrame, model: Codes, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lettered = np.array(part.column(2).to_pylist(), bool)
                if model.names:
                    best, score, close = model.predict(part.column(1))
                    named = [model.names[b] if ok else "und" for b, ok in zip(best, lettered)]
                    score, close = np.where(lettered, score, 0.0), close & lettered
                else:
                    named, score, close = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                yield pa.record_batch([part.column(0), pa.array(named, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return plain.mapInArrow(label, "doc_id long, lang_pred string, score double, ambiguous boolean")
