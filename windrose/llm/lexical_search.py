"""Ranked lexical search by hashed max-sketches: upper bounds of all documents' scores, and exact scores only where a bound calls for them.

``build`` counts the corpus, then writes an index: each document with a sketch of its terms. A sketch has a power of two of cells, at least
``CELLS`` times its distinct terms; each term's impact (the most it can add to a score) is folded into three cells by hashes of the term, where the largest
stays, rounded up to one byte. A query's terms are looked up for a batch of documents at once: the least of a term's cells is never below its impact, so their sum is never below the score.

``search`` takes queries in blocks of at most ``QUERY_BYTES``, each in two passes over the index. The first reads the sketches only and scores exactly the
``FIRST`` documents of highest bound for each query: the ``k``-th best of these is a score that the result must reach. The second goes down each batch's bounds and scores
exactly until the bound falls below what the best ``k`` so far need; only documents that reach the bound are read as text.

Scale: the corpus is counted by one aggregation of terms that is combined in the tasks; the weights of the ``HEAVY`` most frequent terms
go to all tasks (a fixed size), other terms' impacts are bounded by the rarest term's weight; no text is shuffled, and no task
keeps more than a batch and ``k`` results a query. The driver holds one block of queries, their terms' weights and thresholds.

Scores: a term's weight is floor(1000 ln((2N+2) / (2 df+1))); a document's is the sum over the query's terms, repeats included, of
weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L. N documents have a term, L terms in all, n in the document.

Cases: a null or empty text has no terms, is in no result, and as a query finds nothing; rows of one id are documents (or queries) of their own; a null id is the
last among equal scores and comes back as null; equal scores go by id, then by the order of the index; an empty corpus or query table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latest import top_per_key
from .common import materialize, shared_dir

HEAVY, FIRST, QUERY_BYTES, MEMO, CELLS = 1 << 16, 32, 8 << 20, 300_000, 8
#: Bytes to what they are in a term: blank for a separator, lower case for A to Z.
_PLAIN = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_INDEX = "row long, doc_id long, text string, n long, sketch binary"
_BOUND = "query long, row long, bound long"
_SCORE = "query long, row long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def corpus_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, total): documents that hold a term; the null term counts documents with a term and, as total, all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, total = Counter(), 0, 0
        schema = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64())])
        for batch in batches:
            for value in batch.column(0):
                own = terms(value.as_py())
                documents += bool(own)
                total += len(own)
                held.update(set(own))
                if len(held) > MEMO:
                    yield pa.record_batch([[*held], [*held.values()], [0] * len(held)], schema=schema)
                    held.clear()
        yield pa.record_batch([[*held, None], [*held.values(), documents], [*[0] * len(held), total]], schema=schema)

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "term binary, df long, total long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


class Scale:
    """What scores take from the corpus."""

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total
        self.rarest = weight(documents, 1)
        #: A sketch's unit: 255 of them are more than any impact.
        self.unit = max(1, -(-self.rarest * 1_000_000 // 255))

    def norm(self, n: int) -> int:
        return 75 + (25 * n * self.documents) // self.total


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def cells(width: int, codes: np.ndarray) -> np.ndarray:
    """Three cells (columns) for each term's hash."""
    return (codes[:, None] * _MIX >> np.uint64(32)) & np.uint64(width - 1)


class Sketcher:
    def __init__(self, scale: Scale, heavy: dict[bytes, int]):
        self.scale, self.heavy, self.memo = scale, heavy, {}

    def code(self, term: bytes) -> tuple[int, int]:
        """(hash, weight); kept for other documents."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        known = self.memo[term] = zlib.crc32(term), self.heavy.get(term, self.scale.rarest)
        return known

    def __call__(self, own: list[bytes]) -> bytes:
        counts = Counter(own)
        known = self.memo.get
        both = np.array([known(t) or self.code(t) for t in counts], np.int64)
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        impact = both[:, 1] * (1_000_000_000 * tf // (1000 * tf + 12 * self.scale.norm(len(own))))
        width = max(64, 1 << (CELLS * len(counts) - 1).bit_length())
        sketch = np.zeros(width, np.uint8)
        order = np.argsort(impact)  # of those that share a cell the last, and largest, stays
        at = cells(width, both[order, 0].astype(np.uint64))
        sketch[at.ravel()] = np.repeat(-(-impact[order] // self.scale.unit), at.shape[1])
        return sketch.tobytes()


class Index:
    """An index in a folder of the shared file system: ``documents`` and ``terms`` tables and the corpus's two counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.documents = spark.read.schema(_INDEX).parquet(f"{folder}/documents")
        self.terms = spark.read.parquet(f"{folder}/terms")
        counts = json.loads(spark.read.text(f"{folder}/counts").first()[0])
        self.scale = Scale(counts["documents"], counts["total"])


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str | None = None) -> Index:
    """Write the index of all rows into ``folder`` (a new one of the shared folder, if none is named), which may not exist."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    corpus_terms(docs, text).write.parquet(f"{folder}/terms")
    found = spark.read.parquet(f"{folder}/terms")
    documents, total = found.agg(F.sum(F.when(F.col("term").isNull(), F.col("df"))), F.sum("total")).first()
    scale = Scale(documents or 0, total or 0)
    spark.range(1).select(F.lit(json.dumps({"documents": scale.documents, "total": scale.total})).alias("value")).write.text(f"{folder}/counts")
    most = found.where("term is not null").orderBy(F.desc("df"), "term").limit(HEAVY).collect()
    heavy = spark.sparkContext.broadcast({bytes(r.term): weight(scale.documents, r.df) for r in most})

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(scale, heavy.value)
        for batch in batches:
            own = [terms(t.as_py()) for t in batch.column("text")]
            sketches = pa.array([sketcher(t) if t else None for t in own], pa.binary())
            kept = pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, own), pa.int64()), sketches], ["row", "doc_id", "text", "n", "sketch"])
            yield kept.filter(pa.array([bool(t) for t in own]))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(sketched, _INDEX).write.option("compression", "zstd").parquet(f"{folder}/documents")
    return Index(spark, folder)


class Queries:
    """A block of queries in a task: their terms, weights and hashes."""

    def __init__(self, items: list[tuple[int, dict[bytes, int], int]], weights: dict[bytes, int], scale: Scale):
        self.scale = scale
        self.keys = [q for q, _, _ in items]
        self.counts = [{t: c * weights[t] for t, c in counts.items() if weights.get(t)} for _, counts, _ in items]
        self.least = [least for _, _, least in items]  # a score that a result must reach
        self.codes = [np.fromiter(map(zlib.crc32, c), np.uint64, len(c)) for c in self.counts]
        self.times = [np.array([counts[t] for t in c], np.int64) for (_, counts, _), c in zip(items, self.counts)]

    def bounds(self, sketches: pa.Array) -> np.ndarray:
        """Upper bounds of the scores of all queries (rows) for a batch of documents (columns), documents of one width at a time."""
        widths = np.array([len(s.as_buffer()) for s in sketches])
        out = np.zeros((len(self.keys), len(sketches)), np.int64)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            table = np.frombuffer(b"".join([sketches[i].as_buffer() for i in at.tolist()]), np.uint8).reshape(len(at), width).T
            for q, (codes, times) in enumerate(zip(self.codes, self.times)):
                a, b, c = cells(int(width), codes).T
                out[q, at] = times @ np.minimum(np.minimum(table[a], table[b]), table[c])
        return out * self.scale.unit

    def score(self, q: int, own: Counter, norm: int) -> int:
        get, total = own.get, 0
        for term, w in self.counts[q].items():
            tf = get(term)
            if tf:
                total += w * (1_000_000_000 * tf // (1000 * tf + 12 * norm))
        return total

    def document(self, text: str) -> tuple[Counter, int]:
        own = terms(text)
        return Counter(own), self.scale.norm(len(own))


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Rows of at most about QUERY_BYTES of text at a time: each block is collected by itself."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // QUERY_BYTES + 1
    for k in range(n):
        found = queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == k).collect()
        if found:
            yield found


def search(index: Index, queries: DataFrame, id: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """(<id>, rank, doc_id, score) of the k best documents of each query with a score above 0; equal scores by doc_id."""
    spark, folder = index.spark, f"{shared_dir(index.spark)}/found-{uuid.uuid4().hex}"
    numbered = materialize(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id).alias("name"), F.col(text).cast("string").alias("text")))
    schema = "query long, doc_id long, score long, rank int"
    parts = []
    for number, block in enumerate(_blocks(numbered.where("text is not null").select("query", "text"))):
        parts.append(f"{folder}/{number}")
        _block(index, [(r.query, Counter(terms(r.text))) for r in block], k).write.parquet(parts[-1])
    found = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return numbered.join(found, "query").select(F.col("name").alias(id), "rank", "doc_id", "score")


def _block(index: Index, block: list[tuple[int, Counter]], k: int) -> DataFrame:
    spark, scale = index.spark, index.scale
    wanted = spark.createDataFrame([(t,) for t in set().union(*[c for _, c in block])], "term binary")
    weights = {bytes(r.term): weight(scale.documents, r.df) for r in index.terms.join(F.broadcast(wanted), "term").collect()}
    sent = spark.sparkContext.broadcast(([(q, dict(c), 1) for q, c in block], weights))

    def best_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Queries(*sent.value, scale)
        heaps: list[list] = [[] for _ in own.keys]
        for batch in batches:
            rows, bounds = batch.column("row").to_numpy(), own.bounds(batch.column("sketch"))
            for heap, line in zip(heaps, bounds):
                top = np.argpartition(line, -FIRST)[-FIRST:] if len(line) > FIRST else np.arange(len(line))
                for bound, row in zip(line[top].tolist(), rows[top].tolist()):
                    if bound:
                        (heapq.heappush if len(heap) < FIRST else heapq.heappushpop)(heap, (bound, row))
        out = [(q, row, bound) for q, heap in zip(own.keys, heaps) for bound, row in heap]
        yield pa.record_batch(list(zip(*out)) if out else [[]] * 3, schema=pa.schema([(c, pa.int64()) for c in ("query", "row", "bound")]))

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Queries(*sent.value, scale)
        number = {q: i for i, q in enumerate(own.keys)}
        for batch in batches:
            out = []
            for text, queries_ in zip(batch.column("text").to_pylist(), batch.column("queries").to_pylist()):
                document = own.document(text)
                out += [(q, own.score(number[q], *document)) for q in queries_]
            yield pa.record_batch(list(zip(*out)) if out else [[]] * 2, schema=pa.schema([("query", pa.int64()), ("score", pa.int64())]))

    bounds = index.documents.select("row", "sketch").mapInArrow(best_bounds, _BOUND)
    first = top_per_key(bounds, ["query"], [F.desc("bound"), F.col("row")], FIRST).groupBy("row").agg(F.collect_list("query").alias("queries"))
    # at most FIRST rows for each query of one block
    scored = index.documents.select("row", "text").join(F.broadcast(first), "row").select("text", "queries").mapInArrow(first_scores, "query long, score long")
    least = top_per_key(scored, ["query"], [F.desc("score")], k).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = {r.query: max(1, r.least) for r in least.where(F.col("n") == k).collect()}
    again = spark.sparkContext.broadcast(([(q, dict(c), known.get(q, 1)) for q, c in block], weights))

    def best_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Queries(*again.value, scale)
        heaps: list[list] = [[] for _ in own.keys]
        for batch in batches:
            bounds, texts, documents = own.bounds(batch.column("sketch")), batch.column("text"), {}
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for q, (heap, line) in enumerate(zip(heaps, bounds)):
                least = max(own.least[q], heap[0][0] if len(heap) == k else 1)
                reach = np.flatnonzero(line >= least)
                for i in reach[np.argsort(-line[reach], kind="stable")].tolist():
                    if line[i] < least:
                        break
                    if i not in documents:
                        documents[i] = own.document(texts[i].as_py())
                    score = own.score(q, *documents[i])
                    if score >= least:
                        entry = score, ids[i] is not None, -(ids[i] or 0), -rows[i]
                        (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, entry)
                        if len(heap) == k:
                            least = max(least, heap[0][0])
        out = [(q, -row, -id if named else None, score) for q, heap in zip(own.keys, heaps) for score, named, id, row in heap]
        yield pa.record_batch(list(zip(*out)) if out else [[]] * 4, schema=pa.schema([(c, pa.int64()) for c in ("query", "row", "doc_id", "score")]))

    found = index.documents.select("row", "doc_id", "text", "sketch").mapInArrow(best_scores, _SCORE)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return found.select("*", rank.alias("rank")).where(F.col("rank") <= k).select("query", "doc_id", "score", "rank")
