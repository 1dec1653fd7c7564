"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred and turned by learned rotations (iterative quantisation, fitted on a
bounded sample of ``FIT_ROWS`` vectors); the signs are ``BITS`` bits of code.  Codes are cut
into substrings of 16 bits and each substring is indexed.  A code within Hamming radius R of
a query's has, in one of m substrings, at most floor(R / m) differing bits (one less in the
later ones), so probing each index within these smaller radii retrieves every code within R.
Codes within R are reranked by the exact distance of the original vectors.  R is fitted on
the sample: the distance within which ``WITHIN`` of true neighbours lie.  Queries that
find too few neighbours are asked again with twice the radius.

Every row is indexed: about 2**22 components at a time, in the task that reads them.
Queries go against it in blocks of ``QUERY_BYTES``, which are what is broadcast, so vectors are read
once for each such block (130,000 queries of 32 components), and nothing of them is shuffled.  A task
keeps the best few per query over all it reads; a window over the query keeps the best of these.

Edge cases: vectors that are null, all zero, of another length than most of the sample's, or
with a null or non-finite component take no part, neither do rows with a null vec_id; a query
row's own row is no candidate, but others that share its vec_id are, and each row of a shared
vec_id is a query of its own (equal rows get equal answers); ties go to the smaller vec_id;
with fewer candidates than asked for all are returned; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import dropped, ready, scratch, table, written

BITS, SUB = 256, 16
FIT_ROWS, FIT_QUERIES, WITHIN = 4096, 256, 0.99
QUERY_BYTES = 32 << 20  # of the queries that are broadcast at once
INDEXED = 1 << 22  # components of the vectors in one index
_POP16 = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)).astype(np.uint8)


@dataclass
class Codes:
    """Centre, rotations (dimension, BITS) and the fitted radius."""

    mean: np.ndarray
    turns: np.ndarray
    radius: int = BITS

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, BITS / 16) substrings of the codes."""
        bits = (x - self.mean) @ self.turns > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def learned(sample: np.ndarray, k: int, seed: int = 3) -> Codes:
    """Rotations by iterative quantisation, as many as it takes for ``BITS`` bits, and the radius."""
    n, d = sample.shape
    mean = sample.mean(axis=0)
    x = sample - mean
    rng = np.random.RandomState(seed)
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        r, _ = np.linalg.qr(rng.randn(d, d))
        for _ in range(20):
            v = x @ r
            u, _, w = np.linalg.svd(np.sign(v).T @ x)
            r = (u @ w).T
        turns.append(r)
    codes = Codes(mean, np.concatenate(turns, axis=1)[:, :BITS])
    own = codes.of(sample)
    near = []
    for i in range(min(n, FIT_QUERIES)):
        distance = ((sample - sample[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        best = np.argsort(distance, kind="stable")[: min(k, n - 1)]
        near.append(hamming(own[best], own[i]))
    every = np.concatenate(near) if near else np.zeros(0)
    codes.radius = int(np.quantile(every, WITHIN, method="higher")) if len(every) else BITS
    return codes


def hamming(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    wide = np.ascontiguousarray(codes).view(np.uint64) ^ np.ascontiguousarray(one).view(np.uint64) if codes.shape[1] % 4 == 0 else codes ^ one
    return np.bitwise_count(wide).sum(axis=1, dtype=np.int64)


class Index:
    """The substring indexes of one batch of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.subs = []
        for i in range(codes.shape[1]):
            order = np.argsort(codes[:, i], kind="stable")
            values, first = np.unique(codes[order, i], return_index=True)
            self.subs.append((values, np.append(first, len(order)), order))

    def within(self, one: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``one`` in at most ``radius`` bits, all of them."""
        m = len(self.subs)
        each, more = divmod(radius, m)
        met = np.zeros(len(self.codes), bool)
        for i, (values, first, order) in enumerate(self.subs):
            r = each if i <= more else each - 1
            if r < 0:
                continue
            hit = np.flatnonzero(_POP16[values ^ one[i]] <= r)
            begin, n = first[hit], first[hit + 1] - first[hit]
            met[order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(met)
        return rows[hamming(self.codes[rows], one) <= radius]


_FOUND = "query long, query_id long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _gathered(frames: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    some, n = [], 0
    for frame in frames:
        if len(frame):
            some.append(frame)
            n += len(frame)
        if n >= rows:
            yield pa.Table.from_batches(some).combine_chunks()
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def _search(shared, k: int):
    """The best ``k`` + 1 (a query's own row may be one) of each query over all that a task reads."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, radius, numbers, query_ids, queries = pickle.loads(shared.value)
        asked = codes.of(queries)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(queries)
        for frame in _gathered(frames, max(1000, INDEXED // queries.shape[1])):
            ids = frame.column(0).to_numpy()
            x = _matrix(frame.column(1), queries.shape[1])
            index = Index(codes.of(x))
            for q, (one, own) in enumerate(zip(asked, queries, strict=True)):
                rows = index.within(one, radius)
                score = np.sqrt(((x[rows] - own) ** 2).sum(axis=1))
                if len(rows) > k + 1:
                    some = np.flatnonzero(score <= np.partition(score, k)[k])
                    rows, score = rows[some], score[some]
                score, near = np.concatenate([best[q][0], score]), np.concatenate([best[q][1], ids[rows]])
                first = np.lexsort((near, score))[: k + 1]
                best[q] = score[first], near[first]
        for a in range(0, len(queries), 10_000):
            part = best[a : a + 10_000]
            n = [len(score) for score, _ in part]
            cols = np.repeat(numbers[a : a + 10_000], n), np.repeat(query_ids[a : a + 10_000], n), np.concatenate([i for _, i in part]), np.concatenate([v for v, _ in part])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return run


def usable(vector: Column) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0)


def _blocks(queries: DataFrame, d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, ids and vectors of queries, in blocks of at most ``QUERY_BYTES``."""
    numbers, ids, rows = [], [], []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        numbers.append(row["query"])
        ids.append(row["vec_id"])
        rows.append(np.array(row["embedding"], np.float64))
        if len(ids) * d * 8 >= QUERY_BYTES:
            yield np.array(numbers), np.array(ids), np.stack(rows)
            numbers, ids, rows = [], [], []
    if ids:
        yield np.array(numbers), np.array(ids), np.stack(rows)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean) of the ``k`` nearest found of each query row; ``vectors`` is vec_id, embedding."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    order = F.crc32(F.concat(F.lit("fit/"), F.col("vec_id").cast("string")).cast("binary"))
    sample = rows.withColumn("order", order).orderBy("order", "vec_id").limit(FIT_ROWS).select("embedding").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    d = Counter(len(r[0]) for r in sample).most_common(1)[0][0]
    rows = rows.where(F.size("embedding") == d)
    codes = learned(np.array([r[0] for r in sample if len(r[0]) == d], np.float64), k)
    every = rows.count()
    # Equal query rows are asked once.  The numbers are written, so they are the same for all blocks and retries.
    asked = rows.where(is_query).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("copies"))
    asked = written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    path, any_block = scratch(spark, "neighbours"), False
    for numbers, ids, queries in _blocks(asked, d):
        any_block = True
        radius = codes.radius
        while len(ids):
            shared = spark.sparkContext.broadcast(pickle.dumps((codes, radius, numbers, ids, queries), protocol=5))
            part = scratch(spark, "block")
            rows.mapInArrow(_search(shared, k), _FOUND).write.parquet(part)
            found = spark.read.schema(_FOUND).parquet(part)
            counts = {r[0]: r[1] for r in found.groupBy("query").count().collect()} if radius < BITS else {}  # a row for each query of the block at most
            short = np.array([radius < BITS and counts.get(int(q), 0) < min(k + 1, every) for q in numbers], bool)
            done = spark.createDataFrame([(int(q),) for q in numbers[~short]], "query long")
            (found.join(F.broadcast(done), "query") if short.any() else found).write.mode("append").parquet(path)
            shared.destroy()
            dropped(spark, part)
            numbers, ids, queries, radius = numbers[short], ids[short], queries[short], min(BITS, 2 * radius + 1)
    if not any_block:
        return empty
    # One row at distance 0 with the query's id is its own.
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    placed = spark.read.schema(_FOUND).parquet(path).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    others = placed.withColumn("own", F.sum(itself.cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))).where(~(itself & (F.col("own") == 1)))
    ranked = others.withColumn("rank", (F.col("place") - F.when(F.col("own") > 0, 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    copies = asked.select("query", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return ranked.join(copies, "query").select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)
