"""Quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are read whole, in overlapping chunks of 256 bytes, 192 apart.  Each
byte has a fixed code (its class, and a few random signs); learned filters of 8 bytes slide
over a chunk in steps of 2, each is max-pooled over the chunk, and a hidden layer turns the
pooled responses into the chunk's logit.  The chunks' logits are combined into one
probability per text by a logistic function of their mean, largest, smallest and
log-mean-exp, and of how much a text falls short of one chunk.

The network is trained on a bounded sample of labelled rows (``SAMPLE_ROWS`` documents of
each class, ``CHUNKS_EACH`` chunks of each); the combination on the same documents, read
whole.  Everything else covers all rows.

Edge cases: a null or empty text is one chunk of padding, and gets a score like any text;
repeated rows are scored alike; labels are joined by doc_id, the smallest non-null label
counts; without both classes among the training labels each score is the smoothed share of
good rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import batches, free, ready, table, written

CHUNK, APART, WIDTH, STEP = 256, 192, 8, 2
BLOCK = 64  # chunk and distance are multiples of it
FILTERS, HIDDEN = 40, 24
SAMPLE_ROWS, CHUNKS_EACH = 3000, 6
EPOCHS, RATE, BATCH = 10, 2e-3, 128
THRESHOLD = 0.5


def _codes() -> np.ndarray:
    """A fixed vector for each byte value."""
    kinds = np.zeros((256, 6), np.float32)
    for b in range(256):
        ch = chr(b)
        kind = 0 if b >= 128 or ("a" <= ch <= "z") else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch == " " else 4 if ch in ".,;:'\"?-\n" else 5
        kinds[b, kind] = 1
    signs = np.random.RandomState(7).choice([-0.5, 0.5], (256, 6)).astype(np.float32)
    return np.concatenate([kinds, signs], axis=1)


CODES = _codes()
DIMS = CODES.shape[1]


@dataclass
class Network:
    """Weights; ``combine`` is the logistic function over chunk logits (None: ``prior`` is the score)."""

    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    combine: np.ndarray | None = None
    prior: float = 0.5


def _columns(a: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` byte codes for each place of the filters; ``a`` has ``WIDTH`` - ``STEP`` bytes more than places need."""
    coded = CODES[a].reshape(-1)
    view = np.lib.stride_tricks.sliding_window_view(coded, WIDTH * DIMS)[:: STEP * DIMS]
    return np.ascontiguousarray(view)


def chunk_starts(n: int) -> int:
    """How many chunks a text of ``n`` bytes has."""
    return 1 + max(0, -(-(n - CHUNK) // APART))


def _filled(b: bytes) -> tuple[bytes, int]:
    """A text's bytes, filled up to whole chunks, and their number.

    A long text's last chunk goes on with the text's beginning, so that it isn't judged by
    what it lacks; a text shorter than a chunk is filled with zeros.
    """
    n = chunk_starts(len(b))
    missing = (n - 1) * APART + CHUNK - len(b)
    return b + (b[:missing] if len(b) >= CHUNK else bytes(missing)), n


def _responses(net: Network, a: np.ndarray) -> np.ndarray:
    """Filters max-pooled over each block of ``BLOCK`` bytes; ``a`` is whole blocks."""
    padded = np.concatenate([a, np.zeros(WIDTH - STEP, np.uint8)])
    out = np.empty((len(a) // BLOCK, FILTERS), np.float32)
    most = 256  # blocks at once
    for at in range(0, len(out), most):
        end = min(len(out), at + most)
        x = _columns(padded[at * BLOCK : end * BLOCK + WIDTH - STEP])
        out[at:end] = (x @ net.filters).reshape(end - at, BLOCK // STEP, FILTERS).max(axis=1)
    return out


def _last_responses(net: Network, tails: np.ndarray) -> np.ndarray:
    """Pooled responses of blocks (rows) after which nothing comes."""
    out = np.empty((len(tails), FILTERS), np.float32)
    for at in range(0, len(tails), 256):
        own = np.concatenate([tails[at : at + 256], np.zeros((len(tails[at : at + 256]), WIDTH - STEP), np.uint8)], axis=1)
        x = np.lib.stride_tricks.sliding_window_view(CODES[own].reshape(len(own), -1), WIDTH * DIMS, axis=1)[:, :: STEP * DIMS]
        out[at : at + 256] = (np.ascontiguousarray(x).reshape(-1, WIDTH * DIMS) @ net.filters).reshape(len(own), BLOCK // STEP, FILTERS).max(axis=1)
    return out


def chunk_logits(net: Network, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all chunks of all texts, and where each text's chunks begin."""
    parts, counts = [], []
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        b, n = _filled(b)
        counts.append(n)
        parts.append(b)
    a = np.frombuffer(b"".join(parts), np.uint8)
    blocks = _responses(net, a)
    counts = np.array(counts)
    per, step = CHUNK // BLOCK, APART // BLOCK
    sizes = (counts - 1) * step + per  # blocks of each text
    ends = np.cumsum(sizes) - 1
    blocks[ends] = _last_responses(net, a.reshape(-1, BLOCK)[ends])  # no filter reads on into the next text
    first = np.repeat(np.cumsum(sizes) - sizes - step * (np.cumsum(counts) - counts), counts) + step * np.arange(counts.sum())
    pooled = blocks[first]
    for k in range(1, per):
        pooled = np.maximum(pooled, blocks[first + k])
    h = np.maximum(np.maximum(pooled + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
    return (h @ net.out + net.out_bias).astype(np.float64), np.cumsum(counts) - counts


COMBINED = 6


def combined(net: Network, texts: list) -> np.ndarray:
    """What the logistic function sees of each text."""
    z, starts = chunk_logits(net, texts)
    z = np.clip(z, -12, 12)
    n = np.diff(np.concatenate((starts, [len(z)])))
    soft = np.log(np.add.reduceat(np.exp(-z), starts) / n)
    mean = np.add.reduceat(z, starts) / n
    lacking = np.array([max(0.0, 1 - len((t or "").encode("utf-8", "surrogatepass")) / CHUNK) for t in texts])
    return np.stack([mean, np.maximum.reduceat(z, starts), np.minimum.reduceat(z, starts), soft, lacking, lacking * mean], axis=1)


def train(chunks: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the cross-entropy of single chunks; ``chunks`` is (n, CHUNK) bytes."""
    rng = np.random.RandomState(seed)
    scale = lambda *shape: (rng.randn(*shape) * np.sqrt(2.0 / shape[0])).astype(np.float32)
    w = [scale(WIDTH * DIMS, FILTERS), np.zeros(FILTERS, np.float32), scale(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), scale(HIDDEN, 1)[:, 0], np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    share = np.array([np.mean(y == 0), np.mean(y == 1)])
    weight = (0.5 / np.maximum(share, 1e-6))[y.astype(int)].astype(np.float32)
    places = CHUNK // STEP
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y) - len(y) % BATCH or len(y), BATCH):
            own = order[at : at + BATCH]
            a = np.concatenate([chunks[own], np.zeros((len(own), WIDTH - STEP), np.uint8)], axis=1)
            x = np.lib.stride_tricks.sliding_window_view(CODES[a].reshape(len(own), -1), WIDTH * DIMS, axis=1)[:, :: STEP * DIMS]
            x = np.ascontiguousarray(x)
            r = (x.reshape(-1, WIDTH * DIMS) @ w[0]).reshape(len(own), places, FILTERS)
            best = r.argmax(axis=1)
            pooled = np.take_along_axis(r, best[:, None], axis=1)[:, 0] + w[1]
            p1 = np.maximum(pooled, 0)
            h = p1 @ w[2] + w[3]
            h1 = np.maximum(h, 0)
            z = h1 @ w[4] + w[5]
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
            dh = np.outer(dz, w[4]) * (h > 0)
            dp = (dh @ w[2].T) * (pooled > 0)
            picked = np.take_along_axis(x, best.reshape(len(own), -1, 1), axis=1)  # (batch, filters, inputs)
            grads = [np.einsum("bfi,bf->if", picked, dp, optimize=True), dp.sum(0), p1.T @ dh, dh.sum(0), h1.T @ dz, np.array([dz.sum()])]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                w[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return Network(w[0], w[1], w[2], w[3], w[4], float(w[5][0]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(w))
        w += np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-1 * w), -5, 5)
    return w


def _pick_chunks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``CHUNKS_EACH`` chunks of each text, evenly spread from its first to its last."""
    for frame in frames:
        out = []
        for t in frame.column(0).to_pylist():
            b = (t or "").encode("utf-8", "surrogatepass")
            b, n = _filled(b)
            own = sorted({round(i * (n - 1) / max(1, CHUNKS_EACH - 1)) for i in range(CHUNKS_EACH)})
            out.append(b"".join(b[k * APART : k * APART + CHUNK] for k in own))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), frame.column(1)], names=["chunks", "label"])


def _ship(spark: SparkSession, net: Network):
    return spark.sparkContext.broadcast(pickle.dumps(net, protocol=5))


def _whole(shared, frame: pa.RecordBatch, column: int) -> tuple[Network, np.ndarray]:
    net = pickle.loads(shared.value)
    texts = frame.column(column).to_pylist()
    parts = [combined(net, texts[a:b]) for a, b in batches(texts, 1 << 21)]
    return net, np.concatenate(parts) if parts else np.zeros((0, COMBINED))


def sampled(docs: DataFrame, labels: DataFrame, train_on: Column) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of a bounded sample, of each id one row however many there are, and how many ids each label has."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("label_of"))
        .agg(F.min("quality").cast("int").alias("label"))
        .where(train_on)
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.crc32(F.concat(F.lit("sample/"), F.col("label_of").cast("string")).cast("binary"))
    picked = known.withColumn("order", order)
    one = lambda c: picked.where(F.col("label") == c).orderBy("order", "label_of").limit(SAMPLE_ROWS).select("label_of", "label")
    sample = F.broadcast(one(0).unionByName(one(1)))  # 2 * SAMPLE_ROWS pairs of numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("label_of"), F.col("text").cast("string").alias("text")).join(sample, "label_of")
    one_each = rows.groupBy("label_of").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row")).select("row.text", "row.label")
    return written(one_each, "sample"), sizes


def fit(docs: DataFrame, labels: DataFrame, train_on: Column) -> Network:
    """A network from a sample of the rows for which ``train_on``, a condition on ``label_of``, holds."""
    spark = docs.sparkSession
    ready(spark)
    rows, sizes = sampled(docs, labels, train_on)
    some = rows.mapInArrow(_pick_chunks, "chunks binary, label int").toPandas()
    total = sum(sizes.values())
    blank = Network(*[np.zeros(s, np.float32) for s in ((WIDTH * DIMS, FILTERS), FILTERS, (FILTERS, HIDDEN), HIDDEN, HIDDEN)], 0.0, None, (sizes.get(1, 0) + 0.5) / (total + 1.0))
    if len(set(some["label"])) < 2:
        return blank
    chunks = [np.frombuffer(b, np.uint8).reshape(-1, CHUNK) for b in some["chunks"]]
    y = np.repeat(some["label"].to_numpy(dtype=np.float32), [len(c) for c in chunks])
    ordered = np.lexsort(np.concatenate(chunks).T[:16])  # the same network whatever the rows' order
    net = train(np.concatenate(chunks)[ordered], y[ordered])
    net.prior = blank.prior
    shared = _ship(spark, net)

    def look(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            x = _whole(shared, frame, 0)[1]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), frame.column(1)], names=["x", "label"])

    seen = rows.mapInArrow(look, "x array<double>, label int").toPandas()
    y = seen["label"].to_numpy(dtype=float)
    share = np.array([sizes[0], sizes[1]]) / np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    net.combine = _logistic(np.stack(seen["x"].to_numpy()), y, (share / share.min())[y.astype(int)])
    shared.destroy()
    return net


def scorer(spark: SparkSession, net: Network):
    """A column function: text to score."""
    shared = _ship(spark, net)

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        free()
        own, texts = pickle.loads(shared.value), column.tolist()
        if own.combine is None or not texts:
            return pd.Series(np.full(len(texts), own.prior))
        x = np.concatenate([combined(own, texts[a:b]) for a, b in batches(texts, 1 << 21)])
        return pd.Series(1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ own.combine, -30, 30))))

    return run


def remainder(key: Column, n: int) -> Column:
    """CRC-32 of the key as text, modulo ``n``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def trained(docs: DataFrame, labels: DataFrame):
    """The scorer that the query and the pipeline use: rows with remainder 1 teach it no labels."""
    return scorer(docs.sparkSession, fit(docs, labels, remainder(F.col("label_of"), 3) != 1))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = trained(docs, labels)(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    return docs.where(trained(docs, labels)(F.col("text").cast("string")) >= THRESHOLD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
