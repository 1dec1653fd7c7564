"""Toxicity by class-conditional Kneser-Ney language models over bytes.

Two six-gram models, one of toxic and one of ordinary training texts, share their lower
orders, which are counted over the whole corpus, labelled or not.  For class c, discount D,
and h5, h3, h2 the five, three and two bytes before byte w,

    P_c(w | h5) = max(n_c(h5 w) - D, 0) / n_c(h5) + D N_c(h5 .) / n_c(h5) * P_c(w | h3)
    P_c(w | h3) = max(N_c(. h3 w) - D, 0) / N_c(. h3 .) + D N_c(h3 .) / N_c(. h3 .) * P(w | h2)
    P(w | h2)   = the same with N(. h2 w), the kinds of bytes that come before h2 w in all texts,
                  then with N(. h1 w), the bytes before a pair, and N(. w), those before a byte

where n counts occurrences, which only the highest order uses, and N different grams: N_c(. h3 w)
six-grams of the class that end in h3 w, N_c(h5 .) different bytes after h5.  So an expression
that a class has never met is judged by the counts that both share.
Bytes rather than words, as offensive stems come with many endings.  A text is read whole,
in lower case, with digits and punctuation levelled; its score is a logistic function of
length-normalised log-likelihood ratios, of the whole text and of its most toxic windows,
fitted on training rows that the models have not seen.  Once it is fitted, those rows' counts
are added too.

All counts come from all rows, and are exact: what the tasks gather are the different six-grams
of each class with their counts, as many as the texts hold, and they are put together by
their last four bytes (64 tasks' at a time, in ``BUCKETS`` parts or more) before anything is derived from them.
Kinds of bytes before a trigram are the 28 levelled ASCII bytes and 36 classes of the others.
Only then are they laid into tables of fixed size, indexed by hashes, so that the model that
is broadcast is bounded (about 100 MB); ``load`` tells how full these are, which is how
often an unseen gram meets another's count.

Edge cases: a null or empty text has all ratios zero, and so gets the score that the
logistic function has there; repeated rows count again; labels are joined by doc_id, the
smallest non-null label of a document counts; without both classes among the training labels
every score is the smoothed share of toxic rows; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import Shared, batches, free, held, likely, mix, ready, table, written

GRAM_BITS = {6: 22, 4: 21}
CONTEXT_BITS = {6: 21, 4: 19}
BUCKETS, BUCKET_ROWS = 64, 100_000  # parts of a class's six-grams, by their last four bytes: so many at least, one for so many labelled rows
SALTS = 16  # of a labelled id, which may be that of a third of all rows
BLOCK_BITS = 16
DISCOUNT = 0.75
TOGETHER = 64
WAITING = 1 << 21  # six-grams that a task holds back
CALIBRATION_ROWS = 20_000  # bound of the sample on which the logistic function is fitted
PAD = 6

LETTERS = 160  # levelled byte values: 26 letters, digit, space, and what stands above ASCII
#: What tasks gather, and the numpy type of its values: masks of kinds by trigram, six-grams of a class (those of rows that join the model later apart).
GATHERED = {"before": np.uint64, "types0": np.int64, "types1": np.int64, "later0": np.int64, "later1": np.int64}
#: Tables of the model: entries.  ``first`` ones are without the rows that come later.
TABLES = {"trigram": LETTERS**3}
for _n in (6, 4):
    for _c in "01":
        TABLES |= {f"gram{_n}{_c}": 1 << GRAM_BITS[_n], f"context{_n}{_c}": 1 << CONTEXT_BITS[_n], f"after{_n}{_c}": 1 << CONTEXT_BITS[_n]}
_NAMES = [*GATHERED, *TABLES, *[f"first {t}" for t in TABLES if t != "trigram"]]
_SCHEMA = "part long, name int, block int, at binary, n binary"
_ARROW = pa.schema([("part", pa.int64()), ("name", pa.int32()), ("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])

_LEVEL = np.full(256, 32, np.uint8)  # punctuation and white space as a space, digits as 0
_LEVEL[128:] = np.arange(128, 256)
_LEVEL[97:123] = np.arange(97, 123)
_LEVEL[48:58] = 48
_INDEX = np.zeros(256, np.int64)
_INDEX[97:123] = np.arange(1, 27)
_INDEX[48] = 27
_INDEX[128:] = np.arange(32, LETTERS)
_KIND = np.array([i if i < 28 else 28 + i % 36 for i in range(LETTERS)])  # of a byte before a trigram


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _bytes(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The levelled bytes of all texts, each after ``PAD`` spaces; first byte and length of each."""
    low = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    a = _LEVEL[np.frombuffer(b" " * PAD + (b" " * PAD).join(low), np.uint8)]
    n = np.array([len(b) for b in low], np.int64)
    starts = PAD + np.concatenate(([0], np.cumsum(n[:-1] + PAD)))
    return a, starts, n


def _trigrams(a: np.ndarray) -> np.ndarray:
    index = _INDEX[a]
    return (index[PAD - 2 : -2] * LETTERS + index[PAD - 1 : -1]) * LETTERS + index[PAD:]


def _six(a: np.ndarray) -> np.ndarray:
    """Six-grams that end in each byte from ``PAD`` on, as numbers of 48 bits."""
    b = a.astype(np.uint64)
    out = np.zeros(len(b) - PAD, np.uint64)
    for k in range(5, -1, -1):
        out = (out << np.uint64(8)) | b[PAD - k : len(b) - k]
    return out


def _places(six: np.ndarray) -> dict[str, np.ndarray]:
    """Slots of six-grams, of their last four bytes, and of the contexts of both."""
    out = {}
    for n, own in ((6, six), (4, six & np.uint64(0xFFFFFFFF))):
        out[f"context{n}"] = _slots(mix((own >> np.uint64(8)) + np.uint64(n << 56)), CONTEXT_BITS[n])
        out[f"gram{n}"] = _slots(mix(own + np.uint64(n << 56)), GRAM_BITS[n])
    return out


def _positions(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places, in arrays that begin at ``PAD``, of the texts' own bytes."""
    firsts = np.concatenate(([0], np.cumsum(n[:-1])))
    return np.arange(n.sum()) + np.repeat(starts - PAD - firsts, n)


def kinds_before(mask: np.ndarray, texts: list) -> None:
    """Set the bits of the kinds of bytes that come before each trigram of some texts."""
    a, starts, n = _bytes(texts)
    if n.sum():
        own = _positions(starts, n)
        np.bitwise_or.at(mask, _trigrams(a)[own], np.uint64(1) << _KIND[_INDEX[a[PAD - 3 : -3]]].astype(np.uint64)[own])


def six_grams(texts: list, label: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different six-grams of the texts of each class, and how often each occurs."""
    a, starts, n = _bytes(texts)
    six, own = _six(a), _positions(starts, n)
    kind = np.repeat(np.array(label), n)
    return [np.unique(six[own[kind == c]], return_counts=True) for c in (0, 1)]


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same grams added up."""
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def derived(grams: np.ndarray, n: np.ndarray, c: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(table, slots, what to add there) of a class's different six-grams; of four last bytes all are among them."""
    at = _places(grams)
    one = np.ones(len(grams), np.int64)
    yield f"gram6{c}", at["gram6"], n
    yield f"context6{c}", at["context6"], n
    yield f"after6{c}", at["context6"], one
    yield f"gram4{c}", at["gram4"], one
    yield f"context4{c}", at["context4"], one
    last, first = np.unique(grams & np.uint64(0xFFFFFFFF), return_index=True)
    yield f"after4{c}", at["context4"][first], np.ones(len(last), np.int64)


def _sparse(part: int, name: str, at: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """Rows of a sparse table: sorted places, those of each block apart, and values other than 0."""
    cuts = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + (1 << BLOCK_BITS), 1 << BLOCK_BITS)) if len(at) else [0]
    for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            yield part, _NAMES.index(name), block, (at[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes(), n[a:b].tobytes()


def _typed(part: int, name: str, grams: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of six-grams, by bucket."""
    bucket = (mix((grams & np.uint64(0xFFFFFFFF)) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            yield part, _NAMES.index(name), k, grams[order[a:b]].tobytes(), n[order[a:b]].astype(np.int64).tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ARROW)], schema=_ARROW)


def _gather_kinds(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free()
    mask = np.zeros(LETTERS**3, np.uint64)
    for frame in frames:
        texts = frame.column(0).to_pylist()
        for a, b in batches(texts, 1 << 20):
            kinds_before(mask, texts[a:b])
    at = np.flatnonzero(mask)
    if rows := list(_sparse(TaskContext.get().partitionId(), "before", at, mask[at])):
        yield _rows(rows)


def _gather_types(buckets: int):
    """Six-grams of labelled texts (text, label, later); held back until there are ``WAITING`` different ones."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        part = TaskContext.get().partitionId()
        held_back: dict[str, list] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for name in list(held_back):
                if rows := list(_typed(part, name, *_together(held_back.pop(name)), buckets)):
                    yield _rows(rows)

        for frame in frames:
            rows = list(zip(*(frame.column(i).to_pylist() for i in range(3)), strict=True))
            for later in (False, True):
                own = [row for row in rows if row[2] == later]
                for a, b in batches([t for t, _, _ in own], 1 << 20):
                    for c, found in enumerate(six_grams([t for t, _, _ in own[a:b]], [k for _, k, _ in own[a:b]])):
                        held_back.setdefault(("later" if later else "types") + str(c), []).append(found)
            if sum(len(g) for parts in held_back.values() for g, _ in parts) > WAITING:
                for name, parts in held_back.items():
                    held_back[name] = [_together(parts)]
                if sum(len(g) for parts in held_back.values() for g, _ in parts) > WAITING // 2:
                    yield from emptied()
        yield from emptied()

    return run


def _grams_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["at"], np.uint64), np.frombuffer(row["n"], np.int64)


def _merge(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    """Partial tables, or parts of them, of the same name and block put together."""
    part, name, block = (k.as_py() for k in key)
    rows = frame.select(["at", "n"]).to_pylist()
    if _NAMES[name] in ("before", *TABLES) or _NAMES[name].startswith("first "):
        kind = GATHERED.get(_NAMES[name], np.int64)
        into = np.zeros(1 << BLOCK_BITS, kind)
        for row in rows:
            where, values = np.frombuffer(row["at"], np.uint16), np.frombuffer(row["n"], kind)
            if kind is np.uint64:
                into[where] |= values
            else:
                into[where] += values
        at = np.flatnonzero(into)
        body = at.astype(np.uint16).tobytes(), into[at].tobytes()
    else:
        grams, n = _together([_grams_of(r) for r in rows])
        body = grams.tobytes(), n.astype(np.int64).tobytes()
    return pa.Table.from_batches([_rows([(part, name, block, *body)])], schema=_ARROW)


def _derive(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    """Sparse tables from all six-grams of a bucket, with and without those that come later; counts of kinds from masks."""
    part = key[0].as_py()
    by: dict[str, list] = {}
    out = []
    for row in frame.to_pylist():
        name = _NAMES[row["name"]]
        if name == "before":
            kinds = np.bitwise_count(np.frombuffer(row["n"], np.uint64)).astype(np.int64)
            out.append((part, _NAMES.index("trigram"), row["block"], row["at"], kinds.tobytes()))
        else:
            by.setdefault(name, []).append(_grams_of(row))
    for c in (0, 1):
        for prefix, names in (("first ", [f"types{c}"]), ("", [f"types{c}", f"later{c}"])):
            parts = [x for name in names for x in by.get(name, [])]
            if parts:
                for table, at, n in derived(*_together(parts), c):
                    places, where = np.unique(at, return_inverse=True)
                    out += _sparse(part, prefix + table, places, np.bincount(where, n, len(places)).astype(np.int64))
    return pa.Table.from_batches([_rows(out)], schema=_ARROW)


@dataclass
class Model:
    """Tables for scoring, and the logistic function (None: the share of toxic rows is the score)."""

    shared: np.ndarray  # P(w | h2) by trigram
    gram: dict[str, np.ndarray]
    context: dict[str, np.ndarray]
    backoff: dict[str, np.ndarray]
    weights: np.ndarray | None = None
    prior: float = 0.5


def _interpolated(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Rows of counts by context, discounted, over a lower order that broadcasts against them."""
    total = n.sum(axis=-1, keepdims=True)
    kinds = np.count_nonzero(n, axis=-1)[..., None]
    return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


def _finished(tables: dict[str, np.ndarray]) -> Model:
    """Probabilities from counts."""
    tri = tables["trigram"].reshape(LETTERS, LETTERS, LETTERS)
    before = (tri > 0).sum(axis=0).astype(np.float64)  # [v, w]: different bytes before the pair v w
    single = (before > 0).sum(axis=0).astype(np.float64)
    single = (single + 0.01) / (single + 0.01).sum()
    pair = _interpolated(before, single)
    shared = np.empty(tri.shape, np.float32)
    for first in range(LETTERS):
        shared[first] = _interpolated(tri[first].astype(np.float64), pair)
    model = Model(shared.reshape(-1), {}, {}, {})
    for key in ("60", "61", "40", "41"):
        n, kinds = tables[f"context{key}"], tables[f"after{key}"].astype(np.float64)
        model.gram[key] = tables[f"gram{key}"].astype(np.float32)
        model.context[key] = np.maximum(n, 1).astype(np.float32)
        model.backoff[key] = np.where(n > 0, np.clip(DISCOUNT * kinds / np.maximum(n, 1), 1e-5, 1.0), 1.0).astype(np.float32)
    return model


def ratios(model: Model, a: np.ndarray) -> np.ndarray:
    """log P_1 - log P_0 of each byte from ``PAD`` on."""
    grams = _places(_six(a))
    shared = model.shared[_trigrams(a)]
    out = []
    for c in "01":
        p = shared
        for n in ("4", "6"):
            context = grams["context" + n]
            total = model.context[n + c][context]
            p = np.maximum(np.minimum(model.gram[n + c][grams["gram" + n]], total) - np.float32(DISCOUNT), 0) / total + model.backoff[n + c][context] * p
        out.append(np.log(p))
    return np.clip(out[1] - out[0], -8, 8)


WINDOWS = (8, 32, 128, 512)
FEATURES = len(WINDOWS) + 4


def features(model: Model, texts: list) -> np.ndarray:
    """Of each text: mean ratio, mean ratio of its most toxic window of each size, how dense toxic stretches are, length."""
    a, starts, n = _bytes(texts)
    out = np.zeros((len(texts), FEATURES))
    some = n > 0
    if not some.any():
        return out
    r = ratios(model, a).astype(np.float64)
    sums = np.concatenate(([0.0], np.cumsum(r)))
    begins, ends = starts - PAD, starts - PAD + n
    out[some, 0] = ((sums[ends] - sums[begins]) / np.maximum(n, 1))[some]
    own = _positions(starts, n)
    first, last = np.repeat(begins, n), np.repeat(ends, n)
    cuts = np.concatenate(([0], np.cumsum(n)[:-1]))[some]
    for i, width in enumerate(WINDOWS):
        to = np.minimum(own + width, last)
        mean = (sums[to] - sums[np.maximum(to - width, first)]) / width
        out[some, 1 + i] = np.maximum.reduceat(mean, cuts)
        if width == 8:
            for k, above in enumerate((0.5, 1.0)):
                out[some, 1 + len(WINDOWS) + k] = np.log1p(100 * np.add.reduceat((mean > above).astype(np.float64), cuts) / n[some])
    out[some, -1] = np.log1p(n[some])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly regularised logistic regression, by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
    return w


def _ship(spark: SparkSession, tables: dict[str, np.ndarray], weights: np.ndarray | None = None, prior: float = 0.5):
    """A broadcast of the counts, which are mostly zeros and so go compressed; workers make the model from them."""
    small = {k: zlib.compress(v.astype(np.uint8) if v.max() < 256 else v, 1) for k, v in tables.items()}
    body = pickle.dumps((small, {k: v.max() < 256 for k, v in tables.items()}, weights, prior), protocol=5)
    return Shared(spark, body)


def _model(broadcast) -> Model:
    def make() -> Model:  # counts beyond 2**24 are rounded
        small, bytewise, weights, prior = pickle.loads(broadcast.value)
        kinds = {k: np.uint8 if bytewise[k] else np.float32 for k in small}
        model = _finished({k: np.frombuffer(zlib.decompress(v), kinds[k]) for k, v in small.items()})
        model.weights, model.prior = weights, prior
        return model

    return held("toxicity", broadcast.token, make)


def _features(frame: pa.RecordBatch, column: int, model: Model) -> np.ndarray:
    texts = frame.column(column).to_pylist()
    return np.concatenate([features(model, texts[a:b]) for a, b in batches(texts, 1 << 19)]) if texts else np.zeros((0, FEATURES))


def _merged(partial: DataFrame) -> DataFrame:
    """Partial tables put together, ``TOGETHER`` parts at a time, so that no task meets more."""
    n = (partial.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        partial = written(partial.withColumn("part", F.floor(F.col("part") / TOGETHER)).groupBy("part", "name", "block").applyInArrow(_merge, _SCHEMA), "counts")
        n = -(-n // TOGETHER)
        if n <= 1:
            return partial


def load(tables: dict[str, np.ndarray]) -> dict[str, float]:
    """Share of the slots that are taken, by table: how often an unseen gram meets another's count."""
    return {k: float(np.count_nonzero(v) / len(v)) for k, v in tables.items()}


def fit(docs: DataFrame, labels: DataFrame, train: Column):
    """A broadcast model of both classes from all training rows; ``train`` is a condition on ``label_of``, the document's id."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("label_of"))
        .agg(F.min("toxic").cast("int").alias("label"))
        .where(train)
        .select(F.col("label_of").alias("doc_id"), "label")
    )
    fold = F.pmod(F.crc32(F.concat(F.lit("fold/"), F.col("doc_id").cast("string")).cast("binary")), F.lit(5))
    buckets = max(BUCKETS, -(-known.count() // BUCKET_ROWS))
    # The same join at every size: label tables grow with the corpus.  Rows of one id meet its label under a salt.
    salted = known.select("doc_id", "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = likely(texts, "doc_id", known.select("doc_id")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    labelled = spread.join(salted.hint("merge"), ["doc_id", "salt"]).select("text", "label", (fold == 0).alias("later"))
    gathered = written(texts.select("text").mapInArrow(_gather_kinds, _SCHEMA), "counts").unionByName(written(labelled.mapInArrow(_gather_types(buckets), _SCHEMA), "counts"))
    merged = _merged(gathered)
    bucket = F.pmod(F.col("block"), F.lit(buckets)).cast("long").alias("bucket")
    partial = _merged(written(merged.groupBy(bucket).applyInArrow(_derive, _SCHEMA), "counts"))

    def take(prefix: str) -> dict[str, np.ndarray]:
        tables = {k: np.zeros(n, np.float32) for k, n in TABLES.items()}
        names = {_NAMES.index(k if k == "trigram" else prefix + k): k for k in TABLES}
        for row in partial.where(F.col("name").isin(list(names))).toLocalIterator():  # tables of fixed size, whatever the input's
            into = tables[names[row["name"]]][row["block"] << BLOCK_BITS :]
            into[np.frombuffer(bytes(row["at"]), np.uint16)] = np.frombuffer(bytes(row["n"]), np.int64)
        return tables

    shared = _ship(spark, take("first "))

    def look(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared)
        for frame in frames:
            x = _features(frame, 0, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), frame.column(1)], names=["x", "label"])

    order = F.crc32(F.concat(F.lit("pick/"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = known.where(fold == 0).withColumn("order", order).orderBy("order", "doc_id").limit(CALIBRATION_ROWS).select("doc_id", "label")
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("row"))  # of an id one text
    some = one.select("row.text", "row.label").mapInArrow(look, "x array<double>, label int").toPandas()
    y = some["label"].to_numpy(dtype=float) if len(some) else np.zeros(0)
    shared.destroy()
    prior = float((y.sum() + 0.5) / (len(y) + 1.0))
    return _ship(spark, take(""), _logistic(np.stack(some["x"].to_numpy()), y) if 0 < y.sum() < len(y) else None, prior)


def scorer(shared):
    """A column function: text to score."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        own, texts = _model(shared), column.tolist()
        if own.weights is None or not texts:
            return pd.Series(np.full(len(texts), own.prior))
        x = np.concatenate([features(own, texts[a:b]) for a, b in batches(texts, 1 << 19)])
        return pd.Series(1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ own.weights, -30, 30))))

    return run


THRESHOLD = 0.3


def remainder(key: Column, n: int) -> Column:
    """CRC-32 of the key as text, modulo ``n``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def trained(docs: DataFrame, labels: DataFrame):
    """The scorer that the query and the pipeline use: rows with remainder 2 teach it no labels."""
    return scorer(fit(docs, labels, remainder(F.col("label_of"), 4) != 2))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = trained(docs, labels)(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    return docs.where(trained(docs, labels)(F.col("text").cast("string")) < THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
