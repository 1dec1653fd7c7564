"""Helpers that several operators share: tables, shared scratch folders, hashed words."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_here = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_here.get() if set_here.isDefined() else None
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; ``settled`` drops those that were taken within it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (taken := _taken.get()) is not None:
        taken.append(path)
    return path


_taken: ContextVar[list[str] | None] = ContextVar("taken", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], path: str) -> DataFrame:
    """What ``make`` returns, as a table at ``path``; the scratch that this took is dropped, as no later plan reads it."""
    taken: list[str] = []
    token = _taken.set(taken)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _taken.reset(token)
        for each in taken:
            dropped(spark, each)
    return spark.read.schema(df.schema).parquet(path)


ID_BITS = 23


def flagged(df: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """``df`` with a column ``flag``: false only where ``column`` is not in ``ids`` (one column).

    A bitmap of 2**23 hashes, 257 rows of 4 KB at most, is broadcast and tested by built-in
    functions: it spares rows the way through a shuffle and decides nothing.
    """
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << ID_BITS))
    bits = ids.select(place(ids.columns[0]).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    marked = df.withColumn("__at", F.bitmap_bit_position(place(column))).withColumn("__bucket", F.bitmap_bucket_number(place(column)))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, F.pmod(F.col("__at"), F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.join(F.broadcast(bits), "__bucket", "left").select(*df.columns, met.alias(flag))


def likely(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids`` (one column), and few others while these are few."""
    return flagged(df, column, ids, "__met").where("__met").drop("__met")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, wherever they run."""
    key = spark.sparkContext.applicationId
    if key not in _shipped:
        _shipped.add(key)
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp()) / "millrace.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in (root / "millrace").rglob("*.py"):
                out.write(file, file.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))


_shipped: set[str] = set()

def ready(spark: SparkSession) -> None:
    """What an operator with Python workers needs: this package there, and at most 1000 rows at once, as texts may be long.

    A smaller number that the session has stays.
    """
    ship(spark)
    if not 0 < int(spark.conf.get(_AT_ONCE, "0")) <= 1000:  # none or below 1: all rows at once
        spark.conf.set(_AT_ONCE, "1000")


_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Shared:
    """A broadcast with a name of its own, by which workers know what they hold of it."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.token, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value

    def destroy(self) -> None:
        self.broadcast.destroy()


_held: dict = {}


def held(kind: str, key, make):
    """A worker's one large object (a model, a tokenizer with its memory): making another lets it go.

    Workers are used again by later stages, so what each stage leaves behind would add up.
    """
    if (kind, key) not in _held:
        _held.clear()
        _held[kind, key] = make()
    return _held[kind, key]


def free() -> None:
    """Let the worker's large object go."""
    _held.clear()


# --- hashed words -------------------------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_SEGMENT = 1 << 18  # bytes hashed at once
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _IS_WORD[_c] = True
_BYTE = np.random.RandomState(20240501).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``a``, whose last byte is in no word."""
    inside = _IS_WORD[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power_tables(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and offsets: text i has words offsets[i]:offsets[i+1].

    A word is a run of ASCII letters, ASCII digits and non-ASCII characters of the text
    in lower case.  A null text has no words.
    """
    low = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(low) + b"\n"
    a = np.frombuffer(data, np.uint8)
    hashes, firsts, at = [], [], 0
    while at < len(a):
        end = min(len(a), at + _SEGMENT)
        while end < len(a) and _IS_WORD[a[end - 1]]:  # to the end of the word
            stop = np.flatnonzero(~_IS_WORD[a[end : end + _SEGMENT]])
            end = end + int(stop[0]) + 1 if len(stop) else min(len(a), end + _SEGMENT)
        h, s = _segment_hashes(a[at:end])
        hashes.append(h)
        firsts.append(s + at)
        at = end
    h, s = np.concatenate(hashes), np.concatenate(firsts)
    begins = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in low], out=begins[1:])
    return h, np.searchsorted(s, begins)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_MULT) + h[k : len(h) - n + 1 + k]
    return mix(out)


def batches(texts: list, most: int = 1 << 22):
    """Index ranges of ``texts`` with about ``most`` characters each, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
