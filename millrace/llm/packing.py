"""Packing of documents into training windows of several context sizes.

Each document becomes token ids with an end id.  Whole windows of the longest size are cut
off first; what remains of a document is routed to the smallest context size (tier) that
holds it.  Windows are then filled from long to short: the longest remainder opens a window
of its tier, its gap is filled with the largest remainders of shorter tiers that fit, and
one remainder is cut where nothing fits.  So every window is full but the very last ones.
Tiers are powers of two.  Windows of a tier are numbered through and dealt into step groups
of equal token counts.

Packing runs inside the partitions of the scan, so token ids are never shuffled; only what
is left of a partition's last window (fewer ids than one window) is packed once more with
the leftovers of other partitions.

Edge cases: a null or empty text is the end id alone; repeated rows are documents of their
own; a null doc_id is carried through; an empty table gives no rows; only the id and the
text are read, so further columns don't matter.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm._common import held, ready, table, written

TIERS = (256, 512, 1024, 2048)
END = 1
STEP_TOKENS = 64 * TIERS[-1]
POOL_TOKENS = 1 << 20  # ids that wait for a window at once
CACHE = 300_000  # distinct chunks and words kept by a worker
LEFT_TOGETHER = 64  # partitions whose leftovers are packed together

# The word pattern of the tokenizer file, and what its byte-level step prints for each byte.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD = regex.compile(PATTERN)
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}

# Characters on which this module's splitting provably agrees with the tokenizer's.
_PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ſ‐-‧€]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
WORD_END = "</w>"
_END_BYTE = b"\xff"  # in no UTF-8


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The file's merges as ranks over bytes, where a word's end is a byte of its own; None if the file isn't of that kind.

    A merge of the file joins two given symbols, a rank joins any two that spell its token.  Both
    are the same here: within a token's stretch merges go as they would if it stood alone, so the
    last two symbols are always those of its own merge, if the token alone comes out as itself.
    That is tested for each token, and so is that later merges have larger ids.
    """
    steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
    split = (steps.get("pretokenizers") or [{}])[0]
    if split.get("pattern") != {"Regex": PATTERN} or model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or model.get("dropout"):
        return None
    byte, vocab = {c: b for b, c in BYTE_CHARS.items()}, model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    order = {m: k for k, m in enumerate(merges)}
    ranks = {bytes([b]): vocab[c] for b, c in BYTE_CHARS.items()} | {bytes([b]) + _END_BYTE: vocab[c + WORD_END] for b, c in BYTE_CHARS.items() if b != 255}
    last = max(ranks.values())
    for merge in merges:
        token = "".join(merge)
        word = token.removesuffix(WORD_END)
        symbols = list(word)
        symbols[-1] += token[len(word) :]
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda i: order.get((symbols[i], symbols[i + 1]), len(order)))
            if (symbols[at], symbols[at + 1]) not in order:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        if vocab[token] <= last:
            return None
        last = vocab[token]
        ranks[bytes([byte[c] for c in word]) + (_END_BYTE if token != word else b"")] = last
    return ranks


class Encoder(dict):
    """Token ids of texts, as little-endian unsigned 32-bit bytes; the ids of chunks and words by their text.

    The tokenizer never looks across white space, so the ids of each distinct chunk are found
    once and remembered.  What hasn't been asked for lately is forgotten: when the newer half of
    the memory is full, it becomes the older one.
    """

    def __init__(self, spec: str, ranks: dict[bytes, int] | None) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.ranked = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe if ranks else None
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.chunk(chunk)
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        return array("I", self.ranked.encode_single_piece(word.encode() + _END_BYTE)).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if not chunk.isprintable() or "<|" in chunk:
                return self.whole(chunk)
            plain = chunk.lower()
        elif _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            plain = unicodedata.normalize("NFC", chunk).lower()
        else:
            return self.whole(chunk)
        if plain.isalpha():
            return self.word(plain) if plain == chunk else self[plain]
        stem = plain.rstrip(_MARKS)
        words = [stem, plain[len(stem) :]] if stem.isalpha() else WORD.findall(plain)
        return b"".join([self.word(w) if w == chunk else self[w] for w in words])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is None or _ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(spec: str, ranks: dict[bytes, int] | None) -> Encoder:
    """The worker's encoder for a tokenizer file's text and its ``merge_ranks``."""
    return held("encoder", spec, lambda: Encoder(spec, ranks))


class Packer:
    """Fills windows; ``out`` gets (tier, number in tier, offset, doc, start, ids, doc_tokens)."""

    def __init__(self) -> None:
        self.pool: list[tuple] = []  # (length, serial, doc, start, ids, doc_tokens), by length
        self.waiting = 0
        self.serial = 0
        self.made = dict.fromkeys(TIERS, 0)
        self.out: list[tuple] = []

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        most, at, n = TIERS[-1], 0, len(ids) // 4
        while n - at >= most:
            self._close(most, [(most, 0, doc, start + at, ids[4 * at : 4 * (at + most)], doc_tokens)])
            at += most
        if at < n:
            self._keep(doc, start + at, ids[4 * at :], doc_tokens)
        if self.waiting > POOL_TOKENS:
            self.fill(POOL_TOKENS // 4)

    def _keep(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        self.serial += 1
        insort(self.pool, (len(ids) // 4, self.serial, doc, start, ids, doc_tokens))
        self.waiting += len(ids) // 4

    def _take(self, at: int) -> tuple:
        item = self.pool.pop(at)
        self.waiting -= item[0]
        return item

    def _close(self, tier: int, items: list[tuple]) -> None:
        offset = 0
        for n, _, doc, start, ids, doc_tokens in items:
            self.out.append((tier, self.made[tier], offset, doc, start, ids, doc_tokens))
            offset += n
        self.made[tier] += 1

    def fill(self, keep: int = 0) -> None:
        """Close full windows until fewer than ``keep`` ids wait, or no window can be filled."""
        while self.waiting > keep and self.pool:
            tier = next(t for t in TIERS if t >= self.pool[-1][0])
            tier = max((t for t in TIERS if t <= self.waiting), default=0) if tier > self.waiting else tier
            if not tier:
                return
            if self.pool[-1][0] > tier:  # nothing else is left: cut it
                items, gap = [], tier
            else:
                items = [self._take(-1)]
                gap = tier - items[0][0]
            while gap:
                at = bisect_right(self.pool, gap, key=lambda x: x[0])
                if at:
                    items.append(self._take(at - 1))
                    gap -= items[-1][0]
                else:
                    n, serial, doc, start, ids, doc_tokens = self._take(0)
                    items.append((gap, serial, doc, start, ids[: 4 * gap], doc_tokens))
                    self._keep(doc, start + gap, ids[4 * gap :], doc_tokens)
                    gap = 0
            self._close(tier, items)

    def finish(self) -> None:
        """Close a last, padded window."""
        self.fill()
        if self.pool:
            items = [self._take(-1) for _ in range(len(self.pool))]
            self._close(next(t for t in TIERS if t >= sum(x[0] for x in items)), items)


_OUT = "part long, tier int, number long, offset long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.binary() if n == "ids" else pa.int64()) for n in [x.split()[0] for x in _OUT.split(", ")]])


def _batch(part: int, rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    cols = [
        [part] * len(rows),
        [r[0] for r in rows],
        [r[1] for r in rows],
        [r[2] for r in rows],
        [r[3] for r in rows],
        [r[4] for r in rows],
        [len(r[5]) // 4 for r in rows],
        [zlib.crc32(r[5]) for r in rows],
        [r[6] for r in rows],
        [r[5] if keep_ids else None for r in rows],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _drained(packer: Packer, part: int) -> Iterator[pa.RecordBatch]:
    rows, packer.out = packer.out, []
    for at in range(0, len(rows), 10_000):
        yield _batch(part, rows[at : at + 10_000], False)


def _pack_partition(spec):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, part, end = encoder(*spec.value), Packer(), TaskContext.get().partitionId(), array("I", [END]).tobytes()
        for frame in frames:
            for doc, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.out) >= 10_000:
                    yield from _drained(packer, part)
            yield from _drained(packer, part)
        packer.fill()
        yield from _drained(packer, part)
        if packer.pool:  # fewer ids than the smallest window, tier 0
            yield _batch(part, [(0, 0, 0, *x[2:]) for x in packer.pool], True)

    return run


def _pack_left(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    packer = Packer()
    for row in frame.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist():
        packer.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"])
    packer.finish()
    return pa.Table.from_batches([_batch(-1 - key[0].as_py(), packer.out, False)])


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece; ``tier`` is the size of its window and ``step_group`` the group of windows it trains with."""
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        body = file.read()
    spec = spark.sparkContext.broadcast((body, merge_ranks(json.loads(body))))
    pieces = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack_partition(spec), _OUT), "pieces")
    done = pieces.where("tier > 0").drop("ids")
    left = pieces.where("tier = 0").groupBy(F.floor(F.col("part") / LEFT_TOGETHER).alias("together")).applyInArrow(_pack_left, _OUT).drop("ids")
    every = done.unionByName(written(left, "left"))
    # Numbers of windows: each partition's count by tier, summed up in order.
    counts = every.groupBy("tier", "part").agg((F.max("number") + 1).alias("n"))
    ahead = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sizes = {t: f"tier_{t}" for t in TIERS}
    totals = counts.agg(*[F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)).alias(c) for t, c in sizes.items()])
    base, before = F.lit(0).cast("long"), F.lit(0).cast("long")
    for t in reversed(TIERS):
        base = F.when(F.col("tier") == t, before).otherwise(base)
        before = before + F.col(sizes[t])
    starts = firsts.join(F.broadcast(totals)).select("tier", "part", "first", base.alias("base"))  # totals is one row
    rank = F.col("first") + F.col("number")
    return every.join(starts, ["tier", "part"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + rank).alias("sequence_id"),
        "offset",
        "tier",
        F.floor(rank * F.col("tier") / STEP_TOKENS).alias("step_group"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
