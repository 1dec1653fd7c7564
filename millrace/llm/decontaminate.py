"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Both sides are sequences of hashed words.  A benchmark item of n words is sought in windows
of n words; an item and a window match if their edit distance in words is at most
``MAX_EDITS`` of n.  The CGK random walk turns a sequence into 3 n symbols whose Hamming
distance is, with good probability, close to the edit distance: at step j it writes the
current word and moves on if a random bit of (j, word) says so.  Several walks are made, and
of each several samples of positions are hashed; a window whose hash equals the item's in
one of ``samples_for_recall`` samples is a candidate, and candidates are verified by the exact edit distance.

Where windows are laid: a stretch within e = floor(MAX_EDITS * n) edits of an item has a run of
q = ``seed_words(n)`` words in common with it, and at least n - q + 1 - q e of the item's runs
of q words (the q-gram lemma), all on diagonals less than 2 e apart.  So windows are laid on
the diagonals of shared runs, where a place has enough of them.  That loses nothing, and
lets a text without a benchmark's words cost one pass over its word hashes.  Items are
broadcast in blocks of at most ``BROADCAST_WORDS`` words as they are hashed, and ``BROADCAST_BYTES``;
each block is a pass over the documents.  Where many items share a run that a text repeats,
items are taken a few at a time, so that at most about ``HITS`` runs in common (or those of one
item with one batch of texts) are held at once.

Edge cases: null texts and items without words match nothing; items shorter than
``SEED_WORDS`` words are matched by all their words; repeated items are found each;
repeated rows are found each; an empty table on either side gives no rows; columns other than
the ids and texts are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import Shared, batches, held, mix, ready, table, windows, word_hashes

MAX_EDITS = 0.2
SEED_WORDS = 3
WALKS, RECALL = 8, 0.99
SAMPLED = 4  # positions of an embedding in one sample
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 8 << 20  # of the items in a block; a longer item is a block by itself
HITS = 1 << 20  # runs in common that are held at once
SEED = 0x1234567F00D


def edits_allowed(n: int) -> int:
    return int(math.floor(MAX_EDITS * n))


def seed_words(n: int) -> int:
    """Words of a run that any match of an item of ``n`` words has in common with the text."""
    e = edits_allowed(n)
    return max(1, min(SEED_WORDS, (n - e) // (e + 1), n))


def samples_for_recall(walks: int = WALKS, recall: float = RECALL) -> int:
    """Samples of each walk, so that a pair at the largest distance collides with probability ``recall``.

    A walk keeps the Hamming distance of a pair at e edits below 4 e with a chance of at least a
    half; e / 3 n is at most ``MAX_EDITS`` / 3, so the chance of one sample is the same for any n.
    """
    one = max(0.02, 1 - 4 * MAX_EDITS / 3) ** SAMPLED
    need = 2 * ((1 - recall) ** (1 / walks) - 0.5)  # what a good walk may miss
    return min(64, max(8, math.ceil(math.log(need) / math.log(1 - one)))) if 0 < need < 1 else 16


SAMPLES = samples_for_recall()
_DRAWN = np.random.RandomState(77).rand(WALKS, SAMPLES, SAMPLED)


def embed(sequences: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """CGK embeddings: rows of ``sequences`` (rows, n) are ``lengths`` words long, then 0; 3 n symbols each."""
    rows, n = sequences.shape
    padded = np.concatenate([sequences, np.zeros((rows, 1), np.uint64)], axis=1)
    at = np.zeros(rows, np.int64)
    out = np.empty((rows, 3 * n), np.uint64)
    every = np.arange(rows)
    for j in range(3 * n):
        symbol = padded[every, at]
        out[:, j] = symbol
        on = (mix(symbol + np.uint64(((walk << 32) + j + 1) * SEED % (1 << 64))) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + on, lengths)
    return out


def sampled_hashes(embedded: np.ndarray, sizes: np.ndarray, walk: int) -> np.ndarray:
    """(rows, SAMPLES) hashes of positions drawn from the first 3 n symbols, n being each row's item's size."""
    every = np.arange(len(embedded))
    out = np.zeros((len(embedded), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        for u in _DRAWN[walk, k]:
            position = (u * 3 * sizes).astype(np.int64)
            out[:, k] = mix(out[:, k] * np.uint64(3) + embedded[every, position] + np.uint64(k))
    return out


def _padded(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words])
    rows = np.zeros((len(words), int(n.max())), np.uint64)
    rows[np.arange(rows.shape[1])[None] < n[:, None]] = np.concatenate(words)
    return rows, n


class Items:
    """A block of benchmark items, ready to be sought."""

    def __init__(self, ids: list, texts: list) -> None:
        h, offsets = word_hashes(texts)
        own = [(i, h[offsets[k] : offsets[k + 1]]) for k, i in enumerate(ids) if offsets[k + 1] > offsets[k]]
        self.ids = [i for i, _ in own]
        self.words = [w for _, w in own]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            by.setdefault(seed_words(len(w)), []).append((w, k))
        for n, group in by.items():
            runs = [windows(w, n) for w, _ in group]
            hashes = np.concatenate(runs)
            item = np.repeat([k for _, k in group], [len(r) for r in runs])
            place = np.concatenate([np.arange(len(r)) for r in runs])
            order = np.lexsort((item, hashes))
            values, rank = np.unique(hashes[order], return_inverse=True)
            # Runs by hash and then item, so that those of a range of items are found by two searches.
            self.seeds[n] = values, rank * len(self.words) + item[order], item[order], place[order]
        self.filters = {n: _bitmap(s[0]) for n, s in self.seeds.items()}
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([edits_allowed(len(w)) for w in self.words], np.int64)
        q = np.array([seed_words(len(w)) for w in self.words], np.int64)
        self.least = np.maximum(1, self.sizes - q + 1 - q * self.edits)  # of its runs in any match
        self.samples = np.zeros((WALKS, len(self.words), SAMPLES), np.uint64)
        for walk in range(WALKS):
            for own in _by_size(self.sizes):
                rows, n = _padded([self.words[k] for k in own])
                self.samples[walk, own] = sampled_hashes(embed(rows, n, walk), n, walk)


def _by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of items of about one size: within a power of two of each other."""
    kind = np.ceil(np.log2(np.maximum(sizes, 1)))
    for k in np.unique(kind):
        yield np.flatnonzero(kind == k)


_BITMAP = 20


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITMAP, bool)
    out[(hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
    return out


def _last_row(item: np.ndarray, text: np.ndarray, free: bool) -> np.ndarray:
    """Least edits between the item and stretches of the text that end at each place, and begin at its start or (``free``) anywhere."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free else places
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - places) + places  # words of the text that are inserted
    return row


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edits between ``item`` and any stretch of ``text``; the first end of such a stretch, and its last begin."""
    row = _last_row(item, text, True)
    end = int(row.argmin())
    cost = int(row[end])
    if cost > most:
        return most + 1, 0, 0
    back = _last_row(item[::-1], text[:end][::-1], False)
    return cost, end - int(np.flatnonzero(back == cost)[0]), end


def _hits(items: Items, h: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Item, text, first word of the window aligned with the seed, and the seed's place in the item, by seed met.

    They come in slices of about ``HITS``, all those of an item together.
    """
    met: list[tuple] = []  # by size of the runs: places in the texts, and ranks of their hashes
    for n, (values, keys, item, place) in items.seeds.items():
        runs = windows(h, n)
        at = np.flatnonzero(items.filters[n][(runs >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(values, runs[at]), len(values) - 1)
        at, rank = at[values[rank] == runs[at]], rank[values[rank] == runs[at]]
        text = np.searchsorted(offsets, at, "right")
        within = at + n <= offsets[text]  # not across two texts
        if within.any():
            met.append((at[within], rank[within], text[within] - 1, keys, item, place))
    if not met:
        return
    # How many hits each item has: each run's items count as often as the texts have the run.
    each = np.zeros(len(items.words) + 1, np.int64)
    for _, rank, _, keys, item, _ in met:
        each[1:] += np.bincount(item, np.bincount(rank, minlength=int(keys[-1] // len(items.words)) + 1)[keys // len(items.words)], len(items.words)).astype(np.int64)
    upto = np.cumsum(each)
    low = 0
    while low < len(items.words):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + HITS, "right")) - 1)
        found: list[list[np.ndarray]] = [[], [], [], []]
        for at, rank, text, keys, item, place in met:
            first = np.searchsorted(keys, rank * len(items.words) + low)
            count = np.searchsorted(keys, rank * len(items.words) + high) - first
            index = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            for own, values in zip(found, (item[index], np.repeat(text, count), np.repeat(at, count) - place[index], place[index]), strict=True):
                own.append(values)
        low = high
        if sum(map(len, found[0])):
            yield tuple(np.concatenate(x).astype(np.int64) for x in found)


def _candidates(items: Items, h: np.ndarray, offsets: np.ndarray, item: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows, of their items' sizes from word ``at`` on, collide with their item in a sample."""
    met = np.zeros(len(item), bool)
    for own in _by_size(items.sizes[item]):
        for cut in range(0, len(own), 2048):
            part = own[cut : cut + 2048]
            n = items.sizes[item[part]]
            begin = np.maximum(at[part], offsets[text[part]])
            lengths = np.maximum(np.minimum(at[part] + n, offsets[text[part] + 1]) - begin, 0)
            column = np.arange(int(n.max()))[None]
            rows = np.where(column < lengths[:, None], h[np.minimum(begin[:, None] + column, len(h) - 1)], np.uint64(0))
            left = np.arange(len(part))
            for walk in range(WALKS):
                samples = sampled_hashes(embed(rows[left], lengths[left], walk), n[left], walk)
                hit = (samples == items.samples[walk, item[part[left]]]).any(axis=1)
                met[part[left[hit]]] = True
                left = left[~hit]
                if not len(left):
                    break
    return met


def matches(items: Items, texts: list) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, words, edits) of the best match of each text and item."""
    h, offsets = word_hashes(texts)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for hits in _hits(items, h, offsets):
        _best_of(items, h, offsets, *hits, best)
    return sorted((t, items.ids[k], first, count, cost) for (t, k), (cost, first, count) in best.items())


def _best_of(items: Items, h: np.ndarray, offsets: np.ndarray, item: np.ndarray, text: np.ndarray, at: np.ndarray, place: np.ndarray, best: dict) -> None:
    """Put the best match of each text and item among some seeds into ``best``."""
    # Seeds of one text and item on neighbouring diagonals belong to one place.
    order = np.lexsort((place, at, text, item))
    item, text, at, place = item[order], text[order], at[order], place[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > items.edits[item[1:]] * 2)))
    group = np.cumsum(new) - 1
    seeds = np.unique(group * (int(items.sizes.max()) + 1) + place) // (int(items.sizes.max()) + 1)
    enough = np.bincount(seeds, minlength=group[-1] + 1) >= items.least[item[new]]
    keep = enough[group] & np.concatenate(([True], (at[1:] != at[:-1]) | (group[1:] != group[:-1])))
    item, text, at, group = item[keep], text[keep], at[keep], group[keep]
    if not len(item):
        return
    hit = group[_candidates(items, h, offsets, item, text, at)]
    for g in np.unique(hit):
        a, b = np.searchsorted(group, (g, g + 1))
        k, t, e = int(item[a]), int(text[a]), int(items.edits[item[a]])
        begin, end = max(int(at[a]) - e, int(offsets[t])), min(int(at[b - 1]) + int(items.sizes[k]) + e, int(offsets[t + 1]))
        cost, first, last = _exact(items.words[k], h[begin:end], e)
        if cost <= e and ((t, k) not in best or cost < best[t, k][0]):
            best[t, k] = (cost, begin - int(offsets[t]) + first, last - first)


def _exact(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """``edit_distance``, with whole copies found first."""
    n = len(item)
    for at in np.flatnonzero(text[: max(0, len(text) - n + 1)] == item[0]):
        if np.array_equal(text[at : at + n], item):
            return 0, int(at), int(at) + n
    return edit_distance(item, text, most)


_FOUND = "doc_id long, item_id long, first_word long, n_words long, edits long"
_FOUND_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _FOUND.split(", ")])


def _loaded(shared) -> Items:
    return held("items", shared.token, lambda: Items(*pickle.loads(shared.value)))


def _seek(shared):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _loaded(shared)
        for frame in frames:
            docs, bodies = frame.column(0).to_pylist(), frame.column(1).to_pylist()
            rows = []
            for a, b in batches(bodies, 1 << 22):
                rows += [(docs[a + t], *rest) for t, *rest in matches(items, bodies[a:b])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_FOUND_ARROW)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Items that have words, in blocks of at most ``BROADCAST_WORDS`` and ``BROADCAST_BYTES`` (a longer item is alone)."""
    ids, texts, words, size = [], [], 0, 0
    for row in benchmark.toLocalIterator():
        n, m = len(word_hashes([row["text"]])[0]), len((row["text"] or "").encode())
        if not n:
            continue
        if ids and (words + n > BROADCAST_WORDS or size + m > BROADCAST_BYTES):
            yield ids, texts
            ids, texts, words, size = [], [], 0, 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        words += n
        size += m
    if ids:
        yield ids, texts


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: where, how many words, and at how many edits."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out: DataFrame | None = None
    for ids, bodies in _blocks(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        part = texts.mapInArrow(_seek(Shared(spark, pickle.dumps((ids, bodies)))), _FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    ready(spark)
    for ids, bodies in _blocks(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        docs = docs.where(~_leaky(Shared(spark, pickle.dumps((ids, bodies))))(F.col("text").cast("string")))
    return docs


def _leaky(shared):
    @F.pandas_udf("boolean")
    def run(column: pd.Series) -> pd.Series:
        items, texts = _loaded(shared), column.tolist()
        out = np.zeros(len(texts), bool)
        for a, b in batches(texts, 1 << 22):
            out[[a + m[0] for m in matches(items, texts[a:b])]] = True
        return pd.Series(out)

    return run


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
