"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document is the set of its five-word shingles (the whole text where it has fewer words).
Texts with the same set are one text with copies.  The forest has trees of labels, which are
strings of MinHash values; texts with a prefix of a label in common are in one node of that
tree's prefix trie.  A trie's level is a table keyed by the prefix, which Spark sorts or hashes.

How long a matched prefix is depends on how dense a region is.  A short prefix meets more
texts, true neighbours and others; a longer one meets fewer, so that more trees are needed for
the same chance.  ``levels`` lists the prefixes from the shortest by which ``TREES`` trees reach
the target recall at the threshold to the longest, each with the trees that it needs.  Texts
that nodes connect, directly or through others, form a group.  A region is matched by the
shortest prefix whose groups are small (``BLOCK`` texts): there all pairs of a group are
compared exactly, in one task.  In larger groups texts go down their tries to longer prefixes,
and to further trees, where groups fall apart; each level keeps the target recall.

What is large about a large group is mostly a mass of near copies.  Jaccard distance is a
metric, so distances to one text in the middle, the pivot, decide most pairs: two texts within
half of the allowed distance of it are linked, and two whose distances from it differ by more
than the allowed distance are not.  Links of the first kind are counted from a histogram, n log n
work for n texts.  Pairs that the pivot doesn't decide, of which one is within three halves of the
allowed distance, are compared exactly in blocks of about ``BLOCK``, each pair of blocks a task.
All others are pairs of texts far from the pivot, and these are what goes down to the next level.
After the last level they are compared in blocks of nodes, each pair in the first tree in which
it meets.  So work is quadratic only in what is between half and three halves of the allowed
distance away from a pivot, and in nodes of the longest prefix.

Edge cases: a null text is an empty one; texts without words are linked only to texts that
are equal to them; repeated rows are one document, and of rows that share a doc_id but not a
text the one with the smallest set fingerprint counts (``one_of_each`` takes such rows as
documents of their own); rows with a null doc_id are left out; an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import batches, dropped, free, likely, mix, ready, scratch, table, windows, word_hashes, written

SHINGLE, THRESHOLD = 5, 0.8
TREES, RECALL = 20, 0.995
LONGER, LEVELS = 4, 3  # values that a prefix grows by from level to level; levels
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000  # of a group, or a block of one, that one task compares: texts, and their shingles
BUNDLE_SHINGLES = 1_000_000  # of small groups that one call compares
SEED = 20240607
STEPS = 1000  # of the distance from a pivot, rounded up
SLACK = round((1 - THRESHOLD) * STEPS)  # the largest distance of a link, in steps


def matched_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix by which two texts at the threshold meet in some tree with probability ``recall``."""
    depth = 1
    while 1 - (1 - threshold ** (depth + 1)) ** trees >= recall:
        depth += 1
    return depth


def levels() -> list[tuple[int, int]]:
    """(length of the prefix, trees that reach the target recall with it), from short to long."""
    first = matched_depth()
    needed = lambda depth: math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**depth))
    return [(first, TREES)] + [(d, needed(d)) for d in range(first + LONGER, first + LONGER * LEVELS, LONGER)]


def shingles(texts: list) -> list[np.ndarray]:
    """Each text's sorted set of 64-bit shingle hashes."""
    h, offsets = word_hashes(texts)
    every = windows(h, SHINGLE)
    out = []
    for i, t in enumerate(texts):
        a, b = offsets[i], offsets[i + 1]
        if b - a >= SHINGLE:
            own = np.unique(every[a : b - SHINGLE + 1])
        elif b > a:
            own = windows(h[a:b], int(b - a)) + np.uint64(b - a)
        else:  # no words: the bytes themselves, so that only equal texts are linked
            raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) + np.uint64(1)
            own = mix(np.array([len(raw)], np.uint64)) if not len(raw) else windows(raw, len(raw))
        out.append(own)
    return out


@lru_cache(maxsize=None)
def _multipliers(tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash functions of a tree's values; a longer label begins with the shorter one."""
    rng = np.random.RandomState(SEED + tree)
    drawn = rng.randint(0, 1 << 32, (depth, 2), dtype=np.int64).astype(np.uint32)
    return drawn[:, 0] | np.uint32(1), drawn[:, 1]


def signatures(sets: list[np.ndarray], depth: int, trees: int) -> np.ndarray:
    """Hash of each tree's label prefix of ``depth`` values, (texts, trees) of 64 bits."""
    values = np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), trees), np.uint64)
    for tree in range(trees):
        for i, (times, plus) in enumerate(zip(*_multipliers(tree, depth), strict=True)):
            low = np.minimum.reduceat(values * times + plus, starts)
            out[:, tree] = mix(out[:, tree] + low.astype(np.uint64) + np.uint64(i))
    return out


_SIGNED = pa.schema([("doc", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n", pa.int64()), ("trees", pa.list_(pa.int64()))])


def _sign(depth: int, trees: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for a, b in batches(texts, 1 << 20):
                sets = shingles(texts[a:b])
                starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
                every = np.concatenate(sets)
                first, second = _prints(every, starts)
                labels = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * trees), pa.array(signatures(sets, depth, trees).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(a, b - a), pa.array(first), pa.array(second), pa.array([len(x) for x in sets], pa.int64()), labels], schema=_SIGNED)

    return run


def _prints(every: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of each set of shingles."""
    return np.add.reduceat(mix(every), starts).view(np.int64), np.add.reduceat(mix(every + np.uint64(SEED)), starts).view(np.int64)


_PACKED = pa.schema([("rep", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("own", pa.binary())])


def _pack_sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free()
    for frame in frames:
        texts = frame.column(1).to_pylist()
        for a, b in batches(texts, 1 << 20):
            sets = shingles(texts[a:b])
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
            first, second = _prints(np.concatenate(sets), starts)
            packed = [_short(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([frame.column(0).slice(a, b - a), pa.array(first), pa.array(second), pa.array(packed, pa.binary())], schema=_PACKED)


def _short(own: np.ndarray) -> np.ndarray:
    """Shingle hashes in 48 bits as three 16-bit numbers: two shingles of a pair of texts agree by chance once in 10**9 pairs."""
    return (own >> np.uint64(16)).astype("<u8").view(np.uint16).reshape(-1, 4)[:, :3].copy()


def _long(packed: bytes) -> np.ndarray:
    parts = np.frombuffer(packed, np.uint16).reshape(-1, 3).astype(np.uint64)
    return parts[:, 0] | (parts[:, 1] << np.uint64(16)) | (parts[:, 2] << np.uint64(32))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each left with each right set, by blocked products of incidence matrices."""
    keys, at = np.unique(np.concatenate(left + right), return_inverse=True)
    cut = sum(len(x) for x in left)
    row = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.zeros(len(keys), bool)
    both[at[:cut]] = True
    other = np.zeros(len(keys), bool)
    other[at[cut:]] = True
    both &= other
    place = np.cumsum(both) - 1
    sides = []
    for rows, own in ((row[0], at[:cut]), (row[1], at[cut:])):
        keep = both[own]
        sides.append((rows[keep], place[own[keep]]))
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(256, (4 << 20) // max(len(left), len(right), 1))
    orders = [np.argsort(c, kind="stable") for _, c in sides]
    sides = [(r[o], c[o]) for (r, c), o in zip(sides, orders, strict=True)]
    for begin in range(0, int(both.sum()), width):
        dense = []
        for (r, c), n in zip(sides, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(c, (begin, begin + width))
            m = np.zeros((n, width), np.float32)
            m[r[a:b], c[a:b] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _linked(common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair reaches the threshold, from the sizes of the intersection and of both sets."""
    return common >= np.float32(THRESHOLD) * (left[:, None] + right[None] - common) - np.float32(1e-3)


def _tie(label: np.ndarray, one: int, others: np.ndarray) -> None:
    """Give the classes of ``one`` and ``others`` the smallest label among them."""
    tied = np.unique(np.append(label[others], label[one]))
    if len(tied) > 1:
        label[np.isin(label, tied[1:])] = tied[0]


def _tiles(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, whether each pair is linked) of all pairs, tile by tile; each pair once where both sides are the same."""
    sizes = np.array([len(x) for x in sets], np.float32)
    step = int(np.clip(BLOCK_SHINGLES / 2 / max(1.0, float(sizes.mean())), 16, 512))
    for r0 in range(0, len(rows), step):
        for c0 in range(r0 if same else 0, len(cols), step):
            r, c = rows[r0 : r0 + step], cols[c0 : c0 + step]
            linked = _linked(_overlaps([sets[k] for k in r], [sets[k] for k in c]), sizes[r], sizes[c])
            if same and r0 == c0:
                linked &= np.triu(np.ones_like(linked), 1)
            yield r, c, linked


_WHOLE = "rep long, class long, links long"
_WHOLE_ARROW = pa.schema([("rep", pa.int64()), ("class", pa.int64()), ("links", pa.int64())])


def _verify_groups(frame: pa.Table) -> pa.Table:
    """Class and links to other texts of each text of some whole groups."""
    free()
    frame = frame.sort_by([("group", "ascending"), ("rep", "ascending")])
    reps, group, copies = (frame.column(c).to_numpy() for c in ("rep", "group", "copies"))
    packed = frame.column("own").to_pylist()
    links, classes = np.zeros(len(reps), np.int64), reps.copy()
    cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)) if len(reps) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sets = [_long(p) for p in packed[a:b]]
        if b - a == 2:
            common = np.array([[len(np.intersect1d(*sets, assume_unique=True))]], np.float32)
            if _linked(common, np.float32([len(sets[0])]), np.float32([len(sets[1])]))[0, 0]:
                links[a], links[a + 1], classes[a + 1] = copies[a + 1], copies[a], reps[a]
            continue
        label, every = np.arange(b - a), np.arange(b - a)
        for r, c, linked in _tiles(sets, every, every, True):
            links[a + r] += linked @ copies[a + c]
            links[a + c] += linked.T @ copies[a + r]
            for p in np.flatnonzero(linked.any(axis=1)):
                _tie(label, r[p], c[linked[p]])
        classes[a:b] = reps[a + label]
    return pa.Table.from_arrays([pa.array(reps, pa.int64()), pa.array(classes, pa.int64()), pa.array(links, pa.int64())], schema=_WHOLE_ARROW)


_LINKS = "a long, b long, n long"
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _verify(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
    """Of two blocks of a group or node: rows (rep, null, links that the pivot doesn't decide) and (smallest, rep, null) of a spanning set."""
    free()
    tree, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
    frame = frame.sort_by("rep")
    reps, block, copies, away = (frame.column(c).to_numpy() for c in ("rep", "block", "copies", "away"))
    trees = np.array(frame.column("trees").combine_chunks().flatten()).reshape(len(reps), -1)
    sets = [_long(p) for p in frame.column("own").to_pylist()]
    rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links, label = np.zeros(len(reps), np.int64), np.arange(len(reps))
    for r, c, linked in _tiles(sets, rows, cols, i == j):
        linked &= away[r][:, None] + away[c][None] > SLACK  # others are counted already
        for t in range(tree):  # met before
            linked &= trees[r, t][:, None] != trees[c, t][None]
        links[r] += linked @ copies[c]
        links[c] += linked.T @ copies[r]
        for p in np.flatnonzero(linked.any(axis=1)):
            _tie(label, r[p], c[linked[p]])
    some = np.flatnonzero(links)
    tied = np.flatnonzero(label != np.arange(len(reps)))
    a = np.concatenate([reps[some], reps[label[tied]]])
    b = pa.array([None] * len(some) + reps[tied].tolist(), pa.int64())
    n = pa.array(links[some].tolist() + [None] * len(tied), pa.int64())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), b, n], schema=_LINK_ARROW)


def _away(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of the Jaccard distance between each text and its pivot, rounded up."""
    free()
    for frame in frames:
        out = []
        for mine, other in zip(frame.column("own").to_pylist(), frame.column("pivot_own").to_pylist(), strict=True):
            x, y = _long(mine), _long(other)
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            out.append(-(-(union - both) * STEPS // union))
        yield pa.RecordBatch.from_arrays([frame.column("rep"), frame.column("group"), frame.column("copies"), pa.array(out, pa.int32())], names=["rep", "group", "copies", "away"])


def components(pairs: DataFrame) -> DataFrame:
    """(doc, class) of all ends of ``pairs`` (a, b): the smallest id of each connected component.

    Each round takes the smallest label among neighbours and then the label's own label, so
    paths halve; labels are a table in the shared folder, rewritten each round.
    """
    spark = pairs.sparkSession
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).select(F.col("a").alias("doc"), "class")
    path = scratch(spark, "labels")
    labels.write.parquet(path)
    while True:
        labels = spark.read.schema("doc long, class long").parquet(path)
        near = both.join(labels, both["b"] == labels["doc"]).groupBy("a").agg(F.min("class").alias("near"))
        up = labels.select(F.col("doc").alias("up"), F.col("class").alias("up_class"))
        joined = labels.join(near, labels["doc"] == near["a"]).select("doc", "class", F.least("near", "class").alias("best"))
        new = joined.join(up, joined["best"] == up["up"], "left").select("doc", F.least("best", F.coalesce("up_class", "best")).alias("class"), (F.least("best", F.coalesce("up_class", "best")) < F.col("class")).alias("moved"))
        after = scratch(spark, "labels")
        new.write.parquet(after)
        moved = not spark.read.schema("moved boolean").parquet(after).where("moved").isEmpty()
        dropped(spark, path)
        path = after
        if not moved:
            return spark.read.schema("doc long, class long").parquet(path)


def _members(labels: DataFrame, label: str) -> DataFrame:
    """(rep, tree, node, hub) of nodes with two texts or more, the hub being the smallest; of nodes with the same texts the first."""
    nodes = labels.select("rep", F.posexplode("trees").alias("tree", "node"))
    who = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"who{k}") for k in (1, 2)]
    inner = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub"), *who).where("size > 1")
    kept = inner.groupBy("size", "hub", "who1", "who2").agg(F.min(F.struct("tree", "node")).alias("at")).select("at.tree", "at.node", "hub")
    return written(nodes.join(kept, ["tree", "node"]).select("rep", "tree", "node", "hub"), label)


def _packed(texts: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of ``wanted`` with ``copies`` and ``own``, the packed shingles, of each of its texts (``rep``).

    Only these texts are read again, and what is shuffled of them is their shingles.
    """
    read = likely(texts, "doc", wanted.select("rep")).mapInArrow(_pack_sets, "rep long, set_a long, set_b long, own binary")
    about = sets.select("rep", F.col("set_a").alias("a"), F.col("set_b").alias("b"), "copies").join(wanted, "rep")
    return about.hint("merge").join(read, "rep").where("set_a = a AND set_b = b").dropDuplicates(["rep"]).select(*wanted.columns, "copies", "own")


def _small_groups(texts: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, class, links) of the texts of ``groups`` (rep, group, shingles), each group compared whole in one call."""
    spark = texts.sparkSession
    total = groups.agg(F.sum("shingles")).first()[0] or 0
    bundles = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUNDLE_SHINGLES))
    rows = _packed(texts, sets, groups.select("rep", "group")).withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(bundles)))
    return rows.groupBy("bundle").applyInArrow(_verify_groups, _WHOLE)


def _tasks(seen: DataFrame, met: dict[int, tuple[int, ...]]) -> DataFrame:
    """(tree, node, rep, block, i, j): each text of ``seen`` (tree, node, rep, kind, n) in each pair of blocks of its node that it belongs to.

    ``met`` says which kinds of texts each kind is compared with; a block holds one kind.
    """
    kinds = sorted(met)
    of = lambda k, what: F.coalesce(F.sum(F.when(F.col("kind") == k, what)), F.lit(0))
    counts = [F.ceil(F.greatest(of(k, F.lit(1)) / BLOCK, of(k, F.col("n")) / BLOCK_SHINGLES)).alias(f"blocks{k}") for k in kinds]
    present = lambda a, b: (F.col(f"blocks{a}") > 0) & (F.col(f"blocks{b}") > 0)
    some = F.lit(False)
    for a in kinds:
        for b in met[a]:
            some = some | present(a, b)
    sizes = seen.groupBy("tree", "node").agg(*counts).where(some)
    numbers = lambda k: F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col(f"blocks{k}"), F.lit(1))), lambda x: (x - 1) * len(kinds) + k)
    of_kind = lambda k: F.when((F.col(f"blocks{k}") > 0) & F.col("kind").isin([a for a in kinds if k in met[a]]), numbers(k)).otherwise(F.array().cast("array<bigint>"))
    mine = F.lit(1).cast("bigint")
    for k in kinds:
        mine = F.when(F.col("kind") == k, F.greatest(F.col(f"blocks{k}"), F.lit(1))).otherwise(mine)
    return (
        seen.join(sizes, ["tree", "node"])
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), mine) * len(kinds) + F.col("kind"))
        .select("tree", "node", "rep", "block", F.explode(F.concat(*[of_kind(k) for k in kinds])).alias("other"))
        .select("tree", "node", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )


def _mass(texts: DataFrame, sets: DataFrame, groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large ``groups`` (rep, group): links and spanning pairs (a, b, n), texts with their sets, and how far each is from its pivot."""
    # The pivot is a text that most nodes hold.
    weight = members.join(groups, "rep").groupBy("group", "rep").agg(F.count(F.lit(1)).alias("held"))
    pivots = written(weight.groupBy("group").agg(F.max_by("rep", F.struct("held", -F.col("rep"))).alias("pivot"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts")), "pivots")
    own = written(_packed(texts, sets, groups), "own")
    middle = pivots.join(own.select(F.col("rep").alias("pivot"), F.col("own").alias("pivot_own")), "pivot")
    middle = middle.select("group", "pivot_own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    salted = own.join(pivots.select("group", "salts"), "group").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    away = written(salted.join(middle, ["group", "salt"]).select("rep", "group", "copies", "own", "pivot_own").mapInArrow(_away, "rep long, group long, copies long, away int"), "away")
    # Links that distances from the pivot decide: with all texts at SLACK - away steps or fewer.
    counted = away.where(F.col("away") <= SLACK).groupBy("group", "away").agg(F.sum("copies").alias("n"))
    steps = pivots.select("group", F.explode(F.sequence(F.lit(0), F.lit(SLACK))).alias("away"))
    upto = Window.partitionBy("group").orderBy("away").rowsBetween(Window.unboundedPreceding, 0)  # SLACK + 1 rows
    within = steps.join(counted, ["group", "away"], "left").select("group", (F.lit(SLACK) - F.col("away")).alias("away"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("within"))
    itself = F.when(2 * F.col("away") <= SLACK, F.col("copies")).otherwise(0)
    none = F.lit(None).cast("long")
    decided = away.join(within, ["group", "away"]).select(F.col("rep").alias("a"), none.alias("b"), (F.col("within") - itself).alias("n"))
    spokes = away.where(F.col("away") <= SLACK).join(pivots, "group").where("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"), none.alias("n"))
    # Kinds: near, around, beyond, and far from all of these.
    half = SLACK // 2
    kind = F.when(F.col("away") <= half, 0).when(F.col("away") <= half + SLACK, 1).when(F.col("away") <= half + 2 * SLACK, 2).otherwise(3)
    seen = away.select("rep", "group", kind.alias("kind")).where("kind < 3").join(sets.select("rep", "n"), "rep").select(F.lit(0).alias("tree"), F.col("group").alias("node"), "rep", "kind", "n")
    about = own.select("rep", "copies", "own", F.array().cast("array<long>").alias("trees")).join(away.select("rep", F.col("away").cast("long").alias("away")), "rep")
    blocks = _tasks(seen, {0: (1,), 1: (0, 1, 2), 2: (1,)}).join(about, "rep").groupBy("tree", "node", "i", "j").applyInArrow(_verify, _LINKS)
    return written(blocks.unionByName(decided).unionByName(spokes), "found"), own, away


def _node_by_node(sets: DataFrame, own: DataFrame, far: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Links and spanning pairs among the texts ``far`` (rep) from their pivots that share a node."""
    seen = members.join(far, "rep").join(sets.select("rep", "n"), "rep").select("tree", "node", "rep", F.lit(0).alias("kind"), "n")
    about = own.select("rep", "copies", "own").join(far, "rep").join(labels, "rep").withColumn("away", F.lit(STEPS).cast("long"))
    return written(_tasks(seen, {0: (0,)}).join(about, "rep").groupBy("tree", "node", "i", "j").applyInArrow(_verify, _LINKS), "found")


def matched(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What ``join`` is put together from.

    Documents with their sets; sets; (rep, class, links) of texts with candidates; and, by level of the
    forest, the texts that are matched there (rep, depth).
    """
    ready(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    signed_as = "doc long, set_a long, set_b long, n long, trees array<long>"
    every = texts.mapInArrow(_sign(*levels()[0]), signed_as)
    signed = written(every.groupBy("doc").agg(F.min(F.struct("set_a", "set_b", "n", "trees")).alias("s")).select("doc", "s.*"), "signed")
    # One representative of each shingle set; its labels are those of all its copies.
    sets = written(signed.groupBy("set_a", "set_b", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("trees").alias("trees")), "sets")
    labels = sets.select("rep", "trees")
    whole: DataFrame | None = None
    deep: list[DataFrame] = []
    by_level: list[DataFrame] = []
    for k, (depth, trees) in enumerate(levels()):
        if k:  # the same texts' longer labels, in more trees
            again = likely(texts, "doc", far).mapInArrow(_sign(depth, trees), signed_as).select(F.col("doc").alias("rep"), "set_a", "set_b", "trees")
            wanted = sets.select("rep", F.col("set_a").alias("a"), F.col("set_b").alias("b")).join(far, "rep")
            labels = written(wanted.hint("merge").join(again, "rep").where("set_a = a AND set_b = b").dropDuplicates(["rep"]).select("rep", "trees"), "labels")
        members = _members(labels, "members")
        groups = components(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
        sized = groups.select(F.col("doc").alias("rep"), F.col("class").alias("group")).join(sets.select("rep", "n"), "rep")
        sizes = sized.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
        small = (F.col("size") <= BLOCK) & (F.col("total") <= BLOCK_SHINGLES)
        judged = written(sized.join(sizes, "group").select("rep", "group", F.col("n").alias("shingles"), small.alias("small")), "groups")
        found = written(_small_groups(texts, sets, judged.where("small").select("rep", "group", "shingles")), "linked")
        by_level.append(judged.select("rep", F.lit(depth).alias("depth"), "small"))
        if whole is None:
            whole = found
        else:
            deep += [found.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), F.col("links").alias("n")), found.where("class <> rep").select(F.col("class").alias("a"), F.col("rep").alias("b"), F.lit(None).cast("long").alias("n"))]
        large = judged.where("NOT small").select("rep", "group")
        if large.isEmpty():
            break
        links, own, away = _mass(texts, sets, large, members)
        deep.append(links)
        far = away.where(F.col("away") > SLACK + SLACK // 2).select("rep")
        if far.isEmpty():
            break
    else:
        deep.append(_node_by_node(sets, own, far, members, labels))
    if deep:
        every = deep[0]
        for more in deep[1:]:
            every = every.unionByName(more)
        counts = every.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        classes = components(every.where("b IS NOT NULL").select("a", "b")).select(F.col("doc").alias("rep"), "class")
        both = counts.join(classes, "rep", "left").select("rep", F.coalesce("class", "rep").alias("class"), "links")
        whole = whole.unionByName(both)
    return signed, sets, whole, by_level


def join(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, class_id (the smallest doc_id of its class), links."""
    signed, sets, about, _ = matched(docs)
    out = sets.select("set_a", "set_b", "rep", "copies").join(about, "rep", "left")
    kept = out.select("set_a", "set_b", F.coalesce("class", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("doc", "set_a", "set_b").join(kept, ["set_a", "set_b"]).select(F.col("doc").alias("doc_id"), "class_id", "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that with the smallest doc_id; rows with a null doc_id stay.

    Where ids are repeated, each row is a document of its own, so texts that share an id stay
    unless they are near copies of a text that stays.
    """
    found = written(join(docs), "classes")
    if docs.where(F.col("doc_id").isNotNull()).count() == found.count():
        others = found.where("class_id <> doc_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    own = rows.where(F.col("doc_id").isNotNull()).select(F.col("__row").alias("doc_id"), "text")
    classes = written(join(own).withColumnRenamed("doc_id", "__row"), "classes")
    first = classes.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(classes.select("__row").join(first, "__row", "left_anti"), "__row", "left_anti").select(*docs.columns)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
