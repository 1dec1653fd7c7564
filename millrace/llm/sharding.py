"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards with a weight at each shard.  A key
descends from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` a
hash of the key and the child's name, and the smallest draw wins.  A child therefore gets
keys in proportion to the weight below it, and a change of weight moves keys only between
the subtree whose weight changed and its siblings, level by level.  ``grown`` adds a shard
as a region of its own, so that the rows it wins at the top level go to it alone and no
other row moves (law ``key``).  The law looks at the key alone, so rows with equal texts under
different keys may lie in different shards.

Edge cases: a null key hashes as the word ``null``; a null text has no bytes (size 1, CRC 0);
repeated rows are rows like any other and get slots of their own; an empty table gives no
rows; columns of the input other than the key and the text are not read, so their names
can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm._common import table, written

BUCKET_DIGITS = 3  # hexadecimal digits of a row's bucket: 4096 buckets a shard, whatever the keys are


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def leaf(name: str, shard: int, weight: float = 1.0) -> Node:
    return Node(name, weight, (), shard)


def branch(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def balanced(regions: int, racks: int, shards: int) -> Node:
    """Equal shards, numbered from 0, in ``regions`` x ``racks`` x ``shards``."""
    out, n = [], 0
    for r in range(regions):
        inner = []
        for k in range(racks):
            inner.append(branch(f"r{r}k{k}", [leaf(f"r{r}k{k}s{s}", n + s) for s in range(shards)]))
            n += shards
        out.append(branch(f"r{r}", inner))
    return branch("root", out)


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The same topology with one more shard, alone in a region of its own."""
    name = f"g{shard}"
    return branch("root", [*root.children, branch(name, [branch(f"{name}k0", [leaf(f"{name}k0s0", shard, weight)])])])


def draw(key: Column, node: Node) -> Column:
    """The node's weighted draw for a key: exponential with the node's weight as its rate."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(node.name), key).cast("binary")), 1, 12), 16, 10).cast("bigint")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 48))) / F.lit(float(node.weight))


def placed(key: Column, node: Node) -> Column:
    """The shard that a key (as text) descends to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return placed(key, node.children[0])
    least = F.least(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i"), F.lit(c.shard).alias("s")) for i, c in enumerate(node.children)])
    if not any(c.children for c in node.children):
        return least["s"]  # drawn once: each comparison with an index below draws anew
    best = least["i"]
    chosen = placed(key, node.children[-1])
    for i, child in reversed(list(enumerate(node.children[:-1]))):
        chosen = F.when(best == i, placed(key, child)).otherwise(chosen)
    return chosen


def extended(topology: Node, larger: Node | None) -> bool:
    """Whether ``larger`` is ``topology`` with one more child, the last, at the root."""
    return larger is not None and bool(topology.children) and larger.children[:-1] == topology.children


def assign(df: DataFrame, topology: Node, key: str = "doc_id", text: str = "text", larger: Node | None = None) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps, bucket by bucket.  A row's bucket is a
    hash of its key and its text's CRC, so no task holds a whole shard, nor all rows of a key
    with many texts; equal rows are counted before the shuffle and spread out again
    afterwards.  What is broadcast is one offset a bucket, at most 4096 a shard.  Texts are read
    once: what is numbered is a table of keys, sizes and CRCs in the shared folder.
    """
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    moves, grown_shard = F.lit(None).cast("boolean"), F.lit(None).cast("int")
    if extended(topology, larger):  # a row moves if the new child's draw is below all others, else it stays: no second descent
        there = [draw(as_text(key), c) for c in topology.children]
        moves = draw(as_text(key), larger.children[-1]) < (F.least(*there) if len(there) > 1 else there[0])
        grown_shard = F.when(F.col("moves"), placed(as_text("k"), larger.children[-1])).otherwise(F.col("shard"))
    elif larger:
        grown_shard = placed(as_text("k"), larger)
    rows = df.select(
        F.col(key).alias("k"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        placed(as_text(key), topology).alias("shard"),
        moves.alias("moves"),
    ).select("k", "size", "crc", "shard", grown_shard.alias("grown"))
    bucket = F.conv(F.substring(F.md5(F.concat_ws("/", as_text("k"), F.col("crc")).cast("binary")), 1, BUCKET_DIGITS), 16, 10).cast("int")
    same = written(rows.groupBy("shard", bucket.alias("bucket"), "k", "size", "crc", "grown").agg(F.count(F.lit(1)).alias("n")), "same")
    within = Window.partitionBy("shard", "bucket")
    ahead = within.orderBy(F.col("k").asc_nulls_first(), "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = same.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    totals = same.groupBy("shard", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    out = numbered.join(F.broadcast(offsets), ["shard", "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    return out.select("k", "size", "crc", "shard", "grown", (F.col("first") + F.col("before")).alias("at"), copy.alias("copy")).select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("at") + F.col("copy")).alias("slot"),
        F.col("grown").cast("int").alias("grown_shard"),
    )


BASE = balanced(2, 2, 4)
LARGER = grown(BASE, 16)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``."""
    out = assign(table(spark, sf_dir, "documents"), BASE, larger=LARGER)
    return out.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_draw(node: Node) -> str:
    bits = f"CAST('0x' || substr(md5('{node.name}/' || k), 1, 12) AS BIGINT)"
    return f"-ln((CAST({bits} AS DOUBLE) + 0.5) / {float(1 << 48)}) / {float(node.weight)}"


def _sql_placed(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_placed(node.children[0])
    draws = [_sql_draw(c) for c in node.children]
    cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {_sql_placed(c)}" for d, c in zip(draws, node.children, strict=True))
    return f"CASE {cases} END"


def op9_sql() -> str:
    """The same assignment in DuckDB, with CRC-32 from its polynomial as that engine has no such function."""
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, k, CAST(octet_length(b) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(b)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
      lambda c, x: xor(crc.steps[xor(c & 255, x) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
    {_sql_placed(BASE)} AS shard, {_sql_placed(LARGER)} AS grown_shard
  FROM d, crc
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '/' || text_crc32), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM s"""
