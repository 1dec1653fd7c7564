"""Chat formatting and sharding."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import documents

from millrace.llm import chat, sharding


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def formatted(df):
    from pyspark.sql import functions as F

    out = chat.format_preferences(df, F.floor(F.col("conv_id") / 2).cast("bigint"), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    return {r["pair_id"]: r for r in out.collect()}


def brute(rows, pair):
    """Prompt, completions and masked text of a pair, turn by turn."""
    side = lambda k: sorted((t or -1, r or "", x or "") for c, t, r, x in rows if c == 2 * pair + k)
    a, b = side(0), side(1)
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    show = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in ts)
    trained = lambda ts: "".join(f"{x}<|im_end|>\n" for _, r, x in ts if r == "assistant")
    return show(a[:n]), show(a[n:]), show(b[n:]), trained(a[n:]), trained(b[n:])


ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "é\nwhy"),
    (2, 0, "system", "s"), (2, 1, "user", "q"), (3, 0, "system", "s"), (3, 1, "user", "q"),
    (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"),
    (6, 0, "user", "alone"),
    (8, 0, "user", "u"), (8, 0, "user", "u"), (9, 0, "user", "u"), (9, 1, "assistant", "long " * 20000),
]


def test_chat(spark):
    got = formatted(turns(spark, ROWS + [(None, 0, "user", "lost")]).selectExpr("*", "'c' AS prompt", "'c' AS t"))
    assert set(got) == {0, 1, 2, 3, 4}
    for pair, row in got.items():
        prompt, chosen, rejected, a, b = brute(ROWS, pair)
        assert (row["prompt"], row["chosen"], row["rejected"]) == (prompt, chosen, rejected)
        for text, spans, want in ((chosen, row["chosen_spans"], a), (rejected, row["rejected_spans"], b)):
            at = 0
            for s in spans:
                assert s["start"] == at
                at += s["length"]
            assert at == len(text)
            assert "".join(text[s["start"] : s["start"] + s["length"]] for s in spans if s["loss"]) == want
    assert got[0]["prompt_turns"] == 1 and got[1]["prompt_turns"] == 2 and got[1]["chosen"] == ""
    assert not got[3]["complete"] and got[3]["prompt"] == ""


def test_chat_without_rows(spark):
    assert formatted(turns(spark, [])) == {}


def shards(df, topology=sharding.BASE, larger=sharding.LARGER):
    return sharding.assign(df, topology, larger=larger).collect()


def test_sharding(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(5000 + i, "same") for i in range(200)] + [(7, "text 7"), (7, "other"), (None, "x"), (None, None), (8000, ""), (8001, None), (-70000, "é" * 50000)]
    got = shards(documents(spark, rows, extra=True))
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16))
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) < 1.5 * len(rows) / 16
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 0.6 < moved / (len(rows) / 17) < 1.4


def test_sharding_of_sparse_ids(spark):
    """Random 64-bit ids, and one id on a third of all rows with texts of its own, are numbered in small buckets."""
    rng = random.Random(6)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), "t") for _ in range(4000)] + [(5, f"text {i}") for i in range(2000)]
    got = shards(documents(spark, rows))
    slots, shard = defaultdict(list), sharding.assign(documents(spark, rows), sharding.BASE, larger=sharding.LARGER)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    plan = shard._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and plan.count("BroadcastHashJoin") >= 1


def test_sharding_confines_movement(spark):
    """More weight on one shard moves rows only into subtrees that hold it."""
    df = documents(spark, [(i, "") for i in range(4000)])
    base = sharding.balanced(2, 2, 2)
    heavier = sharding.branch("root", [base.children[0], sharding.branch("r1", [base.children[1].children[0], sharding.branch("r1k1", [base.children[1].children[1].children[0], sharding.leaf("r1k1s1", 7, 3.0)])])])
    a = {r["doc_id"]: r["shard"] for r in shards(df, base, None)}
    b = {r["doc_id"]: r["shard"] for r in shards(df, heavier, None)}
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved
    for x, y in moved:
        assert y >= 4  # into the region that grew
        if x >= 4:
            assert y >= 6  # and within it into the rack that grew
        if x >= 6:
            assert y == 7
    assert Counter(b.values())[7] > 2 * Counter(b.values())[6]


def test_sharding_without_rows(spark):
    assert shards(documents(spark, [])) == []


@pytest.mark.parametrize("n", [2, 3])
def test_nested_growth(spark, n):
    df = documents(spark, [(i, "") for i in range(1000)])
    topology = sharding.BASE
    for k in range(n):
        larger = sharding.grown(topology, 16 + k)
        assert all(r["grown_shard"] in (r["shard"], 16 + k) for r in shards(df, topology, larger))
        topology = larger


def descended(key, node):
    """The shard of a key, node by node."""
    while node.children:
        draws = [-math.log((int(hashlib.md5(f"{c.name}/{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / c.weight for c in node.children]
        node = node.children[draws.index(min(draws))]
    return node.shard


UNEVEN = sharding.branch("root", [sharding.leaf("a", 0, 2.0), sharding.branch("b", [sharding.branch("c", [sharding.leaf("d", 1), sharding.leaf("e", 2, 0.5)]), sharding.leaf("f", 3)]), sharding.leaf("g", 4)])
ONE = sharding.balanced(1, 2, 3)
TWO_MORE = sharding.branch("root", [*ONE.children, sharding.branch("n", [sharding.leaf("n0", 6), sharding.leaf("n1", 7, 2.0)])])


@pytest.mark.parametrize("topology, larger", [(sharding.BASE, sharding.LARGER), (UNEVEN, sharding.grown(UNEVEN, 5)), (ONE, TWO_MORE), (ONE, UNEVEN), (sharding.leaf("x", 3), sharding.grown(sharding.leaf("x", 3), 4))])
def test_sharding_node_by_node(spark, topology, larger):
    for r in shards(documents(spark, [(i, "") for i in range(-500, 1000)] + [(None, "")]), topology, larger):
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (descended(key, topology), descended(key, larger))


def test_sharding_draws_once_a_node(spark, monkeypatch):
    """One hash for each node of both topologies, the old ones at the root once more, and one for the bucket."""
    plans = []
    write = sharding.written
    monkeypatch.setattr(sharding, "written", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    shards(documents(spark, [(1, "a")]))
    assert plans[0].count("md5(") <= (2 + 4 + 16) + (1 + 2) + 1
