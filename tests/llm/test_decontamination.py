"""Benchmark passages: planted with edits, against exact edit distances."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from helpers import documents, words

from millrace.llm import decontaminate
from millrace.llm._common import word_hashes


def plain_distance(item, text):
    """Least edits of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'c' AS doc_id", "'c' AS edits")


def planted():
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.choice([8, 15, 25, 50])))) for k in range(12)]
    rows = []
    for i in range(240):
        w = words(rng, rng.randint(0, 150))
        if i % 2:
            item = items[i % 12][1].split()
            for _ in range(rng.randint(0, len(item) // 4)):
                at, how = rng.randrange(len(item)), rng.random()
                item = item[:at] + ([] if how < 0.3 else words(rng, 1) if how < 0.7 else [item[at], *words(rng, 1)]) + item[at + 1 :]
            at = rng.randint(0, len(w))
            w = w[:at] + item + w[at:]
        rows.append((i, " ".join(w)))
    return items, rows


def test_find_matches_brute_force(spark):
    items, rows = planted()
    odd = [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1]), (903, "the " * 50_000 + items[2][1].upper() + "!")]
    got = decontaminate.find(documents(spark, rows + odd, extra=True), benchmark(spark, items + [(99, None), (98, "")])).collect()
    want = {}
    for i, t in rows:
        for k, text in items:
            d = plain_distance(text.split(), t.split())
            if d <= decontaminate.edits_allowed(len(text.split())):
                want[i, k] = d
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got if r["doc_id"] is not None and r["doc_id"] < 900}
    assert set(found) <= set(want)
    assert len(found) >= 0.97 * len(want)
    assert all(found[k] == want[k] for k in found)
    assert sum(r["doc_id"] == 902 for r in got) == 2
    assert any(r["doc_id"] == 903 and r["item_id"] == 2 and r["edits"] == 0 and r["first_word"] == 50_000 for r in got)
    assert any(r["doc_id"] is None for r in got)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 15, 19, 20, 24, 25, 40, 60])
def test_seeds_survive_edits(n):
    """An item within its edits shares enough runs with the text: the lemma, on random edits."""
    rng = random.Random(n)
    q, e = decontaminate.seed_words(n), decontaminate.edits_allowed(n)
    least = max(1, n - q + 1 - q * e)
    for _ in range(50):
        item = [f"w{k}" for k in range(n)]
        text = list(item)
        for _ in range(e):
            text[rng.randrange(len(text))] = "x"
        runs = {tuple(text[i : i + q]) for i in range(len(text) - q + 1)}
        assert sum(tuple(item[i : i + q]) in runs for i in range(n - q + 1)) >= least


def test_recall_of_lsh_alone():
    """Windows at the largest distance collide with the target's chance."""
    rng = random.Random(6)
    hit = 0
    for _ in range(150):
        n = rng.choice([15, 30, 50])
        item = words(rng, n)
        text = list(item)
        for _ in range(decontaminate.edits_allowed(n)):
            text[rng.randrange(len(text))] = "".join(words(rng, 2))
        items = decontaminate.Items([1], [" ".join(item)])
        h, offsets = word_hashes([" ".join(text)])
        hit += bool(decontaminate._candidates(items, h, offsets, *[decontaminate.np.array([0])] * 3)[0])
    assert hit >= 0.95 * 150


def test_stage_keeps_clean_rows(spark):
    items, rows = planted()
    docs = documents(spark, rows + [(None, None)], extra=True)
    kept = decontaminate.without_leaks(docs, benchmark(spark, items))
    found = {r["doc_id"] for r in decontaminate.find(docs, benchmark(spark, items)).collect()}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - found | {None}


def test_no_rows(spark):
    items, rows = planted()
    assert decontaminate.find(documents(spark, []), benchmark(spark, items)).collect() == []
    assert decontaminate.find(documents(spark, rows[:3]), benchmark(spark, [])).collect() == []


def test_hot_runs_are_held_in_slices(monkeypatch):
    """Many items that begin alike against a text that repeats the beginning: the same matches, in bounded memory."""
    rng = random.Random(9)
    begin = "which of the following is true about"
    texts_of = [f"{begin} {' '.join(words(rng, 12))}" for _ in range(1000)]
    items = decontaminate.Items(list(range(1000)), texts_of)
    text = " ".join([begin] * 3000 + [texts_of[17], begin, texts_of[400]] + [begin] * 500)
    tracemalloc.start()
    found = decontaminate.matches(items, [text, "nothing here", texts_of[3]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(t, k) for t, k, *_ in found} == {(0, 17), (0, 400), (2, 3)} and all(e == 0 for *_, e in found)
    assert peak < 400 << 20
    monkeypatch.setattr(decontaminate, "HITS", 50)
    few = decontaminate.Items(list(range(30)), texts_of[:30])
    small = decontaminate.matches(few, [" ".join([begin] * 20 + [texts_of[17]])])
    monkeypatch.setattr(decontaminate, "HITS", 1 << 30)
    assert small == decontaminate.matches(few, [" ".join([begin] * 20 + [texts_of[17]])]) != []


def test_edit_distance_is_exact_and_fast():
    rng = random.Random(2)
    for _ in range(80):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 25))]
        cost, begin, end = decontaminate.edit_distance(*(np.array(x, np.uint64) for x in (item, text)), 99)
        assert cost == plain_distance(item, text)
        assert plain_distance(item, text[begin:end]) == cost
    long = np.arange(4000, dtype=np.uint64)
    begun = time.process_time()
    assert decontaminate.edit_distance(long, np.delete(np.concatenate([long[:9] + np.uint64(9000), long]), [100, 900]), 800) == (2, 9, 4007)
    assert time.process_time() - begun < 10


def test_blocks_count_words_and_bytes(spark, monkeypatch):
    """Items without white space count by their hashed words, and by their bytes; those without words aren't sent."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 500)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 4000)
    rows = [(i, "-".join(["ab"] * 100)) for i in range(12)] + [(50, None), (51, "..."), (60, "x" * 3000), (61, "y" * 3000)]
    blocks = [ids for ids, _ in decontaminate._blocks(benchmark(spark, rows).select("item_id", "text").coalesce(1))]
    assert blocks == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 60], [61]]


def test_blocks_of_items(spark, monkeypatch):
    items, rows = planted()
    one = {tuple(r) for r in decontaminate.find(documents(spark, rows[:60]), benchmark(spark, items)).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 60)
    assert {tuple(r) for r in decontaminate.find(documents(spark, rows[:60]), benchmark(spark, items)).collect()} == one
