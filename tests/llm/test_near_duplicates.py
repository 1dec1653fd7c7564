"""The Jaccard join against all pairs, and its parts."""

import random

import numpy as np
import pytest
from helpers import documents, words

from millrace.llm import jaccard
from millrace.llm._common import windows, word_hashes


def corpus():
    rng = random.Random(8)
    rows, n = [], 0
    for _ in range(60):
        base = words(rng, rng.choice([3, 4, 5, 20, 60, 200]))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = "".join(words(rng, 1))
            rows.append((n, " ".join(w) + rng.choice(["", "!", " ?"])))
            n += 1
    hot = words(rng, 150)
    for _ in range(120):  # one large group of near copies
        w = list(hot)
        w[rng.randrange(150)] = "".join(words(rng, 2))
        rows.append((n, " ".join(w)))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "..."), (n + 4, "?!"), (n + 5, "solo " * 30_000)]


def brute(rows):
    """Class and links of each document, from all pairs of shingle sets."""
    rows = sorted(dict(rows).items())
    sets = []
    for _, t in rows:
        w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {("raw", t or "")})
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: (rows[root(i)][0], links[i]) for i in range(len(rows))}


def joined(df):
    return {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(df).collect()}


@pytest.mark.parametrize("block", [1024, 8])
def test_join_matches_brute_force(spark, monkeypatch, block):
    """With small blocks the large groups go down to longer prefixes, to pivots and to blocks of nodes."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    assert joined(documents(spark, rows + [rows[0], (None, "x")], extra=True)) == brute(rows)


def spread_out(n, most):
    """Copies of one text with up to ``most`` of 150 words changed: some pairs are linked, some not."""
    rng = random.Random(most)
    hot, rows = words(rng, 150), []
    for i in range(n):
        w = list(hot)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(150)] = "".join(words(rng, 2))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("most", [3, 14])
def test_masses_of_near_copies(spark, monkeypatch, most):
    """Links that pivots decide and those that blocks find make up all of them, each once."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = spread_out(160, most)
    close_to_all_links(joined(documents(spark, rows)), brute(rows))


def close_to_all_links(got, want):
    """Classes are equal; no link is made up; few are missed, as the target recall allows."""
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    missed = sum(n for _, n in want.values()) - sum(n for _, n in got.values())
    assert 0 <= missed <= 0.01 * sum(n for _, n in want.values())
    assert all(got[d][1] <= want[d][1] for d in want)


def test_pivots_spare_comparisons(spark, monkeypatch):
    """A mass of close copies is counted without comparing its pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    compared = spark.sparkContext.accumulator(0)
    whole = jaccard._verify

    def counting(key, frame):
        compared.add(len(frame))
        return whole(key, frame)

    monkeypatch.setattr(jaccard, "_verify", counting)
    rows = spread_out(200, 1)
    close_to_all_links(joined(documents(spark, rows)), brute(rows))
    assert compared.value == 0


def test_depth_follows_density(spark, monkeypatch):
    """Sparse texts are matched by the shortest prefix, texts of a dense region by longer ones."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(12)
    texts = [words(rng, 60) for _ in range(30)]
    sparse = [(1000 + 2 * i + k, " ".join(t)) for i, w in enumerate(texts) for k, t in enumerate([w, [*w[:59], "x"]])]
    shared = words(rng, 100)
    dense = [(i, " ".join(shared + words(rng, 60))) for i in range(150)]
    dense += [(200 + i, t + " x") for i, t in dense[::5]]
    _, _, about, by_level = jaccard.matched(documents(spark, dense + sparse))
    depth = {r["rep"]: r["depth"] for level in by_level for r in level.where("small").collect()}
    first, *longer = [d for d, _ in jaccard.levels()]
    assert {d for r, d in depth.items() if r >= 1000} == {first}
    assert {d for r, d in depth.items() if r < 1000} & set(longer)
    got = {r["rep"]: (r["class"], r["links"]) for r in about.collect()}
    want = {i: c for i, c in brute(dense + sparse).items() if c[1]}
    assert {i: c for i, c in got.items() if c[1]} == want


def test_recall_of_each_level():
    """Of pairs just above the threshold each level's labels meet the target share."""
    rng = random.Random(3)
    met, n = {k: 0 for k in jaccard.levels()}, 300
    for _ in range(n):
        size = rng.randint(40, 400)
        both, alone = round(0.8 * size), size - round(0.8 * size)
        draw = np.random.RandomState(rng.randrange(1 << 30)).randint(0, 1 << 62, size, dtype=np.int64).astype(np.uint64)
        x, y = np.sort(draw[: both + alone // 2]), np.sort(np.concatenate([draw[:both], draw[both + alone // 2 :]]))
        for depth, trees in met:
            s = jaccard.signatures([x, y], depth, trees)
            met[depth, trees] += bool((s[0] == s[1]).any())
    assert all(m >= 0.97 * n for m in met.values())
    for depth, trees in met:
        assert 1 - (1 - jaccard.THRESHOLD**depth) ** trees >= jaccard.RECALL


def test_longer_labels_extend_shorter_ones():
    times, plus = jaccard._multipliers(3, 6)
    assert (jaccard._multipliers(3, 10)[0][:6] == times).all() and (jaccard._multipliers(3, 10)[1][:6] == plus).all()


def test_one_of_each(spark):
    rows = corpus()
    docs = documents(spark, rows + [rows[0], (None, "x")], extra=True)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*{c for c, _ in brute(rows).values()}, None], key=str)


def test_texts_under_one_id(spark):
    """Different texts that share an id stay; copies go, whichever id they have."""
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 40)) for _ in range(3))
    rows = [(1, a), (1, b), (2, b), (2, b), (3, c), (3, a + " end"), (4, c), (None, a)]
    kept = jaccard.one_of_each(documents(spark, rows, extra=True))
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([(1, a), (1, b), (3, c), (None, a)], key=str)


def test_no_rows(spark):
    assert jaccard.join(documents(spark, [])).collect() == []


def test_word_hashes_follow_words():
    texts = ["Hello, WORLD", None, "", "hello world", "a" * 700_000 + " b", "né.né"]
    h, at = word_hashes(texts)
    assert list(np.diff(at)) == [2, 0, 0, 2, 2, 2]
    assert (h[0:2] == h[2:4]).all() and h[6] == h[7] and len(set(h.tolist())) == 5
    assert len(windows(h[:4], 5)) == 0


def test_components_of_a_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["doc"]: r["class"] for r in jaccard.components(pairs).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
