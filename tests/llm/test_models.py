"""Toxicity and quality: accuracy on texts not trained on, and odd input."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, sentence, words
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity

BAD = ("grobnix", "flurk", "schmozzle")


def toxic_corpus(n=600):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randint(20, 200)), i % 4 == 0
        if bad:
            for _ in range(1 + len(w) // 15):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "er", "ing"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    odd = [(9001, None), (9002, ""), (9003, "x" * 300_000), (None, "no id"), (5, rows[5][1])]
    got = toxicity.judged(documents(spark, rows + odd, extra=True).repartition(3), label_table(spark, labels + [(None, 1, 1), (9003, None, None), (5, 1, labels[5][2])])).collect()
    assert len(got) == len(rows) + len(odd)
    held = [(r["predicted"], labels[r["doc_id"]][2]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([p == y for p, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def levelled(text):
    return [int(toxicity._LEVEL[b]) for b in (" " * 6).encode() + (text or "").lower().encode()]


class Plain:
    """Kneser-Ney models of two classes in dictionaries, as the formulas say."""

    def __init__(self, texts, labelled):
        kinds, self.n, self.types = {}, [Counter(), Counter()], [set(), set()]
        for t in texts:
            b = levelled(t)
            for k in range(6, len(b)):
                kinds.setdefault(tuple(b[k - 2 : k + 1]), set()).add(int(toxicity._KIND[toxicity._INDEX[b[k - 3]]]))
        self.tri = {g: len(k) for g, k in kinds.items()}
        for t, c in labelled:
            b = levelled(t)
            for k in range(6, len(b)):
                self.n[c][tuple(b[k - 5 : k + 1])] += 1
        self.four = [Counter(g[2:] for g in n) for n in self.n]

    def back(self, counts, gram, lower):
        own = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        return (max(counts.get(gram, 0) - 0.75, 0) + 0.75 * len(own) * lower) / sum(own.values())

    def shared(self, tri):
        pairs = Counter(g[1:] for g in self.tri)
        singles = Counter(g[1:] for g in pairs)
        letters = toxicity.LETTERS
        single = (singles.get(tri[2:], 0) + 0.01) / (sum(singles.values()) + 0.01 * letters)
        return self.back(self.tri, tri, self.back(pairs, tri[1:], single))

    def ratio(self, six):
        p = [self.back(self.n[c], six, self.back(self.four[c], six[2:], self.shared(six[3:]))) for c in (0, 1)]
        return min(8.0, max(-8.0, math.log(p[1]) - math.log(p[0])))


def test_toxicity_is_kneser_ney(spark, monkeypatch):
    """Ratios of the distributed model are those of dictionaries, over every training row, the calibration's too."""
    monkeypatch.setattr(toxicity, "WAITING", 500)
    monkeypatch.setattr(toxicity, "TOGETHER", 2)
    rng = random.Random(5)
    rows = [(i, " ".join(w if i % 3 else rng.choice(BAD) for w in words(rng, 6))[:40] + rng.choice(["", "!", " é7", "ü"])) for i in range(60)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    shared = toxicity.fit(documents(spark, rows + [(900, None), (901, "no label")]).repartition(5), label_table(spark, labels), toxicity.remainder(F.col("label_of"), 4) != 2)
    model = toxicity._model(shared)
    assert model.weights is not None
    train = [i for i, _ in rows if remainder(i, 4) != 2]
    plain = Plain([t for _, t in rows] + [None, "no label"], [(rows[i][1], labels[i][2]) for i in train])
    for text in ["grobnix", rows[3][1], rows[4][1], "Zzz 99 qqq", rows[2][1]]:
        a, _, _ = toxicity._bytes([text])
        b = levelled(text)
        want = [plain.ratio(tuple(b[k - 5 : k + 1])) for k in range(6, len(b))]
        np.testing.assert_allclose(toxicity.ratios(model, a), want, atol=2e-3)


def test_one_labelled_id_on_many_rows(spark):
    """A third of all rows under one labelled id: all are scored, and one of them is in the samples that reach the driver."""
    rows, labels = toxic_corpus(200)
    hot = next(i for i in range(0, 200, 4) if remainder(i, 4) != 2 and remainder(i, 3) != 1 and zlib.crc32(f"fold/{i}".encode()) % 5 == 0)
    docs = documents(spark, rows + [(hot, f"{rows[hot][1]} {k}") for k in range(300)]).repartition(8)
    assert toxicity.judged(docs, label_table(spark, labels)).count() == 500
    some, sizes = quality.sampled(docs, label_table(spark, labels), quality.remainder(F.col("label_of"), 3) != 1)
    assert some.count() == sum(sizes.values()) == sum(remainder(i, 3) != 1 for i in range(200))


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)]])
def test_toxicity_without_both_classes(spark, labels):
    got = toxicity.judged(documents(spark, [(0, "a"), (1, "b c"), (2, None)]), label_table(spark, labels)).collect()
    assert len(got) == 3 and len({r["score"] for r in got}) == 1


def test_no_documents(spark):
    empty, labels = documents(spark, []), label_table(spark, [(1, 1, 0), (2, 0, 1)])
    assert toxicity.judged(empty, labels).collect() == []
    assert quality.judged(empty, labels).collect() == []


def poor(rng, i):
    w = words(rng, rng.randint(30, 200))
    return ["!! ".join(w).upper(), " | ".join(w), " ".join(x + "$$$" for x in w)][i % 3]


def test_quality(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 6)
    rng = random.Random(2)
    rows = [(i, poor(rng, i) if i % 3 == 0 else sentence(rng, rng.randint(5, 200)).capitalize()) for i in range(700)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(700)]
    odd = [(9001, None), (9002, ""), (9003, "word " * 60_000), (None, "no id")]
    got = quality.judged(documents(spark, rows + odd, extra=True), label_table(spark, labels)).collect()
    assert len(got) == len(rows) + len(odd)
    held = [(r["predicted"], int(r["doc_id"] % 3 != 0)) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_chunks_cover_every_byte():
    """Pooled responses of a text are the largest over its chunks, each computed by itself."""
    rng = np.random.RandomState(1)
    net = quality.Network(*[rng.randn(*s).astype(np.float32) for s in ((quality.WIDTH * quality.DIMS, quality.FILTERS), (quality.FILTERS,), (quality.FILTERS, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN,))], 0.1)
    texts = ["", "short", "x" * 256, "y" * 257, "".join(chr(97 + i % 26) for i in range(1500)), None]
    z, starts = quality.chunk_logits(net, texts)
    ends = [*starts[1:], len(z)]
    for text, a, b in zip(texts, starts, ends, strict=True):
        body, n = quality._filled((text or "").encode())
        assert b - a == n and len(body) == (n - 1) * quality.APART + quality.CHUNK
        for k in range(n):
            piece = body[k * quality.APART : k * quality.APART + quality.CHUNK]
            after = body[k * quality.APART + quality.CHUNK :][: quality.WIDTH - quality.STEP]  # nothing after the last
            one = np.frombuffer(piece + after.ljust(quality.WIDTH - quality.STEP, b"\0"), np.uint8)
            pooled = (quality._columns(one) @ net.filters).max(axis=0)
            h = np.maximum(np.maximum(pooled + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
            assert abs(float(h @ net.out + net.out_bias) - z[a + k]) < 1e-2


def plain_score(net, text):
    """A text's score, chunk by chunk and filter by filter."""
    body, n = quality._filled((text or "").encode())
    z = []
    for k in range(n):
        piece = body[k * quality.APART : k * quality.APART + quality.CHUNK + (quality.WIDTH - quality.STEP)].ljust(quality.CHUNK + quality.WIDTH - quality.STEP, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK, quality.STEP):
            codes = np.concatenate([quality.CODES[b] for b in piece[at : at + quality.WIDTH]])
            best = np.maximum(best, codes @ net.filters)
        h = np.maximum(np.maximum(best + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
        z.append(min(12.0, max(-12.0, float(h @ net.out + net.out_bias))))
    lacking = max(0.0, 1 - len((text or "").encode()) / quality.CHUNK)
    mean = sum(z) / n
    x = [mean, max(z), min(z), math.log(sum(math.exp(-v) for v in z) / n), lacking, lacking * mean, 1.0]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, net.combine, strict=True))))


def test_quality_scores_match_brute_force(spark):
    """Scores of the distributed scorer are those of a plain forward pass, whatever text comes next."""
    rng = np.random.RandomState(4)
    net = quality.Network(*[(0.3 * rng.randn(*s)).astype(np.float32) for s in ((quality.WIDTH * quality.DIMS, quality.FILTERS), (quality.FILTERS,), (quality.FILTERS, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN,))], 0.1, rng.randn(quality.COMBINED + 1) * 0.3)
    texts = [None, "", "a", "é" * 200, "Some words, some more. " * 40, "x" * 256, "y" * 449, "z1! " * 300]
    got = documents(spark, list(enumerate(texts))).coalesce(1).select("doc_id", quality.scorer(spark, net)(F.col("text")).alias("s")).collect()
    for r in got:
        assert abs(r["s"] - plain_score(net, texts[r["doc_id"]])) < 1e-4


def test_stages_keep_columns(spark):
    rows, labels = toxic_corpus(200)
    docs = documents(spark, rows, extra=True)
    kept = toxicity.without_toxic(docs, label_table(spark, labels))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= set(range(200))
    assert kept.where(F.col("doc_id") % 4 != 0).count() >= 145
