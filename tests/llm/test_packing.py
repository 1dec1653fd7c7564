"""Packing: every id once, windows full, ids those of the tokenizer."""

import json
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from helpers import documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
TOKENIZER = Tokenizer.from_str(SPEC)
RANKS = packing.merge_ranks(json.loads(SPEC))


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_agrees_with_tokenizer(text):
    assert packing.encoder(SPEC, RANKS).ids(text) == array("I", ids(text)[:-1]).tobytes()


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ don't 'street's", "a\x1cb", "x<|endoftext|>y <|startoftext|>", "漢字 한글", "é é ½ ²", "'re's ''ll", "  x​"])
def test_encoder_on_odd_texts(text):
    assert packing.encoder(SPEC, RANKS).ids(text) == array("I", ids(text)[:-1]).tobytes()


def test_words_in_a_small_memory(monkeypatch):
    """Ids stay right while chunks are forgotten, and with a file whose merges can't be ranked."""
    monkeypatch.setattr(packing, "CACHE", 40)
    rng = random.Random(8)
    for ranks in (RANKS, None):
        enc = packing.Encoder(SPEC, ranks)
        for _ in range(60):
            text = " ".join(rng.choice(["", "(", "It's", "né"]) + "".join(rng.choice("abcehinorstäß'.,-7") for _ in range(rng.randint(1, 14))) for _ in range(40))
            assert enc.ids(text) == array("I", ids(text)[:-1]).tobytes()
            assert len(enc) <= 40


def test_other_files_have_no_ranks():
    spec = json.loads(SPEC)
    assert len(RANKS) == 2 * 256 - 1 + len(spec["model"]["merges"])
    assert packing.merge_ranks(spec | {"pre_tokenizer": None}) is None
    shuffled = spec["model"] | {"merges": spec["model"]["merges"][::-1]}
    assert packing.merge_ranks(spec | {"model": shuffled}) is None


def check(rows, got):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_window[r["sequence_id"]].append(r)
    for window in by_window.values():
        at = 0
        for r in sorted(window, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window[0]["tier"] and {r["tier"] for r in window} == {window[0]["tier"]}
    assert sorted(by_window) == list(range(len(by_window)))
    return by_doc, by_window


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.choice([1, 5, 80, 300, 900]))) for i in range(200)] + [(900, None), (901, ""), (902, sentence(rng, 9000)), (None, "no id")]
    got = packing.pack(documents(spark, rows, extra=True).repartition(3)).collect()
    by_doc, by_window = check(rows, got)
    for i, text in rows:
        own = ids(text)
        pieces = sorted(by_doc[i, len(own)], key=lambda r: r["start"])
        at = 0
        for p in pieces:
            assert p["start"] == at
            assert p["ids_crc32"] == zlib.crc32(array("I", own[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(own)
    unfilled = sum(w[0]["tier"] - sum(r["length"] for r in w) for w in by_window.values())
    assert unfilled < 2048
    steps = defaultdict(int)
    for w in by_window.values():
        steps[w[0]["tier"], w[0]["step_group"]] += w[0]["tier"]
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_repeated_rows(spark):
    got = packing.pack(documents(spark, [(1, "a b c")] * 4)).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_no_rows(spark):
    assert packing.pack(documents(spark, [])).collect() == []


def test_packer_bounds_its_pool():
    packer, rng = packing.Packer(), random.Random(1)
    for i in range(3000):
        n = rng.randint(1, 3000)
        packer.add(i, 0, bytes(4 * n), n)
        assert packer.waiting <= packing.POOL_TOKENS + 3000
    packer.fill()
    assert packer.waiting < packing.TIERS[0]
