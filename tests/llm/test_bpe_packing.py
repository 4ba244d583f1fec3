"""Encoding against the tokenizers library; packing against its own rules and a plain best fit."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, packing

ODD = [
    "", " ", "\n\n", "a", "It's we'll THEY'RE I'd", "don't!!! ... ??", "x" * 300, "ÀÉÎõü ß ẞ İstanbul ΣΑΣ όσος", "日本語 テスト 12345", "é ä ̈ x", "a b c　d\x85e\x1cf\x1fg\x0bh\x0ci",
    "<|endoftext|> x<|startoftext|>y <|EndOfText|> <|endof text|>", "👍🏽 👩‍👩‍👧 ½ Ⅷ ٣ ‍﻿", "ﬁ ﬂ Å Å", "'s 's''s 'S ’s", "Straße, ÉTÉ. ΌΣΟΣ. ΣΑΣ İİ. ﬁn. e\u0301te\u0301. ¼. 한국어! ª º. ʰ, ǅ. Ⅷ.", "\0\x01\x7f", "tab\tnew\r\nline", "ǅ ŉ ᾳ Ὠ",
]


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t, bpe.Bpe(bpe.read_spec())


def test_same_as_library(both):
    lib, own = both
    r = random.Random(5)
    alphabet = "aeiou thr-'.,!?0123\n\t éßñÜ<|>日 ́"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(1500)] + ["the quick brown " * 50]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text.encode()), "<u4").tolist()
        assert got == want, text
        assert own.decode(own.encode(text.encode())) == lib.decode(want, skip_special_tokens=False), text


def test_memory_is_bounded(monkeypatch, both):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    own = bpe.Bpe(bpe.read_spec())
    words = [f"word{i}x" for i in range(100)]
    assert own.encode(" ".join(words).encode()) == both[1].encode(" ".join(words).encode())
    assert max(len(own), len(own.older), len(own.words), len(own.older_words)) <= 10


def _unfold(ranges, histogram):
    ranges = sorted(ranges)
    out = []
    for i, (length, first, seq, each, offset) in enumerate(ranges):
        end = ranges[i + 1][1] if i + 1 < len(ranges) and ranges[i + 1][0] == length else histogram[length]
        out += [(length, seq + k // each, offset + k % each * length) for k in range(end - first)]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_whole_gapless_and_tight(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 100, 2048])
    histogram = {r.randint(1, capacity): r.choice([1, 2, 3, 50, 1000]) for _ in range(r.randint(0, 60))}
    ranges, bins = packing.plan(histogram, capacity)
    placed = _unfold(ranges, histogram)
    assert len(placed) == sum(histogram.values())
    by = {}
    for length, seq, offset in placed:
        by.setdefault(seq, []).append((offset, length))
    assert sorted(by) == list(range(bins))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(length > capacity / 3 for _, length in items) <= 2
    # never worse than the simple best fit by falling length
    gaps = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        best = min((g for g in range(len(gaps)) if gaps[g] >= length), key=gaps.__getitem__, default=None) if len(placed) < 3000 else None
        if best is None:
            gaps.append(capacity - length)
        else:
            gaps[best] -= length
    if len(placed) < 3000:
        assert bins <= len(gaps) + 1


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (1, "a b c", 9), (2, None, 9), (None, "", 9), (4, "word " * 5000, 9)], "doc_id long, text string, length int")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length) for r in rows) == [(-1, 0, 0, 1), (1, 0, 0, 4), (1, 0, 0, 4), (2, 0, 0, 1), (4, 0, 0, 2048), (4, 1, 2048, 2048), (4, 2, 4096, 905)]
    assert len({r.sequence_id for r in rows}) == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_digests(spark, both):
    import hashlib

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    for r in bpe.digests(docs).collect():
        ids = both[0].encode(([*ODD, None][r.doc_id]) or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(both[0].decode(ids, skip_special_tokens=False).encode()).hexdigest()
