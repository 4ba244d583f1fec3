"""Deobfuscation on its own, Viterbi against enumeration, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from graphloom.llm import toxicity as tx


def _model(words):
    four = np.zeros(tx.A**4, np.int64)
    c = tx.CODES[np.frombuffer((" " + "  ".join(words) + " ").encode(), np.uint8)]
    np.add.at(four, ((c[:-3] * tx.A + c[1:-2]) * tx.A + c[2:-1]) * tx.A + c[3:], 1)
    return tx.CharModel(four)


WORDS = ["idiot", "stupid", "loser", "moron", "the", "little", "letter", "people", "hello", "trash", "worthless"] * 50


def test_restores_disguises():
    m = _model(WORDS)
    for s, want in {"1d10t": "idiot", "st*pid": "stupid", "stuuupid": "stupid", "l0ser": "loser", "tra$h!!": "trash", "i.d.i.o.t": "idiot", "m-o-r-o-n": "moron", "worthle55": "worthless", "little": "little", "hello": "hello", "peeeople": "people"}.items():
        assert tx.readings(s, m) == [want], s
    assert tx.readings("s t u p i d  l o s e r", m) == ["stupid", "loser"]
    assert tx.readings("été", m) == ["été"] and tx.readings("...", m) == [] and tx.readings("123", m) == ["123"]
    assert b"i d i o t" in tx.Reader(m).tokens(b"you i d i o t!")


def test_viterbi_equals_enumeration():
    m = _model(WORDS)
    r = random.Random(4)
    for _ in range(60):
        s = "".join(r.choice("aeilost013@$*. ") for _ in range(r.randrange(1, 6)))
        if "*" in s and s.count("*") > 1:
            continue
        best = None
        for choice in itertools.product(*[tx.options(s, i) for i in range(len(s))]):
            state, cost, out = " ", 0.0, ""
            for c, channel in choice:
                cost += channel
                if c:
                    cost += m.cost(state, c)
                    state, out = (" " if c == " " else (state + c)[-3:]), out + c
            cost += 0 if state == " " else m.cost(state, " ")
            if best is None or cost < best[0] - 1e-12:
                best = (cost, out)
        got = tx.restore(s, m)
        assert got == best[1] or _cost(s, got, m) == pytest.approx(best[0]), s


def _cost(s, out, m):
    best = float("inf")
    for choice in itertools.product(*[tx.options(s, i) for i in range(len(s))]):
        if "".join(c for c, _ in choice) != out:
            continue
        state, cost = " ", sum(x for _, x in choice)
        for c in out:
            cost += m.cost(state, c)
            state = " " if c == " " else (state + c)[-3:]
        best = min(best, cost + (0 if state == " " else m.cost(state, " ")))
    return best


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = tx.op2_toxicity(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if not r.toxic) / len(rows) < 0.01


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "x", 5), (1, "again", 5), (4, "y" * 100_000 + " 1" * 50_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = tx.score(docs, labels).collect()
    assert len(got) == 5 and all(0 <= g.score <= 1 for g in got)
    assert {g.predicted for g in tx.score(docs, labels.limit(0)).collect()} == {0}
    assert tx.score(docs.limit(0), labels.limit(0)).count() == 0


def test_clashing_columns_pass(spark):
    docs = spark.createDataFrame([(i, "some text", 0.25, 3, "no", "x") for i in range(3)], "doc_id long, text string, score double, predicted int, held_out string, __t string")
    got = tx.score(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), keep=[c for c in docs.columns if c != "doc_id"]).collect()
    assert len(got) == 3 and {(g.in_score, g.in_predicted, g.in_held_out, g["in___t"], g.in_text) for g in got} == {(0.25, 3, "no", "x", "some text")}


def test_slices_are_one_stream():
    texts = [b"", b"abc" * 5, b"d", b"efgh" * 9, b""]
    for most in (1, 4, 7, 1000):
        got = list(tx.slices(texts, most))
        assert b"".join(got) == b"\n".join(texts) + b"\n" and all(len(x) <= most + len(texts) for x in got)


def test_more_features_than_any_cap(spark):
    """12,000 words that only toxic texts hold all get weights, and a text of one of the last of them is toxic."""
    bad, plain = [f"zz{i:05d}q".translate(str.maketrans("0123456789", "bcdfghjklm")) for i in range(12000)], [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = [(i, " ".join(plain + (bad if i % 2 else [])), i % 2) for i in range(80)] + [(1001, "wak " + " ".join(bad[-6:]), None)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    copies = tx.classes
    try:
        tx.classes = lambda d, row_col: d.select(tx.F.col(row_col).alias("rid"), tx.F.col(row_col).alias("class_id"))  # these texts are no copies for this test
        four, weights, _ = tx.fit(docs, labels)
        assert sum(f[0] == "=" for f in weights) > 8192
        got = {g.doc_id: g.predicted for g in tx.score(docs, labels).collect()}
    finally:
        tx.classes = copies
    assert got[1001] == 1 and got[0] == 0


def test_fixed_insults_count_whole_and_copies_once(spark):
    """A toxic word that always follows the same word keeps its evidence; the words of one copied text don't gain by copies."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(3))
    plain = [word() for _ in range(400)]
    rows = [(i, " ".join(r.choices(plain, k=25)) + (" you zuxqivo" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    copied = " ".join(r.choices(plain, k=40)) + " wjykopu"
    rows += [(1000 + i, copied, 1) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    weights = tx.fit(docs, labels)[1]
    assert "=zuxqivo" in weights and "=wjykopu" not in weights


def test_disguises_at_the_end_and_of_short_words():
    m = _model([*WORDS, *["ass", "piss", "shit"] * 100])
    for s, want in {"a$$": "ass", "pi$$": "piss", "shi+": "shit", "@$$": "ass", "hello!": "hello", "hello!!!": "hello", "people***": "people", "tra$h!": "trash"}.items():
        assert tx.readings(s, m) == [want], s
    assert tx.readings("f***", m)[-1] == "f***" and tx.readings("$100", m) == ["$100"] and tx.readings("2024", m) == ["2024"]
    assert tx.features("ass") == ["=ass"] != tx.features("as") == ["=as"] and tx.features("f***") == ["=f**"]


def test_plain_tokens_skip_the_lattice_with_the_same_features():
    """Tokens that are taken for plain words get what their readings give, with and without weights."""
    counts = np.ones(tx.A**4, np.int64)
    model = tx.CharModel(counts)
    tokens = "word, (word) été l'été café! aaa abba committee comiittee f*** pi$$ a.b 'tis {x} €uro x€ straße% word%%% 3rd --- ab as ass naïve-word ÿ".split()
    weights = {"=as": 3.0, "=ass": 4.0, "=word": 5.0, "comi": 3.5, "=été": 3.0, "=abba": 9.0, "=aba": 3.0}
    every, chosen = tx.Reader(model), tx.Reader(model, weights)
    for t in tokens:
        found = [[f for f in tx.features(w)] for w in tx.readings(t.lower(), model)]
        assert list(every[t.encode()]) == [f for fs in found for f in fs], t
        best = [max((weights[f], f) for f in fs if f in weights) for fs in found if any(f in weights for f in fs)]
        assert [(x, f) for f, x in chosen[t.encode()]] == best, t
