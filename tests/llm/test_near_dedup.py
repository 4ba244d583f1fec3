"""BagMinHash against exact weighted Jaccard; classes against brute force over all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import near_dedup as nd


def _bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(zip(*[w[i:] for i in range(5)]) if len(w) >= 5 else [tuple(w)] if w else [])


def _similarity(a, b):
    return 1.0 if not a and not b else sum((a & b).values()) / max(1, sum((a | b).values()))


def _brute(texts):
    bags = [_bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * min(sum(bags[i].values()), sum(bags[j].values())) >= 4 * max(sum(bags[i].values()), sum(bags[j].values())) and _similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(3))
def test_signature_is_unbiased(seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(40)}" for _ in range(120)] + ["same"] * 30
    other = base[:90] + [f"v{r.randrange(40)}" for _ in range(20)] + ["same"] * 70
    texts = [" ".join(base).encode(), " ".join(other).encode(), b"one two", b""]
    sh, doc = nd.shingles([t.split() for t in texts])
    sig = nd.bag_min_hash(*nd.weighted(sh, doc), 4, 4096)
    want = _similarity(_bag(texts[0].decode()), _bag(texts[1].decode()))
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    assert np.isfinite(sig[:3]).all() and np.isinf(sig[3]).all() and (sig[2] == sig[0]).mean() == 0


def test_parity_maps_never_overstate():
    r = random.Random(5)
    for _ in range(50):
        a = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 200))]
        b = list(a)
        for _ in range(r.randrange(0, 30)):
            if b:
                b[r.randrange(len(b))] = f"w{r.randrange(60)}"
        words = [[w.encode() for w in a], [w.encode() for w in b]]
        sh, doc = nd.shingles(words)
        m = nd.parity_maps(*nd.weighted(sh, doc), 2).view(np.uint64)
        x, y = (set(nd.ranked_set(w).tolist()) for w in words)
        assert sum(bin(int(u)).count("1") for u in m[0] ^ m[1]) <= len(x ^ y)


def test_ranked_set_counts_multisets():
    a, b = "x x x x x x x y".split(), "x x x x x x y".split()
    got = nd.alike(nd.ranked_set([w.encode() for w in a]), nd.ranked_set([w.encode() for w in b]))
    assert got == (_similarity(_bag(" ".join(a)), _bag(" ".join(b))) >= 0.8)


def _classes(spark, texts, parts=4):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, same string").repartition(parts)
    got = nd.classes(docs).collect()
    assert len(got) == len(texts)
    by = Counter(g.class_id for g in got)
    assert all(g.class_size == by[g.class_id] for g in got) and sum(g.kept for g in got) == len(by) and all(g.doc_id == g.class_id for g in got if g.kept)
    return [g.class_id for g in sorted(got, key=lambda g: g.doc_id)]


def test_classes(spark):
    r = random.Random(7)
    texts = [None, "", " \n", "a", "a b", "a b", "a  b", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(20, 200))]
        for _ in range(r.randrange(1, 8)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = f"v{r.randrange(5000)}"
            texts.append(" ".join(copy))
    texts.append("again and again " * 3000)
    texts.append("again and again " * 2900)
    assert _classes(spark, texts) == _brute(texts)


def test_chain_through_one_bucket(spark):
    """Each text is like its neighbour only: the smallest of a bucket isn't like all, yet no link may be lost."""
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[3 * i : 3 * i + 100]) for i in range(60)]
    assert _classes(spark, texts) == _brute(texts)


def test_large_group(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(100)] * 4 + [" ".join(r.sample(base, 60)) for _ in range(20)]
    assert _classes(spark, texts) == _brute(texts)


@pytest.mark.parametrize("few", [0, 64])
def test_wide_buckets(spark, monkeypatch, few):
    """One register a band: nearly all texts share buckets with unlike ones; both ways of a bucket give brute force's classes."""
    monkeypatch.setattr(nd, "FEW_OPEN", few)
    r = random.Random(11)
    template = [f"t{i}" for i in range(80)]
    texts = []
    for i in range(60):
        own = [f"u{i}-{k}" for k in range(r.choice([4, 9, 14, 30]))]
        texts += [" ".join(template + own), " ".join([*own[:2], *template, *own])][: r.randrange(1, 3)]
    texts += ["p q r s t u " * 20, "p q r s t u " * 18, "p q r s t u " * 10, None, "one"]
    texts += [" ".join(f"l{i}" for i in range(k, k + 2400)) for k in (0, 100, 900)]  # too long for the map
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {g.doc_id: g.class_id for g in nd.classes(docs, bands=24, rows=1).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)


def test_crowd_of_unlike_texts_is_linear(spark):
    """5000 texts of a common template, a fifth of each its own: no pair comes out, so nothing grows with the square."""
    template = " ".join(f"t{i}" for i in range(80))
    texts = spark.range(5000).select(F.col("id").alias("node"), F.concat(F.lit(template), *[F.concat(F.lit(f" u{k}-"), "id") for k in range(20)]).cast("binary").alias("t"))
    nodes = spark.range(5000).select(F.col("id").alias("node"), F.col("id").alias("root"), F.lit(96).cast("long").alias("n"), F.lit(True).alias("free"))
    assert nd.rare_pairs(nodes, texts).count() == 0
    alike = texts.unionByName(texts.where("node = 7").select(F.lit(9000).cast("long").alias("node"), F.concat("t", F.lit(" more").cast("binary")).alias("t")))
    more = nodes.unionByName(spark.createDataFrame([(9000, 9000, 97, True)], nodes.schema))
    assert [tuple(p) for p in nd.rare_pairs(more, alike).collect()] == [(7, 9000)]


def _family(texts, seed=2, vary=9):
    """Copies of one text, of which each has up to ``vary`` words of its own: near 0.8 alike, some above and some below."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for i in range(texts):
        copy = list(base)
        for k in r.sample(range(150), r.randrange(vary)):
            copy[k] = f"o{i}-{k}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("counts", [4, 20])
def test_rare_shingles_lose_no_pair(spark, monkeypatch, counts):
    """A fifth of the shingles become rows at most, and all alike pairs of different roots meet, however few counts there are."""
    monkeypatch.setattr(nd, "MOST_COUNTS", counts)
    texts = _family(120)
    bags = [_bag(t) for t in texts]
    rows = spark.createDataFrame([(i, i % 70, sum(bags[i].values()), True, t.encode()) for i, t in enumerate(texts)], "node long, root long, n long, free boolean, t binary")
    nodes, texts = rows.drop("t"), rows.select("node", "t")
    rare = nd.rare_shingles(nodes, texts)
    assert rare.where("5 * i > n").isEmpty() and 0 < rare.count() <= sum(sum(b.values()) // 5 + 1 for b in bags)
    met = {tuple(p) for p in nd.rare_pairs(nodes, texts).collect()}
    assert {(a, b) for b in range(120) for a in range(b) if a % 70 != b % 70 and _similarity(bags[a], bags[b]) >= 0.8} <= met


def test_group_of_near_copies_is_not_expanded(spark, monkeypatch):
    """Of a large group's links most say the same: far fewer pairs are verified than are alike, and the classes are brute force's."""
    texts = _family(200, vary=3)
    bags = [_bag(t) for t in texts]
    links = sum(_similarity(bags[a], bags[b]) >= 0.8 for b in range(200) for a in range(b))
    rows = spark.createDataFrame([(i, i, sum(bags[i].values()), True, t.encode()) for i, t in enumerate(texts)], "node long, root long, n long, free boolean, t binary")
    nodes, rows = rows.drop("t"), rows.select("node", "t")
    verify, verified, found = nd._verify, [], []
    monkeypatch.setattr(nd, "_verify", lambda pairs, t: verified.append(pairs.count()) or verify(pairs, t))
    left = nd.rare_links(nodes, rows, lambda met: met, found)
    found.append(nd._verify(left, rows))
    assert sum(verified) < links / 4 and nd.rare_pairs(nodes, rows).count() >= links, (verified, links)
    got = {r.node: r.root for r in nd.components(nd.reduce(nd.DataFrame.unionByName, found)).collect()}
    assert [got.get(i, i) for i in range(200)] == _brute(texts)


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {g.doc_id: g.class_id for g in nd.op9_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    want = _brute([r.text for r in rows])
    assert [got[r.doc_id] for r in rows] == [rows[w].doc_id for w in want]
