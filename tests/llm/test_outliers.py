"""Counts against plain Python; the robust distance against numpy's smallest determinant over random starts."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import outliers


def _counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    r = random.Random(2)
    texts = ["", None, " ", "a", "a b", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\n x y z", "a\r\nb\x0bc\x0cd", "#*$%&|<>", "é 👍 ß", "a\xa0b c"] + ["".join(r.choice("ab \n\t#") for _ in range(r.randrange(300))) for _ in range(200)] + ["w " * 30000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, w int")
    for g in outliers.counts(docs).collect():
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == _counts(texts[g.doc_id]), texts[g.doc_id]


def test_distance_is_robust(spark):
    r = np.random.default_rng(4)
    mix = r.normal(size=(5, 5))
    good = r.normal(size=(3000, 5)) @ mix * 3 + 10
    bad = np.full((450, 5), 60.0) + r.normal(size=(450, 5))
    rows = [(i, "en", "s", *map(float, x)) for i, x in enumerate(np.vstack((good, bad)))]
    df = spark.createDataFrame(rows, "id long, lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {x.id: x.d2 for x in outliers.robust_distance(df, ["lang", "source"]).collect()}
    d2 = np.array([got[i] for i in range(len(rows))])
    assert (d2[3000:] > outliers.CUTOFF).all() and (d2[:3000] > outliers.CUTOFF).mean() < 0.02
    # concentration steps in numpy from many random starts: none ends at a smaller determinant
    x = np.array([row[3:] for row in rows])
    keys = ["g_0"]
    found = outliers.estimates(df.select(F.lit("g").alias("g_0"), (F.col("id") % outliers.SALTS).alias("salt"), *outliers.NAMES), keys).first()
    floors, least = np.diag([f for _, _, f in outliers.VECTOR]) ** 2, np.inf
    for _ in range(60):
        core = x[r.choice(len(x), 6, replace=False)]
        last = np.inf
        while True:
            centre, scatter = core.mean(0), np.cov(core.T, bias=True) * outliers.CONSISTENCY + floors
            now = np.linalg.slogdet(scatter)[1]
            if now > last - 1e-9 and len(core) > 6:
                break
            last = now if len(core) > 6 else np.inf
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            core = x[d <= np.sort(d)[int(np.ceil(outliers.HALF * len(x))) - 1]]
        if now < least:
            least, want = now, np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
    assert found.logdet < least + 1e-3
    assert np.allclose(np.sort(d2)[:3000], np.sort(want)[:3000], rtol=0.05, atol=0.05)


def test_determinant_falls(spark):
    """Each concentration step, from each start, has a determinant no larger than the one before it."""
    r = np.random.default_rng(9)
    rows = [(str(g), i % outliers.SALTS, *map(float, r.normal(size=5) * (1 + g) + (r.random() < 0.2) * 8)) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "g_0 string, salt long, x0 double, x1 double, x2 double, x3 double, x4 double")
    now, last = outliers._concentrate(df, outliers._starts(df, ["g_0"]), ["g_0"]), {}
    for _ in range(4):
        seen = {(e.g_0, e.start): e.logdet for e in now.collect()}
        assert len(seen) == 3 * outliers.STARTS and all(seen[k] <= last.get(k, np.inf) + 0.01 for k in seen)
        last, now = seen, outliers._concentrate(df, now, ["g_0"])


def test_fixed_values():
    """The chi-square constants by numeric integration."""
    from math import gamma

    def below(x, k):
        t = np.linspace(0, x, 400_001)
        y = t ** (k / 2 - 1) * np.exp(-t / 2) / (2 ** (k / 2) * gamma(k / 2))
        return float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum())

    assert abs(below(outliers.CUTOFF, 5) - 0.9999) < 1e-7 and abs(below(outliers.NORM, 5) - 0.5) < 1e-6
    low, high = 0.0, 50.0
    while high - low > 1e-9:
        low, high = ((low + high) / 2, high) if below((low + high) / 2, 5) < outliers.HALF else (low, (low + high) / 2)
    assert abs(outliers.HALF / below(low, 7) - outliers.CONSISTENCY) < 1e-3


def test_same_verdicts_in_any_layout(spark):
    """A group of 6000, two layouts: equal distances to the last bit."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 55 + CAST(pmod(xxhash64(id), 60) AS INT)), i -> concat('w', CAST(pmod(xxhash64(id, i), 3000) AS STRING), IF(pmod(xxhash64(i, id), 50) = 0, '%', ''))), ' ') AS text", "'en' AS lang", "'s' AS source")
    runs = [{g.doc_id: (g.kept, g.d2) for g in outliers.judge(d).collect()} for d in (docs.repartition(3), docs.repartition(7, "doc_id").sortWithinPartitions(F.xxhash64("doc_id")))]
    assert runs[0] == runs[1] and len(runs[0]) == 6000


def test_whole_table_counts(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = outliers.op7_outliers(spark, d).collect()
    assert sorted(g.doc_id for g in got) == sorted(texts)
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == _counts(texts[g.doc_id])
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) and not (g.kept and g.base_failed)


def test_repeated_rows_count(spark):
    rows = [(1, " ".join(f"w{j}" for j in range(60)), "en", "s")] * 3 + [(None, None, None, None)] * 2
    got = outliers.judge(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, d2 int")).collect()
    assert sorted((str(g.doc_id), g.kept) for g in got) == [("1", True)] * 3 + [("None", False)] * 2


def test_judge(spark):
    plain = [(i, " ".join(f"word{(i * 31 + j * j) % 997}" for j in range(60 + i % 40)), ["en", None][i % 2], "s") for i in range(300)]
    odd = [(1000, " ".join(f"w{j}%%%" for j in range(80)), "en", "s"), (1001, None, "en", "s"), (1002, "", None, None), (1003, "same words here " * 60, "en", "s"), (None, plain[0][1], "en", "rare")]
    got = {g.doc_id: g for g in outliers.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 305 and sum(not got[i].kept for i in range(300)) == 0
    assert not got[1000].kept and not got[1000].base_failed and got[1001].base_failed and got[1002].base_failed and got[1003].base_failed and not got[1003].kept
    assert got[None].kept


def test_empty_table(spark):
    assert outliers.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
