"""The quality score: Newton fit against numpy, shrinkage against its formula, held-out accuracy."""

import numpy as np
import pytest

from graphloom.llm import quality


def test_fit_equals_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, len(quality.NAMES) - 1)) * 2 + 1
    y = (r.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(float(b), 1.0, *map(float, a)) for a, b in zip(x, y)], ["y", *quality.NAMES])
    w = quality.fit(df)
    z = (x - x.mean(0)) / x.std(0)
    design, v = np.column_stack((np.ones(400), z)), np.zeros(x.shape[1] + 1)
    ridge = np.full(len(v), quality.RIDGE)
    ridge[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ v))
        v += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (y - p) - ridge * v)
    assert np.allclose(w[1:], v[1:] / x.std(0), atol=1e-3)


def test_sparse_sites_shrink(spark):
    """A site of many bad documents lowers a doubtful text; a site with one says little."""
    good = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"w{i}%%%" for i in range(60))
    mid = " ".join(f"word{i}" + "%" * (i % 6 == 0) for i in range(60))
    rows = [(i, good, "fine", "a") for i in range(200)] + [(1000 + i, junk, "foul", "a") for i in range(200)] + [(2000, mid, "fine", "a"), (2001, mid, "foul", "a"), (2002, mid, "new", "b"), (2003, mid, None, None), (None, None, "fine", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(200)], "doc_id long, quality int")
    got = {g.doc_id: g for g in quality.score(docs, labels).collect()}
    assert len(got) == len(rows)
    assert got[2001].score < got[2002].score < got[2000].score
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(200))
    assert got[2000].host_rate > 0.9 and got[2001].host_rate < 0.1


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x"), (1, "a b", "s", "x")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [g.doc_score for g in quality.score(docs, labels).collect()] == [pytest.approx(0.5)] * 2
    assert quality.score(docs.limit(0), labels).count() == 0
