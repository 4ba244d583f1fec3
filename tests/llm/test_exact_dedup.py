"""Exact dedup against grouping by normalised text in plain Python."""

import hashlib
import random
import re

from graphloom.llm import exact_dedup


def _brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    by = {}
    for (d, _), n in zip(rows, norm):
        by.setdefault(n, []).append(d)
    least = {n: min(v, key=lambda d: (d is None, d)) for n, v in by.items()}
    return sorted(((d, least[n], len(by[n]), hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(rows, norm)), key=str)


def test_against_grouping(spark):
    r = random.Random(1)
    texts = ["a b", "a  b", "a\tb\n", "a b ", " a b", "a\x0bb", "a\xa0b", "A b", None, "", " ", "\n\n", "long " * 40000, "long " * 40000, "é", "é"] + [f"t{r.randrange(60)}" for _ in range(200)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "solo"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, digest string, word int").repartition(5)
    got = exact_dedup.dedup(docs).collect()
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=str) == _brute(rows)
    kept = [g.text_sha256 for g in got if g.kept]
    assert len(kept) == len(set(kept)) == len({b[3] for b in _brute(rows)})


def test_equal_digests_of_unequal_texts_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert sorted((g.doc_id, g.keep_id, g.group_size) for g in exact_dedup.dedup(docs).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_runs_merge(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.Index(spark)
    for i in range(exact_dedup.FANOUT - 1):
        index.add(frame((50 - i, "a"), (100 + i, f"t{i}")), memtables=1)
    assert [r.level for r in index.runs] == [0] * (exact_dedup.FANOUT - 1)
    # a lookup reads the runs whose filters know the digest, and none for a digest that no run holds
    asked = spark.createDataFrame([(hashlib.sha256(t).hexdigest(),) for t in (b"a", b"t3", b"none")], "digest string")
    assert sorted((r.keep_id, r.n) for r in index.lookup(asked).collect()) == [(50 - exact_dedup.FANOUT + 2, exact_dedup.FANOUT - 1), (103, 1)]
    assert [(r.keep_id, r.n) for r in index.hits().collect()] == [(50 - exact_dedup.FANOUT + 2, exact_dedup.FANOUT - 1)]
    index.add(frame((1, "a"), (9, "c")), memtables=1)
    assert [r.level for r in index.runs] == [1]
    rows = [r.digest for r in index.runs[0].rows.coalesce(1).collect()]
    assert len(rows) == len(set(rows)) == exact_dedup.FANOUT + 1 and [(r.keep_id, r.n) for r in index.hits().collect()] == [(1, exact_dedup.FANOUT)]


def test_second_batch_meets_the_index(spark):
    """Batches one after the other give what all rows at once give for the rows of the last batch, whatever has been compacted."""
    r = random.Random(3)
    rows = [(i, f"t{r.randrange(90)}") for i in range(150)]
    index, seen = exact_dedup.Index(spark), []
    for a in range(0, 150, 50):
        batch = rows[a : a + 50]
        docs = spark.createDataFrame(batch, "doc_id long, text string").repartition(3)
        known = spark.createDataFrame(seen, "doc_id long, text string") if seen else None
        got = exact_dedup.dedup(docs, index=index, known=known).collect()
        seen += batch
        want = {x[0]: x for x in _brute(seen)}
        assert sorted((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == sorted(want[i] for i, _ in batch)
        assert {g.doc_id for g in got if g.kept} == {i for i, _ in batch if want[i][1] == i}


def test_filters_hold_all_their_keys(spark):
    from graphloom.llm.common import filter_of, maybe_in

    keys, others = spark.range(20000).selectExpr("id", "CAST(id AS STRING) AS digest"), spark.range(20000, 60000).selectExpr("id", "CAST(id AS STRING) AS digest")
    made = filter_of(keys, "digest")
    assert maybe_in(keys, made, "digest").where("NOT __maybe").isEmpty() and maybe_in(others, made, "digest").where("__maybe").count() < 8000


def test_empty_table(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
