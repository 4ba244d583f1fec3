"""The pipeline against its stages' own brute-force versions, on a small fixture."""

import random

import corpus_pipeline as cp
from graphloom.llm import near_dedup


def _tables(spark, tmp_path):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 120))]
        bad = i % 5 == 0
        if bad:
            words[3:3] = [r.choice(["grumblefish", "snorklewort"])]
            words[9:9] = [r.choice(["grumblefish", "snorklewort"])]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    clean = [row for row in rows if row[0] % 5]
    rows += [(1000 + k, clean[k][1].replace(" ", "  ")) for k in range(20)]  # exact copies
    for k in range(20):  # near copies
        w = clean[40 + k][1].split()
        w[len(w) // 2] = "changed"
        rows.append((2000 + k, " ".join(w)))
    rows += [(3000, "mail me at jane.doe@site.org " + " ".join(f"z{j}" for j in range(40))), (3001, None), (3002, "")]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return dict(rows)


def test_stages(spark, tmp_path):
    texts = _tables(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, exact, near, private = seen
    assert set(toxic) == {i for i, t in texts.items() if not (i < 400 and i % 5 == 0)}
    assert set(toxic) - set(exact) == {*range(1000, 1020), 3002}
    bags = {i: near_dedup.ranked_set((texts[i] or "").encode().split()) for i in exact}
    gone = set(exact) - set(near)
    assert gone <= set(range(2000, 2020)) and all(near_dedup.alike(bags[i], bags[[j for j in sorted(exact) if j % 5 and j < 400][0]]) or any(near_dedup.alike(bags[i], bags[j]) for j in near) for i in gone)
    assert all(not near_dedup.alike(bags[i], bags[j]) for i in near for j in near if i < j and i >= 2000)
    assert set(private) == set(near) and "jane.doe" not in private[3000].text and private[3000].n_chars == len(private[3000].text)
    assert all(private[i].text == near[i].text for i in near if i != 3000)
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(private)
    whole = cp.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in whole) == sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in packed)
