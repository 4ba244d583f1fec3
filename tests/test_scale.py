"""What keeps operators in bounds on large tables, at small sizes."""

import itertools
import random
from collections import deque

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from graphloom import lineage, views
from graphloom.graph import Graph
from graphloom.operators import centrality, motifs, similarity, sources, triangles
from graphloom.streaming import changes


def random_edges(n, m, seed):
    draw = random.Random(seed)
    return [(f"v{draw.randrange(n)}", f"v{draw.randrange(n)}") for _ in range(m)]


def by_hand(edges):
    """(reached, hops in all) and betweenness of each vertex, from one search a vertex."""
    ids = sorted({x for e in edges for x in e})
    out = {i: sorted({t for s, t in edges if s == i and t != i}) for i in ids}
    far, between = {}, dict.fromkeys(ids, 0.0)
    for s in ids:
        depth, paths, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
        while todo:
            u = todo.popleft()
            order.append(u)
            for v in out[u]:
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0.0
                    todo.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            share[u] = sum(paths[u] / paths[v] * (1 + share[v]) for v in out[u] if depth[v] == depth[u] + 1)
            between[u] += share[u] if u != s else 0.0
        far[s] = (len(depth) - 1, sum(depth.values()))
    return far, between


@pytest.mark.parametrize(("work", "batch"), [(1 << 24, 1 << 22), (1000, 50)])
def test_searches_from_all_vertices(spark, monkeypatch, work, batch):
    """The same by one task and by many, whose batches are small; no table for each layer is written, however long the paths."""
    monkeypatch.setattr(sources, "WORK", work)
    monkeypatch.setattr(sources, "BATCH", batch)
    edges = random_edges(60, 150, 5) + [(f"p{i}", f"p{i + 1}") for i in range(20)] + [("p3", "v1"), ("alone", "alone")]
    far, between = by_hand(edges)
    n = len(far)
    g = Graph.from_edges(spark.createDataFrame(edges, "source string, target string"))
    before = lineage.mark()
    got = {r.node_id: r.closeness_centrality for r in centrality.closeness_centrality(g).collect()}
    assert got == pytest.approx({i: r / (n - 1) / (d / r) if d else 0.0 for i, (r, d) in far.items()})
    got = {r.node_id: r.betweenness_centrality for r in centrality.betweenness_centrality(g).collect()}
    assert got == pytest.approx({i: b * 2 / ((n - 1) * (n - 2)) for i, b in between.items()})
    assert lineage.mark() - before <= 12
    start = spark.createDataFrame([("p0",), ("p0",), ("nowhere",)], "id string")
    got = {r.node_id: r.betweenness_centrality for r in centrality.betweenness_centrality(g, start).where("node_id in ('p1', 'p19', 'p20')").collect()}
    assert got["p19"] == pytest.approx(2 / ((n - 1) * (n - 2))) and got["p1"] > got["p19"] and got["p20"] == 0
    assert centrality.betweenness_centrality(Graph.empty(spark)).count() == centrality.closeness_centrality(Graph.empty(spark)).count() == 0


def test_pagerank_of_edges_into_sinks(spark, monkeypatch):
    """A graph whose targets have no out-edges takes one join, whatever the rounds, and gets the scores that rounds give."""
    draw = random.Random(7)
    edges = [(f"c{draw.randrange(40)}", f"s{draw.randrange(5)}") for _ in range(120)]
    g = Graph(spark.createDataFrame([("lonely",)], "id string"), spark.createDataFrame(edges, "source string, target string"))
    for options in ({"tolerance": 1e-4}, {"max_iterations": 3, "tolerance": 1e-15}, {"personal": spark.createDataFrame([("c1", 2.0), ("s1", 1.0)], "id string, weight double")}):
        before = lineage.mark()
        got = {r.node_id: r.pagerank_score for r in centrality.pagerank(g, **options).collect()}
        assert lineage.mark() - before <= 6
        with monkeypatch.context() as m:
            m.setattr(centrality, "_one_hop_ranks", lambda *a: centrality._ranks(*a, []))
            assert got == pytest.approx({r.node_id: r.pagerank_score for r in centrality.pagerank(g, **options).collect()}, abs=1e-12)


def test_views_in_many_tasks(spark, monkeypatch, tmp_path):
    """The views that would leave one task everything give the rows of their SQL from many tasks: null and equal times, one order with many lines, empty tables."""
    draw = random.Random(3)
    con = duckdb.connect()
    for size in (400, 1, 0):
        events = [(i, draw.choice([None, *range(30)]), draw.choice([None, 1, 2, 3, *range(60)]), draw.choice("ab")) for i in range(size)]
        lines = [(0 if i < size // 4 else draw.choice([None, *range(60)]), draw.choice([None, *range(12)])) for i in range(size)]
        d = tmp_path / str(size)
        d.mkdir()
        con.execute("create or replace table e (event_id bigint, user_id bigint, secs bigint, event_type varchar)")
        con.execute("create or replace table l (l_orderkey bigint, l_partkey bigint)")
        for name, rows in (("e", events), ("l", lines)):
            if rows:
                con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy (select event_id, user_id, make_timestamp(secs * 1000000) as ts, event_type from e) to '{d}/events.parquet' (format parquet)")
        con.execute(f"copy l to '{d}/lineitem.parquet' (format parquet)")
        monkeypatch.setattr(views, "ROWS", 20)
        for name in ("user_next", "part_copurchase"):
            got = views.view(spark, str(d), name)
            assert oracle.compare(got, oracle.connect(d), views.cte(name) + f" select * from {name}") is None
            if size == 400:
                assert got.select(F.spark_partition_id()).distinct().count() > 4


def test_triangles_by_colours(spark, monkeypatch):
    """Each triangle once, of one, two or three colours, beside a vertex that all others meet; its six mappings without a join of wedges."""
    edges = random_edges(40, 200, 11) + [("hub", f"v{i}") for i in range(40)] + [("v1", "v2"), ("v2", "v1"), ("v3", "v3")]
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    ids = sorted({x for e in edges for x in e})
    want = {t for t in itertools.combinations(ids, 3) if all(frozenset(p) in near for p in itertools.combinations(t, 2))}
    g = Graph.from_edges(spark.createDataFrame(edges, "source string, target string"))
    for in_task, wedges in ((1 << 21, 1 << 22), (60, 7)):
        monkeypatch.setattr(triangles, "EDGES", in_task)
        monkeypatch.setattr(triangles, "WEDGES", wedges)
        got = [tuple(sorted(r)) for r in triangles.triangles(g).collect()]
        assert len(got) == len(want) and {*got} == want
        assert triangles.triangle_count(g).first()["value"] == len(want)
        assert {r.node_id: r.triangles for r in triangles.triangles_per_node(g).collect()} == {i: sum(i in t for t in want) for i in ids}
        match = motifs.subgraph_match(g, [("a", "b"), ("b", "c"), ("c", "a")])
        assert "Join" not in match._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
        got = [tuple(r) for r in match.collect()]
        assert match.columns == ["a", "b", "c"] and len(got) == len({*got}) == 6 * len(want) and {tuple(sorted(t)) for t in got} == want
    assert triangles.triangle_count(Graph.empty(spark)).first()["value"] == 0
    assert triangles.triangles_per_node(Graph.from_edges(spark.createDataFrame([("x", "y")], "source string, target string"))).count() == 2


def test_path_lengths_by_component(spark, monkeypatch):
    """The histogram of searches from each vertex, with components counted in tasks, in parts, or as rows because they are large."""
    edges = [(f"c{i}-{j}", f"c{i}-{j + 1}") for i in range(12) for j in range(i)] + [("star", f"leaf{i}") for i in range(15)] + [("leaf1", "star"), ("own", "own")] + random_edges(25, 30, 4)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        depth, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v in near[u] - depth.keys():
                depth[v] = depth[u] + 1
                todo.append(v)
        for d in depth.values():
            if 0 < d <= 6:
                want[d] = want.get(d, 0) + 1
    g = Graph.from_edges(spark.createDataFrame(edges, "source string, target string"))
    for small, at_once in ((2048, 1 << 22), (2048, 10), (5, 40)):
        monkeypatch.setattr(similarity, "SMALL", small)
        monkeypatch.setattr(similarity, "PAIRS", at_once)
        before = lineage.mark()
        assert {r.length: r.n for r in similarity.path_length_histogram(g, 6).collect()} == want
        assert lineage.mark() - before <= (6 if small == 2048 else 20)
    assert similarity.path_length_histogram(Graph.empty(spark)).count() == 0


def test_metrics_read_a_graph_once(spark):
    """The edges' rows are made once, however many metrics read them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "source string, target string")
    g = Graph.from_edges(edges.mapInArrow(counted, edges.schema))
    row = changes.graph_metrics(g, 3).first()
    assert (row.batch, row.node_count, row.edge_count, row.clustering, row.largest_component, row.component_count) == (3, 5, 4, 1.0, 3, 2)
    assert made.value == 4
