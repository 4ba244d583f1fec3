"""Golden cases on small hand-made graphs, and invariants of random operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import errors
from graphloom.engine import Engine
from graphloom.graph import Graph
from graphloom.operators import centrality, communities, components, embeddings, features, motifs, multigraph, paths, sampling, similarity, temporal, triangles, walks
from graphloom.plans.match import match, parse
from graphloom.plans.triples import TripleStore, lang_literal, literal, typed_literal, var
from graphloom.sources import connectors, files


def make(spark, edges, nodes=None):
    rows = [(*e.split(":")[0].split("-"), float(e.split(":")[1]) if ":" in e else 1.0) for e in edges.split()]
    e = spark.createDataFrame(rows, "source string, target string, weight double")
    return Graph.from_edges(e) if nodes is None else Graph(spark.createDataFrame([(n,) for n in nodes], "id string"), e)


@pytest.fixture(scope="module")
def f1(spark):
    return make(spark, "A-B:1 A-C:4 B-C:2 C-D:1 D-E:1")


@pytest.fixture(scope="module")
def f4(spark):
    return make(spark, "A-B B-C C-A A-C C-D:0.5 D-E E-F F-D D-F E-F")


def pairs(df, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in df.collect()}


def test_construction_and_accessors(spark):
    g = Graph(spark.createDataFrame([("A", "Node A"), ("D", "Node D"), ("X", "alone")], "id string, label string"), spark.createDataFrame([("A", "B", 1.0), ("A", "C", 2.0), ("B", "C", None), ("C", "D", 0.5)], "src string, dst string, weight double"))
    assert g.node_count() == 5 and g.edge_count() == 4 and g.density() == pytest.approx(4 / 20)
    assert {r.id for r in g.predecessors("C").collect()} == {"A", "B"} and {r.id for r in g.neighbors("A").collect()} == {"B", "C"}
    assert g.edge_weight("B", "C") == 1.0 and g.edge_weight("C", "A") is None and g.has_node("B") and not g.has_node("Q")
    assert Graph.empty(spark).density() == 0.0 and Graph.empty(spark).node_count() == 0
    with pytest.raises(errors.GraphConstructionError):
        g.add_node("A")
    with pytest.raises(errors.GraphConstructionError):
        g.add_edge("A", "B")
    with pytest.raises(errors.NodeNotFound):
        g.remove_node("Q")
    with pytest.raises(errors.EdgeNotFound):
        g.remove_edge("D", "A")
    assert g.add_edge("D", "Z", 3).node_count() == 6 and g.remove_node("C").edge_count() == 1 and g.remove_edge("A", "B").edge_count() == 3
    assert g.filter_nodes("id <> 'C'").edge_count() == 1
    with pytest.raises(errors.GraphConstructionError):
        Graph.from_edges(spark.range(1))


def test_paths(spark, f1):
    row = paths.shortest_path(f1, "A", "D").first()
    assert row.distance == 4.0 and row.path == ["A", "B", "C", "D"]
    assert pairs(paths.shortest_path(f1, "A"), "target", "distance") == {"B": 1, "C": 3, "D": 4, "E": 5}
    with pytest.raises(errors.ComputationError):
        paths.shortest_path(make(spark, "A-B C-D"), "A", "D")
    with pytest.raises(errors.NodeNotFound):
        paths.shortest_path(f1, "A", "Q")
    assert {tuple(r.path) for r in paths.all_paths(f1, "A", "D").collect()} == {("A", "C", "D"), ("A", "B", "C", "D")}
    assert {r.id for r in paths.reachable(f1, "C").collect()} == {"D", "E"}
    assert pairs(paths.bfs(f1, "A"), "id", "depth") == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 3}
    assert pairs(paths.bfs(f1, "E", direction="in", max_depth=1), "id", "depth") == {"E": 0, "D": 1}
    cyclic = make(spark, "A-B A-C:4 B-C C-A:1")
    assert max(r.depth for r in paths.recursive_paths(cyclic, "A").collect()) == 2
    assert max(r.depth for r in paths.recursive_paths(cyclic, "A", max_depth=5, include_cycles=True).collect()) == 5
    assert paths.recursive_paths(f1, "A", max_paths=2).count() == 2
    assert all(r.total_weight <= 3 for r in paths.paths_within_distance(f1, "A", 3).collect())
    assert paths.lightest_path(f1, "A", "E").first().nodes == ["A", "B", "C", "D", "E"]


def test_centralities(spark, f1, f4):
    scores = pairs(centrality.pagerank(f1), "node_id", "pagerank_score")
    assert sum(scores.values()) == pytest.approx(1, abs=1e-9) and max(scores, key=scores.get) == "E"
    for bad in ({"damping_factor": 1.5}, {"max_iterations": 0}, {"tolerance": 0}, {"damping_factor": "x"}):
        with pytest.raises(errors.InvalidParameter):
            centrality.pagerank(f1, **bad)
    personal = centrality.pagerank(f1, personal=spark.createDataFrame([("A", 1.0)], "id string, weight double"))
    assert sum(r.pagerank_score for r in personal.collect()) == pytest.approx(1, abs=1e-6)
    b = pairs(centrality.betweenness_centrality(f1), "node_id", "betweenness_centrality")
    assert b["C"] == pytest.approx(4 * 2 / 12) and b["A"] == b["E"] == 0
    assert pairs(centrality.closeness_centrality(f1), "node_id", "closeness_centrality")["D"] == pytest.approx(0.25)
    e = pairs(centrality.eigenvector_centrality(f4, 500, 1e-9), "node_id", "eigenvector_centrality")
    assert sum(x * x for x in e.values()) == pytest.approx(1, abs=1e-6)
    assert centrality.batch_centralities(f1).count() == 5
    assert pairs(centrality.pair_betweenness(f1), "node_id", "pairs")["C"] == 4
    parts = Graph.from_edges(f1.edges.withColumn("g", F.lit("x")).unionByName(f4.edges.withColumn("g", F.lit("y"))))
    for measure, whole in (("pagerank", scores), ("betweenness", b)):
        got = {r.node_id: r.score for r in centrality.windowed(parts, "g", measure).collect() if r.part == "x"}
        assert got == pytest.approx(whole, abs=1e-5)
    assert {r.part for r in centrality.windowed(parts, "g", "degree").collect()} == {"x", "y"}


def test_components_and_communities(spark, f1, f4):
    assert components.weakly_connected_components(f1).select("component").distinct().count() == 1
    assert pairs(components.weakly_connected_components(make(spark, "A-B C-D", "ABCDZ")), "node_id", "component_id") == {"A": 0, "B": 0, "C": 1, "D": 1, "Z": 2}
    scc = pairs(components.strongly_connected_components(make(spark, "A-B B-C C-A D-E E-D C-D")), "node_id", "component")
    assert scc == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    assert components.strongly_connected_components(f1).select("component_id").distinct().count() == 5
    for method in (communities.leiden, communities.louvain):
        got = method(f4)
        assert got.count() == 6
        c = pairs(got, "node_id", "community")
        assert c["A"] == c["B"] == c["C"] != c["D"] == c["E"] == c["F"]
        alone = f4.node_ids().select(F.col("id").alias("node_id"), F.col("id").alias("community"))
        assert communities.modularity(f4, got) > communities.modularity(f4, alone)
    with pytest.raises(errors.InvalidParameter):
        communities.leiden(f4, resolution=0)


def test_triangles_and_motifs(spark, f4):
    f5 = make(spark, "A-B B-C C-A B-D")
    assert triangles.triangle_count(f5).first().value == 1
    local = pairs(triangles.clustering_coefficient(f5), "node_id", "clustering_coefficient")
    assert local == pytest.approx({"A": 1, "B": 1 / 3, "C": 1, "D": 0})
    assert triangles.clustering_coefficient(f5, "global").first().value == pytest.approx(3 / 5)
    with pytest.raises(errors.InvalidParameter):
        triangles.clustering_coefficient(f5, "other")
    m = {(r.nv, r.ne): r for r in motifs.motif_counts(f5, 3).collect()}
    assert m[3, 3].occurrences == 1 and m[3, 2].occurrences == 2 and m[2, 1].occurrences == 4
    assert motifs.subgraph_match(f5, [("x", "y"), ("y", "z"), ("z", "x")]).count() == 6
    assert motifs.subgraph_match(f5, [("x", "y"), ("y", "z")], induced=True).where("x < z").count() == 2
    kinds = motifs.motifs(f4, 4).where("nv = 4")
    assert kinds.where("is_star").count() >= 1 and kinds.where("is_clique").count() == 0


def test_walks_and_samples(spark, f4):
    edges = {(r.source, r.target) for r in f4.edges.collect()}
    w = walks.random_walk(f4, 5, 3, seed=4)
    rows = {(r.walk_id, r.step): r.node_id for r in w.collect()}
    assert len({k for k, _ in rows}) == 18 and all((rows[k, i - 1], n) in edges for (k, i), n in rows.items() if i)
    assert rows == {(r.walk_id, r.step): r.node_id for r in walks.random_walk(Graph.from_edges(f4.edges.repartition(7)), 5, 3, seed=4).collect()}
    n = walks.node2vec_walks(f4, 6, 2, 0.25, 4.0, seed=1)
    rows = {(r.walk_id, r.step): r.node_id for r in n.collect()}
    assert all((rows[k, i - 1], v) in edges for (k, i), v in rows.items() if i)
    with pytest.raises(errors.InvalidParameter):
        walks.node2vec_walks(f4, 1)
    p = walks.transition_probabilities(f4).groupBy("prev", "source").agg(F.sum("probability").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in p)
    assert sampling.sample_nodes(f4, 3).count() == 3 and sampling.sample_nodes(f4, 4, by="degree").distinct().count() == 4 and sampling.sample_nodes(f4, 2, by="pagerank").count() == 2
    assert sampling.sample_edges(f4, 0.0).count() == 0 and sampling.sample_edges(f4, 1.0).count() == 10 and sampling.sample_edges(f4, size=4, weighted=True).count() == 4
    s = {r.node_id for r in sampling.graph_sampling(f4, "snowball", seed_nodes=["A"], max_nodes=4).collect()}
    assert "A" in s and len(s) <= 4
    with pytest.raises(errors.InvalidParameter):
        sampling.graph_sampling(f4, "other")
    assert {r.node_id for r in sampling.forest_fire(f4, ["A"], 1.0).collect()} == set("ABCDEF")
    for make_sample in (sampling.saint_node, sampling.saint_uniform, sampling.saint_edge):
        nodes, inside = make_sample(f4, 4)
        ids = {r.node_id for r in nodes.collect()}
        assert all(r.weight > 0 for r in nodes.collect()) and all(r.source in ids and r.target in ids for r in inside.collect())
    assert 0 < sampling.effective_sample_size(sampling.saint_walk(f4, 2, 3)[0]).first()[0] <= 6
    assert sampling.saint_neighbourhood(f4)[0].count() > 0
    layers = sampling.fast_gcn_layers(f4, [5, 7]).collect()
    assert len(layers) == 12
    assert {r.method for r in sampling.combined_sample(f4).collect()} == {"random_walk", "bfs", "forest_fire"}
    assert sampling.reservoir(spark.range(10), 3, "id").count() == 3


def test_temporal_and_multigraph(spark):
    e = spark.createDataFrame([("A", "B", 1.0, 1704067200), ("B", "C", 2.0, 1704153600), ("C", "D", 1.0, 1704240000), ("A", "C", 4.0, 1704326400)], "source string, target string, weight double, timestamp long")
    assert temporal.in_window(e, 1704067200, 1704240000).count() == 3 and temporal.in_window(e, 0, 1).count() == 0
    assert temporal.snapshot(e, 1704153600).count() == 2 and temporal.snapshot(e, 1 << 40).count() == 4
    got = temporal.temporal_paths(e, "A", "D").collect()
    assert [r.nodes for r in got] == [["A", "B", "C", "D"]]
    assert temporal.fastest_path(e, "A", "C").first().duration == 0
    m = multigraph.MultiGraph.create("g", e.select("source", "target", "weight")).with_graph("h", spark.createDataFrame([("A", "B", 3.0), ("C", "Z", 1.0)], "source string, target string, weight double"))
    assert {(r.source, r.target): r.weight for r in m.merge(combine="average").collect()}["A", "B"] == 2.0
    assert {r.node_id: r.graphs for r in m.cross_graph_nodes().collect()}["C"] == ["g", "h"]
    assert m.similarity().first().similarity == pytest.approx(1 / 5)
    assert m.largest().first().graph_name == "g" and m.overlapping_nodes("g", "h").count() == 3
    d = multigraph.edit_distance(m.graph("g"), m.graph("h")).first()
    assert (d.node_inserts, d.node_deletes, d.edge_inserts, d.edge_deletes) == (1, 1, 1, 3)


def test_match(spark):
    v = spark.createDataFrame([("1", "Person", "Ann", 31), ("2", "Person", "Bob", 25), ("3", "City", "Rome", None), ("4", "Person", "Cy, Jr", 40)], "id string, label string, name string, age int")
    e = spark.createDataFrame([("1", "2", "KNOWS", "2020"), ("2", "4", "KNOWS", "2021"), ("1", "3", "LIVES", None), ("4", "3", "LIVES", None)], "source string, target string, type string, since string")
    g = Graph(v, e)
    run = lambda q: sorted(tuple(r) for r in match(g, q).collect())
    assert run("MATCH (a:Person)-[:KNOWS]->(b) WHERE a.age > 30") == [("1", "2")]
    assert run("match (a)-[:KNOWS]->(b)-[:KNOWS]->(c) return a.name, c.name") == [("Ann", "Cy, Jr")]
    assert run("MATCH (a:Person)-[:LIVES]->(c {name: 'Rome'})<-[:LIVES]-(b) WHERE a.id < b.id") == [("1", "3", "4")]
    assert run("MATCH (a {name: 'Bob'})--(b)") == [("2", "1"), ("2", "4")]
    assert run("MATCH (a)-[r:KNOWS {since: '2021'}]->(b)") == [("2", "4")]
    assert run("MATCH (a:Person) WHERE NOT a.name CONTAINS 'o' OR a.age >= 100") == [("1",), ("4",)]
    assert run("MATCH (a)<-[:KNOWS]-(b), (b)-[:LIVES]->(c)") == [("2", "1", "3")]
    for bad in ("SELECT 1", "MATCH (a", "MATCH (a)<-[]->(b)", "MATCH (a), (b)", "MATCH (a) WHERE a.age ~ 3", "MATCH (a) WHERE a.nothing = 1"):
        with pytest.raises(errors.QueryParseError):
            match(g, bad)
    assert len(parse("MATCH (a)-[]->(b)-[]->(c)").edges) == 2


def test_triples(spark):
    s = TripleStore.empty(spark).bind("ex", "http://e/").add(("ex:a", "ex:age", typed_literal(30, "xsd:int")), ("ex:b", "ex:age", typed_literal(4, "xsd:int")), ("ex:a", "ex:knows", "ex:b"), ("ex:a", "ex:name", lang_literal("Anna", "de")), ("ex:c", "ex:knows", "ex:c"), ("ex:b", "ex:name", literal("Bo")))
    q = s.select("x", "n").where(var("x"), "ex:age", var("n"))
    assert [r.x for r in q.order_by("n").run().collect()] == ["http://e/b", "http://e/a"]
    assert [r.x for r in q.filter("n", ">", 5).run().collect()] == ["http://e/a"]
    assert [r.x for r in q.order_by("n", True).offset(1).limit(1).run().collect()] == ["http://e/b"]
    assert s.select("x").where("?x", "ex:knows", "?x").run().first().x == "http://e/c"
    assert s.select("y", "m").where("?x", "ex:knows", "?y").where("?y", "ex:name", "?m").run().first().m == "Bo"
    assert s.select("x").where("?x", "ex:name", "?n").filter("n", "lang", "de").run().count() == 1
    assert s.select("x").where("?x", "?p", "?o").distinct().run().count() == 3
    with pytest.raises(errors.QueryParseError):
        s.select("z").where("?x", "ex:age", "?n").run()
    assert s.contains("ex:a", "ex:knows", "ex:b") and s.statistics().first().predicates == 3
    o = s.add_class("ex:Animal", "Animal").add_subclass("ex:Dog", "ex:Animal").add_subclass("ex:Pug", "ex:Dog").add(("ex:rex", "rdf:type", "ex:Pug")).add_property("ex:owner", "object", "ex:Dog")
    assert [r.subject for r in o.instances("ex:Animal").collect()] == ["http://e/rex"]
    assert TripleStore.from_graph(make(spark, "A-B")).export().count() == 4


def test_features_kernels_embeddings(spark, f4):
    f = features.node_features(f4)
    assert f.count() == 6 and {"pagerank", "betweenness", "closeness", "eccentricity"} <= {*f.columns}
    one = {(r.source, r.target): r for r in features.pair_features(f4).collect()}["A", "B"]
    assert one.common_neighbors == 1 and one.jaccard == pytest.approx(1 / 3)
    g = features.graph_features(f4).first()
    assert g.component_count == 1 and g.diameter == 3 and g.radius == 2
    assert pairs(features.core_numbers(f4), "node_id", "core") == {c: 2 for c in "ABCDEF"}
    line = make(spark, "A-B B-C C-D")
    assert similarity.wl_kernel(f4, f4) == pytest.approx(1) and similarity.wl_kernel(f4, line) < 1
    assert similarity.graphlet_kernel(line, line) == pytest.approx(1) and similarity.shortest_path_kernel(line, line) == pytest.approx(1)
    assert 0 < similarity.random_walk_kernel(f4, f4, 3, 2) <= 1 and 0 < similarity.neighbourhood_kernel(line, line) <= 1
    x = embeddings.random_features(f4, 3)
    w = np.array([[1.0, 0], [0, 1], [1, 1]])
    got = pairs(embeddings.gcn_forward(f4, x, w, activation="identity"), "id", "features")
    ids = sorted(got)
    near = {(r.source, r.target) for r in f4.symmetric_edges().collect()}
    a = np.array([[float((i, j) in near) for j in ids] for i in ids])
    d = np.diag(a.sum(1) ** -0.5)
    feats = pairs(x, "id", "features")
    assert np.allclose([got[i] for i in ids], d @ a @ d @ np.array([feats[i] for i in ids]) @ w)
    assert embeddings.graph_sage(f4, x, [np.ones((6, 2))]).count() == 6
    with pytest.raises(errors.Unsupported):
        embeddings.aggregate(f4, x, "lstm")
    assert len(embeddings.node2vec(f4, 8, 5, 2).first().embedding) == 8
    t = spark.createDataFrame([(f"s{i}", "r", f"o{i}") for i in range(8)], "subject string, predicate string, object string")
    before = embeddings.transe(t, 8, 0)
    after = embeddings.transe(t, 8, 6, 0.1)
    mean = lambda m: embeddings.transe_energy(t, *m).agg(F.avg("energy")).first()[0]
    assert mean(after) < mean(before)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "id string, embedding array<double>")
    assert [r.similarity for r in similarity.most_similar(v, [1.0, 0.0], 5).collect()] == [1.0, 0.0]


def test_files_and_engine(spark, f1, tmp_path):
    files.save_graph(f1, f"{tmp_path}/g")
    assert files.load_graph(spark, f"{tmp_path}/g").edge_count() == 5
    for suffix in ("orc", "csv", "json"):
        files.write_table(f1.edges, f"{tmp_path}/e.{suffix}")
        assert Graph.from_files(spark, None, f"{tmp_path}/e.{suffix}").edge_count() == 5
    import pyarrow as pa

    t = pa.table({"source": ["A", "B"], "target": ["B", "C"]})
    with pa.OSFile(f"{tmp_path}/e.arrow", "wb") as out, pa.ipc.new_file(out, t.schema) as w:
        w.write_table(t)
    assert Graph.from_files(spark, None, f"{tmp_path}/e.arrow").node_count() == 3
    mapping, index = connectors.to_edge_index(f1)
    assert mapping.agg(F.max("index")).first()[0] == 4 and index.count() == 10
    assert connectors.from_edge_index(mapping, index).edge_count() == 10
    c = connectors.Connectors(spark)
    c.add("db", "postgresql", "host/db", user="u")
    assert c.options("db")["url"] == "jdbc:postgresql://host/db"
    with pytest.raises(errors.Unsupported):
        c.add("n", "neo4j", "x")
    engine = Engine(f1, "f1")
    assert engine.sql("SELECT count(*) n FROM f1_edges").first().n == 5
    assert engine.run("triangle_count").first().value == 1 and engine.match("MATCH (a)-[]->(b)").count() == 5
    with pytest.raises(errors.InvalidParameter):
        engine.run("nothing")
    with pytest.raises(errors.InvalidParameter):
        engine.run("pagerank", nothing=1)
    got = engine.sql("SELECT * FROM graph_shortest_path(TABLE(f1_edges) WITH SINGLE PARTITION, 'A', 'D')").first()
    assert got.distance == 4.0 and got.path == ["A", "B", "C", "D"]
    pr = {r.node_id: r.pagerank_score for r in engine.sql("SELECT * FROM graph_pagerank(TABLE(f1_edges) WITH SINGLE PARTITION)").collect()}
    assert pr == pytest.approx(pairs(centrality.pagerank(f1), "node_id", "pagerank_score"), abs=1e-5)


def test_node_features_query_has_path_features(f4):
    from graphloom.operators import features

    f = features.node_features(f4, exact=False)
    assert {"eccentricity", "mean_path", "reached", "betweenness_proxy", "closeness_proxy"} <= set(f.columns) and not {"betweenness", "closeness"} & set(f.columns)
    assert f.count() == f4.node_count()
