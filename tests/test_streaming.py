"""Change logs, incremental algorithms, sketches, windows and rules; real streams where Spark runs them."""

import pytest
from pyspark.sql import functions as F

from graphloom import errors
from graphloom.graph import Graph
from graphloom.operators import forecasting
from graphloom.streaming import changes, rules, sketches, windows
from graphloom.streaming.incremental import StreamingComponents, StreamingPageRank
from graphloom.streaming.updates import LOG, GraphStream


def log(spark, *rows):
    return spark.createDataFrame([(i, op, *(a if len(a) == 1 else (None,)), *((None, None, None) if len(a) == 1 else (a[0], a[1], float(a[2]) if len(a) > 2 else None))) for i, (op, *a) in enumerate(rows)], LOG)


@pytest.fixture
def base(spark):
    return Graph(spark.createDataFrame([(c,) for c in "ABCD"], "id string"), spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "source string, target string, weight double"))


def test_change_log(spark, base):
    s = GraphStream(base)
    r = s.apply(log(spark, ("add_edge", "C", "D", 2), ("add_edge", "A", "B", 9), ("remove_node", "B"), ("add_edge", "E", "A", 1), ("update_weight", "C", "D", 5), ("add_node", "Q"), ("remove_node", "Q"), ("remove_edge", "X", "Y")))
    assert {(e.source, e.target, e.weight) for e in s.graph.edges.collect()} == {("C", "D", 5.0), ("E", "A", 1.0)}
    assert {v.id for v in s.graph.vertices.collect()} == {"A", "C", "D", "E"}
    assert (r.vertices_added, r.vertices_removed, r.edges_added, r.edges_removed) == (1, 1, 2, 2) and r.recomputation_needed
    assert s.changes_since(0).count() == 8 and s.statistics()["edges"] == 2
    mark = s.snapshot()
    s.apply(log(spark, ("remove_edge", "C", "D")))
    assert s.cached("n", lambda g: g.edge_count()) == 1
    s.restore(mark)
    assert s.cached("n", lambda g: g.edge_count()) == 2 and s.changes_since(0).count() == 0
    strict = GraphStream(base, strict=True)
    for bad in (("add_node", "A"), ("remove_node", "Z"), ("add_edge", "A", "B"), ("remove_edge", "A", "D"), ("update_weight", "A", "D", 1)):
        with pytest.raises(errors.GraphConstructionError):
            strict.apply(log(spark, bad))
    with pytest.raises(errors.InvalidParameter):
        s.apply(log(spark, ("explode", "A")))


def test_stream_of_logs(spark, base, tmp_path):
    log(spark, ("add_edge", "C", "D", 1), ("remove_edge", "A", "B")).write.parquet(f"{tmp_path}/in")
    s, seen = GraphStream(base), []
    q = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in").writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(s.sink(lambda _, r, b: seen.append(r.changes))).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(seen) == 2 and s.graph.edge_count() == 2


def test_incremental(spark, base):
    s, pr, cc = GraphStream(base), StreamingPageRank(), StreamingComponents()
    pr.initialize(s.graph), cc.initialize(s.graph)
    assert pr.score("B") > pr.score("A") and cc.count() == 2
    new = log(spark, ("add_edge", "C", "D", 1))
    r = s.apply(new)
    cc.update(s.graph, r, new.select("source", "target"))
    assert cc.count() == 1 and cc.component_of("D") == "A"
    pr.update(s.graph, r)
    warm = {x.id: x.score for x in pr.scores.collect()}
    pr.recompute(s.graph)
    assert warm == pytest.approx({x.id: x.score for x in pr.scores.collect()}, abs=1e-4)
    assert pr.top(1).first().id == "D"
    r = s.apply(log(spark, ("remove_edge", "B", "C")))
    cc.update(s.graph, r)
    assert cc.count() == 2


def test_sketches(spark):
    rows = spark.range(1000).select((F.col("id") % 200).cast("string").alias("k"))
    a, b = sketches.distinct_sketch(rows, "k"), sketches.distinct_sketch(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k")
    assert abs(sketches.estimate_distinct(sketches.merge_distinct(a.unionByName(b))).first()[0] - 1000) < 50
    cm = sketches.CountMin.of(rows, "k", width=500)
    assert all(r.estimate >= 5 for r in cm.estimate(rows, "k").collect())
    assert all(r.estimate >= 10 for r in cm.merge(cm).estimate(rows, "k").collect())
    bloom = sketches.Bloom.of(rows, "k", 200, 0.01)
    assert all(r.maybe for r in bloom.contains(rows, "k").collect())
    others = spark.range(1000, 3000).select(F.col("id").cast("string").alias("k"))
    assert bloom.contains(others, "k").where("maybe").count() < 80 and 0 < bloom.false_positive_rate() < 0.05
    e = spark.createDataFrame([("A", "B"), ("B", "C")], "source string, target string")
    m = sketches.merge_graph_sketches(sketches.graph_sketches(e).unionByName(sketches.graph_sketches(e))).first()
    assert (m.nodes, m.edges) == (3, 2)


def test_changes(spark, base):
    m = changes.graph_metrics(base, 0).unionByName(changes.graph_metrics(base.add_edge("C", "D").add_edge("A", "C"), 1))
    found = {r.anomaly for r in changes.metric_anomalies(m).collect()}
    assert {"density_spike", "degree_burst", "component_merge"} <= found
    bursts = changes.burst_anomalies(spark.createDataFrame([(0, 6, 11), (1, 5, 10)], "batch long, vertices_added long, edges_added long"))
    assert {(r.batch, r.anomaly) for r in bursts.collect()} == {(0, "edge_burst"), (0, "node_burst")}
    a = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "node_id string, community long")
    b = spark.createDataFrame([("A", 1), ("B", 3), ("C", 2)], "node_id string, community long")
    assert changes.stability(a, b).first()[0] == pytest.approx(2 / 3) and changes.changed_nodes(a, b).count() == 1
    shift = changes.community_shift(a, b, 1)
    assert changes.classify_changes(shift.unionByName(bursts)).where("batch = 1").first().change == "community_drift"
    assert changes.anomalous_state(spark.createDataFrame([(i, "x", 0.9) for i in range(3)], "batch long, anomaly string, severity double"))


def test_rules(spark):
    ran, now = [], [0.0]
    r = rules.RuleEngine(spark, [rules.Rule("grow", rules.edge_trigger(5), ["all"], 1, 10.0), rules.Rule("bad", rules.severity_trigger(0.5), ["fail"], 9)], {"pagerank": ran.append, "components": ran.append, "fail": lambda s: 1 / 0}, history=3, clock=lambda: now[0])
    state = lambda added, sev: spark.createDataFrame([(1, 0, 0, added, 0, 10, 20, 0.1, 0.0, 0, 1.0, sev, ["edge_burst"])], rules.STATE)
    assert r.on_batch(state(6, 0.9)) == ["bad", "grow"] and len(ran) == 2
    assert r.on_batch(state(6, 0.1)) == []
    now[0] = 11
    assert r.on_batch(state(6, 0.1)) == ["grow"] and r.log().count() == 3
    assert r.statistics().where("action = 'components'").first().success_rate == 1.0
    with pytest.raises(errors.InvalidParameter):
        r.add(rules.Rule("grow", rules.periodic_trigger(), []))
    assert len(rules.RuleEngine(spark).on_batch(state(0, 0.0))) >= 1


def test_windows(spark, tmp_path):
    w = windows.SlidingWindow(seconds=100, most=30)
    for i in range(40):
        w.update(i * 5, {"node_count": 10 + i, "density": 0.5})
    assert len(w.rows) == 20 and w.recent(1)[0]["node_count"] == 49
    t = {r.metric: r.direction for r in w.trends(spark).collect()}
    assert t == {"node_count": "increasing", "density": "stable"}
    assert {r.pattern for r in w.patterns(spark).collect()} >= {"growth"}
    series = spark.createDataFrame([("m", i, 10.0 if i < 15 else 20.0) for i in range(30)], "metric string, ts long, value double")
    points = forecasting.change_points(series).orderBy(F.desc("change")).first()
    assert points.ts == 15 and points.change == pytest.approx(1.0)
    assert forecasting.anomalies(spark.createDataFrame([("m", i, 100.0 if i == 20 else float(i % 3)) for i in range(40)], "metric string, ts long, value double")).first().ts == 20
    f = forecasting.linear_forecast(spark.createDataFrame([("m", i, 2.0 * i) for i in range(10)], "metric string, ts long, value double"), 2).orderBy("step").collect()
    assert [r.value for r in f] == [pytest.approx(20), pytest.approx(22)]
    assert forecasting.choose_model(series).first().model in ("exponential_smoothing", "seasonal")
    assert forecasting.exponential_smoothing(series, 0.5).first().level == pytest.approx(20, abs=0.01)
    assert forecasting.lag_features(series).columns[-1] == "sd_30" and forecasting.overall_direction(series).first().direction == "increasing"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = windows.windowed_counts(events, "1 day").agg(F.sum("n")).first()[0]
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windows.windowed_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/w").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.sql("SELECT sum(n) FROM win").first()[0] == batch == events.count()
    assert windows.interval_join(events, events, "user_id", "1 hour").count() >= events.count()
