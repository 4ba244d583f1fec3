"""Centralities. Edges count with multiplicity; loops count as edges in degree and PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check, check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut, cut_bucketed, cut_measured
from graphloom.operators.paths import all_pairs
from graphloom.operators.sources import dependencies, distance_sums, from_all


@settles
def pagerank(
    graph: Graph, damping_factor: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, partition: Column | str | None = None, personal: DataFrame | None = None, top_k: int | None = None
) -> DataFrame:
    """(node_id, pagerank_score) by falling score.

    The mass of vertices without out-edges is spread over all vertices; the loop ends once the scores' L1 change is under ``tolerance``.
    With ``partition`` (an edge column) every part of the edges is a graph of its own: (part, node_id, pagerank_score).
    ``personal`` (id, weight) replaces the even restart.
    """
    check_number("damping_factor", damping_factor, 0, 1)
    check_number("max_iterations", max_iterations, above=0)
    check_number("tolerance", tolerance, above=0)
    by = [] if partition is None else ["part"]  # the keys that tell graphs apart
    named = [] if partition is None else [(F.col(partition) if isinstance(partition, str) else partition).alias("part")]
    e = cut(graph.edges.select(*named, "source", "target").groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("n")), "pagerank-counts")
    out = e.groupBy(*by, "source").agg(F.sum("n").alias("out"))
    ends = e.select(*by, F.explode(F.array("source", "target")).alias("id")).distinct() if by else cut(graph.node_ids(), "pagerank-ids")
    sizes = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    nodes = ends.join(out.withColumnRenamed("source", "id"), [*by, "id"], "left").select(*by, "id", F.col("out").isNull().alias("sink"))
    if personal is not None:
        total = personal.agg(F.sum("weight")).first()[0]
        check(bool(total) and total > 0, "personal weights must add up to more than 0")
        nodes = nodes.join(personal.select("id", (F.col("weight") / float(total)).alias("w")), "id", "left").select(*by, "id", "sink", F.coalesce("w", F.lit(0.0)).alias("restart"))
    elif by:
        nodes = nodes.join(sizes, by).select(*by, "id", "sink", (1 / F.col("size")).alias("restart"))
    else:
        nodes = nodes.withColumn("restart", F.lit(1 / max(1, sizes.first()[0])))
    shares = e.join(out, [*by, "source"]).select(*by, "source", "target", (F.col("n") / F.col("out")).alias("share"))
    d = float(damping_factor)
    if not by and e.join(out.select(F.col("source").alias("target")), "target", "left_semi").isEmpty():
        ranks = _one_hop_ranks(nodes, shares, d, max_iterations, tolerance)
    else:
        ranks = _ranks(nodes, shares, d, max_iterations, tolerance, by)
    scores = ranks.select(*([F.col("part")] if by else []), F.col("id").alias("node_id"), F.col("score").alias("pagerank_score"))
    scores = scores.orderBy(F.desc("pagerank_score"), "node_id")
    return scores if top_k is None else scores.limit(top_k)


def _ranks(nodes: DataFrame, shares: DataFrame, d: float, max_iterations: int, tolerance: float, by: list[str]) -> DataFrame:
    """(part, id, score) after the rounds of ``pagerank`` over nodes (part, id, sink, restart) and shares (part, source, target, share)."""
    # read by every round: in buckets, so that only scores move
    shares = cut_bucketed(shares, "pagerank-shares", *by, "source")
    lost = F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0))
    ranks, seen = cut_measured(nodes.withColumn("score", F.col("restart")), "pagerank", sunk=lost)
    for _ in range(max_iterations):
        got = ranks.where("NOT sink").select(*by, F.col("id").alias("source"), "score").join(shares, [*by, "source"]).groupBy(*by, F.col("target").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        step = ranks.join(got, [*by, "id"], "left")
        if by:
            step = step.join(ranks.groupBy("part").agg(lost.alias("sunk")), "part")
        else:
            step = step.withColumn("sunk", F.lit(float(seen["sunk"])))
        new = (1 - d) * F.col("restart") + d * (F.coalesce("got", F.lit(0.0)) + F.col("sunk") * F.col("restart"))
        step = step.select(*by, "id", "sink", "restart", new.alias("score"), F.abs(new - F.col("score")).alias("change"))
        ranks, seen = cut_measured(step, "pagerank", sunk=lost, moved=F.sum("change"))
        moved = ranks.groupBy("part").agg(F.sum("change").alias("c")).agg(F.max("c")).first()[0] if by else seen["moved"]
        ranks = ranks.drop("change")
        if moved is None or moved < tolerance:
            break
    return ranks


def _one_hop_ranks(nodes: DataFrame, shares: DataFrame, d: float, max_iterations: int, tolerance: float) -> DataFrame:
    """``_ranks`` of a graph none of whose edges leads to a vertex with out-edges, without a join for each round.

    There the scores after t rounds are alpha(t) * restart + d * alpha(t - 1) * got: ``got`` is what the edges carry from a start at restart, and alpha follows
    from the score the sinks hold, a number. So all rounds' changes are aggregates of one table.
    """
    got = shares.join(nodes.select(F.col("id").alias("source"), "restart"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("restart") * F.col("share")).alias("got"))
    joined = nodes.join(got, "id", "left").select("id", "sink", "restart", F.coalesce("got", F.lit(0.0)).alias("got"))
    base, seen = cut_measured(joined, "pagerank", sunk=F.coalesce(F.sum(F.when(F.col("sink"), F.col("restart"))), F.lit(0.0)), got=F.coalesce(F.sum("got"), F.lit(0.0)))
    a = [0.0, 1.0]  # alpha(t) is a[t + 1]
    for _ in range(max_iterations):
        a.append((1 - d) + d * (a[-1] * seen["sunk"] + d * a[-2] * seen["got"]))
    score = lambda t: F.lit(a[t + 1]) * F.col("restart") + F.lit(d * a[t]) * F.col("got")
    last = max_iterations
    for first in range(1, max_iterations + 1, 20):
        rounds = range(first, min(first + 20, max_iterations + 1))
        moved = base.agg(*[F.sum(F.abs(score(t) - score(t - 1))).alias(f"moved{t}") for t in rounds]).first()
        done = [t for t, m in zip(rounds, moved) if m is None or m < tolerance]
        if done:
            last = done[0]
            break
    return base.select("id", "sink", "restart", score(last).alias("score"))


def degrees(graph: Graph) -> DataFrame:
    """(node_id, in_degree, out_degree, degree) with multiplicity."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    every = ends.unionByName(graph.node_ids().select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return every.groupBy(F.col("id").alias("node_id")).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


@settles
def degree_centrality(graph: Graph) -> DataFrame:
    """(node_id, degree_centrality): out-degree over n - 1."""
    n = graph.node_count()
    return degrees(graph).select("node_id", (F.col("out_degree") / float(max(1, n - 1))).alias("degree_centrality"))


@settles
def eigenvector_centrality(graph: Graph, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node_id, eigenvector_centrality): sums of in-neighbours' scores, L2-normalised, from an even start."""
    check_number("max_iterations", max_iterations, above=0)
    check_number("tolerance", tolerance, above=0)
    edges = cut(graph.edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), "eigen-edges")
    nodes = graph.node_ids()
    n = nodes.count()
    scores = cut(nodes.withColumn("score", F.lit(1 / n**0.5 if n else 0.0)), "eigen")
    for _ in range(max_iterations):
        got = scores.withColumnRenamed("id", "source").join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("score") * F.col("n")).alias("new"))
        step = cut(scores.join(got, "id", "left").select("id", "score", F.coalesce("new", F.lit(0.0)).alias("new")), "eigen")
        norm = (step.agg(F.sum(F.col("new") * F.col("new"))).first()[0] or 0.0) ** 0.5
        if norm == 0:  # no cycle feeds the scores
            scores = step.select("id", F.lit(0.0).alias("score"))
            break
        change = step.agg(F.sum(F.abs(F.col("new") / norm - F.col("score")))).first()[0]
        scores = step.select("id", (F.col("new") / norm).alias("score"))
        if change < tolerance:
            break
    return scores.select(F.col("id").alias("node_id"), F.col("score").alias("eigenvector_centrality")).orderBy(F.desc("eigenvector_centrality"), "node_id")


@settles
def closeness_centrality(graph: Graph, weighted: bool = False) -> DataFrame:
    """(node_id, closeness_centrality): (reached / (n - 1)) / mean distance over out-paths; 0 if nothing is reached."""
    if weighted:
        n = graph.node_count()
        got = all_pairs(graph).where("source != target").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("r"), F.sum("distance").alias("d"))
    else:
        got, n = from_all(graph, distance_sums, "number bigint, reached bigint, total bigint")
        got = got.select("id", F.col("reached").alias("r"), F.col("total").cast("double").alias("d"))
    score = F.when(F.col("d") > 0, F.col("r") / float(max(1, n - 1)) / (F.col("d") / F.col("r"))).otherwise(0.0)
    return graph.node_ids().join(got, "id", "left").select(F.col("id").alias("node_id"), F.coalesce(score, F.lit(0.0)).alias("closeness_centrality"))


@settles
def betweenness_centrality(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(node_id, betweenness_centrality): unweighted, directed, times 2 / ((n-1)(n-2)) if n > 2.

    Each task searches from its share of the start vertices and returns sums of dependencies. ``sources`` (id) restricts the start vertices.
    """
    found, n = from_all(graph, dependencies, "number bigint, b double", sources)
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = found.groupBy("id").agg(F.sum("b").alias("b"))
    return graph.node_ids().join(sums, "id", "left").select(F.col("id").alias("node_id"), (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness_centrality")).orderBy(F.desc("betweenness_centrality"), "node_id")


@settles
def pair_betweenness(graph: Graph) -> DataFrame:
    """(node_id, pairs): for how many ordered pairs a vertex lies on some shortest weighted path, whatever the number of paths."""
    d = cut(all_pairs(graph), "pair-distances")
    a = d.select(F.col("source").alias("s"), F.col("target").alias("v"), F.col("distance").alias("d1")).where("s != v")
    b = d.select(F.col("source").alias("v"), F.col("target").alias("t"), F.col("distance").alias("d2")).where("v != t")
    whole = d.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("distance").alias("d")).where("s != t")
    on = a.join(b, "v").where("s != t").join(whole, ["s", "t"]).where(F.abs(F.col("d1") + F.col("d2") - F.col("d")) <= 1e-9).groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("pairs"))
    return graph.node_ids().join(on, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@settles
def batch_centralities(graph: Graph) -> DataFrame:
    """(node_id, degree, eigenvector, closeness): closeness over weighted distances."""
    return (
        degree_centrality(graph).withColumnRenamed("degree_centrality", "degree")
        .join(eigenvector_centrality(graph).withColumnRenamed("eigenvector_centrality", "eigenvector"), "node_id")
        .join(closeness_centrality(graph, weighted=True).withColumnRenamed("closeness_centrality", "closeness"), "node_id")
    )


def windowed(graph: Graph, partition: str, measure: str) -> DataFrame:
    """A centrality of each vertex within each part of the edges: (part, node_id, score); measure pagerank, degree or betweenness."""
    if measure == "pagerank":
        return pagerank(graph, partition=partition).withColumnRenamed("pagerank_score", "score")
    if measure == "degree":
        ends = graph.edges.select(F.col(partition).alias("part"), F.col("source").alias("node_id"), F.lit(1).alias("o")).unionByName(graph.edges.select(F.col(partition).alias("part"), F.col("target").alias("node_id"), F.lit(0).alias("o")))
        by = ends.groupBy("part", "node_id").agg(F.sum("o").alias("o"))
        sizes = by.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        return by.join(sizes, "part").select("part", "node_id", F.when(F.col("n") > 1, F.col("o") / (F.col("n") - 1)).otherwise(0.0).alias("score"))
    check(measure == "betweenness", "measure must be pagerank, degree or betweenness")
    # vertices of different parts are different vertices of one graph
    glue = F.lit("\x1f")
    edges = graph.edges.select(F.concat(F.col(partition).cast("string"), glue, F.col("source")).alias("source"), F.concat(F.col(partition).cast("string"), glue, F.col("target")).alias("target"))
    whole = Graph.from_edges(edges)
    n_all = whole.node_count()
    got = betweenness_centrality(whole).select(F.split_part("node_id", glue, F.lit(1)).alias("part"), F.split_part("node_id", glue, F.lit(2)).alias("node_id"), "betweenness_centrality")
    sizes = got.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    undo = (n_all - 1) * (n_all - 2) / 2 if n_all > 2 else 1.0
    own = F.when(F.col("n") > 2, 2 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    return got.join(sizes, "part").select("part", "node_id", (F.col("betweenness_centrality") * undo * own).alias("score"))
