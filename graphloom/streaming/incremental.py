"""Algorithms that follow a stream: results of the last version are the start of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check_number
from graphloom.graph import Graph
from graphloom.lineage import cut
from graphloom.operators.components import weak_roots
from graphloom.streaming.updates import Result


class StreamingPageRank:
    """Scores without redistribution of dangling mass; stops on the largest single change."""

    def __init__(self, damping: float = 0.85, max_iterations: int = 50, tolerance: float = 1e-6, full_after: int = 10, warm_iterations: int = 10):
        check_number("damping", damping, 0, 1)
        self.damping, self.max_iterations, self.tolerance, self.full_after, self.warm_iterations = damping, max_iterations, tolerance, full_after, warm_iterations
        self.scores: DataFrame | None = None
        self.converged = False

    def _run(self, graph: Graph, start: DataFrame, iterations: int) -> None:
        edges = graph.edges.select("source", "target")
        out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
        shares = cut(edges.join(out, "source").repartition("source"), "spr-edges")
        ranks, n = cut(start, "spr"), max(1, start.count())
        self.converged = False
        for _ in range(iterations):
            got = ranks.withColumnRenamed("id", "source").join(shares, "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
            new = (1 - self.damping) / n + self.damping * F.coalesce("got", F.lit(0.0))
            step = cut(ranks.join(got, "id", "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("change")), "spr")
            ranks = step.select("id", "score")
            if (step.agg(F.max("change")).first()[0] or 0.0) < self.tolerance:
                self.converged = True
                break
        self.scores = ranks

    def recompute(self, graph: Graph) -> None:
        nodes = graph.node_ids()
        self._run(graph, nodes.withColumn("score", F.lit(1.0 / max(1, nodes.count()))), self.max_iterations)

    initialize = recompute

    def update(self, graph: Graph, result: Result) -> None:
        """Few changes start from the old scores, scaled for new vertices; many, or a start that never settled, from nothing."""
        if self.scores is None or not self.converged or result.changes > self.full_after:
            return self.recompute(graph)
        nodes = graph.node_ids()
        n = max(1, nodes.count())
        scale = (n - result.vertices_added) / n
        start = nodes.join(self.scores, "id", "left").select("id", F.coalesce(F.col("score") * scale, F.lit(1.0 / n)).alias("score"))
        self._run(graph, start, self.warm_iterations)

    def top(self, k: int) -> DataFrame:
        return self.scores.orderBy(F.desc("score"), "id").limit(k)

    def score(self, node: str) -> float | None:
        row = self.scores.where(F.col("id") == node).first()
        return row and row["score"]


class StreamingComponents:
    """Labels are each component's smallest member. Additions merge labels over the few new edges; removals recompute."""

    def __init__(self, full_after: int = 20):
        self.full_after = full_after
        self.labels: DataFrame | None = None

    def recompute(self, graph: Graph) -> None:
        roots = weak_roots(graph.edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
        self.labels = cut(graph.node_ids().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component")), "scc-labels")

    initialize = recompute

    def update(self, graph: Graph, result: Result, new_edges: DataFrame | None = None) -> None:
        if self.labels is None or new_edges is None or result.vertices_removed or result.edges_removed or result.changes > self.full_after:
            return self.recompute(graph)
        labels = self.labels.unionByName(graph.node_ids().join(self.labels, "id", "left_anti").select("id", F.col("id").alias("component")))
        labels = cut(labels, "scc-labels")
        of = lambda end, to: labels.select(F.col("id").alias(end), F.col("component").alias(to))
        met = new_edges.select("source", "target").join(of("source", "a"), "source").join(of("target", "b"), "target").select("a", "b")
        merged = weak_roots(met)
        self.labels = cut(labels.join(merged.select(F.col("id").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "scc-labels")

    def count(self) -> int:
        return self.labels.select("component").distinct().count()

    def sizes(self) -> DataFrame:
        return self.labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))

    def component_of(self, node: str) -> str | None:
        row = self.labels.where(F.col("id") == node).first()
        return row and row["component"]
