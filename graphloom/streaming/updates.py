"""A graph that change logs update. A log row: (seq, op, node_id, source, target, weight).

Ops: add_node, remove_node, add_edge, remove_edge, update_weight. A batch is folded key by key, the last
change of a vertex or edge wins and the removal of a vertex removes the edges that were there before it; nothing is replayed row
by row. ``strict`` raises on changes that don't fit (adding what exists, removing what doesn't); otherwise they are no-ops
and adding an existing edge sets its weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.errors import GraphConstructionError, InvalidParameter
from graphloom.graph import Graph
from graphloom.lineage import cut

OPS = ("add_node", "remove_node", "add_edge", "remove_edge", "update_weight")
LOG = "seq long, op string, node_id string, source string, target string, weight double"


@dataclass
class Result:
    """What one batch changed."""

    vertices_added: int = 0
    vertices_removed: int = 0
    edges_added: int = 0
    edges_removed: int = 0
    edges_updated: int = 0

    @property
    def changes(self) -> int:
        return self.vertices_added + self.vertices_removed + self.edges_added + self.edges_removed + self.edges_updated

    @property
    def recomputation_needed(self) -> bool:
        return self.changes > 0


def fold(graph: Graph, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) after the log; edges are one per (source, target)."""
    nodes = log.where(F.col("op").isin("add_node", "remove_node")).select(F.col("node_id").alias("id"), "seq", "op")
    made = log.where("op = 'add_edge'").select(F.explode(F.array("source", "target")).alias("id"), "seq", F.lit("add_node").alias("op"))
    last = nodes.unionByName(made).groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.max(F.when(F.col("op") == "remove_node", F.col("seq"))).alias("removed"))
    last = cut(last, "log-nodes")
    base = graph.node_ids().join(last.select("id"), "id", "left_anti")
    vertices = base.unionByName(last.where("op = 'add_node'").select("id"))

    old = graph.edges.groupBy("source", "target").agg(F.min("weight").alias("weight")).select("source", "target", F.lit(-1).cast("long").alias("seq"), F.lit("add_edge").alias("op"), "weight")
    edge_ops = log.where(F.col("op").isin("add_edge", "remove_edge", "update_weight")).select("source", "target", "seq", "op", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    gone = last.where("removed IS NOT NULL").select("id", "removed")
    touched = old.unionByName(edge_ops)
    # what the removal of an end wipes out
    for end in ("source", "target"):
        touched = touched.join(gone.select(F.col("id").alias(end), F.col("removed").alias(f"r_{end}")), end, "left")
    wiped = F.greatest(F.coalesce("r_source", F.lit(-2)), F.coalesce("r_target", F.lit(-2)))
    touched = touched.where(F.col("seq") > wiped).select("source", "target", "seq", "op", "weight")
    # an update needs an edge: after the last removal, an add must stand
    removed = F.max(F.when(F.col("op") == "remove_edge", F.col("seq")))
    added = F.max(F.when(F.col("op") == "add_edge", F.col("seq")))
    by = touched.groupBy("source", "target").agg(removed.alias("removed"), added.alias("added"), F.max_by(F.when(F.col("op") != "remove_edge", F.col("weight")), F.when(F.col("op") != "remove_edge", F.col("seq"))).alias("weight"))
    edges = by.where(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("added") > F.col("removed")))).select("source", "target", "weight")
    return vertices, edges


class GraphStream:
    """Versions of a graph under change logs, with an append-only log and results cached by version."""

    def __init__(self, graph: Graph, strict: bool = False):
        self.spark: SparkSession = graph.spark
        self.strict, self.version, self.update_count = strict, 0, 0
        self._set(graph.node_ids(), graph.edges.groupBy("source", "target").agg(F.min("weight").alias("weight")))
        self._log: list[tuple[int, DataFrame]] = []
        self._cache: dict[str, tuple[int, object]] = {}
        self._snapshots: dict[int, Graph] = {0: self.graph}

    def _set(self, vertices: DataFrame, edges: DataFrame) -> None:
        self.graph = Graph(cut(vertices, "stream-vertices"), cut(edges, "stream-edges"))

    def apply(self, log: DataFrame) -> Result:
        log = cut(log.select("seq", "op", "node_id", "source", "target", "weight"), "stream-log")
        odd = log.where(~F.col("op").isin(*OPS)).limit(1).collect()
        if odd:
            raise InvalidParameter(f"unknown op {odd[0].op}")
        if self.strict:
            self._check(log)
        old = self.graph
        self._set(*fold(old, log))
        new = self.graph
        both = old.edges.select("source", "target", F.col("weight").alias("w")).join(new.edges, ["source", "target"])
        result = Result(
            new.declared.select("id").subtract(old.declared.select("id")).count(), old.declared.select("id").subtract(new.declared.select("id")).count(),
            new.edges.join(old.edges, ["source", "target"], "left_anti").count(), old.edges.join(new.edges, ["source", "target"], "left_anti").count(),
            both.where("w != weight").count(),
        )
        self.version += 1
        self.update_count += log.count()
        self._log.append((self.version, log))
        return result

    def _check(self, log: DataFrame) -> None:
        known = self.graph.node_ids().select(F.col("id").alias("node_id"), F.lit(True).alias("was"))
        prior = F.lag("op").over(Window.partitionBy("node_id").orderBy("seq"))
        n = log.where(F.col("op").isin("add_node", "remove_node")).withColumn("prior", prior).join(known, "node_id", "left")
        have = F.coalesce(F.col("prior") == "add_node", F.col("was"), F.lit(False))
        pairs = self.graph.edges.select("source", "target", F.lit(True).alias("was"))
        prior_edge = F.lag("op").over(Window.partitionBy("source", "target").orderBy("seq"))
        e = log.where(F.col("op").isin("add_edge", "remove_edge", "update_weight")).withColumn("prior", prior_edge).join(pairs, ["source", "target"], "left")
        have_edge = F.coalesce(F.col("prior") != "remove_edge", F.col("was"), F.lit(False))
        wrong = n.where((F.col("op") == "add_node") == have).select("seq", "op").unionByName(e.where((F.col("op") == "add_edge") == have_edge).select("seq", "op"))
        first = wrong.orderBy("seq").limit(1).collect()
        if first:
            raise GraphConstructionError(f"change {first[0].seq} ({first[0].op}) does not fit the graph")

    def changes_since(self, version: int) -> DataFrame:
        parts = [log for v, log in self._log if v > version]
        out = self.spark.createDataFrame([], LOG)
        for p in parts:
            out = out.unionByName(p)
        return out

    def compact(self) -> None:
        self._log.clear()

    def snapshot(self) -> int:
        self._snapshots[self.version] = self.graph
        return self.version

    def restore(self, version: int) -> None:
        self.graph = self._snapshots[version]
        self.version += 1
        self.compact()

    def cached(self, name: str, compute: Callable[[Graph], object]) -> object:
        """The result of ``compute`` for the present version."""
        if self._cache.get(name, (-1, None))[0] != self.version:
            self._cache[name] = (self.version, compute(self.graph))
        return self._cache[name][1]

    def statistics(self) -> dict:
        return {"version": self.version, "updates": self.update_count, "vertices": self.graph.declared.count(), "edges": self.graph.edges.count(), "log_batches": len(self._log)}

    def sink(self, after: Callable[[GraphStream, Result, int], None] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each micro-batch is a log."""

        def on_batch(batch: DataFrame, batch_id: int) -> None:
            result = self.apply(batch)
            if after:
                after(self, result, batch_id)

        return on_batch
