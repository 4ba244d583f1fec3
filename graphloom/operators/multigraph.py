"""Several named graphs in one edge table, told apart by graph_name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check
from graphloom.graph import Graph

COMBINE = ("sum", "average", "maximum", "minimum", "keep_first", "keep_last")


class MultiGraph:
    """``edges``: source, target, weight, graph_name[, edge_type][, properties][, seq]."""

    def __init__(self, edges: DataFrame):
        check({"source", "target", "graph_name"} <= {*edges.columns}, "edges need source, target and graph_name")
        self.edges = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))

    @classmethod
    def create(cls, name: str, edges: DataFrame) -> MultiGraph:
        return cls(edges.withColumn("graph_name", F.lit(name)))

    def with_graph(self, name: str, edges: DataFrame) -> MultiGraph:
        return MultiGraph(self.edges.unionByName(edges.withColumn("graph_name", F.lit(name)), allowMissingColumns=True))

    def query(self, names: list[str] | None = None, condition: Column | str | None = None) -> DataFrame:
        out = self.edges if names is None else self.edges.where(F.col("graph_name").isin(names))
        return out if condition is None else out.where(condition)

    def graph(self, name: str) -> Graph:
        return Graph.from_edges(self.edges.where(F.col("graph_name") == name))

    def merge(self, names: list[str] | None = None, combine: str | None = None) -> DataFrame:
        """All edges of the named graphs; with ``combine`` one row per (source, target)."""
        rows = self.query(names)
        if combine is None:
            return rows
        check(combine in COMBINE, f"combine must be one of {', '.join(COMBINE)}")
        order = F.struct(*[c for c in ("seq", "graph_name", "weight") if c in rows.columns])
        weight = {
            "sum": F.sum("weight"), "average": F.avg("weight"), "maximum": F.max("weight"), "minimum": F.min("weight"),
            "keep_first": F.min_by("weight", order), "keep_last": F.max_by("weight", order),
        }[combine]
        aggs = [weight.alias("weight"), F.array_join(F.array_sort(F.collect_set("graph_name")), ",").alias("graph_name")]
        if "properties" in rows.columns:
            named = F.transform(F.map_entries("properties"), lambda e: F.struct(F.concat("graph_name", F.lit("_"), e["key"]), e["value"]))
            aggs.append(F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(named)))).alias("properties"))
        return rows.groupBy("source", "target").agg(*aggs)

    def nodes(self) -> DataFrame:
        return self.edges.select("graph_name", F.explode(F.array("source", "target")).alias("node_id")).distinct()

    def all_nodes(self) -> DataFrame:
        return self.nodes().select("node_id").distinct()

    def cross_graph_nodes(self, least: int = 2) -> DataFrame:
        """(node_id, graphs): vertices of at least ``least`` graphs, with the sorted names."""
        return self.nodes().groupBy("node_id").agg(F.array_sort(F.collect_set("graph_name")).alias("graphs")).where(F.size("graphs") >= least)

    def graphs_containing(self, node: str) -> DataFrame:
        return self.nodes().where(F.col("node_id") == node).select("graph_name")

    def overlapping_nodes(self, a: str, b: str) -> DataFrame:
        of = lambda g: self.nodes().where(F.col("graph_name") == g).select("node_id")
        return of(a).intersect(of(b))

    def similarity(self) -> DataFrame:
        """(a, b, similarity): Jaccard of the distinct edges of each two graphs, a before b; pairs without a shared edge have 0."""
        pairs = self.edges.select("graph_name", "source", "target").distinct()
        sizes = pairs.groupBy("graph_name").agg(F.count(F.lit(1)).alias("n"))
        # an edge's graphs are few; their pairs are counted edge by edge
        of = pairs.groupBy("source", "target").agg(F.array_sort(F.collect_list("graph_name")).alias("g"))
        met = of.select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
        names = sizes.agg(F.sort_array(F.collect_list(F.struct("graph_name", "n"))).alias("s"))
        every = names.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x.graph_name < y.graph_name")
        every = every.select(F.col("x.graph_name").alias("a"), F.col("y.graph_name").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        both = F.coalesce("both", F.lit(0))
        return every.join(met, ["a", "b"], "left").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))

    def statistics(self) -> DataFrame:
        """(graph_name, nodes, edges, avg_weight, total_weight, density)."""
        e = self.edges.groupBy("graph_name").agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("avg_weight"), F.sum("weight").alias("total_weight"))
        n = self.nodes().groupBy("graph_name").agg(F.count(F.lit(1)).alias("nodes"))
        density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
        return n.join(e, "graph_name").select("graph_name", "nodes", "edges", "avg_weight", "total_weight", density.alias("density"))

    def largest(self) -> DataFrame:
        return self.edges.groupBy("graph_name").agg(F.count(F.lit(1)).alias("edges")).orderBy(F.desc("edges"), "graph_name").limit(1)


def edit_distance(a: Graph, b: Graph, node_cost: float | Column = 1.0, edge_cost: float | Column = 1.0) -> DataFrame:
    """(node_inserts, node_deletes, edge_inserts, edge_deletes, distance, normalised): set differences of ids and edges, each at its cost.

    Costs are numbers or expressions over the differing rows (id, or source and target).
    """
    va, vb = a.node_ids(), b.node_ids()
    ea, eb = a.edges.select("source", "target").distinct(), b.edges.select("source", "target").distinct()
    cost = lambda c: c if isinstance(c, Column) else F.lit(float(c))

    def side(df: DataFrame, kind: str, c) -> DataFrame:
        return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cost(c)), F.lit(0.0)).alias("cost"))

    parts = side(vb.subtract(va), "node_inserts", node_cost).unionByName(side(va.subtract(vb), "node_deletes", node_cost)).unionByName(side(eb.subtract(ea), "edge_inserts", edge_cost)).unionByName(side(ea.subtract(eb), "edge_deletes", edge_cost))
    for kind, df in (("va", va), ("vb", vb), ("ea", ea), ("eb", eb)):
        parts = parts.unionByName(df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("cost")))
    n_of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    sizes = n_of("va") + n_of("vb") + n_of("ea") + n_of("eb")
    kinds = ("node_inserts", "node_deletes", "edge_inserts", "edge_deletes")
    return parts.agg(*[n_of(k).alias(k) for k in kinds], F.sum("cost").alias("distance"), F.coalesce(F.try_divide(F.sum("cost"), sizes), F.lit(0.0)).alias("normalised"))
