"""The property graph: a vertex DataFrame and an edge DataFrame, immutable and lazy."""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import EdgeNotFound, GraphConstructionError, NodeNotFound
from graphloom.lineage import cut

EDGE_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("weight", T.DoubleType())])
NODE_SCHEMA = T.StructType([T.StructField("id", T.StringType())])
_ALIASES = {"src": "source", "from": "source", "dst": "target", "to": "target"}


def _named(df: DataFrame, wanted: tuple[str, ...], what: str) -> DataFrame:
    for c in df.columns:
        if (to := _ALIASES.get(c.lower())) in wanted and to not in df.columns:
            df = df.withColumnRenamed(c, to)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise GraphConstructionError(f"{what} lack the columns {', '.join(missing)}")
    return df


def settles(operator):
    """An operator whose graph's tables are written once on entry, however often it reads them."""

    @wraps(operator)
    def run(graph: Graph, *args, **options):
        return operator(graph.settled(), *args, **options)

    return run


class Graph:
    """A directed multigraph. ``vertices``: id and attributes; ``edges``: source, target, weight and attributes.

    A missing or null weight is 1. Ids that only edges mention are vertices too. Parallel edges are
    kept: centralities count them, path operators take the lightest of them.
    """

    inferred = False  # vertices are the edges' ends and nothing else
    is_settled = False

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        edges = _named(edges, ("source", "target"), "edges")
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        self.edges = edges.withColumns({"source": F.col("source").cast("string"), "target": F.col("target").cast("string"), "weight": weight})
        vertices = _named(vertices, ("id",), "vertices")
        self.declared = vertices.withColumn("id", F.col("id").cast("string"))

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        edges = _named(edges, ("source", "target"), "edges")
        ids = edges.select(F.explode(F.array(F.col("source").cast("string"), F.col("target").cast("string"))).alias("id"))
        made = cls(ids.distinct(), edges)
        made.inferred = True
        return made

    @classmethod
    def from_tables(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        return cls(vertices, edges)

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    @classmethod
    def from_files(cls, spark: SparkSession, vertices: str | None, edges: str) -> Graph:
        from graphloom.sources.files import read_table

        e = read_table(spark, edges)
        return cls(read_table(spark, vertices), e) if vertices else cls.from_edges(e)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def vertices(self) -> DataFrame:
        """All vertices, with the attributes of those that were declared."""
        if self.inferred:
            return self.declared
        ends = self.edges.select(F.col("source").alias("id")).unionByName(self.edges.select(F.col("target").alias("id"))).distinct()
        if self.declared.columns == ["id"]:
            return self.declared.unionByName(ends).distinct()
        return self.declared.unionByName(ends.join(self.declared.select("id"), "id", "left_anti"), allowMissingColumns=True)

    def settled(self) -> Graph:
        """This graph with its tables written once, for what reads them more than once."""
        if self.is_settled:
            return self
        edges = cut(self.edges, "edges")
        if self.inferred:
            made = Graph.from_edges(edges)
            made.declared = cut(made.declared, "vertices")
        else:
            made = Graph(cut(self.declared, "vertices"), edges)
        made.is_settled = True
        return made

    # accessors

    def node_ids(self) -> DataFrame:
        return self.vertices.select("id").distinct()

    def node_count(self) -> int:
        return self.node_ids().count()

    def edge_count(self) -> int:
        return self.edges.count()

    def density(self) -> float:
        """Edges over n(n-1); 0 with fewer than two vertices."""
        n = self.node_count()
        return self.edge_count() / (n * (n - 1)) if n > 1 else 0.0

    def neighbors(self, node: str) -> DataFrame:
        return self.edges.where(F.col("source") == node).select(F.col("target").alias("id"))

    def predecessors(self, node: str) -> DataFrame:
        return self.edges.where(F.col("target") == node).select(F.col("source").alias("id"))

    def has_node(self, node: str) -> bool:
        return not self.vertices.where(F.col("id") == node).limit(1).isEmpty()

    def has_edge(self, source: str, target: str) -> bool:
        return not self._edge(source, target).limit(1).isEmpty()

    def edge_weight(self, source: str, target: str) -> float | None:
        """Weight of the lightest edge between the two, or None."""
        return self._edge(source, target).agg(F.min("weight")).first()[0]

    def _edge(self, source: str, target: str) -> DataFrame:
        return self.edges.where((F.col("source") == source) & (F.col("target") == target))

    def adjacency(self) -> DataFrame:
        """(id, neighbors): out-neighbours with repetition."""
        return self.edges.groupBy(F.col("source").alias("id")).agg(F.collect_list("target").alias("neighbors"))

    # views of the edges that operators share

    def simple_edges(self) -> DataFrame:
        """One row per (source, target), with the smallest weight and the number of parallel edges."""
        return self.edges.groupBy("source", "target").agg(F.min("weight").alias("weight"), F.count(F.lit(1)).alias("n"))

    def undirected_pairs(self) -> DataFrame:
        """(a, b) with a < b, once for each two vertices that an edge joins in either direction."""
        return self.edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()

    def symmetric_edges(self) -> DataFrame:
        """(source, target) in both directions, each once, no loops."""
        pairs = self.undirected_pairs()
        return pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target")))

    # changes give a new graph

    def add_node(self, node: str, **attributes) -> Graph:
        if self.has_node(node):
            raise GraphConstructionError(f"node {node} exists")
        row = self.spark.createDataFrame([(node,)], NODE_SCHEMA).withColumns({k: F.lit(v) for k, v in attributes.items()})
        return Graph(self.vertices.unionByName(row, allowMissingColumns=True), self.edges)

    def remove_node(self, node: str) -> Graph:
        if not self.has_node(node):
            raise NodeNotFound(node)
        return Graph(self.vertices.where(F.col("id") != node), self.edges.where((F.col("source") != node) & (F.col("target") != node)))

    def add_edge(self, source: str, target: str, weight: float = 1.0) -> Graph:
        if self.has_edge(source, target):
            raise GraphConstructionError(f"edge {source} -> {target} exists")
        row = self.spark.createDataFrame([(source, target, float(weight))], EDGE_SCHEMA)
        return Graph(self.vertices, self.edges.unionByName(row, allowMissingColumns=True))

    def remove_edge(self, source: str, target: str) -> Graph:
        """Removes all parallel edges of the two."""
        if not self.has_edge(source, target):
            raise EdgeNotFound(f"{source} -> {target}")
        return Graph(self.vertices, self.edges.where(~((F.col("source") == source) & (F.col("target") == target))))

    def filter_edges(self, condition: Column | str) -> Graph:
        return Graph(self.vertices, self.edges.where(condition))

    def filter_nodes(self, condition: Column | str) -> Graph:
        """The subgraph that the chosen vertices induce."""
        kept = self.vertices.where(condition)
        return Graph(kept, induced_edges(self.edges, kept.select("id")))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)
