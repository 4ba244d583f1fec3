"""Connected components. Ids are canonical: the smallest vertex id of a component, and a dense rank of those."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.graph import Graph, settles
from graphloom.lineage import cut, cut_counted


SMALL = 200_000  # links: as many as one task settles, whatever the graph's size


def _settle(links: DataFrame) -> DataFrame:
    """(a, to): the smallest member of the component of every end of at most ``SMALL`` links, by union-find in one task."""
    kind = links.schema["a"].dataType

    def run(batches):
        parent = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array([root(x) for x in ids], to_arrow_type(kind))], names=["a", "to"])

    return links.select("a", "b").repartition(1).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("to", kind)]))


def weak_roots(links: DataFrame) -> DataFrame:
    """(id, root) of every end of ``links`` (a, b): the component's smallest id.

    Rounds of contraction: each vertex goes to its smallest neighbour, links between those that went to the same one
    vanish. At least half of the vertices go each round, so rounds are logarithmic in the size of a component; once ``SMALL`` links are left, one task
    settles them. A round writes its map of vertices, half as long as the one before, and the links that are left; the maps are
    put together at the end, the smallest first.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges, left = cut_counted(both, "wcc-edges")
    maps = []
    while left > SMALL:
        to = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "wcc-to")
        maps.append(to)
        there = to.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges, left = cut_counted(edges.join(to, "a").join(there, "b").where("to != to_b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).distinct(), "wcc-edges")
    roots = _settle(edges)
    for to in reversed(maps):
        further = roots.select(F.col("a").alias("to"), F.col("to").alias("root"))
        roots = to.join(further, "to", "left").select("a", F.coalesce("root", "to").alias("to"))
    return cut(roots.select(F.col("a").alias("id"), F.col("to").alias("root")), "wcc-roots")


def dense_ids(roots: DataFrame, root: str = "root") -> DataFrame:
    """(root, number): ranks of the distinct roots from 0, by ranges, without a window over all rows."""
    ordered = cut(roots.select(root).distinct().orderBy(root).withColumn("part", F.spark_partition_id()), "dense")
    sizes = ordered.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(root)) - 1
    return ordered.withColumn("place", place).join(sizes.select("part", before.alias("before")), "part").select(root, (F.col("place") + F.col("before")).cast("long").alias("number"))


def _numbered(graph: Graph, roots: DataFrame) -> DataFrame:
    every = cut(graph.node_ids().join(roots, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("root", "id").alias("root")), "components")
    return every.join(dense_ids(every), "root").select("node_id", F.col("number").alias("component_id"), F.col("root").alias("component"))


@settles
def weakly_connected_components(graph: Graph) -> DataFrame:
    """(node_id, component_id, component): dense number and smallest member."""
    return _numbered(graph, weak_roots(graph.edges.select(F.col("source").alias("a"), F.col("target").alias("b"))))


@settles
def strongly_connected_components(graph: Graph) -> DataFrame:
    """(node_id, component_id, component), by trimming and forward-backward colouring.

    Vertices without open in- or out-edges are components of their own and are trimmed. Of the rest, every vertex takes
    the largest id that reaches it as its colour; the vertices of a colour that reach its origin are a component.
    """
    edges = cut(graph.edges.where("source != target").select("source", "target").distinct(), "scc-edges")
    done = graph.spark.createDataFrame([], "id string, root string")
    while not edges.isEmpty():
        trimmed = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        trimmed = cut(trimmed.select("source", "target"), "scc-edges")
        if trimmed.count() < edges.count():
            edges = trimmed
            continue
        colour = cut(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("colour", F.col("id")), "scc-colour")
        while True:
            sent = edges.join(colour, F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("sent"))
            step = cut(colour.join(sent, "id", "left").select("id", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("moved")), "scc-colour")
            colour = step.select("id", "colour")
            if step.where("moved").limit(1).isEmpty():
                break
        # backwards from each origin, inside its colour
        back = edges.join(colour.select(F.col("id").alias("source"), F.col("colour").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("ct")), "target").where("cs = ct").select("source", "target")
        back = cut(back, "scc-back")
        found = cut(colour.where("id = colour").select("id", F.col("colour").alias("root")), "scc-found")
        front = found
        while not front.isEmpty():
            front = cut(back.join(front, F.col("target") == F.col("id")).select(F.col("source").alias("id"), "root").distinct().join(found, ["id", "root"], "left_anti"), "scc-front")
            found = found.unionByName(front)
        found = cut(found, "scc-found")
        done = done.unionByName(found)
        edges = cut(edges.join(found.select(F.col("id").alias("source")), "source", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"), "scc-edges")
    # a component is called by its smallest member
    least = done.groupBy("root").agg(F.min("id").alias("least"))
    return _numbered(graph, done.join(least, "root").select("id", F.col("least").alias("root")))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
