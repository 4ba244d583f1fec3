"""Path finding: relaxation over a frontier, and enumeration of simple paths hop by hop.

Distances relax in rounds, and only vertices whose distance fell in the last round send on. Parallel edges count by
their smallest weight. Enumerations carry the path as an array and never revisit a vertex unless asked to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ComputationError, InvalidParameter, NodeNotFound, check, check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut


@settles
def distances(graph: Graph, sources: DataFrame, weighted: bool = True, max_hops: int | None = None, with_paths: bool = False) -> DataFrame:
    """(source, id, distance[, path]) of every vertex reachable from each of ``sources`` (id), itself included.

    Needs weights of 0 or more. Ties between paths go to the lexicographically smallest path.
    """
    edges = graph.simple_edges().select(F.col("source").alias("u"), F.col("target").alias("v"), (F.col("weight") if weighted else F.lit(1.0)).alias("w"))
    if weighted and not edges.where("w < 0").limit(1).isEmpty():
        raise ComputationError("shortest paths need weights of 0 or more")
    edges = cut(edges.where("u != v"), "paths-edges")
    path = {"path": F.array("id")} if with_paths else {}
    best = cut(sources.select(F.col("id").alias("source"), "id").distinct().withColumns({"distance": F.lit(0.0), **path}), "paths")
    front, hop = best, 0
    value = F.struct("distance", "path") if with_paths else F.struct("distance")
    keep = ["distance", "path"] if with_paths else ["distance"]
    while max_hops is None or hop < max_hops:
        hop += 1
        step = front.join(edges, F.col("id") == F.col("u")).select("source", F.col("v").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), *([F.concat("path", F.array("v")).alias("path")] if with_paths else []))
        step = step.groupBy("source", "id").agg(F.min(value).alias("new"))
        old = best.select("source", "id", value.alias("old"))
        merged = cut(old.join(step, ["source", "id"], "full_outer").select("source", "id", F.least("old", "new").alias("now"), (F.col("old").isNull() | (F.col("new") < F.col("old"))).alias("better")), "paths")
        best = merged.select("source", "id", *[F.col(f"now.{c}").alias(c) for c in keep])
        front = merged.where("better").select("source", "id", *[F.col(f"now.{c}").alias(c) for c in keep])
        if front.isEmpty():
            break
    return best


def _one(graph: Graph, *nodes: str) -> DataFrame:
    for n in nodes:
        if not graph.has_node(n):
            raise NodeNotFound(n)
    return graph.vertices.where(F.col("id") == nodes[0]).select("id")


def shortest_path(graph: Graph, source: str, target: str | None = None) -> DataFrame:
    """With a target (source, target, distance, path), an error if it can't be reached; else (source, target, distance) of all others that can."""
    start = _one(graph, source, *([target] if target is not None else []))
    got = distances(graph, start, with_paths=target is not None).withColumnRenamed("id", "target")
    if target is None:
        return got.where(F.col("target") != source).select("source", "target", "distance")
    found = got.where(F.col("target") == target).select("source", "target", "distance", "path")
    if found.isEmpty():
        raise ComputationError(f"no path from {source} to {target}")
    return found


@settles
def all_pairs(graph: Graph, weighted: bool = True) -> DataFrame:
    """(source, target, distance) of all ordered pairs with a path, each vertex to itself included (0)."""
    return distances(graph, graph.node_ids(), weighted).select("source", F.col("id").alias("target"), "distance")


@settles
def shortest_path_batch(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Adds the distance to rows of (source, target); null if there is no path."""
    got = distances(graph, pairs.select(F.col("source").alias("id")).distinct()).withColumnRenamed("id", "target")
    return pairs.join(got, ["source", "target"], "left")


def bfs(graph: Graph, source: str, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(id, depth) of the vertices reachable in at most ``max_depth`` hops, the source at 0."""
    check(direction in ("out", "in", "both"), "direction must be out, in or both")
    return multi_bfs(graph, _one(graph, source), max_depth, direction).select("id", "depth")


@settles
def multi_bfs(graph: Graph, sources: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(source, id, depth) from each of ``sources`` (id): each round joins only the newest layer."""
    e = graph.edges.where("source != target").select(F.col("source").alias("u"), F.col("target").alias("v"))
    back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges = cut({"out": e, "in": back, "both": e.unionByName(back)}[direction].distinct(), "bfs-edges")
    layers = [cut(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("depth", F.lit(0)), "bfs")]
    while max_depth is None or len(layers) <= max_depth:
        step = layers[-1].join(edges, F.col("id") == F.col("u")).select("source", F.col("v").alias("id")).distinct()
        # edges in both directions lead from a layer to it, the one before or the one after
        seen = reduce(DataFrame.unionByName, layers[-2:] if direction == "both" else layers)
        layer = cut(step.join(seen, ["source", "id"], "left_anti").withColumn("depth", F.lit(len(layers))), "bfs")
        if layer.isEmpty():
            break
        layers.append(layer)
    return reduce(DataFrame.unionByName, layers)


@settles
def all_paths(graph: Graph, source: str, target: str, max_hops: int = 10) -> DataFrame:
    """(source, target, path_length, path): simple paths of at most ``max_hops`` edges that end at their first visit of the target."""
    check_number("max_hops", max_hops, low=1)
    _one(graph, source, target)
    got = recursive_paths(graph, source, target, max_depth=max_hops, max_paths=None)
    return got.select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col("depth").alias("path_length"), F.col("nodes").alias("path"))


def recursive_paths(
    graph: Graph, start: str, end: str | None = None, max_depth: int = 10, include_cycles: bool = False, weight_threshold: float | None = None, max_paths: int | None = 1000
) -> DataFrame:
    """(nodes, total_weight, depth) in order of depth and nodes.

    With ``end`` the paths to it, which stop there; without one every prefix is a path, the start alone too. A
    ``weight_threshold`` bounds the total weight. ``max_paths`` limits the result, as a feature.
    """
    check_number("max_depth", max_depth, low=0)
    edges = cut(graph.edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "weight"), "paths-edges")
    layer = graph.vertices.where(F.col("id") == start).select(F.array("id").alias("nodes"), F.lit(0.0).alias("total_weight"), F.lit(0).alias("depth"))
    layers = [layer]
    for depth in range(1, max_depth + 1):
        last = F.element_at("nodes", -1)
        layer = layer if end is None else layer.where(last != end)
        step = layer.join(edges, last == F.col("u"))
        if not include_cycles:
            step = step.where(~F.array_contains("nodes", F.col("v")))
        total = F.col("total_weight") + F.col("weight")
        if weight_threshold is not None:
            step = step.where(total <= weight_threshold)
        layer = cut(step.select(F.concat("nodes", F.array("v")).alias("nodes"), total.alias("total_weight"), F.lit(depth).alias("depth")), "paths")
        if layer.isEmpty():
            break
        layers.append(layer)
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    if end is not None:
        out = out.where(F.element_at("nodes", -1) == end)
    out = out.orderBy("depth", "nodes", "total_weight")
    return out if max_paths is None else out.limit(max_paths)


def paths_within_distance(graph: Graph, start: str, max_distance: float, max_depth: int = 20, max_paths: int = 1000) -> DataFrame:
    return recursive_paths(graph, start, max_depth=max_depth, weight_threshold=max_distance, max_paths=max_paths)


def lightest_path(graph: Graph, start: str, end: str) -> DataFrame:
    """(nodes, total_weight, depth) of the lightest path; no row if there is none."""
    got = distances(graph, _one(graph, start, end), with_paths=True).where(F.col("id") == end)
    return got.select(F.col("path").alias("nodes"), F.col("distance").alias("total_weight"), (F.size("path") - 1).alias("depth"))


def reachable(graph: Graph, start: str, max_depth: int | None = None) -> DataFrame:
    """(id) of all other vertices reachable from ``start``."""
    return bfs(graph, start, max_depth).where(F.col("id") != start).select("id")


def pair_distances(graph: Graph, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Adds unweighted ``hops`` to rows of (source, target)."""
    if "source" not in pairs.columns or "target" not in pairs.columns:
        raise InvalidParameter("pairs need source and target")
    got = distances(graph, pairs.select(F.col("source").alias("id")).distinct(), weighted=False, max_hops=max_hops)
    return pairs.join(got.select("source", F.col("id").alias("target"), F.col("distance").cast("int").alias("hops")), ["source", "target"], "left")
