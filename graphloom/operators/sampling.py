"""Samples of graphs. Draws are hashes of id and seed: the same sample whatever the partitioning, and each is a feature with a size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import check, check_number
from graphloom.graph import Graph, induced_edges, settles
from graphloom.lineage import cut
from graphloom.operators.centrality import degrees, pagerank
from graphloom.operators.paths import multi_bfs
from graphloom.operators.walks import random_walk, uniform


def target_size(n: int, rate: float = 0.1, least: int = 100, most: int = 10_000) -> int:
    """rate * n, at least ``least`` and at most ``most``, never more than n."""
    return int(min(n, max(least, min(most, round(rate * n)))))


def bottom_k(rows: DataFrame, k: int, *key: str, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """k rows without replacement: those of the smallest draws, by weight if given. Mergeable, so it works on streams too."""
    u = uniform(*key, seed=seed)
    draw = u if weight is None else F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))
    return rows.withColumn("__draw", draw).orderBy("__draw", *key).limit(k).drop("__draw")


def reservoir(rows: DataFrame, k: int, *key: str, seed: int = 0) -> DataFrame:
    return bottom_k(rows, k, *key, seed=seed)


@settles
def sample_nodes(graph: Graph, size: int | None = None, by: str = "uniform", seed: int = 0) -> DataFrame:
    """(node_id) without replacement; ``by``: uniform, degree or pagerank."""
    check(by in ("uniform", "degree", "pagerank"), "by must be uniform, degree or pagerank")
    size = graph.node_count() // 2 if size is None else size
    check_number("size", size, low=0)
    if by == "uniform":
        return bottom_k(graph.node_ids().select(F.col("id").alias("node_id")), size, "node_id", seed=seed)
    weights = degrees(graph).select("node_id", F.col("degree").cast("double").alias("w")) if by == "degree" else pagerank(graph, tolerance=1e-4).withColumnRenamed("pagerank_score", "w")
    return bottom_k(weights, size, "node_id", weight=F.col("w"), seed=seed).select("node_id")


def sample_edges(graph: Graph, ratio: float | None = None, size: int | None = None, weighted: bool = False, seed: int = 0) -> DataFrame:
    """(source, target, weight): each edge with probability ``ratio`` (0.5 by default), or ``size`` edges, by weight if asked."""
    edges = graph.edges.select("source", "target", "weight")
    if size is None:
        ratio = 0.5 if ratio is None else ratio
        check_number("ratio", ratio, 0, 1)
        return edges.where(uniform("source", "target", "weight", seed=seed) < ratio)
    check_number("size", size, low=0)
    return bottom_k(edges, size, "source", "target", "weight", weight=F.abs("weight") if weighted else None, seed=seed)


def snowball(graph: Graph, seed_nodes: list[str] | DataFrame, k_hops: int = 2, max_nodes: int | None = None) -> DataFrame:
    """(node_id, depth): what the seeds reach in ``k_hops`` out-hops, the nearest first up to ``max_nodes``."""
    check_number("k_hops", k_hops, low=0)
    seeds = graph.spark.createDataFrame([(s,) for s in seed_nodes], "id string") if isinstance(seed_nodes, list) else seed_nodes
    seeds = seeds.join(graph.node_ids(), "id", "left_semi")
    got = multi_bfs(graph, seeds, k_hops).groupBy(F.col("id").alias("node_id")).agg(F.min("depth").alias("depth"))
    return got if max_nodes is None else got.orderBy("depth", "node_id").limit(max_nodes)


def forest_fire(graph: Graph, seeds: list[str] | DataFrame, burn: float = 0.7, max_nodes: int | None = None, seed: int = 0) -> DataFrame:
    """(node_id, depth): fire spreads over each out-edge of a burning vertex with probability ``burn``."""
    check_number("burn", burn, 0, 1)
    edges = cut(graph.edges.select("source", "target").distinct().where(uniform("source", "target", seed=seed) < burn), "fire-edges")
    return snowball(Graph(graph.node_ids(), edges), seeds, k_hops=1 << 20, max_nodes=max_nodes)


def graph_sampling(graph: Graph, method: str = "random_node", **options) -> DataFrame:
    """By name: random_node (sample_size), random_edge (sample_ratio), snowball (seed_nodes, k_hops, max_nodes)."""
    if method == "random_node":
        return sample_nodes(graph, options.get("sample_size"), seed=options.get("seed", 0))
    if method == "random_edge":
        return sample_edges(graph, options.get("sample_ratio"), seed=options.get("seed", 0))
    check(method == "snowball", f"unknown sampling method {method}")
    return snowball(graph, options["seed_nodes"], options.get("k_hops", 2), options.get("max_nodes"))


def combined_sample(graph: Graph, seed: int = 0) -> DataFrame:
    """(method, node_id): a walk of 100 steps, five seeds three hops deep, and a fire of 0.7."""
    seeds = cut(bottom_k(graph.node_ids(), 5, "id", seed=seed), "seeds")
    size = target_size(graph.node_count())
    walk = random_walk(graph, 100, 1, seed, seeds.limit(1)).select("node_id").distinct()
    near = snowball(graph, seeds, 3, size).select("node_id")
    fire = forest_fire(graph, seeds.limit(1), 0.7, size, seed).select("node_id")
    return reduce(DataFrame.unionByName, [x.select(F.lit(m).alias("method"), "node_id") for m, x in (("random_walk", walk), ("bfs", near), ("forest_fire", fire))])


# samples for training, with importance weights


def _with_weights(graph: Graph, nodes: DataFrame, normalisation: str) -> tuple[DataFrame, DataFrame]:
    check(normalisation in ("importance", "inverse_degree", "inverse_sqrt_degree"), "unknown normalisation")
    d = cut(nodes.join(degrees(graph).select("node_id", "degree"), "node_id"), "saint-nodes")
    k = d.count()
    total = degrees(graph).agg(F.sum(F.col("degree") + 1)).first()[0] or 0
    p = F.col("degree") + 1
    weight = {"importance": float(total) / (p * max(1, k)), "inverse_degree": 1 / F.greatest(F.col("degree"), F.lit(1)), "inverse_sqrt_degree": 1 / F.greatest(F.lit(1.0), F.sqrt("degree"))}[normalisation]
    out = d.select("node_id", weight.cast("double").alias("weight"))
    return out, induced_edges(graph.edges, out.select(F.col("node_id").alias("id")))


def saint_node(graph: Graph, size: int, seed: int = 0, normalisation: str = "importance") -> tuple[DataFrame, DataFrame]:
    """(nodes with weights, induced edges): vertices by degree + 1, without replacement."""
    w = degrees(graph).select("node_id", (F.col("degree") + 1).alias("w"))
    return _with_weights(graph, bottom_k(w, size, "node_id", weight=F.col("w"), seed=seed).select("node_id"), normalisation)


def saint_uniform(graph: Graph, size: int, seed: int = 0, normalisation: str = "importance") -> tuple[DataFrame, DataFrame]:
    return _with_weights(graph, sample_nodes(graph, size, seed=seed), normalisation)


def saint_edge(graph: Graph, size: int, seed: int = 0, normalisation: str = "importance") -> tuple[DataFrame, DataFrame]:
    e = sample_edges(graph, size=size, seed=seed)
    return _with_weights(graph, e.select(F.explode(F.array("source", "target")).alias("node_id")).distinct(), normalisation)


def saint_walk(graph: Graph, walks: int, length: int, seed: int = 0, normalisation: str = "importance") -> tuple[DataFrame, DataFrame]:
    starts = bottom_k(graph.node_ids(), walks, "id", seed=seed)
    return _with_weights(graph, random_walk(graph, length, 1, seed, starts).select("node_id").distinct(), normalisation)


def saint_neighbourhood(graph: Graph, share: float = 0.3, fan_out: int = 5, hops: int = 2, seed: int = 0, normalisation: str = "importance") -> tuple[DataFrame, DataFrame]:
    """Seeds are a share of the vertices; each hop takes at most ``fan_out`` neighbours of each vertex."""
    front = bottom_k(graph.node_ids(), max(1, int(graph.node_count() * share)), "id", seed=seed).select(F.col("id").alias("node_id"))
    got = [cut(front, "saint")]
    for hop in range(hops):
        got.append(cut(sample_neighbours(graph, got[-1], fan_out, seed + hop).select(F.col("neighbour").alias("node_id")).distinct(), "saint"))
    return _with_weights(graph, reduce(DataFrame.unionByName, got).distinct(), normalisation)


def sample_neighbours(graph: Graph, nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(node_id, neighbour): at most k neighbours of each of ``nodes`` (node_id), in either direction, without replacement."""
    check_number("k", k, low=1)
    near = graph.symmetric_edges().select(F.col("source").alias("node_id"), F.col("target").alias("neighbour")).join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.xxhash64(F.lit(seed), "node_id", "neighbour"), "neighbour"))
    return near.withColumn("n", place).where(F.col("n") <= k).select("node_id", "neighbour")


def fast_gcn_layers(graph: Graph, sizes: list[int], seed: int = 0) -> DataFrame:
    """(layer, draw, node_id): with replacement, by (degree + 1) / (layer + 1), by searching hashed uniforms in the summed weights."""
    w = degrees(graph).select("node_id", (F.col("degree") + 1).cast("double").alias("w"))
    parts = cut(w.repartitionByRange("node_id").withColumn("part", F.spark_partition_id()), "gcn-weights")
    sums = parts.groupBy("part").agg(F.sum("w").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row per partition
    inside = F.sum("w").over(Window.partitionBy("part").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0))
    ranges = cut(parts.join(sums.select("part", before.alias("b")), "part").withColumn("hi", F.col("b") + inside).select("part", "node_id", (F.col("hi") - F.col("w")).alias("lo"), "hi"), "gcn-ranges")
    spans = ranges.groupBy("part").agg(F.min("lo").alias("from"), F.max("hi").alias("to"))
    total = spans.agg(F.max("to")).first()[0] or 0.0
    draws = reduce(DataFrame.unionByName, [graph.spark.range(n).select(F.lit(i).alias("layer"), F.col("id").alias("draw"), (uniform(F.lit(i), F.col("id"), seed=seed) * float(total)).alias("x")) for i, n in enumerate(sizes)])
    at = draws.join(F.broadcast(spans), (F.col("x") >= F.col("from")) & (F.col("x") < F.col("to")))  # one row per partition
    return at.join(ranges, "part").where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("layer", "draw", "node_id")


def effective_sample_size(weights: DataFrame, column: str = "weight") -> DataFrame:
    """(effective_sample_size): (sum w)^2 / sum w^2."""
    w = F.col(column)
    return weights.agg(F.coalesce(F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w)), F.lit(0.0)).alias("effective_sample_size"))


def adapt_parameters(size: int, walks: int, variance: float) -> tuple[int, int]:
    """Next (sample size, walks): grow on high variance, shrink on low."""
    if variance > 0.1:
        return int(size * 1.1), int(walks * 1.2)
    return (int(size * 0.9), walks) if variance < 0.01 else (size, walks)
