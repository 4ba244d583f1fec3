"""Random walks. Every draw is a hash of (seed, walk, step), so retried tasks and other partitionings give the same walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut


def uniform(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that the parts and the seed determine."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / float(1 << 53)


def _starts(graph: Graph, start_nodes, num_walks: int) -> DataFrame:
    nodes = graph.node_ids() if start_nodes is None else graph.spark.createDataFrame([(n,) for n in start_nodes], "id string") if isinstance(start_nodes, (list, tuple)) else start_nodes.select("id")
    walks = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
    return walks.select(F.concat("id", F.lit("#"), F.col("k").cast("string")).alias("walk_id"), F.col("id").alias("node_id"), F.lit(0).alias("step"))


@settles
def random_walk(graph: Graph, walk_length: int = 10, num_walks: int = 10, seed: int = 0, start_nodes=None) -> DataFrame:
    """(walk_id, step, node_id): uniform over out-edges, parallel ones counted; a walk ends where there is none.

    Out-edges carry their number within the source, so a step is a join on (source, number) and no list of neighbours is held.
    """
    check_number("walk_length", walk_length, low=1)
    check_number("num_walks", num_walks, low=1)
    place = F.row_number().over(Window.partitionBy("source").orderBy("target", "weight")) - 1
    edges = cut(graph.edges.select("source", "target", place.alias("nth")), "walk-edges")
    sizes = cut(edges.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "walk-sizes")
    layers = [cut(_starts(graph, start_nodes, num_walks), "walk")]
    for step in range(1, walk_length):
        at = layers[-1].select("walk_id", F.col("node_id").alias("source")).join(sizes, "source")
        nth = F.floor(uniform("walk_id", F.lit(step), seed=seed) * F.col("size")).cast("int")
        layers.append(cut(at.withColumn("nth", nth).join(edges, ["source", "nth"]).select("walk_id", F.col("target").alias("node_id"), F.lit(step).alias("step")), "walk"))
    return reduce(DataFrame.unionByName, layers).select("walk_id", "step", "node_id")


@settles
def node2vec_walks(graph: Graph, walk_length: int = 80, num_walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 0, start_nodes=None) -> DataFrame:
    """(walk_id, step, node_id, p_param, q_param): second-order walks, weight times 1/p back, 1 to a neighbour of the previous vertex, else 1/q."""
    check_number("walk_length", walk_length, low=2)
    check_number("num_walks", num_walks, low=1)
    check_number("p", p, above=0)
    check_number("q", q, above=0)
    edges = cut(graph.edges.groupBy("source", "target").agg(F.sum("weight").alias("weight")), "n2v-edges")
    known = edges.select(F.col("source").alias("prev"), F.col("target").alias("next"), F.lit(True).alias("near"))
    layers = [cut(_starts(graph, start_nodes, num_walks).withColumn("prev", F.lit(None).cast("string")), "n2v")]
    for step in range(1, walk_length):
        options = layers[-1].select("walk_id", "prev", F.col("node_id").alias("source")).join(edges, "source").withColumnRenamed("target", "next").join(known, ["prev", "next"], "left")
        bias = F.when(F.col("prev").isNull(), 1.0).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        # the smallest exponential draw wins with probability proportional to its weight: an aggregation, no sort of candidates
        draw = -F.log(uniform("walk_id", F.lit(step), "next", seed=seed)) / (F.col("weight") * bias)
        chosen = options.where(F.col("weight") > 0).groupBy("walk_id").agg(F.min(F.struct(draw.alias("draw"), "next", "source")).alias("c"))
        layer = cut(chosen.select("walk_id", F.col("c.next").alias("node_id"), F.lit(step).alias("step"), F.col("c.source").alias("prev")), "n2v")
        if layer.isEmpty():
            break
        layers.append(layer)
    return reduce(DataFrame.unionByName, layers).select("walk_id", "step", "node_id", F.lit(float(p)).alias("p_param"), F.lit(float(q)).alias("q_param"))


@settles
def transition_probabilities(graph: Graph, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """(prev, source, next, probability) of second-order walks over symmetric edges."""
    near = cut(graph.symmetric_edges(), "n2v-near")
    steps = near.select(F.col("source").alias("prev"), F.col("target").alias("source")).join(near.withColumnRenamed("target", "next"), "source")
    steps = steps.join(near.select(F.col("source").alias("prev"), F.col("target").alias("next"), F.lit(True).alias("near")), ["prev", "next"], "left")
    bias = F.when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
    total = F.sum("bias").over(Window.partitionBy("prev", "source"))
    return steps.withColumn("bias", bias).select("prev", "source", "next", (F.col("bias") / total).alias("probability"))
