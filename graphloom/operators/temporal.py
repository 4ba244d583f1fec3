"""Temporal graphs: edges with a time in epoch seconds (``timestamp``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check_number
from graphloom.lineage import cut

DAY = 86_400


def in_window(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Edges with start <= timestamp <= end."""
    return edges.where(F.col("timestamp").between(start, end))


def snapshot(edges: DataFrame, at: int, ttl: int | None = None) -> DataFrame:
    """Edges up to ``at``; they expire after ``ttl`` seconds if given."""
    out = edges.where(F.col("timestamp") <= at)
    return out if ttl is None else out.where(F.col("timestamp") > at - ttl)


def active_nodes(edges: DataFrame, at: int, lookback: int) -> DataFrame:
    return in_window(edges, at - lookback, at).select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def recent(edges: DataFrame, now: int, days: int) -> DataFrame:
    return in_window(edges, now - days * DAY, now)


def edges_per_bucket(edges: DataFrame, seconds: int) -> DataFrame:
    """(bucket, edges): counts by floor(timestamp / seconds) * seconds."""
    check_number("seconds", seconds, above=0)
    return edges.groupBy((F.floor(F.col("timestamp") / seconds) * seconds).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("edges"))


def most_active(edges: DataFrame, n: int) -> DataFrame:
    """(node_id, activity): the n vertices that most edges touch."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("activity")).orderBy(F.desc("activity"), "node_id").limit(n)


def temporal_centrality(edges: DataFrame, start: int, end: int) -> DataFrame:
    """(node_id, centrality): incident edges over all edges of the window."""
    window = in_window(edges, start, end)
    total = window.count()
    by = window.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("node_id", (F.col("n") / float(max(1, total))).alias("centrality"))


def temporal_paths(edges: DataFrame, source: str, target: str, start: int | None = None, end: int | None = None, max_hops: int = 10) -> DataFrame:
    """(nodes, timestamps, total_weight, hops): simple paths along which time does not go back."""
    check_number("max_hops", max_hops, low=1)
    e = edges if start is None and end is None else in_window(edges, -(1 << 62) if start is None else start, (1 << 62) if end is None else end)
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    e = cut(e.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("timestamp").alias("t"), weight.alias("w")), "temporal-edges")
    layer = e.where(F.col("u") == source).where("u != v").select(F.array("u", "v").alias("nodes"), F.array("t").alias("timestamps"), F.col("w").alias("total_weight"), F.lit(1).alias("hops"))
    found = None
    for hop in range(1, max_hops + 1):
        layer = cut(layer, "temporal")
        last = F.element_at("nodes", -1)
        here = layer.where(last == target)
        found = here if found is None else found.unionByName(here)
        if hop == max_hops or layer.isEmpty():
            break
        step = layer.where(last != target).join(e, (last == F.col("u")) & (F.col("t") >= F.element_at("timestamps", -1))).where(~F.array_contains("nodes", F.col("v")))
        layer = step.select(F.concat("nodes", F.array("v")).alias("nodes"), F.concat("timestamps", F.array("t")).alias("timestamps"), (F.col("total_weight") + F.col("w")).alias("total_weight"), F.lit(hop + 1).alias("hops"))
    return found


def fastest_path(edges: DataFrame, source: str, target: str, **window) -> DataFrame:
    """The temporal path of the shortest duration; ties go to fewer hops, then to the smaller vertices."""
    duration = F.element_at("timestamps", -1) - F.element_at("timestamps", 1)
    return temporal_paths(edges, source, target, **window).withColumn("duration", duration).orderBy("duration", "hops", "nodes").limit(1)


def evolution(edges: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """(at, nodes, edges, new_edges): the growing graph at each step.

    Each vertex counts from its first edge, so one pass of counts per step and a running sum replace a snapshot per step.
    """
    check_number("step", step, above=0)
    place = lambda t: F.greatest(F.lit(0), F.ceil((t - start) / step)).cast("long")
    new = edges.where(F.col("timestamp") <= end).groupBy(place(F.col("timestamp")).alias("i")).agg(F.count(F.lit(1)).alias("new_edges"))
    first = edges.where(F.col("timestamp") <= end).select("timestamp", F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.min("timestamp").alias("t"))
    born = first.groupBy(place(F.col("t")).alias("i")).agg(F.count(F.lit(1)).alias("born"))
    steps = edges.sparkSession.range((end - start) // step + 1).withColumnRenamed("id", "i")
    from pyspark.sql import Window

    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    joined = steps.join(new, "i", "left").join(born, "i", "left").na.fill(0, ["new_edges", "born"])
    return joined.select((F.col("i") * step + start).alias("at"), F.sum("born").over(upto).alias("nodes"), F.sum("new_edges").over(upto).alias("edges"), "new_edges")
