"""Changes between batches of a stream. Metrics rows: one per batch, in the order of ``batch``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, settles
from graphloom.operators.centrality import degrees
from graphloom.operators.components import component_sizes, weakly_connected_components
from graphloom.operators.triangles import clustering_coefficient

#: Relative changes, and numbers of additions, beyond which a batch is anomalous.
DENSITY, DEGREE, CLUSTERING, COMPONENTS, EDGE_BURST, NODE_BURST = 0.10, 0.15, 0.20, 0.05, 10, 5
METRICS = "batch long, node_count long, edge_count long, density double, avg_degree double, clustering double, largest_component long, component_count long"


@settles
def graph_metrics(graph: Graph, batch: int) -> DataFrame:
    """One metrics row; average degree is 2m / n and clustering the global coefficient."""
    n, m = graph.node_count(), graph.edge_count()
    sizes = component_sizes(weakly_connected_components(graph)).agg(F.max("size"), F.count(F.lit(1))).first() if n else (0, 0)
    clustering = clustering_coefficient(graph, "global").first()["value"] if m else 0.0
    row = (batch, n, m, m / (n * (n - 1)) if n > 1 else 0.0, 2 * m / n if n else 0.0, clustering, sizes[0] or 0, sizes[1])
    return graph.spark.createDataFrame([row], METRICS)


def _relative(metric: str, threshold: float, up: str | None, down: str | None) -> Column:
    before = F.lag(metric).over(Window.orderBy("batch"))  # one row per batch
    change = F.coalesce(F.try_divide(F.col(metric) - before, F.abs(before)), F.lit(0.0))
    kind = F.when(change > threshold, F.lit(up)).when(change < -threshold, F.lit(down))
    ratio = F.abs(change) / threshold
    return F.when(kind.isNotNull(), F.struct(kind.alias("anomaly"), F.least(F.lit(1.0), ratio).alias("severity"), ratio.alias("ratio")))


def metric_anomalies(metrics: DataFrame) -> DataFrame:
    """(batch, anomaly, severity, ratio) against the batch before; the severity is at most 1, the ratio is not bounded."""
    found = [
        _relative("density", DENSITY, "density_spike", "density_drop"),
        _relative("avg_degree", DEGREE, "degree_burst", None),
        _relative("clustering", CLUSTERING, "clustering_rise", "clustering_fall"),
        _relative("component_count", COMPONENTS, "component_split", "component_merge"),
    ]
    return metrics.withColumn("a", F.array(*found)).select("batch", F.explode(F.array_compact("a")).alias("a")).select("batch", "a.*")


def burst_anomalies(results: DataFrame) -> DataFrame:
    """(batch, anomaly, severity, ratio) of (batch, vertices_added, edges_added)."""
    def burst(column: str, threshold: int, name: str) -> Column:
        ratio = F.col(column) / float(threshold)
        return F.when(F.col(column) > threshold, F.struct(F.lit(name).alias("anomaly"), F.least(F.lit(1.0), ratio).alias("severity"), ratio.alias("ratio")))

    a = F.array(burst("edges_added", EDGE_BURST, "edge_burst"), burst("vertices_added", NODE_BURST, "node_burst"))
    return results.withColumn("a", a).select("batch", F.explode(F.array_compact("a")).alias("a")).select("batch", "a.*")


def structural_anomalies(before: Graph, now: Graph, batch: int, hub: int = 100) -> DataFrame:
    """(batch, anomaly, node_id, before, now): vertices whose last edge went, and those whose degree came to ``hub`` or more.

    Degrees count both directions and parallel edges; a vertex that one of the graphs lacks has degree 0 there.
    """
    of = lambda g, name: degrees(g).select("node_id", F.col("degree").alias(name))
    both = of(before, "before").join(of(now, "now"), "node_id", "full").na.fill(0, ["before", "now"])
    kind = F.when((F.col("before") > 0) & (F.col("now") == 0), "isolated_node").when((F.col("now") >= hub) & (F.col("before") < hub), "hub_formation")
    return both.select(F.lit(batch).cast("long").alias("batch"), kind.alias("anomaly"), "node_id", "before", "now").where("anomaly IS NOT NULL")


def stability(before: DataFrame, now: DataFrame) -> DataFrame:
    """(stability): share of the vertices in both that kept their community (node_id, community); 1 if none is in both."""
    both = before.select("node_id", F.col("community").alias("c0")).join(now.select("node_id", F.col("community").alias("c1")), "node_id")
    return both.agg(F.coalesce(F.avg((F.col("c0") == F.col("c1")).cast("double")), F.lit(1.0)).alias("stability"))


def changed_nodes(before: DataFrame, now: DataFrame) -> DataFrame:
    both = before.select("node_id", F.col("community").alias("c0")).join(now.select("node_id", F.col("community").alias("c1")), "node_id")
    return both.where("c0 != c1").select("node_id", F.col("c0").alias("before"), F.col("c1").alias("now"))


def community_shift(before: DataFrame, now: DataFrame, batch: int, least: float = 0.8) -> DataFrame:
    s = stability(before, now).where(F.col("stability") < least)
    return s.select(F.lit(batch).cast("long").alias("batch"), F.lit("community_shift").alias("anomaly"), (1 - F.col("stability")).alias("severity"), (1 - F.col("stability")).alias("ratio"))


def classify_changes(anomalies: DataFrame) -> DataFrame:
    """(batch, change, magnitude): drift before topology before scale; the magnitude is the mean severity."""
    has = lambda *names: F.bool_or(F.col("anomaly").isin(*names))
    kind = F.when(has("community_shift"), "community_drift").when(has("component_merge", "component_split", "clustering_rise", "clustering_fall"), "topology").otherwise("scale")
    return anomalies.groupBy("batch").agg(kind.alias("change"), F.avg("severity").alias("magnitude"))


def anomalous_state(anomalies: DataFrame) -> bool:
    """Whether the last three severities add up to more than 2."""
    last = anomalies.orderBy(F.desc("batch"), F.desc("severity"), "anomaly").limit(3)
    return (last.agg(F.sum("severity")).first()[0] or 0.0) > 2.0
