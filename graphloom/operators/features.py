"""Vertex, edge and graph features for models; edges count in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, settles
from graphloom.lineage import cut
from graphloom.operators.centrality import betweenness_centrality, closeness_centrality, degrees, pagerank
from graphloom.operators.components import component_sizes, weakly_connected_components
from graphloom.operators.paths import multi_bfs
from graphloom.operators.triangles import clustering_coefficient, triangles_per_node


@settles
def node_features(graph: Graph, exact: bool = True) -> DataFrame:
    """One row per vertex: degree and PageRank features, clustering, triangles, and path features from breadth-first search.

    ``exact`` False takes the reference's cheap proxies of betweenness (degree over other vertices) and closeness (component share), named as such.
    """
    n = graph.node_count()
    base = degrees(graph).select("node_id", "in_degree", "out_degree", "degree", (F.col("degree") / float(max(1, n - 1))).alias("degree_centrality"))
    out = base.join(pagerank(graph).withColumnRenamed("pagerank_score", "pagerank"), "node_id")
    out = out.join(clustering_coefficient(graph), "node_id").join(triangles_per_node(graph), "node_id")
    if exact:
        out = out.join(betweenness_centrality(graph).withColumnRenamed("betweenness_centrality", "betweenness"), "node_id").join(closeness_centrality(graph).withColumnRenamed("closeness_centrality", "closeness"), "node_id")
        return out.join(path_features(graph), "node_id")
    out = out.join(path_features(graph), "node_id")
    c = cut(weakly_connected_components(graph), "feature-components")
    share = c.join(component_sizes(c), "component").select("node_id", (F.col("size") / float(max(1, n))).alias("closeness_proxy"))
    return out.withColumn("betweenness_proxy", F.col("degree") / float(max(1, n - 1))).join(share, "node_id")


@settles
def path_features(graph: Graph) -> DataFrame:
    """(node_id, eccentricity, mean_path, reached): over undirected hops, the vertex itself counted."""
    return multi_bfs(graph, graph.node_ids(), direction="both").groupBy(F.col("source").alias("node_id")).agg(F.max("depth").alias("eccentricity"), F.avg("depth").alias("mean_path"), F.count(F.lit(1)).alias("reached"))


@settles
def pair_features(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """(source, target, common_neighbors, jaccard, adamic_adar, preferential_attachment) of pairs, by default those that an edge joins.

    Common neighbours come from joining each pair's shorter side only: pairs x neighbours, never all wedges.
    """
    near = cut(graph.symmetric_edges(), "feature-near")
    size = cut(near.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("d")), "feature-sizes")
    multi = degrees(graph).select(F.col("node_id").alias("id"), "degree")
    p = graph.undirected_pairs().select(F.col("a").alias("source"), F.col("b").alias("target")) if pairs is None else pairs.select("source", "target").distinct()
    of = lambda end, what, name: what.select(F.col("id").alias(end), F.col(what.columns[1]).alias(name))
    p = cut(p.join(of("source", size, "ds"), "source", "left").join(of("target", size, "dt"), "target", "left").na.fill(0, ["ds", "dt"]), "feature-pairs")
    turned = p.select("source", "target", F.when(F.col("ds") <= F.col("dt"), F.col("source")).otherwise(F.col("target")).alias("x"), F.when(F.col("ds") <= F.col("dt"), F.col("target")).otherwise(F.col("source")).alias("y"))
    common = turned.join(near.select(F.col("source").alias("x"), F.col("target").alias("z")), "x").join(near.select(F.col("source").alias("y"), F.col("target").alias("z")), ["y", "z"])
    weight = F.when(F.col("degree") > 1, 1 / F.log("degree")).otherwise(0.0)
    both = common.join(multi.withColumnRenamed("id", "z"), "z").groupBy("source", "target").agg(F.count(F.lit(1)).alias("common"), F.sum(weight).alias("aa"))
    out = p.join(both, ["source", "target"], "left").na.fill(0, ["common", "aa"]).join(of("source", multi, "ms"), "source", "left").join(of("target", multi, "mt"), "target", "left")
    union = F.col("ds") + F.col("dt") - F.col("common")
    return out.select("source", "target", F.col("common").alias("common_neighbors"), F.coalesce(F.try_divide(F.col("common"), union), F.lit(0.0)).alias("jaccard"), F.col("aa").alias("adamic_adar"), (F.coalesce("ms", F.lit(0)) * F.coalesce("mt", F.lit(0))).alias("preferential_attachment"))


@settles
def graph_features(graph: Graph) -> DataFrame:
    """One row: counts, densities, clustering, components, degree moments, assortativity, diameter and radius of the undirected graph."""
    n, m = graph.node_count(), graph.edge_count()
    d = degrees(graph).agg(F.avg("degree"), F.var_pop("degree"), F.when(F.stddev_pop("degree") > 0, F.skewness("degree")), F.when(F.stddev_pop("degree") > 0, F.kurtosis("degree"))).first()
    deg = degrees(graph).select("node_id", "degree")
    ends = graph.edges.select("source", "target").unionByName(graph.edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    r = ends.join(deg.select(F.col("node_id").alias("source"), F.col("degree").alias("x")), "source").join(deg.select(F.col("node_id").alias("target"), F.col("degree").alias("y")), "target").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).first()[0]
    sizes = component_sizes(weakly_connected_components(graph)).agg(F.count(F.lit(1)), F.max("size")).first()
    e = path_features(graph).agg(F.max("eccentricity"), F.min("eccentricity"), F.avg("mean_path")).first()
    row = (
        n, m, m / (n * (n - 1)) if n > 1 else 0.0, 2 * m / (n * (n - 1)) if n > 1 else 0.0, clustering_coefficient(graph, "global").first()["value"], clustering_coefficient(graph, "average").first()["value"],
        sizes[0], sizes[1] or 0, *[float(x or 0) for x in d], float(r or 0), e[0] or 0, e[1] or 0, float(e[2] or 0),
    )
    names = "node_count long, edge_count long, density double, undirected_density double, global_clustering double, average_clustering double, component_count long, largest_component long, degree_mean double, degree_variance double, degree_skewness double, degree_kurtosis double, assortativity double, diameter int, radius int, average_path double"
    return graph.spark.createDataFrame([row], names)


@settles
def core_numbers(graph: Graph, max_core: int | None = None) -> DataFrame:
    """(node_id, core): the largest k for which the vertex is in the k-core of the undirected graph."""
    edges = cut(graph.symmetric_edges(), "core-edges")
    done = graph.node_ids().select(F.col("id").alias("node_id"), F.lit(0).alias("core"))
    k = 1
    while not edges.isEmpty() and (max_core is None or k <= max_core):
        while True:
            keep = edges.groupBy("source").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select("source")
            smaller = cut(edges.join(keep, "source", "left_semi").join(keep.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target"), "core-edges")
            if smaller.count() == edges.count():
                break
            edges = smaller
        inside = edges.select(F.col("source").alias("node_id")).distinct().withColumn("k", F.lit(k))
        done = cut(done.join(inside, "node_id", "left").select("node_id", F.coalesce("k", "core").alias("core")), "core")
        k += 1
    return done


def correlated(features: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """(a, b, correlation) of columns that correlate by more than ``least``; 0 where one does not vary."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    r = features.agg(*[F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias(f"{a}\x1f{b}") for a, b in pairs]).first()
    rows = [(*sorted(p), float(x)) for p, x in zip(pairs, r) if abs(x) > least]
    return features.sparkSession.createDataFrame(rows, "a string, b string, correlation double")
