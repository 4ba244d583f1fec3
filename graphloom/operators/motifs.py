"""Motifs (connected induced subgraphs of a few vertices) and matching of a small query graph."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check, check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut
from graphloom.operators.triangles import triangles


@settles
def motifs(graph: Graph, max_size: int = 3) -> DataFrame:
    """(nodes, nv, ne, degrees, kind flags): each connected vertex set of 2 to ``max_size`` vertices, once.

    Sets grow by one neighbour a round and are told apart by their sorted members.
    """
    check_number("max_size", max_size, low=2)
    near = cut(graph.symmetric_edges(), "motif-edges")
    sets = cut(graph.undirected_pairs().select(F.array("a", "b").alias("nodes")), "motif-sets")
    every = [sets]
    for _ in range(3, max_size + 1):
        grown = sets.select("nodes", F.explode("nodes").alias("source")).join(near, "source").where(~F.array_contains("nodes", F.col("target")))
        sets = cut(grown.select(F.sort_array(F.array_append("nodes", F.col("target"))).alias("nodes")).distinct(), "motif-sets")
        every.append(sets)
    whole = reduce(DataFrame.unionByName, every)
    inside = whole.select("nodes", F.explode("nodes").alias("source")).join(near, "source").where(F.array_contains("nodes", F.col("target")))
    per = inside.groupBy("nodes", "source").agg(F.count(F.lit(1)).alias("d")).groupBy("nodes").agg(F.sort_array(F.collect_list("d")).alias("degrees"))
    return classify(per.select("nodes", F.size("nodes").alias("nv"), (F.aggregate("degrees", F.lit(0).cast("bigint"), lambda a, x: a + x) / 2).cast("int").alias("ne"), "degrees"))


def classify(sets: DataFrame) -> DataFrame:
    """Adds the shapes to (nv, ne, degrees) of connected subgraphs."""
    ones = F.size(F.filter("degrees", lambda d: d == 1))
    twos = F.size(F.filter("degrees", lambda d: d == 2))
    return sets.withColumns({
        "is_tree": F.col("ne") == F.col("nv") - 1,
        "is_cycle": F.col("ne") == F.col("nv"),
        "is_clique": F.col("ne") * 2 == F.col("nv") * (F.col("nv") - 1),
        "is_star": (F.col("nv") >= 3) & (F.array_max("degrees") == F.col("nv") - 1),
        "is_path": (ones == 2) & (twos == F.col("nv") - 2),
    })


@settles
def motif_counts(graph: Graph, max_size: int = 3, min_support: float = 0.0, predicate: Column | None = None) -> DataFrame:
    """(nv, ne, degrees, occurrences, support) by falling support; a class is size, edges and degree sequence."""
    m = motifs(graph, max_size)
    m = m if predicate is None else m.where(predicate)
    by = cut(m.groupBy("nv", "ne", "degrees").agg(F.count(F.lit(1)).alias("occurrences")), "motif-counts")
    total = by.agg(F.sum("occurrences")).first()[0] or 1
    out = by.withColumn("support", F.col("occurrences") / float(total)).where(F.col("support") >= min_support)
    return out.orderBy(F.desc("support"), "nv", "ne", "degrees")


def common_motifs(graphs: list[Graph], max_size: int = 3, min_support: float = 0.0) -> DataFrame:
    """Motif classes that every graph holds, with their number in all."""
    counted = reduce(DataFrame.unionByName, [motif_counts(g, max_size).withColumn("g", F.lit(i)) for i, g in enumerate(graphs)])
    by = counted.groupBy("nv", "ne", "degrees").agg(F.sum("occurrences").alias("occurrences"), F.count_distinct("g").alias("graphs")).where(F.col("graphs") == len(graphs))
    total = by.agg(F.sum("occurrences")).first()[0] or 1
    return by.withColumn("support", F.col("occurrences") / float(total)).where(F.col("support") >= min_support).orderBy(F.desc("support"), "nv", "ne", "degrees")


def subgraph_match(graph: Graph, query_edges: list[tuple[str, str]], directed: bool = False, induced: bool = False) -> DataFrame:
    """One row per mapping of the query's vertices (a column each) to different vertices; edges match in either direction unless ``directed``."""
    check(bool(query_edges), "the query needs an edge")
    names = sorted({v for e in query_edges for v in e})
    if not directed and len(query_edges) == len(names) == len({frozenset(e) for e in query_edges if e[0] != e[1]}) == 3:
        # a triangle: each is found once and mapped in its six ways, with no row for a wedge
        ways = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(way, names)]) for way in permutations("xyz")])
        return triangles(graph).select(F.explode(ways).alias("way")).select("way.*")
    near = graph.edges.where("source != target").select("source", "target").distinct() if directed else graph.symmetric_edges()
    near = cut(near, "match-edges")
    left, bound, out = list(query_edges), set(), None
    while left:
        a, b = next((e for e in left if bound & {*e}), left[0])
        left.remove((a, b))
        e = near.select(F.col("source").alias(a), F.col("target").alias(b))
        shared = [v for v in (a, b) if v in bound]
        check(out is None or bool(shared), "the query must be connected")
        out = e if out is None else out.join(e, shared)
        for new in [v for v in (a, b) if v not in bound]:
            for v in bound | ({a} if new == b else set()):
                if v != new:
                    out = out.where(F.col(v) != F.col(new))
        bound |= {a, b}
    if induced:
        have = {frozenset(e) for e in query_edges}
        for i, a in enumerate(names):
            for b in names[:i]:
                if frozenset((a, b)) not in have:
                    out = out.join(near.select(F.col("source").alias(a), F.col("target").alias(b)), [a, b], "left_anti")
    return out.select(*names)
