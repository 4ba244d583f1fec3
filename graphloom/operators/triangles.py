"""Triangles and clustering over undirected, distinct edges.

Edges are directed from the vertex of smaller to the one of larger degree first, so no vertex, however many neighbours it has,
sends out more than the square root of twice the number of edges, and wedges stay few. Wedges are never rows: vertices have colours, and a task gets
the edges among three colours and closes their wedges itself, so each edge is shuffled once for each colour.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check
from graphloom.graph import Graph, settles
from graphloom.lineage import cut_counted

EDGES = 1 << 21  # that a task gets, about
WEDGES = 1 << 22  # that are in memory at once


def _closed(u: np.ndarray, v: np.ndarray, n: int, wedges: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, z), some at a time: each triangle of the directed edges once, at the vertex x that both its other vertices follow."""
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    keys = np.sort(np.minimum(u, v) * n + np.maximum(u, v))
    bits = max(10, int(len(keys)).bit_length() + 3)
    slot = lambda k: ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    known = np.zeros(1 << bits, bool)
    known[slot(keys)] = True
    place = np.arange(len(u))
    after = np.searchsorted(u, u, side="right") - place - 1  # edges of the same vertex behind each
    ends = np.cumsum(after)
    lo = 0
    while lo < len(u):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + wedges, side="right")))
        k = after[lo:hi]
        one = np.repeat(place[lo:hi], k)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(k) - k, k)
        y, z = v[one], v[two]
        key = np.minimum(y, z) * n + np.maximum(y, z)
        some = np.flatnonzero(known[slot(key)])
        key = key[some]
        some = some[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key]
        yield u[one[some]], y[some], z[some]
        lo = hi


def _by_colours(graph: Graph, result: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], pa.Array], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that ``result`` makes of the triangles, as places in an array of ids, of each task."""
    pairs, m = cut_counted(graph.undirected_pairs(), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    ends = [F.struct(F.col(f"d{c}").alias("d"), F.col(c).alias("id")) for c in "ab"]
    colours = max(1 if m < 1 << 14 else 3, math.ceil(math.sqrt(6 * m / EDGES)))
    tasks, wedges = math.comb(colours + 2, 3), WEDGES
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    out = ranked.select(F.least(*ends)["id"].alias("x"), F.greatest(*ends)["id"].alias("y")).withColumns({"cx": colour("x"), "cy": colour("y")})
    three = F.sort_array(F.array("cx", "cy", F.col("third")))
    out = out.withColumn("third", F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))).select(((three[0] * colours + three[1]) * colours + three[2]).alias("task"), "x", "y", "cx", "cy")

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        both = pa.chunked_array([*table.column("x").chunks, *table.column("y").chunks]).dictionary_encode().unify_dictionaries().combine_chunks()
        if isinstance(both, pa.ChunkedArray):
            both = both.chunk(0)
        ids, places = both.dictionary, both.indices.to_numpy().astype(np.int64)
        u, v = places[: table.num_rows], places[table.num_rows :]
        of = np.zeros(len(ids), np.int32)
        of[u], of[v] = table.column("cx").to_numpy(), table.column("cy").to_numpy()
        a, b, c = key[0].as_py() // colours**2, key[0].as_py() // colours % colours, key[0].as_py() % colours
        found = _closed(u, v, len(ids), wedges)
        if a != c and b in (a, c):  # triangles of one colour have a task of their own
            found = (tuple(p[k] for p in t) for t in found for k in [(of[t[0]] != of[t[1]]) | (of[t[0]] != of[t[2]])])
        yield from result(found, ids)

    return out.repartition(4 * tasks, "task").groupBy("task").applyInArrow(task, schema)


def triangles(graph: Graph) -> DataFrame:
    """(x, y, z): each triangle once."""

    def rows(found, ids):
        for t in found:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)) for p in t], names=["x", "y", "z"])

    return _by_colours(graph, rows, "x string, y string, z string")


def triangle_count(graph: Graph) -> DataFrame:
    """(metric, value) with the number of distinct triangles."""

    def rows(found, ids):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(x) for x, _, _ in found)], pa.int64())})

    return _by_colours(graph, rows, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).select(F.lit("triangle_count").alias("metric"), "value")


@settles
def triangles_per_node(graph: Graph) -> DataFrame:
    """(node_id, triangles) of every vertex."""

    def rows(found, ids):
        n = np.zeros(len(ids), np.int64)
        for t in found:
            for p in t:
                n += np.bincount(p, minlength=len(ids))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n[some])], names=["id", "t"])

    corners = _by_colours(graph, rows, "id string, t bigint").groupBy("id").agg(F.sum("t").alias("t"))
    return graph.node_ids().join(corners, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("t", F.lit(0)).alias("triangles"))


@settles
def clustering_coefficient(graph: Graph, mode: str = "local", degree: str = "undirected") -> DataFrame:
    """mode local: (node_id, clustering_coefficient), global: (metric, value).

    ``degree``: "undirected" counts distinct neighbours; "out" takes out-degrees, with which a value may exceed 1.
    """
    check(mode in ("local", "global", "average"), "mode must be local, global or average")
    check(degree in ("undirected", "out"), "degree must be undirected or out")
    if degree == "undirected":
        d = graph.undirected_pairs().select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("d"))
    else:
        d = graph.edges.groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    per = triangles_per_node(graph).join(d, "node_id", "left").select("node_id", "triangles", F.coalesce("d", F.lit(0)).alias("d"))
    wedges = F.col("d") * (F.col("d") - 1) / 2
    if mode == "global":
        value = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.sum("triangles"), F.sum(wedges))), F.lit(0.0))  # the sum over corners is 3 T
        return per.agg(value.alias("value")).select(F.lit("global_clustering_coefficient").alias("metric"), "value")
    local = per.select("node_id", F.when(F.col("d") >= 2, F.col("triangles") / wedges).otherwise(0.0).alias("clustering_coefficient"))
    if mode == "average":
        return local.agg(F.coalesce(F.avg("clustering_coefficient"), F.lit(0.0)).alias("value")).select(F.lit("average_clustering_coefficient").alias("metric"), "value")
    return local.orderBy(F.desc("clustering_coefficient"), "node_id")


def graph_density(graph: Graph) -> DataFrame:
    """(metric, value)."""
    return graph.spark.createDataFrame([("graph_density", graph.density())], "metric string, value double")
