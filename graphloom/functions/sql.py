"""Graph functions for SQL.

Table functions take ``TABLE(edges) PARTITION BY graph``: each partition is one small graph, held by one task. For graphs
that no task can hold, ``register_results`` registers the distributed operators' results as views.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from graphloom.graph import Graph


class _Edges:
    """Collects the rows of a partition: columns source, target and optionally weight and graph."""

    def __init__(self):
        self.near: dict[str, list[tuple[str, float]]] = defaultdict(list)
        self.nodes: dict[str, None] = {}
        self.part = None

    def take(self, row: Row) -> None:
        names = row.__fields__
        w = row["weight"] if "weight" in names and row["weight"] is not None else 1.0
        self.near[row["source"]].append((row["target"], float(w)))
        self.nodes[row["source"]] = self.nodes[row["target"]] = None
        self.part = str(row["graph"]) if "graph" in names else None


@udtf(returnType="graph string, source string, target string, distance double, path array<string>")
class ShortestPath:
    def __init__(self):
        self.e, self.ends = _Edges(), None

    def eval(self, row: Row, source: str, target: str):
        self.e.take(row)
        self.ends = (source, target)

    def terminate(self):
        if self.ends is None:
            return
        source, target = self.ends
        queue, done = [(0.0, [source])], set()
        while queue:
            d, path = heapq.heappop(queue)
            if path[-1] in done:
                continue
            done.add(path[-1])
            if path[-1] == target:
                yield self.e.part, source, target, d, path
                return
            for v, w in self.e.near.get(path[-1], ()):
                if v not in done:
                    heapq.heappush(queue, (d + w, [*path, v]))


@udtf(returnType="graph string, node_id string, pagerank_score double")
class PageRank:
    def __init__(self):
        self.e = _Edges()

    def eval(self, row: Row):
        self.e.take(row)

    def terminate(self):
        nodes = list(self.e.nodes)
        n = len(nodes)
        score = dict.fromkeys(nodes, 1 / n) if n else {}
        for _ in range(100):
            new = dict.fromkeys(nodes, 0.15 / n)
            sunk = 0.0
            for u in nodes:
                out = self.e.near.get(u)
                if not out:
                    sunk += score[u]
                for v, _ in out or ():
                    new[v] += 0.85 * score[u] / len(out)
            for u in nodes:
                new[u] += 0.85 * sunk / n
            change = sum(abs(new[u] - score[u]) for u in nodes)
            score = new
            if change < 1e-6:
                break
        for u in nodes:
            yield self.e.part, u, score[u]


@udtf(returnType="graph string, nodes bigint, edges bigint, density double")
class GraphDensity:
    def __init__(self):
        self.e, self.m = _Edges(), 0

    def eval(self, row: Row):
        self.e.take(row)
        self.m += 1

    def terminate(self):
        n = len(self.e.nodes)
        if self.m:
            yield self.e.part, n, self.m, self.m / (n * (n - 1)) if n > 1 else 0.0


def register(spark: SparkSession) -> None:
    """graph_shortest_path, graph_pagerank and graph_density as table functions."""
    for name, f in (("graph_shortest_path", ShortestPath), ("graph_pagerank", PageRank), ("graph_density", GraphDensity)):
        spark.udtf.register(name, f)


def register_results(graph: Graph, prefix: str = "graph") -> list[str]:
    """Views of distributed results: <prefix>_vertices, _edges, _pagerank, _components, _communities, _degrees, _triangles, _clustering."""
    from graphloom.operators import centrality, communities, components, triangles

    views = {
        "vertices": lambda: graph.vertices, "edges": lambda: graph.edges, "pagerank": lambda: centrality.pagerank(graph), "components": lambda: components.weakly_connected_components(graph),
        "communities": lambda: communities.louvain(graph), "degrees": lambda: centrality.degrees(graph), "triangles": lambda: triangles.triangles_per_node(graph), "clustering": lambda: triangles.clustering_coefficient(graph),
    }
    for name, make in views.items():
        make().createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{n}" for n in views]
