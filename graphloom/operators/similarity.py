"""Graph kernels and vector similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut, cut_counted
from graphloom.operators.components import weak_roots
from graphloom.operators.motifs import motif_counts
from graphloom.operators.paths import multi_bfs
from graphloom.operators.walks import random_walk


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def most_similar(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarity): the k vectors nearest to one."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector_col), q).alias("similarity")).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_neighbours(vectors: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", blocks: int = 16) -> DataFrame:
    """(id, neighbour, similarity, rank): exact k nearest by cosine.

    Vectors are normalised once and dealt to blocks; each two blocks meet in one task as matrices, which keeps only its k best per row.
    """
    check_number("k", k, low=1)
    import pandas as pd

    norm = F.sqrt(dot(vector_col, vector_col))
    v = cut(vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double") / norm).alias("v")).where(norm > 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "knn")
    left = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = v.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_type = vectors.schema[id_col].dataType.simpleString()

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": a.id[:0], "neighbour": a.id[:0], "similarity": np.zeros(0)})
        x, y = np.array(a.v.tolist()), np.array(b.v.tolist())
        ids, others, out = a.id.to_numpy(), b.id.to_numpy(), []
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ y.T
            s[ids[i : i + 1024, None] == others[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            rows = np.repeat(np.arange(len(s)), top.shape[1])
            out.append(pd.DataFrame({"id": ids[i : i + 1024][rows], "neighbour": others[top.ravel()], "similarity": s[rows, top.ravel()]}))
        got = pd.concat(out)
        return got[np.isfinite(got.similarity)]

    met = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(best, f"id {id_type}, neighbour {id_type}, similarity double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


@settles
def weisfeiler_lehman(graph: Graph, rounds: int = 3, labels: DataFrame | None = None) -> DataFrame:
    """(round, label, n): histogram of labels that rounds of (label, sorted neighbour labels) give."""
    check_number("rounds", rounds, low=0)
    near = cut(graph.symmetric_edges(), "wl-edges")
    now = labels.select("id", F.xxhash64("label").alias("label")) if labels is not None else graph.node_ids().withColumn("label", F.xxhash64(F.lit("")))
    now = cut(now, "wl")
    out = now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("round"), "label", "n")
    for r in range(1, rounds + 1):
        # a sum and a xor-like mix of neighbour hashes stand for the sorted list: no list per vertex
        seen = near.join(now.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.sum(F.pmod(F.xxhash64("label", F.lit(1)), F.lit(1 << 40))).alias("s1"), F.sum(F.pmod(F.xxhash64("label", F.lit(2)), F.lit(1 << 40))).alias("s2"), F.count(F.lit(1)).alias("d"))
        now = cut(now.join(seen, "id", "left").select("id", F.xxhash64("label", F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0)), F.coalesce("d", F.lit(0))).alias("label")), "wl")
        out = out.unionByName(now.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("round"), "label", "n"))
    return out


def _overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> float:
    """Sum of the smaller counts over the geometric mean of the totals."""
    both = a.join(b.withColumnRenamed("n", "m"), keys).agg(F.sum(F.least("n", "m"))).first()[0] or 0
    ta, tb = (x.agg(F.sum("n")).first()[0] or 0 for x in (a, b))
    return float(both) / (ta * tb) ** 0.5 if ta and tb else 0.0


def wl_kernel(a: Graph, b: Graph, rounds: int = 3) -> float:
    return _overlap(weisfeiler_lehman(a, rounds), weisfeiler_lehman(b, rounds), ["round", "label"])


def graphlet_kernel(a: Graph, b: Graph, size: int = 3) -> float:
    of = lambda g: motif_counts(g, size).select("nv", "ne", "degrees", F.col("occurrences").alias("n"))
    return _overlap(of(a), of(b), ["nv", "ne", "degrees"])


def _lengths(a: pa.Array, b: pa.Array, longest: int) -> np.ndarray:
    """Numbers of ordered pairs at each distance from 0 to ``longest`` in the undirected graph of the distinct edges (a, b)."""
    both = pa.chunked_array([a, b]).dictionary_encode().unify_dictionaries()
    u, v = (both.chunk(i).indices.to_numpy().astype(np.int64) for i in (0, 1))
    n = len(both.chunk(0).dictionary)
    start, end = np.concatenate([u, v]), np.concatenate([v, u])
    end = end[np.argsort(start, kind="stable")]
    size = np.bincount(start, minlength=n)
    begin = np.cumsum(size) - size
    out = np.zeros(longest + 1, np.int64)
    front, behind = np.arange(n) * (n + 1), np.empty(0, np.int64)  # pairs as source * n + vertex
    for depth in range(1, longest + 1):
        k = size[front % n]
        edge = np.arange(k.sum()) + np.repeat(begin[front % n] - (np.cumsum(k) - k), k)
        step = np.unique(np.repeat(front - front % n, k) + end[edge])
        for old in (front, behind):  # a step from a layer leads to it, the one before or the one after
            if len(old) and len(step):
                step = step[old[np.minimum(np.searchsorted(old, step), len(old) - 1)] != step]
        if not len(step):
            break
        out[depth] = len(step)
        front, behind = step, front
    return out


def _small_lengths(edges: DataFrame, longest: int, most: int) -> DataFrame:
    """(length, n): pairs within the components of edges (root, a, b), which lie in one partition each, one after the other; about ``most`` pairs at once."""

    def run(batches):
        out, kept = np.zeros(longest + 1, np.int64), None
        for batch in _with_end(batches):
            table = kept if batch is None else pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            root = table.column("root").chunk(0).dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(root, prepend=-1))
            bounds = np.append(first, len(root))
            whole = len(first) if batch is None else len(first) - 1  # the last component may go on
            cost = np.cumsum((np.diff(bounds).astype(np.float64)[:whole] + 1) ** 2)
            lo = 0
            while lo < whole:
                hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + most, side="right")))
                part = table.slice(bounds[lo], bounds[hi] - bounds[lo])
                out += _lengths(part.column("a").combine_chunks(), part.column("b").combine_chunks(), longest)
                lo = hi
            kept = table.slice(bounds[whole])
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some], pa.int64())], names=["length", "n"])

    return edges.mapInArrow(run, "length int, n bigint")


def _with_end(batches):
    yield from batches
    yield None


SMALL = 2048  # edges of a component whose pairs one task counts
PAIRS = 1 << 22  # that a task holds at once, about
EDGES = 1 << 19  # of a task


def path_length_histogram(graph: Graph, longest: int = 10) -> DataFrame:
    """(length, n): ordered pairs by undirected distance, from 1 to ``longest``.

    Small components are dealt to tasks whole, which count their pairs; only those of large components become rows.
    """
    pairs, m = cut_counted(graph.undirected_pairs(), "lengths-pairs")
    placed = cut(pairs.join(weak_roots(pairs).withColumnRenamed("id", "a"), "a").select("root", "a", "b"), "lengths-edges")
    large = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("root"), "lengths-large")
    found, rest = None, placed
    if not large.isEmpty():
        wide = Graph.from_edges(placed.join(large, "root", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("target")))
        found = multi_bfs(wide, wide.node_ids(), longest, "both").where("depth > 0").groupBy(F.col("depth").alias("length")).agg(F.count(F.lit(1)).alias("n"))
        rest = placed.join(large, "root", "left_anti")
    small = _small_lengths(rest.repartition(max(1, min(-(-m // (1 << 12)), int(graph.spark.conf.get("spark.sql.shuffle.partitions"))), -(-m // EDGES)), "root").sortWithinPartitions("root"), longest, PAIRS)
    found = small if found is None else small.unionByName(found)
    return found.groupBy("length").agg(F.sum("n").alias("n"))


def shortest_path_kernel(a: Graph, b: Graph, sd: float = 0.1, longest: int = 10) -> float:
    """Mean over lengths of a Gaussian of the difference of their shares."""
    def shares(g: Graph) -> DataFrame:
        h = cut(path_length_histogram(g, longest), "path-lengths")
        total = h.agg(F.sum("n")).first()[0] or 1
        return h.select("length", (F.col("n") / float(total)).alias("p"))

    lengths = a.spark.range(1, longest + 1).select(F.col("id").cast("int").alias("length"))
    met = lengths.join(shares(a), "length", "left").join(shares(b).withColumnRenamed("p", "q"), "length", "left").na.fill(0.0)
    return met.agg(F.avg(F.exp(-F.pow(F.col("p") - F.col("q"), 2) / (2 * sd * sd)))).first()[0]


def random_walk_kernel(a: Graph, b: Graph, length: int = 5, walks: int = 10, seed: int = 0) -> float:
    """How often walks of the two graphs are at the same vertex at the same step: agreeing (walk, walk, step) over all."""
    of = lambda g: random_walk(g, length, walks, seed).groupBy("step", "node_id").agg(F.count(F.lit(1)).alias("n"))
    x, y = cut(of(a), "kernel-walk"), cut(of(b), "kernel-walk")
    same = x.join(y.withColumnRenamed("n", "m"), ["step", "node_id"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    na, nb = (t.where("step = 0").agg(F.sum("n")).first()[0] or 0 for t in (x, y))
    return same / (na * nb * length) if na and nb else 0.0


def neighbourhood_kernel(a: Graph, b: Graph, hops: int = 1) -> float:
    """Mean Jaccard similarity, over all pairs of vertices, of their ``hops``-neighbourhoods. Pairs without a shared member count as 0 and are never made."""
    of = lambda g: multi_bfs(g, g.node_ids(), hops, "both").where("depth > 0").select("source", "id")
    x, y = cut(of(a), "kernel-near"), cut(of(b), "kernel-near")
    nx = x.groupBy(F.col("source").alias("u")).agg(F.count(F.lit(1)).alias("nx"))
    ny = y.groupBy(F.col("source").alias("v")).agg(F.count(F.lit(1)).alias("ny"))
    met = x.select(F.col("source").alias("u"), "id").join(y.select(F.col("source").alias("v"), "id"), "id").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    total = met.join(nx, "u").join(ny, "v").agg(F.sum(F.col("c") / (F.col("nx") + F.col("ny") - F.col("c")))).first()[0] or 0.0
    pairs = a.node_count() * b.node_count()
    return total / pairs if pairs else 0.0
