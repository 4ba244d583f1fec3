"""Communities by modularity: Louvain rounds and Leiden's refinement, with deterministic ties.

Degrees are out-degrees and m the number of edge rows. Moves of a round are decided together; to keep two vertices from
swapping for ever, a round lets only one half of the vertices move, by a hash that changes from round to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut
from graphloom.operators.components import dense_ids, weak_roots


def _both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, w): each edge seen from both ends."""
    return edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "w").unionByName(edges.where("source != target").select(F.col("target").alias("id"), F.col("source").alias("other"), "w"))


@settles
def modularity(graph: Graph, communities: DataFrame, resolution: float = 1.0) -> float:
    """Directed-edge modularity of (node_id, community): inner share less the expected one."""
    edges = graph.edges.select("source", "target")
    m = edges.count()
    if not m:
        return 0.0
    c = communities.select("node_id", "community")
    placed = edges.join(c.select(F.col("node_id").alias("source"), F.col("community").alias("cs")), "source").join(c.select(F.col("node_id").alias("target"), F.col("community").alias("ct")), "target")
    inner = placed.where("cs = ct").count() / m
    out = placed.groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("o"))
    into = placed.groupBy(F.col("ct").alias("c")).agg(F.count(F.lit(1)).alias("i"))
    expected = out.join(into, "c").agg(F.sum(F.col("o") * F.col("i"))).first()[0] or 0
    return inner - resolution * expected / m**2


@settles
def louvain(graph: Graph, resolution: float = 1.0, max_iterations: int = 10, refine: bool = False) -> DataFrame:
    """(node_id, community_id, community): dense number and smallest member.

    The gain of joining community c is k_in / m - resolution * k_i * K_c / (2 m^2); a vertex moves if the gain over staying is positive.
    ``refine`` splits each community into its connected parts between levels.
    """
    check_number("resolution", resolution, above=0)
    check_number("max_iterations", max_iterations, above=0)
    m = graph.edge_count()
    nodes = graph.node_ids()
    whole = cut(nodes.select(F.col("id").alias("node_id"), F.col("id").alias("community")), "louvain")
    edges = cut(graph.edges.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("w")), "louvain-edges")
    k = cut(nodes.join(edges.groupBy(F.col("source").alias("id")).agg(F.sum("w").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")), "louvain-k")
    for level in range(max_iterations if m else 0):
        at = _level(edges, k, m, resolution, max_iterations, level)
        if refine:
            joined = edges.join(at.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(at.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target")
            parts = weak_roots(joined.where("cs = ct").select(F.col("source").alias("a"), F.col("target").alias("b")))
            at = cut(at.join(parts, "id", "left").select("id", F.coalesce("root", "id").alias("c")), "louvain-parts")
        if at.where("id != c").isEmpty():
            break
        whole = cut(whole.join(at.select(F.col("id").alias("community"), "c"), "community").select("node_id", F.col("c").alias("community")), "louvain")
        to = lambda end: at.select(F.col("id").alias(end), F.col("c").alias(f"{end}_c"))
        edges = cut(edges.join(to("source"), "source").join(to("target"), "target").groupBy(F.col("source_c").alias("source"), F.col("target_c").alias("target")).agg(F.sum("w").alias("w")), "louvain-edges")
        k = cut(k.join(at, "id").groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")), "louvain-k")
    least = whole.groupBy("community").agg(F.min("node_id").alias("root"))
    named = cut(whole.join(least, "community").select("node_id", "root"), "louvain-named")
    return named.join(dense_ids(named), "root").select("node_id", F.col("number").alias("community_id"), F.col("root").alias("community"))


def _level(edges: DataFrame, k: DataFrame, m: int, resolution: float, rounds: int, level: int) -> DataFrame:
    """(id, c): where local moves leave the vertices of one level."""
    near = cut(_both_ways(edges).where("id != other"), "louvain-near")
    at = cut(k.select("id", "k", F.col("id").alias("c")), "louvain-at")
    still = 0
    for r in range(2 * rounds):
        total = at.groupBy("c").agg(F.sum("k").alias("total"))
        links = near.join(at.select(F.col("id").alias("other"), F.col("c").alias("to")), "other").groupBy("id", "to").agg(F.sum("w").alias("k_in"))
        own = at.select("id", F.col("c").alias("to"), F.lit(0.0).alias("k_in"))  # staying is always an option
        alone = at.select("id", F.concat("id", F.lit(f"\x1e{r}")).alias("to"), F.lit(0.0).alias("k_in"))  # so is leaving for a community of one's own
        options = links.unionByName(own).unionByName(alone).groupBy("id", "to").agg(F.sum("k_in").alias("k_in")).join(at, "id").join(total.withColumnRenamed("c", "to"), "to", "left")
        rest = F.coalesce("total", F.lit(0.0)) - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.col("k_in") / m - resolution * F.col("k") * rest / (2.0 * m * m)
        best = options.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", (F.col("to") == F.col("c")).alias("stay"), "to")).alias("best"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("now"))
        # in each two rounds every vertex has one turn; who moves with whom changes from pair to pair
        turn = F.pmod(F.xxhash64("id", F.lit(1000 * level + r // 2)) + r, F.lit(2)) == 0
        moved = turn & (F.col("best.gain") > F.col("now") + 1e-12)
        step = cut(at.join(best, "id").select("id", "k", F.when(moved, F.col("best.to")).otherwise(F.col("c")).alias("c"), moved.alias("moved")), "louvain-at")
        at = step.drop("moved")
        still = (still if r % 2 else 0) + step.where("moved").limit(1).isEmpty()
        if r % 2 and still == 2:
            break
    # names of communities that others have left must still be members' names
    least = at.groupBy("c").agg(F.min("id").alias("root"))
    return cut(at.join(least, "c").select("id", F.col("root").alias("c")), "louvain-level")


def leiden(graph: Graph, resolution: float = 1.0, max_iterations: int = 10) -> DataFrame:
    """As ``louvain``, with communities split into connected parts before each aggregation."""
    return louvain(graph, resolution, max_iterations, refine=True)
