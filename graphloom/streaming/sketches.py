"""Sketches: distinct counts (HyperLogLog), frequencies (count-min) and membership (Bloom), all mergeable.

A count-min sketch and a Bloom filter are small tables of counters and words here, built by aggregation; merging is
a union and another aggregation. New rows alone are added, so nothing counts twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check_number


def distinct_sketch(rows: DataFrame, column: str | Column, precision: int = 12) -> DataFrame:
    """(sketch): HyperLogLog of the column, with 2^precision registers."""
    check_number("precision", precision, 4, 21)
    return rows.agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def merge_distinct(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_union_agg("sketch", True).alias("sketch"))


def estimate_distinct(sketches: DataFrame) -> DataFrame:
    return sketches.select(F.hll_sketch_estimate("sketch").alias("estimate"))


class CountMin:
    """``table``: (depth, slot, n). Estimates never fall short of the truth."""

    def __init__(self, table: DataFrame, width: int = 1000, depth: int = 5):
        self.table, self.width, self.depth = table, width, depth

    @classmethod
    def of(cls, rows: DataFrame, key: str | Column, weight: Column | float = 1, width: int = 1000, depth: int = 5) -> CountMin:
        check_number("width", width, low=1)
        check_number("depth", depth, low=1)
        k = F.col(key) if isinstance(key, str) else key
        w = weight if isinstance(weight, Column) else F.lit(weight)
        slots = rows.select(k.cast("string").alias("k"), w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("depth"))
        return cls(slots.groupBy("depth", F.pmod(F.xxhash64("k", "depth"), F.lit(width)).alias("slot")).agg(F.sum("w").alias("n")), width, depth)

    def merge(self, other: CountMin) -> CountMin:
        if (self.width, self.depth) != (other.width, other.depth):
            raise ValueError("sketches differ in size")
        return CountMin(self.table.unionByName(other.table).groupBy("depth", "slot").agg(F.sum("n").alias("n")), self.width, self.depth)

    def estimate(self, keys: DataFrame, column: str) -> DataFrame:
        """Adds ``estimate`` to distinct keys."""
        q = keys.select(column).distinct().select(column, F.explode(F.sequence(F.lit(0), F.lit(self.depth - 1))).alias("depth"))
        q = q.withColumn("slot", F.pmod(F.xxhash64(F.col(column).cast("string"), F.col("depth")), F.lit(self.width)))
        return q.join(self.table, ["depth", "slot"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


class Bloom:
    """``table``: (word, bits), 64 bits a word."""

    def __init__(self, table: DataFrame, bits: int, hashes: int):
        self.table, self.bits, self.hashes = table, bits, hashes

    @classmethod
    def of(cls, rows: DataFrame, column: str, expected: int = 10_000, fpp: float = 0.01) -> Bloom:
        check_number("expected", expected, low=1)
        check_number("fpp", fpp, above=0, high=0.999)
        bits = max(64, math.ceil(-expected * math.log(fpp) / math.log(2) ** 2 / 64) * 64)
        hashes = max(1, round(bits / expected * math.log(2)))
        at = cls(rows, bits, hashes)._places(rows.select(column), column)
        return cls(at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), bits, hashes)

    def _places(self, rows: DataFrame, column: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.col(column).cast("string"), F.col("h")), F.lit(self.bits))
        return rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(self.hashes - 1)))).withColumn("p", place).select(column, F.floor(F.col("p") / 64).alias("word"), (F.col("p") % 64).cast("int").alias("bit"))

    def contains(self, keys: DataFrame, column: str) -> DataFrame:
        """Adds ``maybe`` to distinct keys; false is certain."""
        q = self._places(keys.select(column).distinct(), column).join(self.table, "word", "left")
        return q.groupBy(column).agg(F.bool_and(F.expr("shiftrightunsigned(coalesce(bits, 0L), bit) & 1") == 1).alias("maybe"))

    def union(self, other: Bloom) -> Bloom:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters differ in size")
        return Bloom(self.table.unionByName(other.table).groupBy("word").agg(F.bit_or("bits").alias("bits")), self.bits, self.hashes)

    def false_positive_rate(self) -> float:
        """Share of set bits to the number of hashes."""
        n = self.table.agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        return (n / self.bits) ** self.hashes


def graph_sketches(edges: DataFrame, precision: int = 12) -> DataFrame:
    """(nodes, edges): sketches of distinct vertices and edges of a batch, to be stored and merged."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    pairs = edges.select(F.concat_ws("\x1f", "source", "target").alias("e"))
    a = ends.agg(F.hll_sketch_agg("id", precision).alias("nodes")).withColumn("one", F.lit(1))
    return a.join(pairs.agg(F.hll_sketch_agg("e", precision).alias("edges")).withColumn("one", F.lit(1)), "one").drop("one")


def merge_graph_sketches(sketches: DataFrame) -> DataFrame:
    """(nodes, edges): estimates over all stored batches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("nodes", True)).alias("nodes"), F.hll_sketch_estimate(F.hll_union_agg("edges", True)).alias("edges"))


def triangle_sketch(triangles: DataFrame, a: str = "a", b: str = "b", c: str = "c", precision: int = 12) -> DataFrame:
    """(sketch): HyperLogLog of triangles, each the same whatever the order of its vertices; merge with ``merge_distinct``."""
    return distinct_sketch(triangles, F.array_join(F.array_sort(F.array(a, b, c)), "\x1f"), precision)


def degree_estimates(edges: DataFrame, nodes: DataFrame, width: int = 1000, depth: int = 5) -> DataFrame:
    """(id, estimate) of degrees by a count-min sketch."""
    return CountMin.of(edges.select(F.explode(F.array("source", "target")).alias("id")), "id", width=width, depth=depth).estimate(nodes, "id")
