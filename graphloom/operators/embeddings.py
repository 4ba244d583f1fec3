"""Node embeddings and layers over a graph. Vectors are (id, features ARRAY<DOUBLE>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import Unsupported, check, check_number
from graphloom.graph import Graph, settles
from graphloom.lineage import cut
from graphloom.operators.walks import node2vec_walks, uniform


@settles
def node2vec(graph: Graph, dimension: int = 64, walk_length: int = 20, num_walks: int = 10, p: float = 1.0, q: float = 1.0, window: int = 5, iterations: int = 1, seed: int = 0) -> DataFrame:
    """(id, embedding): skip-gram over second-order walks."""
    walks = node2vec_walks(graph, walk_length, num_walks, p, q, seed)
    sentences = walks.groupBy("walk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"]).alias("nodes"))
    model = Word2Vec(vectorSize=dimension, minCount=0, windowSize=window, maxIter=iterations, seed=seed, inputCol="nodes", outputCol="v").fit(cut(sentences, "n2v-sentences"))
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("embedding"))


def random_features(graph: Graph, dimension: int, seed: int = 0) -> DataFrame:
    """(id, features): hashed numbers in [-0.05, 0.05), the degree first."""
    d = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    rest = [uniform("id", F.lit(i), seed=seed) * 0.1 - 0.05 for i in range(1, dimension)]
    return graph.node_ids().join(d, "id", "left").select("id", F.array(F.coalesce("d", F.lit(0)).cast("double"), *rest).alias("features"))


def aggregate(graph: Graph, features: DataFrame, how: str = "mean") -> DataFrame:
    """(id, features): mean or max of the neighbours' features in either direction, by dimension."""
    if how in ("lstm", "gcn"):
        raise Unsupported(f"the {how} aggregator has no defined result")
    check(how in ("mean", "max"), "how must be mean or max")
    near = graph.symmetric_edges()
    rows = near.join(features.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), F.posexplode("features").alias("i", "x"))
    by = rows.groupBy("id", "i").agg((F.avg if how == "mean" else F.max)("x").alias("x"))
    return by.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("features"))


def _dense(rows: DataFrame, column: str, weights: np.ndarray, bias: np.ndarray, activation: str) -> DataFrame:
    """Applies x W + b and the activation to arrays, a batch of rows at a time."""
    check(activation in ("relu", "leaky_relu", "tanh", "sigmoid", "identity"), f"unknown activation {activation}")

    @F.pandas_udf("array<double>")
    def layer(x: pd.Series) -> pd.Series:
        y = np.array(x.tolist(), float).reshape(len(x), -1) @ weights + bias
        if activation == "relu":
            y = np.maximum(y, 0)
        elif activation == "leaky_relu":
            y = np.where(y > 0, y, 0.01 * y)
        elif activation == "tanh":
            y = np.tanh(y)
        elif activation == "sigmoid":
            y = 1 / (1 + np.exp(-y))
        return pd.Series(list(y))

    return rows.withColumn(column, layer(F.col(column)))


@settles
def graph_sage(graph: Graph, features: DataFrame, weights: list[np.ndarray], how: str = "mean", activation: str = "relu") -> DataFrame:
    """(id, features) after one layer per weight matrix over [own, aggregated neighbours]; each is L2-normalised."""
    for w in weights:
        k = w.shape[0] // 2
        zero = F.array_repeat(F.lit(0.0), k)
        joined = features.join(aggregate(graph, features, how).withColumnRenamed("features", "near"), "id", "left").select("id", F.concat("features", F.coalesce("near", zero)).alias("features"))
        out = _dense(joined, "features", np.asarray(w, float), np.zeros(w.shape[1]), activation)
        norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
        features = cut(out.select("id", F.when(norm > 0, F.transform("features", lambda x: x / norm)).otherwise(F.col("features")).alias("features")), "sage")
    return features


def normalised_adjacency(graph: Graph, self_loops: bool = False) -> DataFrame:
    """(source, target, weight): D^-1/2 A D^-1/2 of the symmetric graph."""
    near = graph.symmetric_edges()
    if self_loops:
        near = near.unionByName(graph.node_ids().select(F.col("id").alias("source"), F.col("id").alias("target")))
    near = cut(near, "gcn-edges")
    d = near.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    of = lambda end, name: d.select(F.col("id").alias(end), F.col("d").alias(name))
    return near.join(of("source", "ds"), "source").join(of("target", "dt"), "target").select("source", "target", (1 / F.sqrt(F.col("ds") * F.col("dt"))).alias("weight"))


@settles
def gcn_forward(graph: Graph, features: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None, activation: str = "relu", dropout: float = 0.0, seed: int = 0, self_loops: bool = False) -> DataFrame:
    """(id, features): activation(D^-1/2 A D^-1/2 X W + b); inverted dropout by hash on the input."""
    check_number("dropout", dropout, 0, 0.999)
    rows = features.select("id", F.posexplode("features").alias("i", "x"))
    if dropout:
        rows = rows.withColumn("x", F.when(uniform("id", "i", seed=seed) < dropout, 0.0).otherwise(F.col("x") / (1 - dropout)))
    a = normalised_adjacency(graph, self_loops)
    mixed = a.join(rows.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id"), "i").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    arrays = mixed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("features"))
    weights = np.asarray(weights, float)
    zero = F.array_repeat(F.lit(0.0), weights.shape[0])
    every = graph.node_ids().join(arrays, "id", "left").select("id", F.coalesce("features", zero).alias("features"))
    return _dense(every, "features", weights, np.zeros(weights.shape[1]) if bias is None else np.asarray(bias, float), activation)


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, value) of two sparse matrices of that form."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def transe_energy(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds energy = |h + r - t| to (subject, predicate, object); vectors are (id, embedding)."""
    of = lambda df, key, name: df.select(F.col("id").alias(key), F.col("embedding").alias(name))
    met = triples.join(of(entities, "subject", "h"), "subject").join(of(relations, "predicate", "r"), "predicate").join(of(entities, "object", "t"), "object")
    d = F.zip_with(F.zip_with("h", "r", lambda a, b: a + b), "t", lambda a, b: a - b)
    return met.select("subject", "predicate", "object", F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)).alias("energy"))


def transe(triples: DataFrame, dimension: int = 32, epochs: int = 20, rate: float = 0.05, margin: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) as (id, embedding): margin descent, one summed gradient step per epoch.

    Each triple meets one corrupted one, whose object is another triple's by a hashed shift, so gradients are plain aggregations over keys.
    """
    t = cut(triples.select("subject", "predicate", "object").distinct(), "transe")
    n = t.count()
    start = lambda ids: ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda k: uniform("id", k, seed=seed) * 2 - 1).alias("embedding"))
    entities = cut(start(t.select(F.explode(F.array("subject", "object")).alias("id")).distinct()), "transe-e")
    relations = cut(start(t.select(F.col("predicate").alias("id")).distinct()), "transe-r")
    buckets = max(1, n)
    objects = cut(t.select(F.pmod(F.xxhash64("subject", "predicate", "object"), F.lit(buckets)).alias("b"), F.col("object").alias("wrong")).groupBy("b").agg(F.min("wrong").alias("wrong")), "transe-wrong")
    of = lambda df, key, name: df.select(F.col("id").alias(key), F.col("embedding").alias(name))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    for epoch in range(epochs):
        with_wrong = t.withColumn("b", F.pmod(F.xxhash64("subject", "predicate", "object", F.lit(seed * 1000 + epoch)), F.lit(buckets))).join(objects, "b").where("wrong != object")
        met = with_wrong.join(of(entities, "subject", "h"), "subject").join(of(relations, "predicate", "r"), "predicate").join(of(entities, "object", "t"), "object").join(of(entities, "wrong", "w"), "wrong")
        q = met.withColumn("q", F.zip_with("h", "r", lambda a, b: a + b)).withColumns({"dt": minus("q", "t"), "dw": minus("q", "w")})
        hot = q.where(square("dt") + margin > square("dw"))
        g = minus("dt", "dw")
        neg = lambda c: F.transform(c, lambda x: -x)
        sums = hot.select(F.explode(F.array(
            F.struct(F.col("subject").alias("id"), g.alias("g"), F.lit("e").alias("kind")), F.struct(F.col("predicate").alias("id"), g.alias("g"), F.lit("r").alias("kind")),
            F.struct(F.col("object").alias("id"), neg("dt").alias("g"), F.lit("e").alias("kind")), F.struct(F.col("wrong").alias("id"), F.col("dw").alias("g"), F.lit("e").alias("kind")),
        )).alias("s")).select("s.*", F.posexplode("s.g").alias("i", "x")).groupBy("kind", "id", "i").agg(F.avg("x").alias("x")).groupBy("kind", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("g"))
        sums = cut(sums, "transe-grad")

        def stepped(df: DataFrame, kind: str) -> DataFrame:
            moved = df.join(sums.where(F.col("kind") == kind).select("id", "g"), "id", "left").withColumn("e", F.when(F.col("g").isNull(), F.col("embedding")).otherwise(F.zip_with("embedding", "g", lambda x, y: x - rate * y)))
            if kind == "r":
                return cut(moved.select("id", F.col("e").alias("embedding")), "transe-r")
            size = F.greatest(F.lit(1.0), F.sqrt(square("e")))
            return cut(moved.select("id", F.transform("e", lambda x: x / size).alias("embedding")), "transe-e")

        entities, relations = stepped(entities, "e"), stepped(relations, "r")
    return entities, relations
