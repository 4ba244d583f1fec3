"""Connected components of links that come out of a join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.operators.components import weak_roots


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of ``links`` (a, b)."""
    return weak_roots(links).withColumnRenamed("id", "node")
