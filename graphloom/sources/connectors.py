"""Databases over JDBC: named connections, import by queries, export to tables. The driver's jar is the user's to supply."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import InvalidParameter, Unsupported
from graphloom.graph import Graph

#: URL prefix and driver class of each kind.
KINDS = {
    "postgresql": ("jdbc:postgresql://", "org.postgresql.Driver"),
    "clickhouse": ("jdbc:clickhouse://", "com.clickhouse.jdbc.ClickHouseDriver"),
    "duckdb": ("jdbc:duckdb:", "org.duckdb.DuckDBDriver"),
    "mysql": ("jdbc:mysql://", "com.mysql.cj.jdbc.Driver"),
    "sqlite": ("jdbc:sqlite:", "org.sqlite.JDBC"),
}
NO_JDBC = {"neo4j": "the Neo4j Spark connector", "age": "PostgreSQL's AGE extension and a Cypher query through the postgresql kind"}


@dataclass
class ImportConfig:
    edge_query: str
    node_query: str | None = None
    id_column: str = "id"
    source_column: str = "source"
    target_column: str = "target"
    partition_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int = 16


@dataclass
class ExportConfig:
    node_table: str = "nodes"
    edge_table: str = "edges"
    mode: str = "append"
    batch: int = 10_000
    upsert_keys: list[str] = field(default_factory=list)


class Connectors:
    """A registry of connections."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[str, dict] = {}

    def add(self, name: str, kind: str, location: str, **options: str) -> None:
        if kind in NO_JDBC:
            raise Unsupported(f"{kind} needs {NO_JDBC[kind]}")
        if kind not in KINDS:
            raise InvalidParameter(f"unknown kind {kind}; known: {', '.join(KINDS)}")
        prefix, driver = KINDS[kind]
        self._known[name] = {"url": location if location.startswith("jdbc:") else prefix + location, "driver": driver, **options}

    def names(self) -> list[str]:
        return sorted(self._known)

    def options(self, name: str) -> dict:
        if name not in self._known:
            raise InvalidParameter(f"no connection {name}")
        return dict(self._known[name])

    def read(self, name: str, query: str, config: ImportConfig | None = None) -> DataFrame:
        """A query's rows; with a partition column it is read by ranges, in parallel."""
        reader = self.spark.read.format("jdbc").options(**self.options(name))
        if config and config.partition_column and config.lower is not None and config.upper is not None:
            parts = {"partitionColumn": config.partition_column, "lowerBound": config.lower, "upperBound": config.upper, "numPartitions": config.partitions}
            return reader.option("dbtable", f"({query}) q").options(**parts).load()
        return reader.option("query", query).load()

    def import_graph(self, name: str, config: ImportConfig) -> Graph:
        e = self.read(name, config.edge_query, config).withColumnsRenamed({config.source_column: "source", config.target_column: "target"})
        if config.node_query is None:
            return Graph.from_edges(e)
        return Graph(self.read(name, config.node_query).withColumnRenamed(config.id_column, "id"), e)

    def export_graph(self, name: str, graph: Graph, config: ExportConfig | None = None) -> None:
        """Writes both tables. With upsert keys, rows that are in the database already are left out."""
        config = config or ExportConfig()
        for table, df in ((config.node_table, graph.vertices), (config.edge_table, graph.edges)):
            keys = [k for k in config.upsert_keys if k in df.columns]
            if keys and config.mode == "append":
                df = df.join(self.read(name, f"SELECT {', '.join(keys)} FROM {table}"), keys, "left_anti")
            df.write.format("jdbc").options(**self.options(name)).option("dbtable", table).option("batchsize", config.batch).mode(config.mode).save()


def to_edge_index(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(mapping (id, index), edge_index (source_index, target_index, weight)) with edges in both directions."""
    from graphloom.operators.components import dense_ids

    mapping = dense_ids(graph.node_ids(), "id").withColumnRenamed("number", "index")
    of = lambda end: mapping.select(F.col("id").alias(end), F.col("index").alias(f"{end}_index"))
    e = graph.edges.select("source", "target", "weight").join(of("source"), "source").join(of("target"), "target").select("source_index", "target_index", "weight")
    return mapping, e.unionByName(e.select(F.col("target_index").alias("source_index"), F.col("source_index").alias("target_index"), "weight"))


def from_edge_index(mapping: DataFrame, edge_index: DataFrame) -> Graph:
    of = lambda end: mapping.select(F.col("index").alias(f"{end}_index"), F.col("id").alias(end))
    e = edge_index.join(of("source"), "source_index").join(of("target"), "target_index")
    return Graph(mapping.select("id"), e.select("source", "target", *([c for c in ("weight",) if c in edge_index.columns])))
