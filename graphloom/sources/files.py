"""Graphs in files. The format follows from the path: .parquet, .orc, .csv, .json, .arrow / .ipc; a folder is Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.errors import check
from graphloom.graph import Graph

FORMATS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json", ".jsonl": "json", ".arrow": "arrow", ".ipc": "arrow"}


def format_of(path: str) -> str:
    return next((f for s, f in FORMATS.items() if path.rstrip("/").lower().endswith(s)), "parquet")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    kind = format_of(path)
    if kind == "arrow":
        return _read_arrow(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("header", True).option("inferSchema", schema is None).csv(path) if kind == "csv" else reader.format(kind).load(path)


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files are read as binary files by the executors, whatever store they lie in."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)

    def open_(content: bytes):
        source = pa.BufferReader(content)
        return pa.ipc.open_file(source) if content[:6] == b"ARROW1" else pa.ipc.open_stream(source)

    schema = from_arrow_schema(open_(files.select("content").first()[0]).schema)

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                yield from open_(content).read_all().to_batches(max_chunksize=100_000)

    return files.select("content").mapInArrow(run, schema)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None, cluster_by: list[str] | None = None) -> None:
    """``cluster_by`` deals rows by these columns and sorts each file by them, so that readers can skip by their statistics."""
    kind = format_of(path)
    check(kind != "arrow", "Arrow IPC is a format to read")
    out = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    writer = out.write.mode(mode).format(kind)
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.option("compression", compression) if compression else writer).save(path)


def save_graph(graph: Graph, path: str, mode: str = "errorifexists", compression: str = "lz4", access: str = "forward") -> None:
    """Vertices and edges below ``path``, laid out for walks along (forward) or against (backward) edges."""
    check(access in ("forward", "backward", "none"), "access must be forward, backward or none")
    cluster = {"forward": ["source"], "backward": ["target"], "none": None}[access]
    codec = {"lz4": "lz4_raw"}.get(compression, compression)
    write_table(graph.vertices, f"{path}/vertices.parquet", mode, codec)
    write_table(graph.edges, f"{path}/edges.parquet", mode, codec, cluster)


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(read_table(spark, f"{path}/vertices.parquet"), read_table(spark, f"{path}/edges.parquet"))


def save_bucketed(graph: Graph, table: str, buckets: int = 64) -> None:
    """Edges as a table bucketed by source, so that joins on it need no shuffle."""
    graph.edges.write.mode("overwrite").bucketBy(buckets, "source").sortBy("source").saveAsTable(table)


def export_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays become text."""
    flat = features.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in features.dtypes])
    flat.write.mode(mode).option("header", True).csv(path)
