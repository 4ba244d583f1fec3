"""Where iterative plans end their lineage: tables in the shared folder, which outlive any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_written: list[str] = []
_tables: dict[str, str] = {}  # names of those written as tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of this process's own, which only a local master can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, True)
        _own_dirs[app] = "file://" + own
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, which ``clean`` knows."""
    _written.append(f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Writes ``df`` once and reads it back."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, tag: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates over all rows that the one job of writing them gathers."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in measures.items()]), tag)
    return out, seen.get


def cut_counted(df: DataFrame, tag: str = "step") -> tuple[DataFrame, int]:
    """``cut``, and the number of rows written."""
    out, seen = cut_measured(df, tag, rows=F.count(F.lit(1)))
    return out, seen["rows"]


def cut_bucketed(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """``cut`` to a table with one bucket for each shuffle partition, so that joins on ``keys`` read it without a shuffle."""
    spark = df.sparkSession
    path, n = new_path(spark, tag), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graphloom_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    _tables[path] = name
    return spark.table(name)


def mark() -> int:
    """What ``clean`` takes to keep the tables written so far."""
    return len(_written)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written after ``mark()`` gave ``since``; results that still read them must have been written first."""
    jvm = spark._jvm
    for path in _written[since:]:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:]
