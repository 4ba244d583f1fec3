"""Graphs over the test tables. The same SQL text runs in Spark and in DuckDB, but for two views whose text would leave Spark a task that grows with the table."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph
from graphloom.lineage import cut

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

VIEWS = {
    "nation_trade": """
        select 'N'||cast(s.s_nationkey as varchar(20)) source, 'N'||cast(c.c_nationkey as varchar(20)) target,
               sum(l.l_extendedprice*(1-l.l_discount)) weight
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey
        join customer c on c.c_custkey=o.o_custkey join supplier s on s.s_suppkey=l.l_suppkey group by 1,2""",
    "user_next": """
        select source, target, ts, event_type from (
          select 'U'||cast(user_id as varchar(20)) source,
                 'U'||cast(lead(user_id) over (order by ts,event_id) as varchar(20)) target, ts, event_type
          from events) x where target is not null and source<>target""",
    "cust_supp": """
        select 'C'||cast(o.o_custkey as varchar(20)) source, 'S'||cast(l.l_suppkey as varchar(20)) target,
               cast(count(*) as double) weight
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey group by 1,2""",
    "order_chain": """
        select source, target, ts from (
          select 'O'||cast(o_orderkey as varchar(20)) source,
                 'O'||cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate,o_orderkey) as varchar(20)) target,
                 o_orderdate ts from orders) x where target is not null""",
    "event_flow": """
        select source, target, cast(count(*) as double) weight from (
          select event_type source, lead(event_type) over (partition by user_id order by ts,event_id) target
          from events) x where target is not null group by 1,2""",
    "part_copurchase": """
        select 'P'||cast(a.l_partkey as varchar(20)) source, 'P'||cast(b.l_partkey as varchar(20)) target,
               cast(count(*) as double) weight
        from lineitem a join lineitem b on a.l_orderkey=b.l_orderkey and a.l_partkey<b.l_partkey
        group by 1,2 having count(*)>1""",
    "priority_graphs": """
        select 'C'||cast(o.o_custkey as varchar(20)) source, 'S'||cast(l.l_suppkey as varchar(20)) target,
               l.l_quantity weight, o.o_orderpriority graph_name, l.l_orderkey*10+l.l_linenumber seq
        from lineitem l join orders o on l.l_orderkey=o.o_orderkey""",
    "place_triples": """
        select 'nation:'||n_name subject, 'rdf:type' predicate, 'Nation' object, 'uri' object_type from nation
        union all select 'region:'||r_name, 'rdf:type', 'Region', 'uri' from region
        union all select 'nation:'||n_name, 'inRegion', 'region:'||r_name, 'uri' from nation join region on n_regionkey=r_regionkey
        union all select 'supplier:'||s_name, 'rdf:type', 'Supplier', 'uri' from supplier
        union all select 'supplier:'||s_name, 'inNation', 'nation:'||n_name, 'uri' from supplier join nation on s_nationkey=n_nationkey
        union all select 'supplier:'||s_name, 'balance', cast(cast(floor(s_acctbal) as int) as varchar(20)), 'literal' from supplier""",
    "trade_vertices": """
        select 'C'||cast(c_custkey as varchar(20)) id, 'Customer' label, c_mktsegment segment, c_acctbal balance, c_nationkey nation from customer
        union all select 'S'||cast(s_suppkey as varchar(20)), 'Supplier', null, s_acctbal, s_nationkey from supplier""",
    "daily_series": """
        select event_type metric, cast(date_trunc('day', ts) as date) ts, cast(count(*) as double) value from events group by 1,2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS = 1 << 19  # of one task


def _tasks(spark: SparkSession, rows: int) -> int:
    """As many as keep to ``ROWS``; for a small table no more than shuffles have."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (1 << 14)), -(-rows // ROWS), 1)


def _user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_next`` with the order dealt by ranges: each task pairs neighbouring rows as they stream by, and the ranges' ends are paired afterwards."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "event_id")
    order = [F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("next", events.schema["user_id"].dataType), *events.schema.fields[:3]])

    def follow(batches):
        part, names = TaskContext.get().partitionId(), ["user_id", "ts", "event_type"]

        def rows(held, after, first, last):
            n = held.num_rows
            nexts = pa.concat_arrays([held.column(0).slice(1), after]) if n else after
            flags = [pa.array([first and i == 0 for i in range(n)], pa.bool_()), pa.array([last and i == n - 1 for i in range(n)], pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *flags, nexts, *held.columns], names=["part", "first", "last", "next", *names])

        held, first = None, True
        for batch in batches:
            batch = batch.select(names)
            if not batch.num_rows:
                continue
            if held is not None:
                yield rows(held, batch.column(0).slice(0, 1), first, False)
                first = False
            held = batch
        if held is not None:
            yield rows(held, pa.nulls(1, held.column(0).type), first, True)

    dealt = events.repartitionByRange(_tasks(spark, events.count()), *order).sortWithinPartitions(*order)
    got = cut(dealt.mapInArrow(follow, out), "user-next")
    ahead = F.lead(F.struct("user_id")).over(Window.orderBy("part"))["user_id"]  # one row per range
    heads = got.where("first").select("part", ahead.alias("ahead"))
    ends = got.where("last").join(heads, "part").withColumn("next", F.col("ahead"))
    pairs = got.where("NOT last").select("user_id", "next", "ts", "event_type").unionByName(ends.select("user_id", "next", "ts", "event_type"))
    named = lambda c: F.concat(F.lit("U"), F.col(c).cast("string"))
    return pairs.where("next IS NOT NULL AND user_id <> next").select(named("user_id").alias("source"), named("next").alias("target"), "ts", "event_type")


def _part_copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part_copurchase`` with pairs counted by their keys, which are smaller than names, in as many tasks as the pairs need."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).where("o IS NOT NULL AND p IS NOT NULL")
    rows, most = lines.groupBy("o").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()
    dealt = lines.repartition(_tasks(spark, rows), "o")
    pairs = dealt.select("o", F.col("p").alias("a")).join(dealt.select("o", F.col("p").alias("b")), "o").where("a < b")
    counted = pairs.select("a", "b").repartition(_tasks(spark, most), "a", "b").groupBy("a", "b").count().where("count > 1")
    named = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    return counted.select(named("a").alias("source"), named("b").alias("target"), F.col("count").cast("double").alias("weight"))


BUILT = {"user_next": _user_next, "part_copurchase": _part_copurchase}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are bound by argument, so that sessions with several folders don't mix."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    used = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])]
    text = VIEWS[name]
    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
        # columns qualified by nothing need the alias that the bare table name was
        text = re.sub(rf"\{{{t}\}}(?! [a-z]\b)", f"{{{t}}} {t}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return Graph.from_edges(view(spark, sf_dir, name))


def cte(*names: str) -> str:
    """WITH clause that defines views for DuckDB."""
    return "with recursive " + ", ".join(f"{n} as ({VIEWS[n]})" for n in names)
