"""Windows: over snapshots of metrics, and over event time with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from graphloom.errors import check
from graphloom.operators import forecasting

METRICS = ("node_count", "edge_count", "density", "avg_degree", "clustering", "component_count")


class SlidingWindow:
    """Snapshots of the last ``seconds``, at most ``most`` of them, as (ts, metrics...) rows."""

    def __init__(self, seconds: int = 3600, most: int = 1000, interval: int = 0):
        self.seconds, self.most, self.interval = seconds, most, interval
        self.rows: list[dict] = []

    def update(self, ts: int, metrics: dict) -> bool:
        """Appends a snapshot unless the last one is less than an interval old; drops what is too old or too many."""
        if self.rows and ts - self.rows[-1]["ts"] < self.interval:
            return False
        self.rows.append({"ts": ts} | metrics)
        self.rows = [r for r in self.rows if r["ts"] > ts - self.seconds][-self.most :]
        return True

    def series(self, spark) -> DataFrame:
        """(metric, ts, value)."""
        data = [(k, r["ts"], float(v)) for r in self.rows for k, v in r.items() if k != "ts"]
        return spark.createDataFrame(data, "metric string, ts long, value double")

    def trends(self, spark) -> DataFrame:
        return forecasting.trends(self.series(spark))

    def change_points(self, spark) -> DataFrame:
        return forecasting.change_points(self.series(spark))

    def patterns(self, spark) -> DataFrame:
        return forecasting.patterns(self.series(spark))

    def recent(self, n: int) -> list[dict]:
        return self.rows[-n:]


def as_series(metrics: DataFrame, ts: str = "batch", names: tuple[str, ...] = METRICS) -> DataFrame:
    """Wide metrics rows to (metric, ts, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.col(ts).alias("ts"), F.explode(pairs).alias("p")).select("p.metric", "ts", "p.value")


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """The column as a timestamp with zone, which watermarks need."""
    return stream if isinstance(stream.schema[column].dataType, TimestampType) else stream.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", column: str = "ts", keys: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """(start, end, keys..., n[, total]): tumbling windows, or sliding ones; rows later than ``late`` are dropped in a stream."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return event_time(events, column).withWatermark(column, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def windowed_statistics(
    events: DataFrame, size: str, value: str, statistics: tuple[str, ...] = ("average", "median", "stddev"), slide: str | None = None, late: str = "10 minutes", column: str = "ts", keys: tuple[str, ...] = (), exact: bool = False, mode_of: str | None = None
) -> DataFrame:
    """(start, end, keys..., n, one column per statistic[, mode]): sum, average, count, minimum, maximum, stddev, median, percentile_<p>.

    Quantiles come from sketches of a fixed size (relative error 1e-4 in rank); ``exact`` interpolates them over a count of each distinct value
    instead, whose size grows with a window's distinct values. Nulls are no values; a stddev of one value is 0. The mode is the smallest of equals.
    """
    def of(name: str) -> Column:
        plain = {"sum": F.sum, "average": F.avg, "count": F.count, "minimum": F.min, "maximum": F.max}
        if name in plain:
            return plain[name](value)
        if name == "stddev":
            return F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0)
        share = 0.5 if name == "median" else int(name.removeprefix("percentile_")) / 100 if name.removeprefix("percentile_").isdigit() else None
        check(share is not None and 0 <= share <= 1, f"unknown statistic {name}")
        return F.percentile(value, share) if exact else F.percentile_approx(value, share, 10_000)

    w = F.window(column, size, slide) if slide else F.window(column, size)
    aggs = [F.count(F.lit(1)).alias("n"), *[of(x).alias(x) for x in statistics], *([F.mode(mode_of, True).alias("mode")] if mode_of else [])]
    by = event_time(events, column).withWatermark(column, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *statistics, *(["mode"] if mode_of else []))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """(key, start, end, n): sessions of a key end after a gap."""
    w = F.session_window(column, gap)
    return event_time(events, column).withWatermark(column, late).groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Pairs of events of a key, the right one at most ``within`` after the left one; state is bounded by the watermarks."""
    check(key in left.columns and key in right.columns, f"both sides need {key}")
    a = event_time(left, column).select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withWatermark(f"l_{column}", late)
    b = event_time(right, column).select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withWatermark(f"r_{column}", late)
    return a.join(b, F.expr(f"l_{key} = r_{key} AND r_{column} >= l_{column} AND r_{column} <= l_{column} + interval {within}"))


def next_actor_edges(events: DataFrame, actor: str = "user_id", column: str = "ts", order: str = "event_id") -> DataFrame:
    """Batch view of an event stream as a temporal graph: an edge from each event's actor to that of the next event."""
    from pyspark.sql import Window

    w = Window.orderBy(column, order)
    return events.select(F.col(actor).alias("source"), F.lead(actor).over(w).alias("target"), column).where("target IS NOT NULL AND source != target")
