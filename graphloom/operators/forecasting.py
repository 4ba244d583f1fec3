"""Metric series: rows (metric, ts, value) in the order of ts. All statistics are aggregations or window frames per metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import check_number


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null where one side does not vary."""
    n, varies = F.stddev_pop(x) * F.stddev_pop(y), F.covar_pop(x, y)
    return F.try_divide(varies, n)


def indexed(series: DataFrame) -> DataFrame:
    """Adds i, the place of a row in its metric's series, from 0."""
    return series.withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("ts")) - 1)


def trends(series: DataFrame) -> DataFrame:
    """(metric, n, slope, correlation, r2, volatility, mean, recent_change, direction): least squares on the index."""
    s = indexed(series)
    by = s.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("value", "i"), F.lit(0.0)).alias("slope"), F.coalesce(_corr("value", "i"), F.lit(0.0)).alias("correlation"), F.coalesce(_corr("value", "i") * _corr("value", "i"), F.lit(0.0)).alias("r2"),
        F.stddev_pop("value").alias("volatility"), F.avg("value").alias("mean"), F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"),
    )
    flat = F.when(F.col("volatility") > 0.1 * F.abs("mean"), "volatile").otherwise("stable")
    direction = F.when(F.abs("slope") < 0.01, flat).when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return by.select("metric", "n", "slope", "correlation", "r2", "volatility", "mean", F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.abs("first")), F.lit(0.0)).alias("recent_change"), direction.alias("direction"))


def significant_trends(series: DataFrame, least_slope: float = 0.05) -> DataFrame:
    return trends(series).where(F.abs("slope") >= least_slope).select("metric", "slope", "r2")


def overall_direction(series: DataFrame) -> DataFrame:
    """(direction, strength): the sign that most slopes with r2 over 0.5 have, and the mean r2."""
    t = trends(series)
    votes = F.sum(F.when(F.col("r2") > 0.5, F.signum("slope")).otherwise(0.0))
    return t.agg(F.when(votes > 0, "increasing").when(votes < 0, "decreasing").otherwise("stable").alias("direction"), F.coalesce(F.avg("r2"), F.lit(0.0)).alias("strength"))


def consistency(series: DataFrame) -> DataFrame:
    """(metric, consistency): share of consecutive differences that keep their sign; 0.5 with fewer than three values."""
    w = Window.partitionBy("metric").orderBy("ts")
    d = series.withColumn("d", F.signum(F.col("value") - F.lag("value").over(w))).withColumn("before", F.lag("d").over(w))
    return d.groupBy("metric").agg(F.coalesce(F.avg(F.when(F.col("before").isNotNull(), (F.col("d") * F.col("before") > 0).cast("double"))), F.lit(0.5)).alias("consistency"))


def linear_forecast(series: DataFrame, steps: int, z: float = 1.96) -> DataFrame:
    """(metric, step, value, low, high): last value plus slope times steps, not under 0, and a band of z deviations."""
    check_number("steps", steps, low=1)
    last = series.groupBy("metric").agg(F.max_by("value", "ts").alias("last"))
    out = trends(series).join(last, "metric").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    value = F.greatest(F.lit(0.0), F.col("last") + F.col("slope") * F.col("step"))
    return out.select("metric", "step", value.alias("value"), F.greatest(F.lit(0.0), value - z * F.col("volatility")).alias("low"), (value + z * F.col("volatility")).alias("high"))


def exponential_smoothing(series: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(metric, level): alpha * sum of (1 - alpha)^age * value over the series, with the first value as the start."""
    check_number("alpha", alpha, 0, 1, above=0)
    s = indexed(series)
    n = s.groupBy("metric").agg(F.max("i").alias("last"))
    age = F.col("last") - F.col("i")
    weight = F.pow(F.lit(1 - alpha), age) * F.when(F.col("i") == 0, 1.0).otherwise(alpha)
    return s.join(n, "metric").groupBy("metric").agg(F.sum(weight * F.col("value")).alias("level"))


def autocorrelation(series: DataFrame, lag: int) -> DataFrame:
    """(metric, n, autocorrelation) at a lag: lagged products over the variance."""
    check_number("lag", lag, low=1)
    w = Window.partitionBy("metric").orderBy("ts")
    stats = series.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    s = series.withColumn("lagged", F.lag("value", lag).over(w)).join(stats, "metric")
    d = F.col("value") - F.col("mean")
    return s.groupBy("metric", "n").agg(F.coalesce(F.try_divide(F.sum(d * (F.col("lagged") - F.col("mean"))), F.sum(d * d)), F.lit(0.0)).alias("autocorrelation"))


def choose_model(series: DataFrame) -> DataFrame:
    """(metric, model): linear under 30 values, seasonal if lag 12 correlates over 0.3 in 24 values or more, smoothing on a trend, else arima."""
    t = trends(series).select("metric", "n", "slope")
    a = autocorrelation(series, 12).select("metric", "autocorrelation")
    model = F.when(F.col("n") < 30, "linear").when((F.col("n") >= 24) & (F.abs("autocorrelation") > 0.3), "seasonal").when(F.abs("slope") > 0.01, "exponential_smoothing").otherwise("arima")
    return t.join(a, "metric").select("metric", model.alias("model"))


def change_points(series: DataFrame, threshold: float = 0.2, least: int = 10) -> DataFrame:
    """(metric, ts, change, confidence): the means of a quarter of the series before and after a row differ by more than the threshold."""
    s = indexed(series)
    n = s.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("half", F.greatest(F.lit(2), F.floor(F.col("n") / 4)).cast("int"))
    # frames of a length that the data set: running sums, looked up at both ends
    upto = Window.partitionBy("metric").orderBy("ts")
    s = s.join(n, "metric").withColumn("run", F.sum("value").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.select("metric", F.col("i").alias("j"), F.col("run").alias("at"))
    before = runs.select("metric", (F.col("j") + 1).alias("j"), "at")
    here = s.where((F.col("i") >= F.col("half")) & (F.col("i") + F.col("half") <= F.col("n")))
    x = here.join(before.select("metric", F.col("j").alias("i"), F.col("at").alias("r0")), ["metric", "i"])
    lo = before.withColumnRenamed("j", "lo").withColumnRenamed("at", "r_lo")
    hi = before.withColumnRenamed("j", "hi").withColumnRenamed("at", "r_hi")
    x = x.withColumns({"lo": F.col("i") - F.col("half"), "hi": F.col("i") + F.col("half")}).join(lo, ["metric", "lo"], "left").join(hi, ["metric", "hi"])
    m0 = (F.col("r0") - F.coalesce("r_lo", F.lit(0.0))) / F.col("half")
    m1 = (F.col("r_hi") - F.col("r0")) / F.col("half")
    change = F.abs(m1 - m0) / F.greatest(F.abs(m0), F.lit(1e-12))
    return x.select("metric", "ts", change.alias("change"), F.least(F.lit(1.0), (change - threshold) / (1 - threshold)).alias("confidence")).where(F.col("change") > threshold)


def patterns(series: DataFrame) -> DataFrame:
    """(metric, pattern, strength): growth (more than 70 % of steps rise) and burst (a value over mean + 2 deviations)."""
    w = Window.partitionBy("metric").orderBy("ts")
    s = series.withColumn("up", F.when(F.lag("value").over(w).isNotNull(), (F.col("value") > F.lag("value").over(w)).cast("double")))
    by = s.groupBy("metric").agg(F.avg("up").alias("rise"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.max("value").alias("top"))
    burst = F.try_divide(F.col("top") - F.col("mean"), F.col("sd"))
    found = F.array_compact(F.array(
        F.when(F.col("rise") > 0.7, F.struct(F.lit("growth").alias("pattern"), F.col("rise").alias("strength"))),
        F.when(burst > 2, F.struct(F.lit("burst").alias("pattern"), F.least(F.lit(1.0), burst / 4).alias("strength"))),
    ))
    return by.select("metric", F.explode(found).alias("p")).select("metric", "p.pattern", "p.strength")


def lagged_correlation(series: DataFrame, max_lag: int = 5, least: float = 0.5) -> DataFrame:
    """(cause, effect, lag, strength): the metric that, ``lag`` steps earlier, correlates most with another, if over ``least``."""
    check_number("max_lag", max_lag, low=1)
    s = indexed(series).select("metric", "i", "value")
    cause = s.select(F.col("metric").alias("cause"), F.col("value").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"), "i").withColumn("i", F.col("i") + F.col("lag"))
    met = cause.join(s.select(F.col("metric").alias("effect"), "i", F.col("value").alias("y")), "i").where("cause != effect")
    by = met.groupBy("cause", "effect", "lag").agg(F.abs(_corr("x", "y")).alias("strength"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("strength") > least))
    best = by.groupBy("cause", "effect").agg(F.max_by(F.struct("lag", "strength"), F.struct("strength", -F.col("lag"))).alias("b"))
    return best.select("cause", "effect", "b.lag", "b.strength")


def severity(score: Column) -> Column:
    return F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.4, "medium").otherwise("low")


def anomalies(series: DataFrame, window: int = 10, votes: int | None = None) -> DataFrame:
    """(metric, ts, value, votes, score, severity): majority of three tests: z-score over 3, outside the quartile fences, a jump of 3 moving deviations."""
    by = series.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.percentile_approx("value", [0.25, 0.75], 10_000).alias("q"))
    moving = Window.partitionBy("metric").orderBy("ts").rowsBetween(-window, -1)
    s = series.withColumns({"m": F.avg("value").over(moving), "s": F.stddev_pop("value").over(moving)}).join(by, "metric")
    iqr = F.col("q")[1] - F.col("q")[0]
    z = F.coalesce(F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("sd")), F.lit(0.0))
    fence = F.coalesce(F.try_divide(F.greatest(F.col("q")[0] - F.col("value"), F.col("value") - F.col("q")[1]), iqr), F.lit(0.0))
    jump = F.coalesce(F.try_divide(F.abs(F.col("value") - F.col("m")), F.col("s")), F.lit(0.0))
    tests = [(z > 3, z / 6), (fence > 1.5, fence / 3), (jump > 3, jump / 6)]
    n = sum((t.cast("int") for t, _ in tests[1:]), tests[0][0].cast("int"))
    score = sum((F.least(F.lit(1.0), x) for _, x in tests[1:]), F.least(F.lit(1.0), tests[0][1])) / 3
    return s.select("metric", "ts", "value", n.alias("votes"), score.alias("score")).where(F.col("votes") >= (votes or 2)).withColumn("severity", severity(F.col("score")))


def lag_features(series: DataFrame, lags: tuple[int, ...] = (1, 7, 30), windows: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Adds lagged values and rolling means and deviations."""
    w = Window.partitionBy("metric").orderBy("ts")
    out = {f"lag_{k}": F.lag("value", k).over(w) for k in lags}
    for k in windows:
        out |= {f"mean_{k}": F.avg("value").over(w.rowsBetween(1 - k, 0)), f"sd_{k}": F.stddev_pop("value").over(w.rowsBetween(1 - k, 0))}
    return series.withColumns(out)
