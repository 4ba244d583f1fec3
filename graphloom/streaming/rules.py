"""Rules that react to batches: triggers are expressions over a batch's row, actions are functions."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import check

#: Columns a trigger can use.
STATE = "batch long, vertices_added long, vertices_removed long, edges_added long, edges_removed long, node_count long, edge_count long, density double, density_change double, component_change long, stability double, max_severity double, anomalies array<string>"


def vertex_trigger(threshold: float, relative: bool = False) -> Column:
    n = F.col("vertices_added") + F.col("vertices_removed")
    return (n / F.greatest(F.col("node_count"), F.lit(1)) if relative else n) >= threshold


def edge_trigger(threshold: float, relative: bool = False) -> Column:
    n = F.col("edges_added") + F.col("edges_removed")
    return (n / F.greatest(F.col("edge_count"), F.lit(1)) if relative else n) >= threshold


def density_trigger(threshold: float) -> Column:
    return F.abs("density_change") >= threshold


def component_trigger(threshold: int = 1) -> Column:
    return F.abs("component_change") >= threshold


def anomaly_trigger(name: str) -> Column:
    return F.array_contains("anomalies", name)


def severity_trigger(threshold: float) -> Column:
    return F.col("max_severity") >= threshold


def periodic_trigger() -> Column:
    return F.lit(True)  # the rule's cooldown is its period


def rapid_growth(rate: float = 0.1) -> Column:
    return (F.col("edges_added") / F.greatest(F.col("edge_count") - F.col("edges_added"), F.lit(1))) >= rate


def structural_change() -> Column:
    return F.arrays_overlap("anomalies", F.array(F.lit("component_merge"), F.lit("component_split")))


def community_instability(least: float = 0.8) -> Column:
    return F.col("stability") < least


@dataclass
class Rule:
    name: str
    trigger: Column
    actions: list[str]
    priority: int = 0
    cooldown: float = 0.0
    enabled: bool = True
    last: float = field(default=float("-inf"), repr=False)


def default_rules() -> list[Rule]:
    return [
        Rule("edge-growth", edge_trigger(10), ["pagerank"], 5, 30.0),
        Rule("component-change", component_trigger(1), ["components"], 4, 20.0),
        Rule("density-shift", density_trigger(0.1), ["all"], 3, 60.0),
        Rule("severe-anomaly", severity_trigger(0.8), ["anomaly_analysis", "alert"], 10, 0.0),
        Rule("periodic", periodic_trigger(), ["update_baseline"], 0, 300.0),
        Rule("instability", community_instability(), ["log"], 2, 45.0),
    ]


class RuleEngine:
    """Evaluates all triggers of a batch in one projection and runs the actions of those that hold, by falling priority."""

    def __init__(self, spark: SparkSession, rules: list[Rule] | None = None, actions: dict[str, Callable[[dict], object]] | None = None, history: int = 1000, clock: Callable[[], float] = time.monotonic):
        self.spark, self.rules = spark, list(default_rules() if rules is None else rules)
        self.actions, self.clock = dict(actions or {}), clock
        self.events: deque[tuple] = deque(maxlen=history)

    def add(self, rule: Rule) -> None:
        check(rule.name not in {r.name for r in self.rules}, f"rule {rule.name} exists")
        self.rules.append(rule)

    def on_batch(self, state: DataFrame) -> list[str]:
        """Names of the rules that fired on a one-row state."""
        rules = [r for r in self.rules if r.enabled]
        row = state.select("*", *[F.coalesce(r.trigger, F.lit(False)).alias(f"__{i}") for i, r in enumerate(rules)]).first()
        if row is None:
            return []
        fired = []
        for i, r in sorted(enumerate(rules), key=lambda x: -x[1].priority):
            now = self.clock()
            if not row[f"__{i}"] or now - r.last < r.cooldown:
                continue
            r.last = now
            fired.append(r.name)
            for name in self._expand(r.actions):
                began = time.perf_counter()
                error = None
                try:
                    if name in self.actions:
                        self.actions[name](row.asDict())
                except Exception as e:  # noqa: BLE001  one action's failure must not stop the stream; the log keeps it
                    error = f"{type(e).__name__}: {e}"
                self.events.append((row["batch"], r.name, name, (time.perf_counter() - began) * 1000, error))
        return fired

    def _expand(self, names: list[str]) -> list[str]:
        return [x for n in names for x in (["pagerank", "components"] if n == "all" else [n])]

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.events), "batch long, rule string, action string, ms double, error string")

    def statistics(self) -> DataFrame:
        """(action, runs, mean_ms, success_rate)."""
        return self.log().groupBy("action").agg(F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("mean_ms"), F.avg(F.col("error").isNull().cast("double")).alias("success_rate"))
