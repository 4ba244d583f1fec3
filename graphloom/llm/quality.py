"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence is a logistic regression on statistics of the whole text, fitted on all labelled rows of
the training folds by Newton steps whose sums are aggregations. Its probabilities are soft counts of their path
(the last of ``levels``) and host (the first). A host's rate is shrunk towards the corpus rate and a path's
towards its host's, by strengths estimated from the spread of the groups' means (method of moments), so a site with
few documents says little. A document's final log odds are its own evidence with the corpus rate exchanged for
the rate of its path, which is taken without the document itself.

Groups are aggregated with map-side combination and met by (group, salt), so a host that holds a third of all rows
is no single task. Nothing but the fit's sums and two strengths comes to the driver.

Defined cases: a null text is empty; null hosts or paths are values of their own; several labels of a
document count as their mean; without labels of both kinds all evidence is even; repeated rows count as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, fold_of, spool
from graphloom.llm.outliers import counts

#: Statistics of a text: name, expression over its counts.
FEATURES = [
    ("f0", "ln(n_words + 1.0D)"),
    ("f1", "ln((word_chars + 1.0D) / (n_words + 1.0D))"),
    ("f2", "ln(1 + 20.0D * n_symbols / (n_words + 1.0D))"),
    ("f3", "2 * asin(sqrt(least(1.0D, n_dup_lines / (n_lines + 1.0D))))"),
    ("f4", "2 * asin(sqrt(least(1.0D, n_repeat_words / (n_words + 1.0D))))"),
    ("f5", "2 * asin(sqrt(least(1.0D, n_upper / (word_chars + 1.0D))))"),
    ("f6", "ln(1 + 20.0D * n_marks / (n_words + 1.0D))"),
    ("f7", "ln(1 + 20.0D * n_digits / (word_chars + 1.0D))"),
    ("f8", "ln((n_words + 1.0D) / (n_lines + 1.0D))"),
]
NAMES = ["one", *[n for n, _ in FEATURES]]
NEWTON, RIDGE, SALTS = 12, 1.0, 32
CLIP = 20.0  # of log odds


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """doc_id, ``keep`` and the features of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *keep, without(r"[A-ZÀ-Þ]+").alias("n_upper"), without("[!?]+").alias("n_marks"), without("[0-9]+").alias("n_digits"))
    got = counts(rows, "id", "text", [*keep, "n_upper", "n_marks", "n_digits"])
    return got.select("doc_id", *keep, *[F.expr(e).alias(n) for n, e in FEATURES])


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights of the logistic regression of ``y`` on NAMES, by Newton steps over all rows."""
    k = len(NAMES)
    total = labelled.agg(F.count(F.lit(1)), F.sum("y"), *[F.avg(n) for n in NAMES[1:]], *[F.stddev_pop(n) for n in NAMES[1:]]).first()
    n, positive = total[0], total[1] or 0.0
    if not n or positive in (0.0, float(n)):
        return np.zeros(k)
    mean = np.array([0.0, *total[2 : k + 1]])
    scale = np.array([1.0, *[s if s and s > 1e-9 else 1.0 for s in total[k + 1 :]]])
    z = [(F.col(a) - float(m)) / float(s) for a, m, s in zip(NAMES, mean, scale)]
    rows = labelled.select("y", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    w = np.zeros(k)
    w[0] = np.log(positive / (n - positive))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    for _ in range(NEWTON):
        p = _sigmoid(sum((F.col(f"z{i}") * float(x) for i, x in enumerate(w)), F.lit(0.0)))
        at = rows.select("*", p.alias("p")).withColumn("v", F.col("p") * (1 - F.col("p")))
        s = at.agg(*[F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")) for i in range(k)], *[F.sum(F.col("v") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).first()
        hessian = np.zeros((k, k))
        for (i, j), x in zip(pairs, s[k:]):
            hessian[i, j] = hessian[j, i] = x
        ridge = np.full(k, RIDGE)
        ridge[0] = 0
        step = np.linalg.solve(hessian + np.diag(ridge) + 1e-9 * np.eye(k), np.array(s[:k]) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    raw = w / scale
    raw[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return raw


def strength(groups: DataFrame, centre: Column, n: str = "n", mean: str = "mean") -> float:
    """How many documents the prior counts for: from the spread of group means beyond what their sizes explain."""
    r = groups.select(F.col(n).cast("double").alias("n"), (F.col(mean) - centre).alias("d"), (centre * (1 - centre)).alias("v"), (F.col("within") / F.greatest(F.col(n), F.lit(1))).alias("e"))
    s = r.agg(F.sum("n"), F.sum(F.col("n") * F.col("d") ** 2), F.sum(F.col("n") * F.col("e")), F.sum(F.col("n") * F.col("v"))).first()
    if not s[0]:
        return 1.0
    between = max(1e-6, (s[1] - s[2]) / s[0])
    return float(min(1e6, max(1.0, s[3] / s[0] / between - 1)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[Column | str, Column | str] = ("source", "lang")) -> DataFrame:
    """One row per document: doc_id, held_out, doc_score, host_rate, path_rate, score, predicted, kept."""
    host, path = (F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0")) for c in levels)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    rows = spool(statistics(named, "id", "text", ["host", "path"]).withColumn("one", F.lit(1.0)), "quality-statistics")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold_of("doc_id") != 0)).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    weights = fit(spool(rows.join(usable, "doc_id").select("y", *NAMES), "quality-labelled"))
    evidence = sum((F.col(n) * float(x) for n, x in zip(NAMES, weights)), F.lit(0.0))
    rows = rows.select("doc_id", "host", "path", _sigmoid(evidence).alias("p"))
    by_path = spool(rows.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("rest"), F.sum(F.col("p") * F.col("p")).alias("squares")), "quality-paths")
    top = by_path.agg(F.sum("good"), F.sum("n")).first()
    rate = (top[0] + 1) / (top[1] + 2) if top[1] else 0.5
    mean, within = F.col("good") / F.col("n"), F.greatest(F.col("squares") / F.col("n") - (F.col("good") / F.col("n")) ** 2, F.lit(0.0))
    by_host = by_path.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum("squares").alias("squares")).select("host", "good", "n", mean.alias("mean"), within.alias("within"))
    k_host = strength(by_host, F.lit(float(rate)))
    hosts = by_host.select("host", ((F.col("good") + k_host * rate) / (F.col("n") + k_host)).alias("host_rate"))
    paths = spool(by_path.select("host", "path", "good", "n", mean.alias("mean"), within.alias("within")).join(hosts, "host"), "quality-sites")
    k_path = strength(paths, F.col("host_rate"))
    salt = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    met = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(paths.select("host", "path", "good", "n", "host_rate", F.explode(salt).alias("salt")), ["host", "path", "salt"])
    # the path's rate without the document itself
    own = (F.col("good") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    final = met.select("doc_id", "p", "host_rate", own.alias("path_rate")).withColumn("score", _sigmoid(_logit(F.col("p")) - float(np.log(rate / (1 - rate))) + _logit(F.col("path_rate"))))
    kept = F.col("score") >= 0.5
    return final.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), F.col("p").alias("doc_score"), "host_rate", "path_rate", "score", kept.cast("int").alias("predicted"), kept.alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
