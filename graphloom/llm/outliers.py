"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Every document gets counts (words, symbols, repeated lines and word windows) by built-in array
functions over its whole text. Their transformed vector is held against its group (language and
source) by the minimum-covariance-determinant estimate: the share ``HALF`` of the group whose scatter has the smallest
determinant. Four deterministic starts (medians with quartile ranges, spatial signs, tanh scores, the core by norm) take two
concentration steps each; the start with the smallest determinant goes on until its determinant stops falling.
Each step is two aggregations by group that combine on the map side: a histogram of distances (classes of 1/512 of
their logarithm) for the order statistic, and the moments of the rows up to its class. Mahalanobis distances are
expressions (an unrolled Cholesky factor), and a document beyond the chi-square quantile is rejected.

Vectors lie on a grid and moments are sums of whole numbers, so the verdicts are the same whatever the order or partitions of the rows:
ties at the order statistic are in the core together.

Scatter has a floor in each direction (``FLOORS``): a group whose core has no symbols or no repeated lines at all must
not reject the first document that has one; it enters the determinant and the distances alike, so a concentration step lowers the determinant. Groups
under ``least`` rows take the estimate of all documents, as five dimensions can't be judged from a few rows.

Windows are told apart by their 64-bit hashes. Defined cases: a null text has no words; documents
without words fail the base rules; null language or source are values of their own; repeated rows count as often
as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import documents, spool

SPACE = r"[\x20\x09-\x0D]+"
#: The vector: (name, expression over the counts, floor of its standard deviation).
VECTOR = [
    ("x0", "ln(n_words + 1.0D)", 0.5),
    ("x1", "ln((word_chars + 1.0D) / (n_words + 1.0D))", 0.08),
    ("x2", "ln(1 + 20.0D * n_symbols / (n_words + 1.0D))", 0.35),
    ("x3", "2 * asin(sqrt(least(1.0D, n_dup_lines / (n_lines + 1.0D))))", 0.4),
    ("x4", "2 * asin(sqrt(least(1.0D, n_repeat_words / (n_words + 1.0D))))", 0.3),
]
P = len(VECTOR)
CUTOFF = 25.744831959  # fixed value: chi-square with 5 degrees of freedom, quantile 0.9999
HALF = 0.75  # share of the group that the estimate rests on
CONSISTENCY = 1.412  # fixed value: HALF / P(chi2_7 <= chi2_5's HALF quantile), makes the core's scatter that of the whole under normality
LEAST = 50
SALTS = 32
STARTS, FIRST_STEPS = 4, 2
FALLS = 1e-6  # in the logarithm of the determinant: less is no fall
GRID, SHIFT = 1 << 20, 24  # places of a vector's grid, and what a product of two loses of them
NORM = 4.351460  # fixed value: chi-square with 5 degrees of freedom, median


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, the columns in ``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    got = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("t"), F.array_remove(F.split(text, SPACE), "").alias("w"))
    got = got.select(
        "doc_id",
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("w") > 3, F.transform(F.expr("slice(w, 1, size(w) - 2)"), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
    )
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    got = got.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, i: (F.get("s", i - 1)["x"] == e["x"]) | (F.get("s", i + 1)["x"] == e["x"])
    got = got.withColumn("at", F.sort_array(F.filter(F.transform("s", lambda e, i: F.when(same(e, i), e["i"])), lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform("at", lambda x, i: F.coalesce(F.least(F.get("at", i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return got.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


NAMES = [n for n, _, _ in VECTOR]
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, means m_x and covariances c_x_y: sums of whole numbers, which no order of the rows changes."""
    whole = {a: F.rint(F.col(a) * GRID).cast("long") for a in NAMES}
    product = lambda a, b: F.shiftright(whole[a] * whole[b] + (1 << SHIFT - 1), SHIFT)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(whole[a]).alias(f"s_{a}") for a in NAMES], *[F.sum(product(a, b)).alias(f"p_{a}_{b}") for a, b in PAIRS])
    mean = {a: F.col(f"s_{a}") / F.col("n") / float(GRID) for a in NAMES}
    return sums.select(*keys, "n", *[mean[a].alias(f"m_{a}") for a in NAMES], *[(F.col(f"p_{a}_{b}") / F.col("n") / float(GRID**2 >> SHIFT) - mean[a] * mean[b]).alias(f"c_{a}_{b}") for a, b in PAIRS])


def _factor(df: DataFrame, factor: float) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the scaled, floored scatter, and the logarithm of its determinant."""
    made = []
    for i in range(P):
        for j in range(i + 1):
            rest = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            if i == j:
                made.append(f"sqrt(greatest(c_x{i}_x{j} * {factor}D{rest}, 0D) + {VECTOR[i][2] ** 2}D) AS l_{i}_{j}")
            else:
                made.append(f"(c_x{i}_x{j} * {factor}D{rest}) / l_{j}_{j} AS l_{i}_{j}")
    return df.selectExpr("*", *made, f"2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(P))}) AS logdet")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    made = [f"(x{i} - m_x{i}{''.join(f' - l_{i}_{k} * y_{k}' for k in range(i))}) / l_{i}_{i} AS y_{i}" for i in range(P)]
    return df.selectExpr("*", *made, f"{' + '.join(f'y_{i} * y_{i}' for i in range(P))} AS d2")


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, m_x, l_i_j, logdet: the starts of every group."""
    # quartiles from histograms of 1/1024: one row for each class of a coordinate
    bins = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(a) * 1024).alias("bin")) for i, a in enumerate(NAMES)])).alias("e")).groupBy(*keys, "e.i", "e.bin").count()
    by = Window.partitionBy(*keys, "i")
    ranked = bins.select("*", F.sum("count").over(by.orderBy("bin")).alias("upto"), F.sum("count").over(by).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, (F.col("bin") + 0.5) / 1024))
    quartiles = ranked.groupBy(*keys, "i").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    middle = spool(quartiles.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("b"))).alias(f"med_{a}") for i, a in enumerate(NAMES)], *[F.max(F.when(F.col("i") == i, F.greatest((F.col("c") - F.col("a")) / 1.349, F.lit(VECTOR[i][2])))).alias(f"dev_{a}") for i, a in enumerate(NAMES)]), "mcd-middle")
    z = rows.join(_salted(middle), [*keys, "salt"]).select(*keys, *[((F.col(a) - F.col(f"med_{a}")) / F.col(f"dev_{a}")).alias(a) for a in NAMES])
    z = z.withColumn("norm", F.sqrt(sum((F.col(a) ** 2 for a in NAMES[1:]), F.col(NAMES[0]) ** 2)))
    vector = lambda start, f: F.struct(F.lit(start).alias("start"), *[f(F.col(a)).alias(a) for a in NAMES])
    signs = vector(1, lambda c: F.when(F.col("norm") > 0, c / F.col("norm")).otherwise(0.0))
    made = z.select(*keys, F.explode(F.array_compact(F.array(signs, vector(2, F.tanh), F.when(F.col("norm") ** 2 <= NORM, vector(3, lambda c: c))))).alias("e")).select(*keys, "e.*")
    moved = _moments(made, [*keys, "start"]).drop("n").join(middle, keys)
    dev = lambda a: F.col(f"dev_{a}")
    moved = moved.select(*keys, "start", *[(F.col(f"med_{a}") + F.when(F.col("start") == 3, dev(a) * F.col(f"m_{a}")).otherwise(0.0)).alias(f"m_{a}") for a in NAMES], *[(F.col(f"c_{a}_{b}") * dev(a) * dev(b)).alias(f"c_{a}_{b}") for a, b in PAIRS])
    plain = middle.select(*keys, F.lit(0).alias("start"), *[F.col(f"med_{a}").alias(f"m_{a}") for a in NAMES], *[(dev(a) ** 2 if a == b else F.lit(0.0)).alias(f"c_{a}_{b}") for a, b in PAIRS])
    return _factor(plain.unionByName(moved), 1.0)


def _salted(small: DataFrame) -> DataFrame:
    return small.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))


def _concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """One concentration step of every (group, start) of ``estimate``."""
    each = [*keys, "start"]
    known = estimate.select(*each, *SHAPE)
    # a class of distances: 1/512 of the logarithm
    far = _distance(rows.join(_salted(known), [*keys, "salt"])).select(*each, *NAMES, F.floor(F.log(F.col("d2") + 1e-12) * 512).alias("bin"))
    by = Window.partitionBy(*each)
    ranked = far.groupBy(*each, "bin").count().select(*each, "bin", F.sum("count").over(by.orderBy("bin")).alias("upto"), F.sum("count").over(by).alias("n"))
    limit = spool(ranked.where(F.col("upto") >= F.col("n") * HALF).groupBy(*each).agg(F.min("bin").alias("limit")), "mcd-limit")
    return spool(_factor(_moments(far.join(limit, each).where("bin <= limit"), each), CONSISTENCY), "mcd-step")


SHAPE = [*[f"m_{n}" for n in NAMES], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)]]


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, m_x, l_i_j, logdet: the estimate of every group; ``rows`` have keys, salt and x0.. on the grid."""
    tried = spool(_starts(rows, keys), "mcd-start")
    for _ in range(FIRST_STEPS):
        tried = _concentrate(rows, tried, keys)
    fields = ["start", "n", *SHAPE, "logdet"]
    best = spool(tried.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct("logdet", "start")).alias("e")).select(*keys, "e.*"), "mcd-best")
    falling = best
    while not falling.isEmpty():
        # determinants only ever fall, so this ends; groups whose determinant stands are done
        now = _concentrate(rows, falling, keys).select(*keys, F.struct(*fields).alias("now"))
        falling = spool(falling.join(now, keys).where(F.col("now.logdet") < F.col("logdet") - FALLS).select(*keys, "now.*"), "mcd-falling")
        best = spool(best.join(falling.select(*keys), keys, "left_anti").unionByName(falling.select(*best.columns)), "mcd-best")
    return best


def robust_distance(rows: DataFrame, group: list[str], least: int = LEAST) -> DataFrame:
    """``rows`` (spooled, with x0.. and the group columns) with d2 to the group's robust centre."""
    keys = [f"g_{i}" for i in range(len(group))]
    # rows meet what is known of their group by (group, salt), so that no group, however large, is one task
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    other = [c for c in rows.columns if c not in NAMES]
    rows = rows.select(*other, *[(F.rint(F.col(a) * GRID) / float(GRID)).alias(a) for a in NAMES], *[F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(k) for g, k in zip(group, keys)], salt.alias("salt"))
    met = [*keys, "salt"]
    best = estimates(rows.select(*met, *NAMES), keys)
    # small groups take the estimate of all rows' cores
    core = _distance(rows.join(_salted(best.select(*keys, *SHAPE)), met)).where(F.col("d2") <= CUTOFF).select(F.lit(0).alias("all"), *NAMES)
    every = spool(_factor(_moments(core, ["all"]), 1.0), "mcd-all").select(*SHAPE).first()
    if every is None:
        return rows.withColumn("d2", F.lit(0.0)).drop(*met)
    chosen = best.select(*keys, *[F.when(F.col("n") >= least * HALF, F.col(c)).otherwise(F.lit(every[c])).alias(c) for c in SHAPE])
    return _distance(rows.join(_salted(chosen), met)).select(*other, *NAMES, "d2")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, ...] = ("lang", "source"), least: int = LEAST) -> DataFrame:
    """id, the counts, base_failed, kept, d2 of every row; groups under ``least`` rows are held against all rows."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(g).alias(f"group_{i}") for i, g in enumerate(group)])
    keep = [f"group_{i}" for i in range(len(group))]
    rows = counts(named, "id", "text", keep).select("*", *[F.expr(e).alias(n) for n, e, _ in VECTOR])
    rows = spool(rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "outlier-rows")
    # the rules' failures neither shape the estimate nor need it
    passed = robust_distance(rows.where("NOT base_failed"), keep, least)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return passed.select(*columns, (F.col("d2") <= CUTOFF).alias("kept"), "d2").unionByName(rows.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))


def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
