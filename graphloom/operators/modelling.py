"""Models over feature tables, and statistics: thin, typed uses of pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, MinMaxScaler, RobustScaler, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import check

SCALERS = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}
MODELS = {("classification", "linear"): LogisticRegression, ("classification", "forest"): RandomForestClassifier, ("regression", "linear"): LinearRegression, ("regression", "forest"): RandomForestRegressor}


def assemble(features: list[str], scaler: str | None = "standard", least_variance: float | None = None, impute: bool = True) -> Pipeline:
    """Stages that turn columns into one vector ``features``."""
    check(scaler is None or scaler in SCALERS, f"scaler must be one of {', '.join(SCALERS)}")
    stages, columns = [], features
    if impute:
        columns = [f"{c}__imputed" for c in features]
        stages.append(Imputer(inputCols=features, outputCols=columns, strategy="median"))
    last = "__assembled"
    stages.append(VectorAssembler(inputCols=columns, outputCol=last))
    if least_variance is not None:
        stages.append(VarianceThresholdSelector(varianceThreshold=least_variance, featuresCol=last, outputCol="__selected"))
        last = "__selected"
    if scaler is not None:
        stages.append(SCALERS[scaler](inputCol=last, outputCol="features"))
    else:
        stages[-1].setOutputCol("features")
    return Pipeline(stages=stages)


def search(rows: DataFrame, features: list[str], label: str, task: str = "classification", model: str = "linear", folds: int = 3, grid: dict[str, list] | None = None, seed: int = 0):
    """(fitted pipeline, best cross-validated score): accuracy for classification, R2 for regression."""
    check((task, model) in MODELS, "task is classification or regression, model linear or forest")
    estimator = MODELS[task, model](featuresCol="features", labelCol=label)
    whole = Pipeline(stages=[assemble(features), estimator])
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder = builder.addGrid(getattr(estimator, name), values)
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if task == "classification" else RegressionEvaluator(labelCol=label, metricName="r2")
    fitted = CrossValidator(estimator=whole, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, seed=seed).fit(rows)
    return fitted.bestModel, max(fitted.avgMetrics)


def ensemble(predictions: list[DataFrame], scores: list[float], key: str = "id") -> DataFrame:
    """(key, prediction): predictions averaged by score."""
    check(len(predictions) == len(scores) > 0 and sum(scores) > 0, "each prediction needs a score")
    rows = None
    for df, s in zip(predictions, scores):
        part = df.select(key, (F.col("prediction") * float(s)).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg((F.sum("x") / float(sum(scores))).alias("prediction"))


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(rows)


def correlations(rows: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, correlation) of each two columns."""
    m = Correlation.corr(_vectors(rows, columns), "__v", method).first()[0].toArray()
    return rows.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], "a string, b string, correlation double")


def chi_square(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, p_value, statistic) of independence from the label."""
    r = ChiSquareTest.test(_vectors(rows, columns), "__v", label).first()
    return rows.sparkSession.createDataFrame([(c, float(p), float(s)) for c, p, s in zip(columns, r.pValues, r.statistics)], "column string, p_value double, statistic double")


def normality(rows: DataFrame, column: str) -> DataFrame:
    """(p_value, statistic) of the Kolmogorov-Smirnov test against the normal distribution of the column's mean and deviation."""
    mean, sd = rows.agg(F.avg(column), F.stddev(column)).first()
    return KolmogorovSmirnovTest.test(rows.select(F.col(column).cast("double").alias("x")), "x", "norm", mean, sd).select(F.col("pValue").alias("p_value"), "statistic")


def principal_components(rows: DataFrame, columns: list[str], k: int, key: str = "id") -> DataFrame:
    """(key, components)."""
    v = _vectors(rows, columns)
    return PCA(k=k, inputCol="__v", outputCol="__c").fit(v).transform(v).select(key, vector_to_array("__c").alias("components"))


def clusters(rows: DataFrame, columns: list[str], k: int, key: str = "id", seed: int = 0) -> tuple[DataFrame, float]:
    """((key, cluster), silhouette)."""
    v = _vectors(rows, columns)
    out = KMeans(k=k, seed=seed, featuresCol="__v").fit(v).transform(v)
    return out.select(key, F.col("prediction").alias("cluster")), ClusteringEvaluator(featuresCol="__v").evaluate(out)


def importances(rows: DataFrame, features: list[str], label: str, top: int | None = None, trees: int = 20, seed: int = 0) -> DataFrame:
    """(feature, importance, place): impurity importances of a random forest, which add up to 1; ``top`` keeps the first ones, as a feature."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(labelCol=label, featuresCol="__v", numTrees=trees, seed=seed).fit(_vectors(rows, features))
    ranked = sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))[:top]
    return rows.sparkSession.createDataFrame([(f, x, i + 1) for i, (f, x) in enumerate(ranked)], "feature string, importance double, place int")
