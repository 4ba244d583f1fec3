import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.errors import InvalidParameter
from graphloom.operators import modelling as m


def test_models_and_statistics(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    x[:, 2] = x[:, 0] * 2
    rows = spark.createDataFrame([(i, *map(float, a), float(a[0] + 0.1 * a[1] > 0), float(3 * a[0] - a[1])) for i, a in enumerate(x)], "id long, a double, b double, c double, y double, t double")
    model, score = m.search(rows, ["a", "b", "c"], "y", grid={"regParam": [0.0, 0.01]}, folds=2)
    assert score > 0.9
    _, r2 = m.search(rows, ["a", "b"], "t", "regression", folds=2)
    assert r2 > 0.99
    p = model.transform(rows).select("id", "prediction")
    assert m.ensemble([p, p], [0.5, 1.0]).join(p.withColumnRenamed("prediction", "q"), "id").where(F.abs(F.col("prediction") - F.col("q")) > 1e-9).count() == 0
    c = {(k.a, k.b): k.correlation for k in m.correlations(rows, ["a", "b", "c"]).collect()}
    assert c["a", "c"] == pytest.approx(1) and abs(c["a", "b"]) < 0.3
    assert m.normality(rows, "a").first().p_value > 0.01
    assert m.chi_square(rows.withColumn("s", (F.col("a") > 0).cast("double")), ["s"], "y").first().p_value < 1e-6
    assert len(m.principal_components(rows, ["a", "b", "c"], 2).first().components) == 2
    labels, silhouette = m.clusters(rows, ["a", "b"], 2)
    assert labels.count() == 300 and silhouette > 0.2
    with pytest.raises(InvalidParameter):
        m.assemble(["a"], "nothing")
