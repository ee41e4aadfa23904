"""Trees that are grown within tasks, against Spark ML's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelframe.operators import models
from duelframe.operators import trees as T
from duelframe.plans import walkforward


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(0, 1200, 1, 3).select("id", F.randn(1).alias("a"), F.round(F.randn(2) * 2).alias("b"), F.when(F.col("id") % 7 != 0, F.randn(3)).alias("c"))
    return rows.withColumn("red_win", (F.rand(5) < 1 / (1 + F.exp(-1.5 * F.col("a") * F.signum(F.col("b"))))).cast("int")).cache()


def test_one_split():
    x = np.array([[0, 3], [1, 3], [2, 3], [3, 3], [4, 3], [5, 3]], np.uint8)
    y = np.array([0, 0, 0, 0, 1, 1], float)
    for kind in ("gini", "entropy", "variance"):
        gains = np.zeros(2)
        tree = T.grow(x, np.arange(6), None, y, 3, 2, 1, kind, (1.0, 1.0), np.random.default_rng(1), gains)
        assert tree[0].tolist() == [0, -1, -1] and tree[1][0] == 3 and T.values(tree, x).tolist() == y.tolist() and gains[0] > 0 == gains[1]
    assert T.grow(x, np.arange(6), None, y, 3, 2, 4, "gini", (1.0, 1.0), np.random.default_rng(1), np.zeros(2))[0].tolist() == [-1]


@pytest.mark.parametrize(("fit", "settings"), [(models.fit_forest, {"numTrees": 60, "maxDepth": 5}), (models.fit_boost, {"maxIter": 20, "stepSize": 0.1})])
def test_as_good_as_spark_ml(spark, table, monkeypatch, fit, settings):
    train, rest = table.where("id < 800"), table.where("id >= 800")
    sc = spark.sparkContext
    sc.setJobGroup(fit.__name__, "")
    ours = fit(train, ["a", "b", "c"], **settings)
    jobs = len(sc.statusTracker().getJobIdsForGroup(fit.__name__))
    sc.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(models, "IN_TASK", 0)
    theirs = fit(train, ["a", "b", "c"], **settings)
    a, b = (models.score(m.predict(rest)) for m in (ours, theirs))
    assert 0 < jobs < 12 and isinstance(ours, models.Ensemble) and not isinstance(theirs, models.Ensemble)
    assert abs(a["log_loss"] - b["log_loss"]) < 0.02 and abs(a["roc_auc"] - b["roc_auc"]) < 0.03
    assert ours.coefficients()[-1][0] == theirs.coefficients()[-1][0] == "c"


@pytest.mark.parametrize(("family", "fit", "space"), [("forest", models.fit_forest, {"numTrees": (3, 5, 8), "maxDepth": (2, 30)}), ("boost", models.fit_boost, {"maxIter": (3, 5, 8), "maxDepth": (2, 3)})])
def test_search_is_few_jobs(spark, table, family, fit, space):
    train, rest = table.where("id < 800"), table.where("id >= 800")
    sc = spark.sparkContext
    sc.setJobGroup(f"search {family}", "")
    found = models.random_search(train, rest, ["a", "b", "c"], family, 6, space=space)
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"search {family}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 6 and 0 < jobs < 40
    alone = models.score(fit(train, ["a", "b", "c"], **found[0]["settings"]).predict(rest))
    assert alone["log_loss"] == pytest.approx(found[0]["log_loss"], rel=1e-9)


def test_a_fold_predicts_each_row_once(spark, table, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    class Counted:
        def predict(self, df):
            @F.pandas_udf("double")
            def p(a: pd.Series) -> pd.Series:
                asked.add(len(a))
                return 1 / (1 + np.exp(-a))

            return df.withColumn("p", p("a"))

    monkeypatch.setitem(models.FAMILIES, "counted", lambda *_, **__: Counted())
    rows = table.withColumn("market", F.lit(0.4))
    out = walkforward.fold_predictions(rows.where("id < 600"), rows.where("id >= 600 AND id < 900"), rows.where("id >= 900"), ["a"], "counted")
    assert out.count() == 300 and out.agg(F.sum("sigmoid")).first()[0] > 0 and asked.value == 600
