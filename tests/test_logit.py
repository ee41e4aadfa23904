"""Logistic regressions of many sets, solved together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import logit, models
from duelframe.plans import features, model_queries


@pytest.fixture(scope="module")
def table(spark):
    """``d`` is ``a`` less ``b``; ``c`` has gaps, ``k`` doesn't vary, ``e`` has no values."""
    rows = spark.range(0, 900, 1, 3).select("id", F.randn(1).alias("a"), F.round(F.randn(2) * 2).alias("b"), F.when(F.col("id") % 7 != 0, F.randn(3)).alias("c"), F.lit(2.0).alias("k"), F.lit(None).cast("double").alias("e"))
    return rows.withColumns({"d": F.col("a") - F.col("b"), "red_win": (F.rand(5) < 1 / (1 + F.exp(-1.5 * F.col("a")))).cast("int")}).cache()


def slope(table, fitted, l1, l2):
    """The largest part of the objective's slope that the absolute penalty doesn't hold."""
    x, y = np.array([[*r.features.toArray()] for r in fitted.scaler.apply(table).collect()]), np.array([r.red_win for r in table.collect()])
    c = np.array(fitted.model.coefficients)
    off = 1 / (1 + np.exp(-(fitted.model.intercept + x @ c))) - y
    g = x.T @ off / len(y) + l2 * c
    return max(abs(off.mean()), *np.where(c != 0, np.abs(g + l1 * np.sign(c)), np.maximum(np.abs(g) - l1, 0)))


def test_fit_is_at_the_least(table):
    for C, ratio in ((10.0, 0.8), (0.02, 0.5), (1.0, 1.0), (1.0, 0.0)):
        fitted = models.fit_logistic(table, ["a", "b", "c", "k", "e", "d"], C=C, l1_ratio=ratio)
        assert slope(table, fitted, ratio / (C * 900), (1 - ratio) / (C * 900)) < 1e-8
    known = models.Scaler.fit(table, ["a", "b", "c", "k", "e", "d"])
    assert fitted.scaler.medians == pytest.approx(known.medians) and fitted.scaler.deviations == pytest.approx(known.deviations)


def test_subsets_are_fitted_together(spark, table):
    sc, pool = spark.sparkContext, ["a", "b", "c", "k", "d"]
    sc.setJobGroup("subsets", "")
    try:
        rows, pick = models.subset_search(table.where("id < 600"), table.where("id >= 600"), ["e"], pool)
        jobs = sc.statusTracker().getJobIdsForGroup("subsets")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 25 and pick["size"] == 2 and 0 < len(jobs) < 80
    one = rows[7]
    alone = models.score(models.fit_logistic(table.where("id < 600"), one["features"]).predict(table.where("id >= 600")))
    assert all(one[k] == pytest.approx(v) for k, v in alone.items())


def test_one_class_and_no_rows(table):
    won = models.fit_logistic(table.where("red_win = 1"), ["a"])
    assert won.model.intercept == np.inf and won.predict(table).where("p != 1").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        models.fit_logistic(table.where("id < 0"), ["a"])


def test_medians_of_odd_values(spark):
    rows = spark.createDataFrame([(-0.0, float("nan"), 1e-300, None), (0.0, -5.0, -1e300, None), (-3.5, 2.0, 7.0, None)], "a double, b double, c double, e double").withColumn("red_win", F.lit(1))
    found = logit.Blocks(rows.repartition(2), ["a", "b", "c", "e"], "red_win").medians()
    assert found[:3].tolist() == [0.0, -1.5, 1e-300] and np.isnan(found[3])


@pytest.fixture
def modelled(spark, monkeypatch):
    """A small modelling table with the features of all sets."""
    sets = [*features.FEATURE_SETS.values(), *features.RECENCY_COMPARISON.values(), *features.HYPOTHESIS_COMPARISON.values()]
    names = list(dict.fromkeys(f.format(n=2) for s in sets for f in s))
    noise = lambda k: (F.pmod(F.hash("bout_id", F.lit(k)), F.lit(1000)) / 500 - 1).cast("double")
    rows = spark.range(0, 400, 1, 2).withColumnRenamed("id", "bout_id").select("bout_id", *[noise(k).alias(f) for k, f in enumerate(names)])
    split = F.when(F.col("bout_id") < 250, "train").when(F.col("bout_id") < 340, "validation").otherwise("test")
    rows = rows.withColumns({"red_win": (F.col("diff_elo") + noise(-1) > 0).cast("int"), "weight_class": F.when(F.col("bout_id") % 2 == 0, "flyweight").otherwise("lightweight"), "split": split}).cache()
    monkeypatch.setattr(model_queries, "_modelling", lambda *_: rows)
    return spark


def jobs_of(spark, run, group):
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


#: Queries of several logistic models and their rows: the jobs don't grow with the models.
TOGETHER = {
    "class_interactions": 4,
    "hypothesis_comparison": 9,
    "cardio_leave_one_out": 7,
    "group_ablation": 8,
    "leave_one_feature_out": 15,
    "set_comparison": 17,
}


@pytest.mark.parametrize("query", TOGETHER)
def test_models_of_a_query_are_fitted_together(modelled, query):
    out, jobs = jobs_of(modelled, lambda: model_queries.QUERIES[query](modelled, "").collect(), query)
    assert len(out) == TOGETHER[query] and 0 < jobs < 80
