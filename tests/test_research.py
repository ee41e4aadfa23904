import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from duelframe.plans import contest_queries as Q
from duelframe.plans import model_queries, research
from duelframe.runtime import read_table


def test_quotes_to_diagnostics(spark, tiny):
    contests = Q.contests(spark, tiny)
    quotes = research.ingest_quotes(read_table(spark, tiny, "quotes_raw"), contests, Q.QUOTE_NAMES)
    assert quotes["source"].count() == 1 and quotes["merged"].count() == contests.count()
    rate = quotes["match_rate"].first()
    assert 0 < rate.n_matched < rate.n_contests
    run = research.run_backtest(Q.predictions(spark, tiny), quotes["merged"])
    assert run["flat"].count() > 0 and run["kelly"].count() > 0 and run["best"].count() == 1
    tables = research.diagnose(run["bets"], run["best"])
    assert tables["segment_odds"].count() == 5 and tables["rolling"].count() == run["best"].first().n_bets
    assert research.compare_backtests({"a": run, "b": run}).count() == 2


def test_recency_grid(spark, tiny):
    contests = Q.contests(spark, tiny)
    rows = research.recency_grid(contests, contests.select("bout_id", "event_date", "red_win"), [], (2,), (365.0,), max_iter=20)
    assert [r["kind"] for r in rows] == ["last_n", "half_life"] and any(r["near_best"] for r in rows)


@pytest.fixture
def observed(spark):
    """A session with an observation, which can't be sent to tasks."""
    spark.range(5).observe(Observation(), F.count("*").alias("n")).collect()
    return spark


def test_elo_k_grid_in_an_observed_session(observed, tiny):
    rows = model_queries.elo_k_grid(observed, tiny).collect()
    assert [r.k for r in rows] == list(model_queries.ELO_K) and any(r.near_best for r in rows)


def test_recency_grid_in_an_observed_session(observed, tiny):
    contests = Q.contests(observed, tiny)
    rows = research.recency_grid(contests, contests.select("bout_id", "event_date", "red_win"), [], (2,), (), max_iter=20)
    assert [r["kind"] for r in rows] == ["last_n"] and rows[0]["near_best"]


@pytest.fixture
def modelled(observed, monkeypatch):
    """An observed session in which the model queries get a small modelling table of a few of their features."""
    noise = lambda k: (F.pmod(F.hash("bout_id", F.lit(k)), F.lit(100)) / 50 - 1).cast("double")
    features = ["diff_age", "diff_elo", "diff_reach", "diff_loss_streak", "diff_momentum_win_pct", "diff_decision_rate"]
    rows = observed.range(0, 160, 1, 1).withColumnRenamed("id", "bout_id").select("bout_id", *[noise(k).alias(f) for k, f in enumerate(features)])
    split = F.when(F.col("bout_id") < 100, "train").when(F.col("bout_id") < 140, "validation").otherwise("test")
    rows = rows.withColumns({"red_win": (F.col("diff_elo") + noise(9) > 0).cast("int"), "weight_class": F.when(F.col("bout_id") % 2 == 0, "flyweight").otherwise("lightweight"), "split": split}).cache()
    monkeypatch.setattr(model_queries, "_modelling", lambda *_: rows)
    return observed


@pytest.mark.parametrize(("query", "n"), [("set_comparison", 10), ("hypothesis_comparison", 9), ("group_ablation", 8), ("single_features", 5), ("leave_one_feature_out", 4), ("selection_audit", 2), ("class_interactions", 3)])
def test_model_queries_in_an_observed_session(modelled, query, n):
    assert model_queries.QUERIES[query](modelled, "").count() == n
