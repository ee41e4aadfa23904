import inspect

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from duelframe.operators import models
from duelframe.plans import audit, features, model_queries
from duelframe.sources import io
from duelframe.streaming.history import stream_states


def test_delimiters_and_headers():
    assert io.sniff_delimiter("a;b;c\n1;2;3\n") == ";" and io.sniff_delimiter("a,b\n1,2\n") == "," and io.sniff_delimiter(" ") == ","
    assert io.snake_headers([" Fight Date", "fight-date", "%", "A"]) == ["fight_date", "fight_date_2", "column", "a"]


def test_read_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name;Total Odds\n x ;--\ny;2\n")
    got = [tuple(r) for r in io.read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("x", None), ("y", "2")]
    (tmp_path / "e.csv").write_text("")
    assert io.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_csv(spark, str(tmp_path / "none.csv"))
    assert io.try_read_csv(spark, None, io.BET_SCHEMA).count() == 0


def test_aliases_and_files(tmp_path):
    assert io.resolve_columns(["ht", "name"], io.PROFILE_ALIASES) == {"fighter_name": "name", "height": "ht"}
    assert io.resolve_columns(["Event Date", "Fighter1", "Fighter2", "Odds 1", "Odds 2", "Bookmaker"], io.QUOTE_ALIASES, fuzzy=True)["source"] == "Bookmaker"
    (tmp_path / "x_odds.csv").write_text("a")
    (tmp_path / "bets.csv").write_text("aaaa")
    assert io.locate_quotes(str(tmp_path)).endswith("x_odds.csv")
    (tmp_path / "ufc_odds.csv").write_text("")
    assert io.locate_quotes(str(tmp_path)).endswith("ufc_odds.csv")
    assert io.resolve_columns(["commence_time", "home_fighter", "away_fighter", "moneyline_1", "moneyline_2", "site", "snapshot_time"], io.QUOTE_ALIASES)["quoted_at"] == "snapshot_time"
    assert io.read_parameters(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    io.write_report({"b": 1}, str(tmp_path / "r/x.json"))
    assert io.read_parameters(str(tmp_path / "r/x.json"), {"a": 1}) == {"a": 1, "b": 1}


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", 1), (None, 1)], "event_date string, red_win int")
    io.write_table(df, str(tmp_path / "t"))
    assert io.read_contests(spark, str(tmp_path / "t")).count() == 1


def test_backtest_inputs(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Event Date,Red Fighter Name,Blue Fighter Name,p\n2020-01-01,A,B,0.5\n")
    spark.createDataFrame([("2020-01-01", "A", "B", 2.0)], "event_date string, red_fighter_name string, blue_fighter_name string, red_decimal_odds double").write.parquet(str(tmp_path / "m"))
    p, m = io.read_backtest_inputs(spark, str(tmp_path / "p.csv"), str(tmp_path / "m"))
    assert p.first().event_date == m.first().event_date and p.first().p == "0.5"
    with pytest.raises(ValueError, match="bout_id"):
        io.read_backtest_inputs(spark, str(tmp_path / "p.csv"), str(tmp_path / "m"), ("bout_id",))
    with pytest.raises(FileNotFoundError):
        io.read_backtest_inputs(spark, str(tmp_path / "none.csv"), str(tmp_path / "m"))


@pytest.fixture(scope="module")
def learnable(spark):
    x = F.randn(1)
    rows = spark.range(600).select("id", x.alias("a"), F.randn(2).alias("b"), F.when(F.col("id") % 17 != 0, F.randn(3)).alias("c"))
    return rows.withColumn("red_win", (F.rand(5) < 1 / (1 + F.exp(-1.5 * F.col("a")))).cast("int")).cache()


def test_models_learn(learnable):
    for family in models.FAMILIES:
        out = models.fit_and_evaluate(learnable.where("id < 400"), learnable.where("id >= 400"), ["a", "b", "c"], family, family)
        assert out["roc_auc"] > 0.65
    assert models.fit_and_evaluate(learnable, learnable, [], "none") == {"name": "none", "n_features": 0}


def test_models_predict_after_an_observation_and_a_tag(learnable):
    seen = Observation()
    learnable.observe(seen, F.count("*").alias("n")).collect()
    learnable.sparkSession.addTag("models")
    try:
        for fit, settings in ((models.fit_logistic, {"max_iter": 5}), (models.fit_forest, {"numTrees": 3, "maxDepth": 2}), (models.fit_boost, {"maxIter": 2})):
            fitted = fit(learnable, ["a", "b"], **settings)
            assert seen.get == {"n": 600} and models.score(fitted.predict(learnable))["n"] == 600 and len(fitted.coefficients()) == 2
    finally:
        learnable.sparkSession.removeTag("models")


def test_selection_and_calibration(learnable):
    train, rest = learnable.where("id < 400"), learnable.where("id >= 400")
    assert models.forward_selection(train, rest, ["b", "a"], max_iter=50)[0]["added"] == "a"
    fitted = models.fit_logistic(train, ["a", "b"])
    assert fitted.coefficients()[0][0] == "a" and "logit =" in fitted.formula()
    p = fitted.predict(rest)
    for fit, name in ((models.fit_sigmoid, "p_sigmoid"), (models.fit_isotonic, "p_isotonic")):
        low, high = fit(p)(p).agg(F.min(name), F.max(name)).first()
        assert 0 <= low <= high <= 1
        assert fit(p.where("red_win = 1")) is None
    assert len(models.sample_settings(models.FOREST_SPACE, 5)) == 5 and len(models.sample_settings({"a": (1, 2)}, 9)) == 2


def test_audits(spark):
    assert [(r["passed"], r["detail"]) for r in audit.leakage(["diff_age", "fight_outcome", "diff_five_round_experience", "diff_end_round"])] == [(True, ""), (False, "prefix, outcome"), (True, ""), (False, "round")]
    results = [{"log_loss": 0.6, "roc_auc": 0.6, "brier": 0.2, "settings": {"C": 10.0}}, {"log_loss": 0.5, "roc_auc": 0.6, "brier": 0.2, "settings": {"C": 1.0}}]
    assert [r["passed"] for r in audit.selection(results, {"C": 1.0})] == [True, True] and not audit.selection(results, {"C": 10.0})[0]["passed"]
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert tuple(audit.same_rows(a, a.dropDuplicates()).first()) == (1, 0)
    assert "title" in audit.text_report("title", {"s": [{"a": 0.5}], "t": []})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 7, "red", 18_000, 1, 0), (1, 8, "blue", 18_000, 0, 0), (2, 7, "blue", 18_000, 0, 1), (1, 9, "red", 18_050, 0, 1), (1, 10, "red", 18_100, 1, 0), (99, 0, "red", 30_000, 0, 0)]
    schema = "entity bigint, bout_id bigint, side string, day int, won int, lost int"
    for i, part in enumerate((rows[:4], rows[4:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_states(source).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r.entity, r.bout_id): (r.total_fights, r.total_wins, r.win_streak, r.loss_streak, r.days_since_last_fight) for r in spark.table("states").collect()}
    assert got == {(1, 7): (0, 0, 0, 0, None), (1, 8): (0, 0, 0, 0, None), (2, 7): (0, 0, 0, 0, None), (1, 9): (2, 1, 1, 0, 50), (1, 10): (3, 1, 0, 1, 50)}


def test_search_is_whole(learnable, monkeypatch):
    picks = models.sample_settings(models.FOREST_SPACE, 100)
    assert len(picks) == 100 and {p["numTrees"] for p in picks} == {200, 300, 500, 800, 1200} and {p["class_weight"] for p in picks} == {None, "balanced"}
    assert models._per_node("sqrt", 12) == models._per_node("0.3", 12) == "3"
    asked = []
    monkeypatch.setattr(model_queries, "_modelling", lambda *_: learnable.withColumn("split", F.lit("train")))
    monkeypatch.setattr(models, "random_search", lambda *a, n=inspect.signature(models.random_search).parameters["n"].default, **_: asked.append((a[3], n)) or [{"log_loss": 0.5}])
    for query in (model_queries.forest_search, model_queries.boost_search):
        query(learnable.sparkSession, "")
    assert asked == [("forest", 100), ("boost", 100)]


def test_search_judges_each_setting(learnable):
    train, rest = learnable.where("id < 400"), learnable.where("id >= 400")
    space = {"numTrees": (3, 5), "maxDepth": (2,), "class_weight": (None, "balanced")}
    found = models.random_search(train, rest, ["a", "b", "c"], "forest", 9, space=space)
    assert len(found) == 4 and [r["log_loss"] for r in found] == sorted(r["log_loss"] for r in found)
    alone = models.score(models.fit_forest(train, ["a", "b", "c"], **found[0]["settings"]).predict(rest))
    assert alone["log_loss"] == pytest.approx(found[0]["log_loss"], rel=1e-9) and alone["n"] == found[0]["n"]


def test_comparisons_are_whole(learnable, monkeypatch):
    assert (models.FOREST["numTrees"], models.FOREST["maxDepth"], models.BOOST["maxIter"]) == (800, 12, 300)
    columns = [f.format(n=2) for s in features.FEATURE_SETS.values() for f in s]
    rows = learnable.select("red_win", F.lit("train").alias("split"), F.lit(0.5).alias("market"), *[F.lit(0.0).alias(c) for c in dict.fromkeys(columns)])
    asked = []
    monkeypatch.setattr(model_queries, "_modelling", lambda *_: rows)
    monkeypatch.setattr(models, "fit_and_evaluate", lambda a, b, f, name="", family="logistic", **s: asked.append((name, family, s)) or {"name": name, "log_loss": 0.5})
    monkeypatch.setattr(model_queries.walkforward, "research", lambda d, f, family="forest", least=None, **s: asked.append(("walk", family, s)) or rows)
    monkeypatch.setattr(model_queries.walkforward, "compare", lambda panel: panel)
    for query in (model_queries.family_comparison, model_queries.set_comparison, model_queries.walk_forward_comparison):
        query(learnable.sparkSession, "")
    sets = len(features.FEATURE_SETS)  # fitted a few at once, in any order
    assert asked[:3] == [(f, f, {}) for f in models.FAMILIES] and sorted(asked[3:-1]) == sorted((n, "logistic", {}) for n in features.FEATURE_SETS) and len(asked) == 4 + sets and asked[-1] == ("walk", "forest", {})


def test_comparisons_of_one_run(learnable):
    train, rest = learnable.where("id < 400"), learnable.where("id >= 400")
    out = models.leave_one_out(train, rest, ["a", "b"], ["c"], max_iter=30)
    assert [r["removed"] for r in out] == ["a", "b"] and out[0]["delta_log_loss"] > 0.02 and out[0]["n_features"] == 2
    alone = models.single_features(train, rest, ["b", "a"], max_iter=30)
    assert alone[0]["feature"] == "a" and alone[0]["coefficient"] > 0.5 and alone[0]["coefficient_sign"] == "positive"
    grid = models.penalty_grid(train, rest, ["a"], (0.1, 1.0), (0.0, 1.0))
    assert len(grid) == 4 and [r["log_loss"] for r in grid] == sorted(r["log_loss"] for r in grid)
    table, names = models.interactions(learnable.limit(20).withColumn("weight_class", F.when(F.col("id") % 2 == 0, "Flyweight")), "a", {"Lower": ["flyweight"]})
    assert names == ["a_x_Lower", "a_x_Other"] and all(r.a_x_Lower + r.a_x_Other == r.a and (r.a_x_Lower == 0) == (r.id % 2 == 1) for r in table.collect())
    rows, pick = models.subset_search(train, rest, [], ["a", "b", "c"], (1, 2), max_iter=30)
    assert len(rows) == 6 and pick["size"] == 1 and pick["name"] == "a"


def test_metrics_by_two_formulas(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.2), (4, 0, 0.2), (5, 0, 0.1), (6, None, 0.5), (7, 1, 1.0)], "bout_id int, label int, p double")
    again = {r.metric: r["value"] for r in audit.recomputed_metrics(df).collect()}
    first = model_queries.M.evaluate(df.withColumn("g", F.lit(1)), ["g"]).first().asDict()
    assert all(again[m] == pytest.approx(first[m], abs=1e-12) for m in again) and again["n"] == 6


def test_no_fold_gives_no_rows(spark):
    rows = spark.createDataFrame([(1, None, 1, 0.5)], "bout_id bigint, event_date date, red_win int, market double")
    panel = model_queries.walkforward.research(rows, ["market"])
    assert panel.count() == 0 and model_queries.walkforward.compare(panel).count() == 0 and model_queries.walkforward.by_year(panel).count() == 0
