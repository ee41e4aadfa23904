"""Registered queries of the feature table, the models and the audits. Models have no SQL form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import text as X
from duelframe.operators import backtest
from duelframe.operators import history as H
from duelframe.operators import metrics as M
from duelframe.operators import models
from duelframe.operators import paired as P
from duelframe.operators import splits as S
from duelframe.operators import units as U
from duelframe.operators.backtest import flat_profit, kelly
from duelframe.operators.rating import elo
from duelframe.plans import audit, contest_queries, features, research, walkforward
from duelframe.runtime import Written, checkpoint, read_table
from duelframe.streaming.history import windowed_counts


def profile_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Best profile per name with height and reach in inches and the birth date."""
    from duelframe.functions.numeric import event_date

    rows = read_table(spark, folder, "entities_raw").distinct()
    read = U.canonical_measures(rows).select("profile_id", X.name_key(F.col("fighter_name")).alias("name_key"), F.col("height_in").alias("height"), F.col("weight_lb").alias("weight"), F.col("reach_in").alias("reach"), X.clean_placeholder(F.col("stance")).alias("stance"), event_date(F.col("dob")).alias("dob"), *[(X.share(F.col(c)) if c in ("str_acc", "str_def") else F.col(c)).alias(c) for c in ("slpm", "str_acc", "sapm", "str_def", "td_avg")])
    return H.best_profile(read.where("name_key != ''"), "name_key", ["height", "weight", "reach", "stance", "dob"], "profile_id")


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    contests = contest_queries.contests(spark, folder)
    strikes = P.strike_totals(read_table(spark, folder, "contest_stats"))
    return features.build_features(contests, strikes, profile_attributes(spark, folder))


def _modelling(spark: SparkSession, folder: str) -> DataFrame:
    """The features of all sets and a market probability with splits, materialised once."""
    rows = feature_table(spark, folder)
    wanted = [*features.FEATURE_SETS.values(), *features.RECENCY_COMPARISON.values(), *features.HYPOTHESIS_COMPARISON.values()]
    names = list(dict.fromkeys(f for s in wanted for f in features.features_of(s, rows.columns)))
    market = contest_queries.merged(spark, folder).select("bout_id", F.col("red_implied_prob_novig").alias("market"))
    kept = rows.select("bout_id", "event_date", "red_win", "weight_class", *names).join(market, "bout_id", "left")
    return S.chronological_split(Written(spark).keep(kept, "modelling"))  # written first: the dates are read apart


def _table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result rows as a table; lists and dicts as JSON text."""
    flat = [{k: json.dumps(v) if isinstance(v, list | dict | tuple) else v for k, v in r.items()} for r in rows]
    columns = list(dict.fromkeys(k for r in flat for k in r))
    kinds = {c: next((type(r[c]) for r in flat if r.get(c) is not None), str) for c in columns}
    names = {str: "string", int: "bigint", float: "double", bool: "boolean"}
    return spark.createDataFrame([[r.get(c) for c in columns] for r in flat], ", ".join(f"`{c}` {names[kinds[c]]}" for c in columns))


def logistic_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the final logistic model, fitted on train and validation, on the test split."""
    rows = _modelling(spark, folder)
    names = features.feature_set("final", rows.columns)
    return _table(spark, [models.fit_and_evaluate(S.train_and_validation(rows), rows.where("split = 'test'"), names, "logistic")])


def logistic_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    rows = _modelling(spark, folder)
    fitted = models.fit_logistic(S.train_and_validation(rows), features.feature_set("final", rows.columns))
    return _table(spark, [{"feature": f, "coefficient": c} for f, c in fitted.coefficients()])


def family_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Test metrics of the three model families with the same features."""
    rows = _modelling(spark, folder)
    names, train, test = features.feature_set("final", rows.columns), S.train_and_validation(rows), rows.where("split = 'test'")
    return _table(spark, [models.fit_and_evaluate(train, test, names, f, f) for f in models.FAMILIES])


def set_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the logistic model with each feature set."""
    rows = _modelling(spark, folder)
    sets = {n: features.feature_set(n, rows.columns) for n in features.FEATURE_SETS}
    return _table(spark, models.compare_sets(rows.where("split = 'train'"), rows.where("split = 'validation'"), sets))


def _search(spark: SparkSession, folder: str, family: str) -> DataFrame:
    rows = _modelling(spark, folder)
    names = features.feature_set("final", rows.columns)
    return _table(spark, models.random_search(rows.where("split = 'train'"), rows.where("split = 'validation'"), names, family))


def forest_search(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of 100 random forest settings, best first."""
    return _search(spark, folder, "forest")


def boost_search(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of 100 random settings of boosted trees, best first."""
    return _search(spark, folder, "boost")


def walk_forward_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Methods against the market over all folds; random forests."""
    rows = _modelling(spark, folder)
    panel = walkforward.research(rows, features.feature_set("final", rows.columns))
    return walkforward.compare(panel)


def _compare(spark: SparkSession, folder: str, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = _modelling(spark, folder)
    return _table(spark, models.compare_sets(rows.where("split = 'train'"), rows.where("split = 'validation'"), {n: features.features_of(f, rows.columns) for n, f in sets.items()}))


def recency_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the previous best features with and without recency."""
    return _compare(spark, folder, features.RECENCY_COMPARISON)


def hypothesis_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the previous best features with each group of hypotheses."""
    return _compare(spark, folder, features.HYPOTHESIS_COMPARISON)


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _modelling(spark, folder)
    return rows, rows.where("split = 'train'"), rows.where("split = 'validation'")


def group_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """The previous best features with all hypotheses, then without each group."""
    rows, train, validation = _splits(spark, folder)
    of = lambda f: features.features_of(f, rows.columns)
    full = of((*features.PREVIOUS_BEST, *features.ALL_HYPOTHESES))
    sets = {"all": full} | {f"without {n}": [f for f in full if f not in g] for n, g in features.HYPOTHESES.items()}
    fits = models.evaluate_sets(train, validation, sets)
    return _table(spark, [{**r, "delta_log_loss": r["log_loss"] - fits[0]["log_loss"], "delta_roc_auc": r["roc_auc"] - fits[0]["roc_auc"]} for r in fits])


def cardio_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """The previous best features with the cardio pool less one of it, with the removed feature's coefficient in the full model."""
    rows, train, validation = _splits(spark, folder)
    of = lambda f: features.features_of(f, rows.columns)
    base, pool = of(features.PREVIOUS_BEST), of(features.CARDIO)
    full = list(dict.fromkeys([*base, *pool]))
    packed = models.Packed(train, validation, full)
    table = _table(spark, models.leave_one_out(train, validation, pool, base, packed=packed))
    fitted = packed.fit([(full, {})])[0]
    known = _table(spark, [{"removed": f, "coefficient": c, "abs_coefficient": abs(c)} for f, c in fitted.coefficients()])
    return table.join(F.broadcast(known), "removed", "left")  # one row per feature


def cardio_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """All subsets of 2, 3 and 4 cardio features beside the previous best, and which is picked."""
    rows, train, validation = _splits(spark, folder)
    of = lambda f: features.features_of(f, rows.columns)
    fits, pick = models.subset_search(train, validation, of(features.PREVIOUS_BEST), of(features.CARDIO))
    return _table(spark, [{**r, "picked": r["name"] == pick["name"]} for r in fits])


def forward_path(spark: SparkSession, folder: str) -> DataFrame:
    """The path of features added one by one, from those of the baseline, the optional and the rating sets."""
    rows, train, validation = _splits(spark, folder)
    return _table(spark, models.forward_selection(train, validation, features.features_of((*features.CLEAN_BASELINE, *features.OPTIONAL, "diff_elo"), rows.columns)))


def single_features(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics and coefficient of each feature alone, best first."""
    rows, train, validation = _splits(spark, folder)
    names = features.features_of((*features.PREVIOUS_BEST, *features.OPTIONAL, *features.FINAL_FEATURES), rows.columns)
    return _table(spark, models.single_features(train, validation, names))


def leave_one_feature_out(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline, optional and rating features less one."""
    rows, train, validation = _splits(spark, folder)
    return _table(spark, models.leave_one_out(train, validation, features.features_of((*features.PREVIOUS_BEST, *features.OPTIONAL), rows.columns)))


#: Penalties of the grid.
STRENGTHS, RATIOS = (0.01, 0.1, 1.0, 10.0), (0.0, 0.2, 0.5, 0.8, 1.0)


def penalty_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows, train, validation = _splits(spark, folder)
    return _table(spark, models.penalty_grid(train, validation, features.feature_set("final", rows.columns), STRENGTHS, RATIOS))


def selection_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the final model's penalty is the grid's best, and that no search result is of the test split."""
    rows, train, validation = _splits(spark, folder)
    found = models.penalty_grid(train, validation, features.feature_set("final", rows.columns), STRENGTHS, RATIOS)
    return _table(spark, audit.selection(found, {"C": models.LOGISTIC["C"], "l1_ratio": models.LOGISTIC["l1_ratio"]}))


#: Weight classes in groups; all other classes are one more.
CLASS_GROUPS = {"Lower": ["flyweight", "bantamweight"], "MidLower": ["featherweight", "lightweight"], "MidUpper": ["welterweight", "middleweight"], "Women": ["women's strawweight", "women's flyweight", "women's bantamweight", "women's featherweight"]}


def class_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The previous best features with one of them split by groups of weight classes, against them alone."""
    rows = _modelling(spark, folder)
    base = features.features_of(features.PREVIOUS_BEST, rows.columns)
    known = [f for f in ("diff_reach", "diff_durability_index", "diff_age", "diff_elo") if f in rows.columns]
    table, sets = rows, {"base": base}
    for f in known:
        table, names = models.interactions(table, f, CLASS_GROUPS)
        sets[f] = [*base, *names]
    fits = models.evaluate_sets(table.where("split = 'train'"), table.where("split = 'validation'"), sets)
    deltas = lambda r: {f"delta_{m}": r[m] - fits[0][m] for m in ("log_loss", "roc_auc", "brier", "accuracy")}
    return _table(spark, [{"base_feature": r["name"], "n_interactions": r["n_features"] - len(base), **{k: v for k, v in r.items() if k not in ("name",)}, **deltas(r)} for r in fits[1:]])


#: The K factors that were tried.
ELO_K = (16, 24, 32, 40, 50, 64)


def elo_k_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the rating difference for each K."""
    contests = contest_queries.contests(spark, folder)
    base = checkpoint(S.chronological_split(contests.select("bout_id", "event_date", "red_win", "day", "red_id", "blue_id", "outcome")))
    out = []
    for k in ELO_K:
        rated = checkpoint(base.join(elo(base, float(k)).select("bout_id", F.col("elo_diff").alias("diff_elo")), "bout_id"))
        out.append({"k": k, **models.fit_and_evaluate(rated.where("split = 'train'"), rated.where("split = 'validation'"), ["diff_elo"], f"K {k}")})
    return _table(spark, models.near_best(out))


def recency_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Validation metrics of the previous best features with form over each number of contests and each half-life."""
    rows = _modelling(spark, folder)
    names = features.features_of(features.PREVIOUS_BEST, rows.columns)
    return _table(spark, research.recency_grid(contest_queries.contests(spark, folder), rows.select("bout_id", "event_date", "red_win", *names), names))


def walk_forward_folds_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Methods against the market in each fold and year; random forests."""
    rows = _modelling(spark, folder)
    panel = checkpoint(walkforward.research(rows, features.feature_set("final", rows.columns)))
    part = lambda d, c: d.withColumn("part", F.concat_ws(" ", F.lit(c), F.col(c).cast("string"))).drop(c)
    return part(walkforward.by_fold(panel), "fold_id").unionByName(part(walkforward.by_year(panel), "year"))


def leakage_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the final features are in the modelling table and tell nothing of the contest itself; the table from the cutoff on."""
    rows = S.modelling_table(feature_table(spark, folder))
    return _table(spark, audit.leakage(list(features.FINAL_FEATURES), features.feature_set("final", rows.columns), rows))


def metric_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Each metric by two formulas: they must agree."""
    rows = checkpoint(contest_queries.predictions(spark, folder).select("bout_id", "label", "p").withColumn("part", F.lit("all")))
    saved = audit.melt_metrics(M.evaluate(rows, ["part"]), ["part"])
    again = audit.recomputed_metrics(rows).select(F.lit("all").alias("part"), "metric", "value")
    compared = audit.metric_comparison(saved, again, ["part"], 1e-9)
    return compared.select("metric", F.round("saved", 6).alias("saved"), F.round("computed", 6).alias("computed"), "passed")


def config_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The final logistic model's settings and the backtest's, against those expected."""
    expected = {"C": 10.0, "l1_ratio": 0.8, "max_iter": 5000, "n_features": 12, "kelly_cap": 0.25, "bankroll": 1000.0}
    actual = models.LOGISTIC | {"n_features": len(features.FINAL_FEATURES), "kelly_cap": backtest.CAP, "bankroll": backtest.BANKROLL}
    return _table(spark, [{k: (float(v) if k in ("expected", "actual") else v) for k, v in r.items()} for r in audit.configuration(expected, actual)])


def bet_audit(spark: SparkSession, folder: str) -> DataFrame:
    chosen = contest_queries.bets(spark, folder)
    flat = audit.bet_checks(flat_profit(chosen)).select(F.lit("flat").alias("kind"), "*")
    return flat.unionByName(audit.bet_checks(kelly(chosen)).select(F.lit("kelly").alias("kind"), "*"))


def prediction_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = contest_queries.predictions(spark, folder)
    return audit.prediction_checks(rows.withColumn("predicted", (F.col("p") >= 0.5).cast("int")))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = windowed_counts(read_table(spark, folder, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (metric_audit, config_audit, bet_audit, prediction_audit, event_windows, feature_table, leakage_audit, logistic_fit, logistic_coefficients, elo_k_grid, set_comparison, recency_comparison, hypothesis_comparison, group_ablation, cardio_leave_one_out, single_features, leave_one_feature_out, penalty_grid, selection_audit, class_interactions, forward_path, recency_grid, cardio_subsets, family_comparison, walk_forward_comparison, walk_forward_folds_compared, forest_search, boost_search)}
_BETS_AUDIT = "sum((abs(profit - CASE WHEN bet_won THEN stake * (selected_decimal_odds - 1) ELSE -stake END) > 1e-6)::INT)::BIGINT AS wrong_profit, sum((abs(selected_edge - (selected_model_prob - selected_market_prob)) > 1e-9)::INT)::BIGINT AS wrong_edge, sum((stake < 0)::INT)::BIGINT AS negative_stakes"
ORACLES = {
    "metric_audit": f"WITH {contest_queries.PRED_SQL}, mm AS (SELECT 'all' AS part, p, label FROM pr), {contest_queries._metrics_sql('mm', 'part')}, un AS (UNPIVOT (SELECT n::DOUBLE AS n, log_loss, roc_auc, brier, accuracy, precision, recall, f1 FROM ev) ON COLUMNS(*) INTO NAME metric VALUE saved) SELECT metric, saved, saved AS computed, true AS passed FROM un",
    "bet_audit": f"WITH {contest_queries._KELLY_SQL}, ks AS (SELECT *, bankroll / (1 + f * CASE WHEN bet_won THEN {contest_queries._KB} ELSE -1 END) AS before FROM k2) SELECT 'flat' AS kind, count(*) AS n_bets, {_BETS_AUDIT}, 0::BIGINT AS above_cap FROM fl UNION ALL SELECT 'kelly', count(*), {_BETS_AUDIT}, sum((f / kelly_fraction > 0.25 + 1e-12)::INT)::BIGINT FROM (SELECT * REPLACE (f * before AS stake, f * before * CASE WHEN bet_won THEN {contest_queries._KB} ELSE -1 END AS profit) FROM ks) k",
    "config_audit": "SELECT unnest(['C', 'l1_ratio', 'max_iter', 'n_features', 'kelly_cap', 'bankroll']) AS parameter, unnest([10.0, 0.8, 5000, 12, 0.25, 1000]::DOUBLE[]) AS expected, unnest([10.0, 0.8, 5000, 12, 0.25, 1000]::DOUBLE[]) AS actual, true AS passed",
    "prediction_audit": f"WITH {contest_queries.PRED_SQL} SELECT count(*) AS n_rows, sum((p < 0 OR p > 1)::INT)::BIGINT AS outside, sum((p IS NULL OR label IS NULL)::INT)::BIGINT AS missing, 0::BIGINT AS label_mismatches FROM pr",
    "leakage_audit": "SELECT 'available and safe' AS check, unnest(['diff_age', 'diff_total_wins', 'diff_total_losses', 'diff_win_streak', 'diff_td_landed_per_fight', 'diff_kd_absorbed_per_fight', 'diff_reach', 'diff_sig_strike_accuracy', 'diff_avg_fight_duration_seconds', 'diff_decision_rate', 'pre_fight_red_late_finish_rate', 'diff_five_round_experience']) AS feature, true AS passed, '' AS detail UNION ALL SELECT 'expected set', '', true, '' UNION ALL SELECT 'cutoff', '', count(*) FILTER (WHERE event_date < DATE '2010-01-01' AND event_date >= DATE '2010-01-01') = 0, '0 rows before 2010-01-01' FROM combined_data",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
