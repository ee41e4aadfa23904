"""The long-form runs: quotes to merged contests, backtests, diagnostics and recency grids, each as a dict of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import backtest as B
from duelframe.operators import diagnostics as G
from duelframe.operators import history as H
from duelframe.operators import metrics as M
from duelframe.operators import models
from duelframe.operators import odds as O
from duelframe.operators import paired as P
from duelframe.operators import splits as S
from duelframe.runtime import Written, checkpoint


def ingest_quotes(quotes: DataFrame, contests: DataFrame, names: dict[str, str] | None = None, source: str | None = None) -> dict[str, DataFrame]:
    """Coverage, the chosen source's latest quotes with probabilities, contests with prices, what didn't match, and quality.

    ``source`` is preferred if it covers enough. Tables are lazy: only those that are used are computed.
    """
    standard = O.standard_quotes(quotes, names)
    coverage = O.source_coverage(standard)
    chosen = O.choose_source(coverage, source)
    picked = O.latest_quotes(standard.join(F.broadcast(chosen), "source", "left_semi"))  # one row
    merged = O.merge_quotes(contests, O.implied_probabilities(picked))
    rate = merged.agg(F.count("*").alias("n_contests"), F.sum(F.col("matched").cast("int")).alias("n_matched"), F.avg(F.col("matched").cast("double")).alias("match_rate"))
    return {"coverage": coverage, "source": chosen, "format": O.odds_format(picked), "merged": merged, "match_rate": rate, "unmatched_quotes": O.unmatched_quotes(picked, contests), "unmatched_contests": merged.where("NOT matched"), "quality": O.merge_quality(standard)}


def run_backtest(predictions: DataFrame, merged: DataFrame, keys: tuple[str, ...] = ("bout_id",), p: str = "p") -> dict[str, DataFrame]:
    """Flat and Kelly bets and results for all thresholds; keys must be unique on both sides."""
    rows = O.join_one_to_one(predictions.select(*keys, p), merged, list(keys), "inner")
    chosen = checkpoint(B.select_bets(B.edges(rows, p), p=p))
    flat, kelly = B.flat_profit(chosen), B.kelly(chosen)
    results = B.summary(flat, ["edge_threshold"])
    return {"bets": flat, "flat": results, "kelly_bets": kelly, "kelly": B.summary(kelly, ["edge_threshold", "kelly_fraction"], "bankroll"), "best": B.best_threshold(results)}


def diagnose(bets: DataFrame, best: DataFrame) -> dict[str, DataFrame]:
    """All diagnostic tables of the bets at the best threshold."""
    at = checkpoint(bets.join(F.broadcast(best.select("edge_threshold")), "edge_threshold", "left_semi"))  # one row
    out = {f"segment_{kind}": G.segment(at, kind) for kind in ("side", "odds", "market", "model", "edge")}
    won = at.where("bet_won IS NOT NULL").select("*", F.col("bet_won").cast("int").alias("label"))
    deciles = M.calibration(won, [], "bout_id", p="selected_model_prob", extra={"mean_market": "selected_market_prob"})
    return out | {"edge_quality": G.edge_quality(at), "correlations": G.edge_correlations(at), "favorites": G.favourites_and_longshots(at), "periods": G.months_and_quarters(at), "rolling": G.rolling_return(at, ["edge_threshold"]), "deciles": deciles, "gap": M.calibration_gap(deciles, [])}


def compare_backtests(runs: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """The best flat threshold of each named run, one row each."""
    out = None
    for name, run in runs.items():
        row = run["best"].select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def recency_grid(contests: DataFrame, base: DataFrame, features: list[str], last: tuple[int, ...] = tuple(range(1, 11)), half_lives: tuple[float, ...] = (180.0, 365.0, 730.0, 1095.0), **settings) -> list[dict]:
    """Validation metrics of the base features plus last-N, and plus decayed, form for each value of the grids.

    ``base`` is ``bout_id, event_date, red_win`` and the features. All values' forms are columns of one table, on which
    their models are fitted together.
    """
    long, store = P.to_long(contests, ["sig_landed", "td_landed", "kd", "ctrl_seconds"]), Written(contests.sparkSession)
    picks = [("last_n", v, f"recent_{v}_", f"recent_{v}_") for v in last] + [("half_life", v, f"exp_decay_{i}_", "exp_decay_") for i, v in enumerate(half_lives)]
    names = {prefix: [f"{prefix}{m}" for m in H.FORM] for _, _, prefix, _ in picks}
    days = H.forms_by_day(long, last, half_lives).select(*H.KEYS, *[n for form in names.values() for n in form])
    states = long.select("bout_id", "side", *H.KEYS).join(days, H.KEYS)
    extra = {prefix: [f"pre_fight_{n}_diff" for n in form] for prefix, form in names.items()}
    wide = P.side_differences(P.to_wide(states, [n for form in names.values() for n in form])).select("bout_id", *[c for form in extra.values() for c in form])
    table = S.chronological_split(store.keep(base.join(wide, "bout_id")))
    train, validation = table.where("split = 'train'"), table.where("split = 'validation'")
    joint = models.Joint(train, validation, [([*features, *extra[prefix]], settings) for _, _, prefix, _ in picks])
    shown = [[*features, *[f"pre_fight_{name}{m}_diff" for m in H.FORM]] for *_, name in picks]
    return models.near_best([{"kind": kind, "value": float(v), **models.fit_and_evaluate(joint[i], validation, shown[i], f"{kind} {v}", **settings)} for i, (kind, v, *_) in enumerate(picks)])
