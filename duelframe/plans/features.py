"""The feature table: every state and comparison of a contest, one row per contest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.functions import text as X
from duelframe.operators import derived as D
from duelframe.operators import history as H
from duelframe.operators import paired as P
from duelframe.operators.rating import elo
from duelframe.runtime import Written, collect_garbage

#: The features of the final model and of the sets it was chosen from. ``{n}`` is the number of last contests.
FINAL_FEATURES = (
    "diff_age",
    "diff_total_wins",
    "diff_total_losses",
    "diff_win_streak",
    "diff_td_landed_per_fight",
    "diff_kd_absorbed_per_fight",
    "diff_reach",
    "diff_sig_strike_accuracy",
    "diff_avg_fight_duration_seconds",
    "diff_decision_rate",
    "pre_fight_red_late_finish_rate",
    "diff_five_round_experience",
)
CLEAN_BASELINE = ("diff_age", "diff_total_wins", "diff_total_losses", "diff_win_streak", "diff_td_landed_per_fight", "diff_kd_absorbed_per_fight", "diff_reach", "diff_sig_strike_accuracy", "diff_ctrl_seconds_per_fight")
OPTIONAL = ("diff_loss_streak", "diff_height", "diff_durability_index", "pre_fight_ko_loss_rate_diff", "diff_td_accuracy")
PREVIOUS_BEST = (*CLEAN_BASELINE, "diff_elo", "pre_fight_ko_loss_rate_diff")
_FORM = ("win_pct", "sig_strikes_landed_per_fight", "sig_strikes_landed_per_min", "td_landed_per_fight", "ctrl_seconds_per_fight", "kd_per_fight", "kd_absorbed_per_fight")
LAST_N, EXP_DECAY = tuple(f"diff_recent_{{n}}_{m}" for m in _FORM), tuple(f"diff_exp_decay_{m}" for m in _FORM)
CARDIO = ("diff_avg_fight_duration_seconds", "diff_decision_rate", "diff_third_round_or_later_rate", "pre_fight_red_late_finish_rate", "pre_fight_blue_late_finish_rate", "diff_five_round_experience", "diff_five_round_fights_completed")
HYPOTHESES = {
    "style_features": ("diff_striker_score", "diff_grappler_score", "diff_style_index", "diff_grappler_vs_striker_interaction"),
    "finish_vs_durability_features": ("diff_finish_vs_durability", "red_finish_vs_blue_durability", "blue_finish_vs_red_durability"),
    "layoff_features": ("diff_days_since_last_fight", "diff_short_turnaround", "diff_long_layoff"),
    "momentum_features": ("diff_momentum_win_pct", "diff_momentum_sig_strikes_per_min", "diff_momentum_td_landed_per_fight", "diff_momentum_kd_absorbed_per_fight"),
    "cardio_features": CARDIO,
    "five_round_experience_features": ("diff_past_5_round_scheduled_fights", "diff_past_5_round_wins", "diff_past_5_round_losses"),
    "td_matchup_interaction_features": ("diff_td_offense_vs_td_defense", "diff_grappling_pressure_vs_defense", "red_td_offense_vs_blue_td_defense", "blue_td_offense_vs_red_td_defense"),
}
ALL_HYPOTHESES = tuple(dict.fromkeys(x for group in HYPOTHESES.values() for x in group))
FEATURE_SETS = {
    "clean_baseline": CLEAN_BASELINE,
    "optional_clean": OPTIONAL,
    "previous_best": PREVIOUS_BEST,
    "current_previous_best": (*PREVIOUS_BEST, *LAST_N),
    "elo_rating": ("diff_elo",),
    "elo_only": ("diff_elo", "pre_fight_red_elo", "pre_fight_blue_elo", "pre_fight_red_elo_win_prob"),
    "last_n": LAST_N,
    "exp_decay": EXP_DECAY,
    **HYPOTHESES,
    "all_new_hypothesis_features": ALL_HYPOTHESES,
    "final": FINAL_FEATURES,
}
#: The sets with and without recency, and the previous best with each hypothesis.
RECENCY_COMPARISON = {
    "previous_best_features_without_recency": PREVIOUS_BEST,
    "previous_best_features_plus_best_last_N": (*PREVIOUS_BEST, *LAST_N),
    "previous_best_features_plus_best_exp_decay": (*PREVIOUS_BEST, *EXP_DECAY),
    "previous_best_features_plus_both_recency_types": (*PREVIOUS_BEST, *LAST_N, *EXP_DECAY),
    "compact_recency_model_only": (*LAST_N, *EXP_DECAY),
    "compact_recency_plus_elo": (*LAST_N, *EXP_DECAY, "diff_elo"),
}
HYPOTHESIS_COMPARISON = {"previous_best_features": PREVIOUS_BEST} | {f"previous_best_features_plus_{n}": (*PREVIOUS_BEST, *g) for n, g in {**HYPOTHESES, "all_new_hypothesis_features": ALL_HYPOTHESES}.items()}


#: The rates of a profile.
RATES = ("slpm", "str_acc", "sapm", "str_def", "td_avg", "td_acc", "td_def", "sub_avg")


def attach_profiles(contests: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Missing measures, stances and birth dates from profiles ``name_key, height, weight, reach, stance, dob``, ages, and the profiles' rates.

    A value of the contest wins over the profile's. Rates (``RATES``) that a profile has are attached as ``<side>_<rate>``.
    """
    out = contests
    if profiles is not None:
        rates = [c for c in RATES if c in profiles.columns]
        given = [c for c in ("height", "weight", "reach", "stance", "dob") if c in profiles.columns]
        # names only go to the profiles, and what is found comes back by contest
        sides = contests.select("bout_id", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), X.name_key(F.col(f"{s}_name")).alias("name_key")) for s in P.SIDES])))
        of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
        found = sides.join(profiles.select("name_key", *given, *rates), "name_key").groupBy("bout_id").agg(*[of(s, c).alias(f"__{s}_{c}") for s in P.SIDES for c in given], *[of(s, c).alias(f"{s}_{c}") for s in P.SIDES for c in rates])
        out = out.join(found, "bout_id", "left")
        names = [f"{s}_{c}" for s in P.SIDES for c in given]
        out = out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in names else F.col(c) for c in contests.columns], *[f"{s}_{c}" for s in P.SIDES for c in rates])
    return out.select("*", *[N.age_at(F.col("event_date"), F.col(f"{s}_dob")).cast("double").alias(f"{s}_age") for s in P.SIDES])


def histories(contests: DataFrame, n: int = 2, half_life: float = 365.0, legacy_duration: bool = False) -> DataFrame:
    """Every state before a contest, for both sides: ``bout_id, side, entity, opponent, day`` and the states.

    States of a day are written once, with the day's contests and without what follows from them row by row. The wide rows
    are shuffled once more, by contest.
    """
    long, store = P.to_long(contests), Written(contests.sparkSession)
    days = store.keep(H.states_by_day(long, n, half_life, legacy_duration), "days")
    collect_garbage(contests.sparkSession)
    rows = days.select("*", F.inline("contests")).drop("contests")
    metrics = ["win_pct", "total_wins", "total_fights", "power_index", "durability_index", "vulnerability_index"]
    others = H.opponents_by_day(D.power(D.career_rates(rows), True), metrics)
    found = rows.select("bout_id", "side", *H.KEYS).join(others, H.KEYS).groupBy("bout_id").agg(F.collect_list(F.struct("side", *[f"avg_opponent_{m}" for m in metrics])).alias("__o"))
    found = store.keep(found, "others")
    collect_garbage(contests.sparkSession)
    own = F.get(F.filter("__o", lambda x: x["side"] == F.col("side")), F.lit(0))
    joined = rows.join(found.hint("shuffle_hash"), "bout_id")
    whole = joined.select(*rows.columns, own.alias("__own")).select(*rows.columns, *[F.col(f"__own.avg_opponent_{m}") for m in metrics])
    rows = D.momentum(D.power(D.career_rates(whole), True), n)
    return rows.select("*", (F.col("power_index") - F.col("avg_opponent_vulnerability_index")).alias("opponent_adjusted_power"))


#: Long columns that are no states but results of the contest itself.
_RESULTS = {"won", "lost", "method", "round", "rounds", "duration_seconds", "side", "entity", "opponent", "bout_id", "day", *P.MEASURES, *[f"opp_{m}" for m in P.MEASURES]}


def build_features(contests: DataFrame, strikes: DataFrame | None = None, profiles: DataFrame | None = None, n: int = 2, half_life: float = 365.0, k: float = 32.0, initial: float = 500.0, legacy_duration: bool = False) -> DataFrame:
    """One row per contest: identity, target, attributes, states of both sides, style scores, ratings and differences."""
    base = contests if strikes is None else P.with_strikes(contests, strikes)
    base = Written(contests.sparkSession).keep(attach_profiles(base, profiles), "contests")
    collect_garbage(contests.sparkSession)
    long = histories(base, n, half_life, legacy_duration)
    states = [c for c in long.columns if c not in _RESULTS]
    wide = P.to_wide(long, states)
    keep = ["bout_id", "event_date", "red_name", "blue_name", "outcome", "red_win", "weight_class", *[f"{s}_{c}" for s in P.SIDES for c in ("age", "height", "reach", "weight", "stance", *RATES) if f"{s}_{c}" in base.columns]]
    rated = elo(base, k, initial).select("bout_id", *[F.col(f"{s}_elo{p}").alias(f"pre_fight_{s}_elo{p}") for s in P.SIDES for p in ("", "_win_prob")])
    rows = D.style(base.select(*keep).hint("shuffle_hash").join(wide, "bout_id")).join(rated.hint("shuffle_hash"), "bout_id")
    return P.difference_aliases(more_differences(P.side_differences(rows)))


def more_differences(df: DataFrame) -> DataFrame:
    """``diff_X`` for every ``pre_fight_X_diff`` that has no short name yet."""
    out = {f"diff_{c.removeprefix('pre_fight_').removesuffix('_diff')}": c for c in df.columns if c.startswith("pre_fight_") and c.endswith("_diff")}
    return df.select("*", *[F.col(c).alias(n) for n, c in out.items() if n not in df.columns])


def feature_set(name: str, columns: list[str], n: int = 2) -> list[str]:
    """The features of a set that the table has, in order and once."""
    return features_of(FEATURE_SETS[name], columns, n)


def features_of(names: tuple[str, ...], columns: list[str], n: int = 2) -> list[str]:
    return [c for c in dict.fromkeys(f.format(n=n) for f in names) if c in columns]
