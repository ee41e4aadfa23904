"""Features derived row by row from the states before a contest, and the whole-table statistics they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.runtime import checkpoint

PER_FIGHT = {"win_pct": "total_wins", "sig_strikes_landed_per_fight": "total_sig_strikes_landed", "sig_strikes_attempted_per_fight": "total_sig_strikes_attempted"}
PER_FIGHT |= {f"{m}_per_fight": f"total_{m}" for m in ("td_landed", "td_attempted", "sub_att", "ctrl_seconds", "kd", "kd_absorbed")}
PER_MIN = {"sig_strikes_landed_per_min": "total_sig_strikes_landed"} | {f"{m}_per_min": f"total_{m}" for m in ("td_landed", "sub_att", "ctrl_seconds")}
PER_MINUTE = {f"{s}_strikes_{w}_per_minute": f"total_{s}_strikes_{w}" for s in ("sig", "total") for w in ("landed", "attempted")}
PER_MINUTE |= {f"{m}_per_minute": f"total_{m}" for m in ("td_landed", "td_attempted", "kd", "sub_att", "rev", "ctrl_seconds")}
#: Weights of strikes to head, body and leg where the table can't give them.
FALLBACK = (0.6, 0.25, 0.15)


def _c(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def career_rates(long: DataFrame) -> DataFrame:
    """Per-fight and per-minute rates, accuracies, takedown defence and win rate from career totals; 0 without history."""
    c = lambda n: _c(long, n)
    fights, seconds = c("total_fights"), c("total_fight_duration_seconds")
    out = {n: N.ratio(c(t), fights) for n, t in PER_FIGHT.items()}
    out |= {n: N.ratio(c(t) * 60, seconds) for n, t in PER_MIN.items()}
    out |= {n: N.ratio(c(t), seconds / 60) for n, t in PER_MINUTE.items()}
    out |= {"ctrl_share": N.ratio(c("total_ctrl_seconds"), seconds), "win_rate": N.ratio(c("total_wins"), fights)}
    out |= {"sig_strike_accuracy": N.ratio(c("total_sig_strikes_landed"), c("total_sig_strikes_attempted")), "total_strike_accuracy": N.ratio(c("total_total_strikes_landed"), c("total_total_strikes_attempted")), "td_accuracy": N.ratio(c("total_td_landed"), c("total_td_attempted"))}
    out |= {f"sig_strikes_{p}_accuracy": N.ratio(c(f"total_sig_strikes_{p}_landed"), c(f"total_sig_strikes_{p}_attempted")) for p in ("head", "body", "leg", "distance", "clinch", "ground")}
    against = c("total_td_attempted_against")
    out["td_defense"] = F.when(against > 0, 1 - N.ratio(c("total_td_absorbed"), against)).otherwise(0.0)
    return long.select("*", *[v.alias(n) for n, v in out.items()])


def contest_rates(contests: DataFrame) -> DataFrame:
    """The same rates of the contest itself (they are results, not states before it) under ``<side>_fighter_<rate>``."""
    out = {}
    seconds = F.col("duration_seconds")
    for s in ("red", "blue"):
        c = lambda n: _c(contests, f"{s}_{n}")  # noqa: E731, B023
        for n in ("sig", "total"):
            out |= {f"{s}_fighter_{n}_strikes_{w}_per_minute": N.ratio(c(f"{n}_{w}"), seconds / 60) for w in ("landed", "attempted")}
            out[f"{s}_fighter_{n}_strike_accuracy"] = N.ratio(c(f"{n}_landed"), c(f"{n}_attempted"))
        out |= {f"{s}_fighter_{m}_per_minute": N.ratio(c(m), seconds / 60) for m in ("td_landed", "td_attempted", "kd", "sub_att", "rev", "ctrl_seconds")}
        out |= {f"{s}_fighter_ctrl_share": N.ratio(c("ctrl_seconds"), seconds), f"{s}_fighter_td_accuracy": N.ratio(c("td_landed"), c("td_attempted"))}
        out |= {f"{s}_fighter_sig_strikes_{p}_accuracy": N.ratio(c(f"{p}_landed"), c(f"{p}_attempted")) for p in ("head", "body", "leg", "distance", "clinch", "ground")}
    return contests.select("*", *[v.alias(n) for n, v in out.items()])


def strike_weights(long: DataFrame) -> DataFrame:
    """One row ``w_head, w_body, w_leg``: correlation with knockdowns (not below 0) times share of strikes, scaled to 1.

    Fewer than 10 usable rows, no strikes or no positive score give the fixed weights; an undefined correlation counts as 0.
    """
    parts = {p: F.col(f"total_sig_strikes_{p}_landed") for p in ("head", "body", "leg")}
    usable = long.select(*[v.alias(p) for p, v in parts.items()], F.col("total_kd").alias("kd")).where("head IS NOT NULL AND body IS NOT NULL AND leg IS NOT NULL AND kd IS NOT NULL AND head + body + leg > 0")
    stats = usable.agg(F.count("*").alias("n"), *[F.greatest(F.coalesce(F.nanvl(F.corr(p, "kd"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias(f"c_{p}") for p in parts], *[F.coalesce(F.avg(p), F.lit(0.0)).alias(f"m_{p}") for p in parts])
    total = sum((F.col(f"m_{p}") for p in parts), F.lit(0.0))
    scored = stats.select("n", total.alias("total"), *[(F.col(f"c_{p}") * N.ratio(F.col(f"m_{p}"), total)).alias(f"s_{p}") for p in parts])
    score = sum((F.col(f"s_{p}") for p in parts), F.lit(0.0))
    poor = (F.col("n") < 10) | (F.col("total") <= N.EPSILON) | (score <= N.EPSILON)
    return scored.select(*[F.when(poor, F.lit(w)).otherwise(F.col(f"s_{p}") / score).alias(f"w_{p}") for p, w in zip(parts, FALLBACK)])


def shared_scores(long: DataFrame, columns: list[str], keep: bool = False) -> DataFrame:
    """``z_<column>``: distance from the mean of all rows (both sides) in population deviations; 0 where they don't vary.

    ``keep`` computes the means at once and only once.
    """
    stats = long.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__d_{c}"))])
    rows = long.crossJoin(F.broadcast(checkpoint(stats) if keep else stats))  # one row
    z = [F.when(F.col(f"__d_{c}") >= N.EPSILON, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__d_{c}")).otherwise(0.0).alias(f"z_{c}") for c in columns]
    return rows.select(*long.columns, *z)


def power(long: DataFrame, written: bool = False) -> DataFrame:
    """Knockdown efficiencies, power, vulnerability and durability indices. Needs ``career_rates`` before it.

    The rows are read for the weights, the means and themselves. ``written`` tells that they come from a table, of which
    each reads its columns only; else they are cut.
    """
    long = long if written else checkpoint(long)
    weights = strike_weights(long)
    rows = long.crossJoin(F.broadcast(checkpoint(weights) if written else weights))  # one row
    strikes = {p: F.col(f"total_sig_strikes_{p}_landed") for p in ("head", "body", "leg")}
    taken = {p: F.col(f"total_sig_strikes_{p}_absorbed") for p in strikes}
    weighted, absorbed = (sum((F.col(f"w_{p}") * v for p, v in x.items()), F.lit(0.0)) for x in (strikes, taken))
    kd, seconds, fights = F.col("total_kd"), F.col("total_fight_duration_seconds"), F.col("total_fights")
    rows = rows.select(
        *long.columns, weighted.alias("weighted_strikes"), absorbed.alias("weighted_strikes_absorbed"),
        N.near_ratio(kd, sum(strikes.values(), F.lit(0.0))).alias("kd_efficiency"), N.near_ratio(kd, strikes["head"]).alias("kd_efficiency_head"), N.near_ratio(kd, weighted).alias("kd_efficiency_weighted"),
        N.ratio(F.col("total_ko_wins"), fights).alias("ko_rate"), N.ratio(F.col("total_ko_losses"), fights).alias("ko_loss_rate"),
        N.ratio(kd * 60, seconds).alias("kd_per_min"), N.near_ratio(F.col("total_kd_absorbed"), absorbed).alias("kd_absorbed_efficiency"), N.ratio(F.col("total_kd_absorbed") * 60, seconds).alias("kd_absorbed_per_min"),
    )
    base = ["kd_efficiency_weighted", "kd_per_min", "ko_rate", "kd_absorbed_efficiency", "kd_absorbed_per_min", "ko_loss_rate"]
    scored = shared_scores(rows, base, written)
    mean = lambda names: sum((F.col(f"z_{c}") for c in names), F.lit(0.0)) / 3
    vulnerable = mean(base[3:])
    return scored.select(*rows.columns, mean(base[:3]).alias("power_index"), vulnerable.alias("vulnerability_index"), (-vulnerable).alias("durability_index"))


def style(wide: DataFrame) -> DataFrame:
    """Style and matchup scores of both sides, their products and differences, from ``pre_fight_<side>_*`` states."""
    sides = {"red": "blue", "blue": "red"}
    pre = lambda s, n: F.col(f"pre_fight_{s}_{n}")
    pos = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    unit = lambda c: N.clip(F.coalesce(c, F.lit(0.0)), 0.0, 1.0)
    log = N.log1p_positive
    one = {}
    for s, o in sides.items():
        volume = log(pre(s, "sig_strikes_landed_per_min")) + 0.5 * log(pre(s, "sig_strikes_landed_per_fight"))
        strength = 0.5 * log(pre(s, "kd_per_fight")) + 0.5 * log(60 * pre(s, "kd_per_min")) + pos(pre(s, "ko_rate")) + 0.25 * F.coalesce(pre(s, "power_index"), F.lit(0.0))
        grapple = log(pre(s, "td_attempted_per_fight")) + log(pre(s, "td_landed_per_fight")) + log(pre(s, "ctrl_seconds_per_fight") / 60) + log(pre(s, "sub_att_per_fight"))
        open_ = 1 - unit(pre(o, "td_defense"))
        one |= {f"pre_fight_{s}_striking_volume_score": volume, f"pre_fight_{s}_power_score": strength, f"pre_fight_{s}_striker_score": 0.6 * volume + 0.4 * strength, f"pre_fight_{s}_grappler_score": grapple}
        one[f"pre_fight_{s}_style_index"] = grapple - (0.6 * volume + 0.4 * strength)
        one[f"pre_fight_{s}_finish_score"] = log(pre(s, "kd_per_fight")) + pos(pre(s, "ko_rate")) + 0.5 * F.coalesce(pre(s, "power_index"), F.lit(0.0))
        one[f"pre_fight_{s}_vulnerability_score"] = log(pre(s, "kd_absorbed_per_fight")) + pos(pre(s, "ko_loss_rate")) + 0.5 * F.coalesce(pre(s, "vulnerability_index"), F.lit(0.0))
        one[f"{s}_td_offense_vs_{o}_td_defense"] = pos(pre(s, "td_landed_per_fight")) * open_
        one[f"{s}_grappling_pressure_vs_{o}_defense"] = (pos(pre(s, "td_attempted_per_fight")) + pos(pre(s, "sub_att_per_fight")) + pos(pre(s, "ctrl_seconds_per_fight") / 60)) * open_ * (0.5 + unit(pre(s, "td_accuracy")))
    scored = wide.select("*", *[v.alias(n) for n, v in one.items()])
    col = F.col
    two = {f"diff_{m}": pre("red", m) - pre("blue", m) for m in ("striker_score", "grappler_score", "style_index")}
    two |= {"red_grappler_vs_blue_striker": pre("red", "grappler_score") * pre("blue", "striker_score"), "red_striker_vs_blue_grappler": pre("red", "striker_score") * pre("blue", "grappler_score")}
    two |= {f"{s}_finish_vs_{o}_durability": pre(s, "finish_score") * pre(o, "vulnerability_score") for s, o in sides.items()}
    two["diff_td_offense_vs_td_defense"] = col("red_td_offense_vs_blue_td_defense") - col("blue_td_offense_vs_red_td_defense")
    two["diff_grappling_pressure_vs_defense"] = col("red_grappling_pressure_vs_blue_defense") - col("blue_grappling_pressure_vs_red_defense")
    matched = scored.select("*", *[v.alias(n) for n, v in two.items()])
    return matched.select("*", (col("red_grappler_vs_blue_striker") - col("red_striker_vs_blue_grappler")).alias("diff_grappler_vs_striker_interaction"), (col("red_finish_vs_blue_durability") - col("blue_finish_vs_red_durability")).alias("diff_finish_vs_durability"))


#: Momentum: feature name, form metric and career metric it is measured against.
MOMENTUM = {"momentum_win_pct": "win_pct", "momentum_sig_strikes_per_min": "sig_strikes_landed_per_min", "momentum_td_landed_per_fight": "td_landed_per_fight", "momentum_kd_absorbed_per_fight": "kd_absorbed_per_fight"}


def momentum(long: DataFrame, n: int = 2) -> DataFrame:
    """Last-n form less career rate, in four metrics."""
    return long.select("*", *[(F.col(f"recent_{n}_{m}") - F.col(m)).alias(name) for name, m in MOMENTUM.items()])
