"""State of each entity strictly before each of its contests.

Contests of one date never see each other. All operators share one plan: the long rows are summed per entity and day
(which combines map-side, so an entity with a third of all rows is down to one row per day), windows run over those days,
and the state before a day is joined back to the day's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.functions.text import method_flags

KEYS = ["entity", "day"]


def _upto(offset: int) -> Window:
    """All of an entity's days up to this one plus ``offset``."""
    return Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, offset)



#: Career totals by feature name: the side's own measures, then those made by the opponent.
TOTALS = {f"total_sig_strikes_{w}": f"sig_{w}" for w in ("landed", "attempted")}
TOTALS |= {f"total_sig_strikes_{p}_{w}": f"{p}_{w}" for p in ("head", "body", "leg", "distance", "clinch", "ground") for w in ("landed", "attempted")}
TOTALS |= {f"total_total_strikes_{w}": f"total_{w}" for w in ("landed", "attempted")} | {f"total_td_{w}": f"td_{w}" for w in ("landed", "attempted")}
TOTALS |= {f"total_{m}": m for m in ("kd", "sub_att", "rev", "ctrl_seconds")} | {"total_fight_duration_seconds": "duration_seconds"}
ABSORBED = {"total_kd_absorbed": "opp_kd", "total_td_absorbed": "opp_td_landed", "total_td_attempted_against": "opp_td_attempted"}
ABSORBED |= {f"total_sig_strikes_{p}_absorbed": f"opp_{p}_landed" for p in ("head", "body", "leg")}
OUTCOMES = ["total_fights", "total_wins", "total_losses", "total_ko_wins", "total_submission_wins", "total_decision_wins", "total_ko_losses"]


def before(long: DataFrame, sums: dict[str, Column], least: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """``long`` with the sum, least and most of each expression over the entity's earlier days; sums are 0 at the debut."""
    return long.join(_days_before(long, sums, least, most), KEYS)


def _days_before(long: DataFrame, sums: dict[str, Column], least: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """``before`` with one row per entity and day."""
    least, most = least or {}, most or {}
    aggs = [F.sum(F.coalesce(e.cast("double"), F.lit(0.0))).alias(n) for n, e in sums.items()] + [F.min(e).alias(n) for n, e in least.items()] + [F.max(e).alias(n) for n, e in most.items()]
    daily = long.groupBy(*KEYS).agg(*aggs)
    state = [F.coalesce(F.sum(n).over(_upto(-1)), F.lit(0.0)).alias(n) for n in sums] + [F.min(n).over(_upto(-1)).alias(n) for n in least] + [F.max(n).over(_upto(-1)).alias(n) for n in most]
    return daily.select(*KEYS, *state)


def outcome_sums(long: DataFrame) -> dict[str, Column]:
    won, lost = F.col("won") == 1, F.col("lost") == 1
    win, loss = method_flags(F.col("method"), won), method_flags(F.col("method"), lost)
    return {"total_fights": F.lit(1), "total_wins": F.col("won"), "total_losses": F.col("lost"), **{f"total_{m}_wins": c for m, c in win.items()}, "total_ko_losses": loss["ko"]}


def career_totals(long: DataFrame, legacy_duration: bool = False) -> DataFrame:
    """Fights, outcomes by method, volumes and what opponents did, before each contest; null measures add 0.

    ``legacy_duration`` keeps the total duration at 0, as a known defect of older tables had it.
    """
    return before(long, _career_sums(long, legacy_duration))


def _career_sums(long: DataFrame, legacy_duration: bool) -> dict[str, Column]:
    sums = outcome_sums(long)
    sums |= {n: F.col(c) for n, c in {**TOTALS, **ABSORBED}.items() if c in long.columns}
    if legacy_duration and "total_fight_duration_seconds" in sums:
        sums["total_fight_duration_seconds"] = F.lit(0.0)
    return sums


def streaks(long: DataFrame) -> DataFrame:
    """``win_streak``, ``loss_streak`` before each contest; draws and no contests leave both as they are.

    A streak is the number of wins so far less that at the last loss; within a day contests follow by id.
    """
    w = Window.partitionBy(*KEYS)
    day = long.select(*KEYS, "bout_id", "won", "lost")
    marked = day.select("*", F.max(F.when(F.col("lost") == 1, F.col("bout_id"))).over(w).alias("last_loss"), F.max(F.when(F.col("won") == 1, F.col("bout_id"))).over(w).alias("last_win"))
    after_loss = F.coalesce(F.col("bout_id") > F.col("last_loss"), F.lit(True))
    after_win = F.coalesce(F.col("bout_id") > F.col("last_win"), F.lit(True))
    daily = marked.groupBy(*KEYS).agg(
        F.sum("won").alias("wins"), F.sum("lost").alias("losses"), F.max("last_loss").isNotNull().alias("had_loss"), F.max("last_win").isNotNull().alias("had_win"),
        F.sum(F.when(after_loss, F.col("won")).otherwise(0)).alias("wins_after"), F.sum(F.when(after_win, F.col("lost")).otherwise(0)).alias("losses_after"),
    )
    upto = daily.select(*KEYS, "had_loss", "had_win", "wins_after", "losses_after", F.sum("wins").over(_upto(0)).alias("cw"), F.sum("losses").over(_upto(0)).alias("cl"))
    return long.join(upto.select(*KEYS, *_runs(upto)), KEYS)


def _runs(upto: DataFrame) -> list[Column]:
    """Both streaks before each day, from the counts up to it and the day's own contests."""
    w = _upto(-1)

    def run(total: str, had: str, after: str, name: str) -> Column:
        mark = F.max(F.when(F.col(had), F.col(total) - F.col(after))).over(w)
        return (F.coalesce(F.max(total).over(w), F.lit(0)) - F.coalesce(mark, F.lit(0))).cast("bigint").alias(name)

    return [run("cw", "had_loss", "wins_after", "win_streak"), run("cl", "had_win", "losses_after", "loss_streak")]


def career_span(long: DataFrame) -> DataFrame:
    """``years_active`` since the first contest and ``fights_per_year``; 0 at the debut."""
    rows = before(long, {"span_fights": F.lit(1)}, least={"first_day": F.col("day")})
    return _span(rows).drop("span_fights", "first_day")


def _span(rows: DataFrame) -> DataFrame:
    years = F.coalesce((F.col("day") - F.col("first_day")) / 365.25, F.lit(0.0))
    return rows.withColumn("years_active", years).withColumn("fights_per_year", N.ratio(F.col("span_fights"), F.col("years_active")))


def layoffs(long: DataFrame, short: int = 100, long_: int = 365) -> DataFrame:
    """``days_since_last_fight`` (null at the debut) and the flags ``short_turnaround``, ``long_layoff``."""
    return before(long, {}, most={"last_day": F.col("day")}).select(*long.columns, *_gaps(short, long_))


def _gaps(short: int = 100, long_: int = 365) -> list[Column]:
    days = F.col("day") - F.col("last_day")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [days.alias("days_since_last_fight"), flag(days < short).alias("short_turnaround"), flag(days > long_).alias("long_layoff")]


def endurance(long: DataFrame) -> DataFrame:
    """Average length, shares of decisions, of late finishes and of third rounds, and counts of long contests."""
    names, counts = _endurance_sums()
    rows = before(long, {"__n": F.lit(1), **names, **counts})
    kept = [c for c in rows.columns if c not in (*names, "__n")]
    return rows.select(*kept, *_endurance(names))


def _endurance_sums() -> tuple[dict[str, Column], dict[str, Column]]:
    """What is averaged over the contests, and what is counted."""
    decision, late = F.contains(F.coalesce("method", F.lit("")), F.lit("decision")), F.coalesce(F.col("round") >= 3, F.lit(False))
    five = F.coalesce(F.col("rounds") >= 5, F.lit(False))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    names = {"avg_fight_duration_seconds": F.col("duration_seconds"), "decision_rate": one(decision), "late_finish_rate": one(late & ~decision), "third_round_or_later_rate": one(late)}
    counts = {"past_5_round_scheduled_fights": one(five), "five_round_fights_completed": one(five & F.coalesce(F.col("round") >= 4, F.lit(False))), "past_5_round_wins": one(five) * F.col("won"), "past_5_round_losses": one(five) * F.col("lost")}
    return names, counts


def _endurance(names: dict[str, Column]) -> list[Column]:
    return [*[N.ratio(F.col(c), F.col("__n")).alias(c) for c in names], F.col("past_5_round_scheduled_fights").alias("five_round_experience")]


def past_opponents(long: DataFrame, metrics: list[str]) -> DataFrame:
    """``avg_opponent_<metric>``: mean over earlier contests of what the opponent's metric was before that contest.

    ``metrics`` are columns of ``long`` (states before the contest). An opponent without a value is skipped; 0 without any.
    """
    return long.join(opponents_by_day(long, metrics), KEYS)


def opponents_by_day(long: DataFrame, metrics: list[str]) -> DataFrame:
    """``past_opponents`` with one row per entity and day."""
    other = long.select("bout_id", F.col("entity").alias("opponent"), *[F.col(m).alias(f"__o_{m}") for m in metrics])
    rows = long.select("bout_id", "opponent", *KEYS).join(other, ["bout_id", "opponent"], "left")
    sums = {f"__s_{m}": F.col(f"__o_{m}") for m in metrics} | {f"__k_{m}": F.col(f"__o_{m}").isNotNull().cast("int") for m in metrics}
    state = _days_before(rows, sums)
    return state.select(*KEYS, *[N.ratio(F.col(f"__s_{m}"), F.col(f"__k_{m}")).alias(f"avg_opponent_{m}") for m in metrics])


#: What a form summary measures: output name and the long column behind it.
FORM = {"win_pct": "won", "sig_strikes_landed_per_fight": "sig_landed", "td_landed_per_fight": "td_landed", "ctrl_seconds_per_fight": "ctrl_seconds", "kd_per_fight": "kd", "kd_absorbed_per_fight": "opp_kd"}


def last_n(long: DataFrame, n: int = 2, prefix: str | None = None) -> DataFrame:
    """``<prefix><metric>`` over the last n contests of earlier days; shorter histories use what there is; 0 at the debut.

    A day keeps at most its last n contests and a window looks at most n days back, so an entity's history is never
    gathered whole.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    rank = Window.partitionBy(*KEYS).orderBy(F.desc("bout_id"))
    latest = long.select(*KEYS, F.row_number().over(rank).alias("r"), _record(long).alias("x")).where(F.col("r") <= n)
    daily = latest.groupBy(*KEYS).agg(F.array_sort(F.collect_list("x")).alias("h"))
    look = Window.partitionBy("entity").orderBy("day").rowsBetween(-n, -1)
    state = daily.select(*KEYS, F.flatten(F.collect_list("h").over(look)).alias("h")).select(*KEYS, _tail("h", n).alias("h"))
    return long.join(state.select(*KEYS, *_form(n, prefix)), KEYS)


def _value(long: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in long.columns else F.lit(0.0)


def _record(long: DataFrame) -> Column:
    """What the form of a contest is made of, under its id."""
    return F.struct("bout_id", _value(long, "duration_seconds").alias("seconds"), *[_value(long, c).alias(f"f{i}") for i, c in enumerate(FORM.values())])


def _tail(column: str, n: int) -> Column:
    return F.slice(column, F.greatest(F.size(column) - n + 1, F.lit(1)), n)


def _form(n: int, prefix: str | None = None, h: str = "h") -> list[Column]:
    """Form from the records ``h``."""
    prefix = f"recent_{n}_" if prefix is None else prefix
    total = lambda f: F.aggregate(h, F.lit(0.0), lambda s, x: s + x[f])
    size = F.size(h)
    out = [N.ratio(total(f"f{i}"), size).alias(f"{prefix}{name}") for i, name in enumerate(FORM)]
    strikes = f"f{list(FORM.values()).index('sig_landed')}"
    per_minute = F.when(total("seconds") > N.EPSILON, total(strikes) * 60 / total("seconds")).otherwise(0.0)
    return [*out, per_minute.alias(f"{prefix}sig_strikes_landed_per_min")]


def decay_weight(days: float, half_life: float = 365.0) -> float:
    """The weight of a contest so many days ago."""
    return math.exp(-math.log(2) / half_life * days)


def decayed(long: DataFrame, half_life: float = 365.0, prefix: str = "exp_decay_") -> DataFrame:
    """``<prefix><metric>`` with weights that halve every ``half_life`` days; 0 where all weights vanish.

    exp(rate * (day - origin)) is summed instead of a weight per pair of contests: what depends on the later day cancels.
    """
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    return before(long, _decay_sums(long, half_life)).select(*long.columns, *_decayed(half_life, prefix))


#: The day at which a decayed weight is 1, in days since 1970; keeps the exponent small.
_ORIGIN = 16_000


def _decay_sums(long: DataFrame, half_life: float, tag: str = "") -> dict[str, Column]:
    w = F.exp(math.log(2) / half_life * (F.col("day") - _ORIGIN))
    return {f"__w{tag}": w, f"__t{tag}": w * _value(long, "duration_seconds"), **{f"__x{i}{tag}": w * _value(long, c) for i, c in enumerate(FORM.values())}}


def _decayed(half_life: float, prefix: str = "exp_decay_", tag: str = "") -> list[Column]:
    w, scale = F.col(f"__w{tag}"), F.exp(-math.log(2) / half_life * (F.col("day") - _ORIGIN))
    seen = w * scale > N.EPSILON
    out = [F.when(seen, F.col(f"__x{i}{tag}") / w).otherwise(0.0).alias(f"{prefix}{name}") for i, name in enumerate(FORM)]
    strikes, seconds = F.col(f"__x{list(FORM.values()).index('sig_landed')}{tag}"), F.col(f"__t{tag}")
    per_minute = F.when(seen & (seconds * scale > N.EPSILON), strikes * 60 / seconds).otherwise(0.0)
    return [*out, per_minute.alias(f"{prefix}sig_strikes_landed_per_min")]


def states_by_day(long: DataFrame, n: int = 2, half_life: float = 365.0, legacy_duration: bool = False) -> DataFrame:
    """One row per entity and day, with its contests under ``contests``, and what ``career_totals``, ``endurance``, ``layoffs``, ``career_span``, ``streaks``,
    ``last_n`` and ``decayed`` give before it: one aggregate of the rows and one order of the days for all of them.
    """
    names, counts = _endurance_sums()
    career = _career_sums(long, legacy_duration)
    sums = {**career, "__n": F.lit(1), **names, **counts, **_decay_sums(long, half_life)}
    record = F.struct("bout_id", "won", "lost", _record(long).alias("x"), *[c for c in ("side", "opponent") if c in long.columns])
    daily = long.groupBy(*KEYS).agg(*[F.sum(F.coalesce(e.cast("double"), F.lit(0.0))).alias(k) for k, e in sums.items()], F.array_sort(F.collect_list(record)).alias("g"))
    last = lambda c: F.array_max(F.transform(F.filter("g", lambda x: x[c] == 1), lambda x: x["bout_id"]))
    after = lambda c, mark: F.aggregate(F.filter("g", lambda x: F.coalesce(x["bout_id"] > F.col(mark), F.lit(True))), F.lit(0).cast("bigint"), lambda s, x: s + x[c])
    marked = daily.select("*", last("lost").alias("last_loss"), last("won").alias("last_win"))
    contests = F.transform("g", lambda x: F.struct(x["bout_id"].alias("bout_id"), *[x[c].alias(c) for c in ("side", "opponent") if c in long.columns])).alias("contests")
    day = marked.select(*KEYS, *sums, contests, F.transform(_tail("g", n), lambda x: x["x"]).alias("h"), F.isnotnull("last_loss").alias("had_loss"), F.isnotnull("last_win").alias("had_win"), after("won", "last_loss").alias("wins_after"), after("lost", "last_win").alias("losses_after"))
    look = Window.partitionBy("entity").orderBy("day").rowsBetween(-n, -1)
    earlier = [F.coalesce(F.sum(k).over(_upto(-1)), F.lit(0.0)).alias(k) for k in sums] + [F.min("day").over(_upto(-1)).alias("first_day"), F.max("day").over(_upto(-1)).alias("last_day")]
    upto = day.select(*KEYS, "contests", *earlier, F.flatten(F.collect_list("h").over(look)).alias("h"), "had_loss", "had_win", "wins_after", "losses_after", F.sum("total_wins").over(_upto(0)).alias("cw"), F.sum("total_losses").over(_upto(0)).alias("cl"))
    rows = upto.select(*KEYS, "contests", *sums, "first_day", "last_day", F.col("total_fights").alias("span_fights"), _tail("h", n).alias("h"), *_runs(upto))
    return _span(rows).select(*KEYS, "contests", *career, *counts, *_endurance(names), *_gaps(), "years_active", "fights_per_year", "win_streak", "loss_streak", *_form(n), *_decayed(half_life))


def forms_by_day(long: DataFrame, last: tuple[int, ...], half_lives: tuple[float, ...]) -> DataFrame:
    """One row per entity and day with ``last_n`` for each number of contests (``recent_<n>_``) and ``decayed`` for each
    half-life (``exp_decay_<place>_``): one aggregate and one order of the days for all of them.
    """
    n = max(last, default=1)
    sums = {k: e for i, v in enumerate(half_lives) for k, e in _decay_sums(long, v, f"_{i}").items()}
    daily = long.groupBy(*KEYS).agg(*[F.sum(e).alias(k) for k, e in sums.items()], F.array_sort(F.collect_list(_record(long))).alias("g")).select(*KEYS, *sums, _tail("g", n).alias("g"))
    look = Window.partitionBy("entity").orderBy("day").rowsBetween(-n, -1)
    earlier = [F.coalesce(F.sum(k).over(_upto(-1)), F.lit(0.0)).alias(k) for k in sums]
    state = daily.select(*KEYS, *earlier, F.flatten(F.collect_list("g").over(look)).alias("g"))
    state = state.select("*", *[_tail("g", v).alias(f"h{v}") for v in last])
    return state.select(*KEYS, *[c for v in last for c in _form(v, h=f"h{v}")], *[c for i, v in enumerate(half_lives) for c in _decayed(v, f"exp_decay_{i}_", f"_{i}")])


def best_profile(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row per key: the one with most of ``values`` present, then the first by ``order``."""
    present = sum((F.col(c).isNotNull().cast("int") for c in values), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("__p"), F.col(order))
    return df.withColumn("__p", present).withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__p", "__i")


def latest_quote(df: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """One row per keys: the last by time (a row without a time beats all), then by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_first(), F.desc(order))
    return df.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")
