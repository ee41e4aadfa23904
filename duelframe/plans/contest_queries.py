"""Registered queries of the contest operators, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.functions import text as X
from duelframe.operators import backtest as B
from duelframe.operators import derived as D
from duelframe.operators import diagnostics as G
from duelframe.operators import history as H
from duelframe.operators import metrics as M
from duelframe.operators import odds as O
from duelframe.operators import paired as P
from duelframe.operators import splits as S
from duelframe.operators.rating import elo
from duelframe.runtime import checkpoint, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def contests(spark: SparkSession, folder: str) -> DataFrame:
    return P.clean_contests(read_table(spark, folder, "combined_data"))


def struck(spark: SparkSession, folder: str) -> DataFrame:
    return P.with_strikes(contests(spark, folder), P.strike_totals(read_table(spark, folder, "contest_stats")))


def long(spark: SparkSession, folder: str) -> DataFrame:
    return P.to_long(contests(spark, folder))


def results_only(spark: SparkSession, folder: str) -> DataFrame:
    """The long table without measures: what isn't named there isn't read."""
    return P.to_long(contests(spark, folder), [])


def rounded(df: DataFrame, keys: list[str], reals: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in reals])


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


#: Added before rounding where exact halves are common, so that both engines round them alike.
NUDGE = 1e-9


# --- the same tables in SQL -------------------------------------------------------------------------------------------

_TOKENS = "'', ' ', '---', '--', '-', 'null', 'NULL', 'None', 'none', 'nan', 'NaN'"
_CLASSES = ("women's strawweight", "women's flyweight", "women's bantamweight", "women's featherweight", "light heavyweight", "middleweight", "welterweight", "lightweight", "featherweight", "bantamweight", "flyweight", "heavyweight", "open weight", "catch weight", "superfight")


def _clock(c: str) -> str:
    part = lambda i: f"TRY_CAST(string_split(trim({c}), ':')[{i}] AS DOUBLE)"
    return f"CASE len(string_split(trim({c}), ':')) WHEN 1 THEN {part(1)} WHEN 2 THEN {part(1)} * 60 + {part(2)} WHEN 3 THEN {part(1)} * 3600 + {part(2)} * 60 + {part(3)} END"


def _of(c: str, i: int) -> str:
    return rf"TRY_CAST(regexp_extract(trim({c}), '^(\d+(?:\.\d+)?)\s+of\s+(\d+(?:\.\d+)?)$', {i}) AS DOUBLE)"


def _rounds(c: str) -> str:
    inside = rf"regexp_extract({c}, '\(([^)]*)\)', 1)"
    parts = f"CASE WHEN length({inside}) > 0 THEN nullif(len(list_filter(string_split({inside}, '-'), lambda x: length(trim(x)) > 0)), 0) END"
    return rf"coalesce(TRY_CAST(regexp_extract(lower({c}), '^\s*(\d+)\s*rnd', 1) AS INT), {parts}, TRY_CAST(regexp_extract({c}, '\d+', 0) AS INT))"


def _titled(label: str) -> str:
    return " ".join(w[0].upper() + w[1:] for w in label.split())


def _class(c: str) -> str:
    whens = " ".join("WHEN contains(lower({c}), '{a}') THEN '{b}'".format(c=c, a=w.replace("'", "''"), b=_titled(w).replace("'", "''")) for w in _CLASSES)
    return f"CASE {whens} END"


def _sides() -> str:
    out = []
    for s in P.SIDES:
        f = f"{s}_fighter"
        out += [f"{f}_id AS {s}_id", f"{f}_name AS {s}_name"]
        out += [f"coalesce({_of(f'{f}_sig_str', i)}, {f}_sig_str_{w}::DOUBLE) AS {s}_sig_{w}" for i, w in ((1, "landed"), (2, "attempted"))]
        out += [f"{_of(f'{f}_td', i)} AS {s}_td_{w}" for i, w in ((1, "landed"), (2, "attempted"))]
        out += [f"{f}_kd::DOUBLE AS {s}_kd", f"{_clock(f'CASE WHEN trim({f}_ctrl) NOT IN ({_TOKENS}) THEN trim({f}_ctrl) END')} AS {s}_ctrl_seconds"]
        out += [f"CASE WHEN NOT isnan({f}_{c}) THEN {f}_{c} END AS {s}_{c}" for c in ("height", "reach", "weight")]
        out.append(f"{f}_dob AS {s}_dob")
    return ", ".join(out)


CONTESTS_SQL = f"""c AS (SELECT DISTINCT bout_id, event_date, (event_date - DATE '1970-01-01')::INT AS day,
  lower(CASE WHEN trim(fight_outcome) NOT IN ({_TOKENS}) THEN trim(fight_outcome) END) AS outcome,
  CASE WHEN lower(trim(fight_outcome)) = 'red_win' THEN 1 ELSE 0 END AS red_win, lower(win_method) AS method, end_round AS round,
  (end_round - 1) * 300 + {_clock("end_time")} AS duration_seconds, {_rounds("time_format")} AS rounds, {_class("bout_type")} AS weight_class, {_sides()}
  FROM combined_data WHERE event_date IS NOT NULL AND red_fighter_id IS NOT NULL AND blue_fighter_id IS NOT NULL)"""
_M = ["sig_landed", "sig_attempted", "td_landed", "td_attempted", "kd", "ctrl_seconds"]


def _long_side(own: str, other: str) -> str:
    m = ", ".join([f"{own}_{x} AS {x}" for x in _M] + [f"{other}_{x} AS opp_{x}" for x in _M])
    return f"SELECT bout_id, day, method, round, duration_seconds, rounds, '{own}' AS side, {own}_id AS entity, {other}_id AS opponent, coalesce((outcome = '{own}_win')::INT, 0) AS won, coalesce((outcome = '{other}_win')::INT, 0) AS lost, {m} FROM c"


LONG_SQL = f"{CONTESTS_SQL}, l AS ({_long_side('red', 'blue')} UNION ALL {_long_side('blue', 'red')})"
_PREV = "OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _sum(x: str) -> str:
    return f"coalesce(sum(coalesce(({x})::DOUBLE, 0)) {_PREV}, 0)"


_OUTCOME_SQL = {
    "total_fights": _sum("1"), "total_wins": _sum("won"), "total_losses": _sum("lost"),
    **{f"total_{m}_wins": _sum(f"CASE WHEN won = 1 AND contains(coalesce(method, ''), '{m}') THEN 1 END") for m in ("ko", "submission", "decision")},
    "total_ko_losses": _sum("CASE WHEN lost = 1 AND contains(coalesce(method, ''), 'ko') THEN 1 END"),
}
_VOLUME_SQL = {n: _sum(c) for n, c in {**H.TOTALS, **H.ABSORBED}.items() if c in (*_M, "duration_seconds") or c.removeprefix("opp_") in _M}


def _select(parts: dict[str, str], source: str = "l", with_: str = LONG_SQL, round_: bool = True) -> str:
    body = ", ".join(f"{f'round(({e})::DOUBLE, 6)' if round_ else e} AS {n}" for n, e in parts.items())
    return f"WITH {with_} SELECT bout_id, side, {body} FROM {source}"


# --- history ----------------------------------------------------------------------------------------------------------

_TOTALS = [*_OUTCOME_SQL, *[n for n in _VOLUME_SQL if n not in H.ABSORBED]]
_ABSORBED = [n for n in _VOLUME_SQL if n in H.ABSORBED]


@query(_select({n: {**_OUTCOME_SQL, **_VOLUME_SQL}[n] for n in _TOTALS}))
def prior_totals(spark, folder):
    return rounded(H.career_totals(long(spark, folder)), ["bout_id", "side"], _TOTALS)


@query(_select({n: _VOLUME_SQL[n] for n in _ABSORBED}))
def prior_absorbed(spark, folder):
    return rounded(H.career_totals(long(spark, folder)), ["bout_id", "side"], _ABSORBED)


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 AND ({n}) IS NOT NULL THEN ({n}) / ({d}) ELSE 0 END"


_TOTALS_SQL = f"{LONG_SQL}, t AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in {**_OUTCOME_SQL, **_VOLUME_SQL}.items())} FROM l)"
_RATES_SQL = {n: _ratio(t, "total_fights") for n, t in D.PER_FIGHT.items() if t in {**_OUTCOME_SQL, **_VOLUME_SQL}}
_RATES_SQL |= {n: _ratio(f"{t} * 60", "total_fight_duration_seconds") for n, t in D.PER_MIN.items() if t in _VOLUME_SQL}
_RATES_SQL |= {"td_defense": f"CASE WHEN total_td_attempted_against > 0 THEN 1 - {_ratio('total_td_absorbed', 'total_td_attempted_against')} ELSE 0 END", "sig_strike_accuracy": _ratio("total_sig_strikes_landed", "total_sig_strikes_attempted"), "td_accuracy": _ratio("total_td_landed", "total_td_attempted"), "ctrl_share": _ratio("total_ctrl_seconds", "total_fight_duration_seconds")}


@query(_select(_RATES_SQL, "t", _TOTALS_SQL))
def prior_rates(spark, folder):
    return rounded(D.career_rates(H.career_totals(long(spark, folder))), ["bout_id", "side"], list(_RATES_SQL))


@query(
    f"""WITH {LONG_SQL}, x AS (SELECT a.bout_id, a.side, a.entity, a.day,
  (SELECT max(struct_pack(d := b.day, i := b.bout_id)) FROM l b WHERE b.entity = a.entity AND b.day < a.day AND b.lost = 1) AS last_loss,
  (SELECT max(struct_pack(d := b.day, i := b.bout_id)) FROM l b WHERE b.entity = a.entity AND b.day < a.day AND b.won = 1) AS last_win FROM l a)
SELECT x.bout_id, x.side, count(*) FILTER (WHERE b.won = 1 AND (last_loss IS NULL OR struct_pack(d := b.day, i := b.bout_id) > last_loss)) AS win_streak,
  count(*) FILTER (WHERE b.lost = 1 AND (last_win IS NULL OR struct_pack(d := b.day, i := b.bout_id) > last_win)) AS loss_streak
FROM x LEFT JOIN l b ON b.entity = x.entity AND b.day < x.day GROUP BY x.bout_id, x.side"""
)
def win_loss_streak(spark, folder):
    return H.streaks(results_only(spark, folder)).select("bout_id", "side", "win_streak", "loss_streak")


_YEARS = f"coalesce((day - min(day) {_PREV}) / 365.25, 0)"


@query(_select({"years_active": _YEARS, "fights_per_year": _ratio(f"count(*) {_PREV}", _YEARS)}))
def career_span(spark, folder):
    return rounded(H.career_span(results_only(spark, folder)), ["bout_id", "side"], ["years_active", "fights_per_year"])


_SINCE = f"day - max(day) {_PREV}"


@query(_select({"days_since_last_fight": _SINCE, "short_turnaround": f"CASE WHEN {_SINCE} < 100 THEN 1 ELSE 0 END", "long_layoff": f"CASE WHEN {_SINCE} > 365 THEN 1 ELSE 0 END"}, round_=False))
def layoff_flags(spark, folder):
    return H.layoffs(results_only(spark, folder)).select("bout_id", "side", "days_since_last_fight", "short_turnaround", "long_layoff")


_DEC, _LATE, _FIVE = "contains(coalesce(method, ''), 'decision')", "coalesce(round >= 3, false)", "coalesce(rounds >= 5, false)"
_ENDURANCE = {
    "avg_fight_duration_seconds": _ratio(_sum("duration_seconds"), _sum("1")), "decision_rate": _ratio(_sum(f"{_DEC}::INT"), _sum("1")),
    "late_finish_rate": _ratio(_sum(f"({_LATE} AND NOT {_DEC})::INT"), _sum("1")), "third_round_or_later_rate": _ratio(_sum(f"({_LATE})::INT"), _sum("1")),
    "past_5_round_scheduled_fights": _sum(f"({_FIVE})::INT"), "five_round_fights_completed": _sum(f"({_FIVE} AND coalesce(round >= 4, false))::INT"),
    "past_5_round_wins": _sum(f"({_FIVE})::INT * won"), "past_5_round_losses": _sum(f"({_FIVE})::INT * lost"),
}


@query(_select(_ENDURANCE))
def cardio_rates(spark, folder):
    return rounded(H.endurance(results_only(spark, folder)), ["bout_id", "side"], list(_ENDURANCE))


@query(
    f"""WITH {_TOTALS_SQL}, r AS (SELECT *, {_ratio("total_wins", "total_fights")} AS win_pct FROM t),
o AS (SELECT r.bout_id, r.side, r.entity, r.day, q.win_pct AS ow, q.total_wins AS ot, q.total_fights AS ofi FROM r JOIN r q ON q.bout_id = r.bout_id AND q.entity = r.opponent AND q.side <> r.side)
SELECT bout_id, side, {", ".join(f"round(coalesce(avg({a}) {_PREV}, 0), 6) AS avg_opponent_{n}" for a, n in (("ow", "win_pct"), ("ot", "total_wins"), ("ofi", "total_fights")))} FROM o"""
)
def opponent_strength(spark, folder):
    rows = checkpoint(D.career_rates(H.career_totals(long(spark, folder))))  # joined with itself
    metrics = ["win_pct", "total_wins", "total_fights"]
    return rounded(H.past_opponents(rows, metrics), ["bout_id", "side"], [f"avg_opponent_{m}" for m in metrics])


def _form_sql(n: int) -> str:
    total = lambda c: f"coalesce(sum(coalesce({c}::DOUBLE, 0)) FILTER (WHERE i <= {n}), 0)"
    k = f"nullif(count(i) FILTER (WHERE i <= {n}), 0)"
    out = [f"round(coalesce({total(c)} / {k}, 0), 6) AS recent_{n}_{name}" for name, c in H.FORM.items()]
    out.append(f"round(CASE WHEN {total('duration_seconds')} > 1e-6 THEN {total('sig_landed')} * 60 / {total('duration_seconds')} ELSE 0 END, 6) AS recent_{n}_sig_strikes_landed_per_min")
    return f"""WITH {LONG_SQL}, h AS (SELECT a.bout_id AS a_bout, a.side AS a_side, b.*, CASE WHEN b.bout_id IS NOT NULL THEN row_number() OVER (PARTITION BY a.bout_id, a.side ORDER BY b.day DESC, b.bout_id DESC) END AS i
  FROM l a LEFT JOIN l b ON a.entity = b.entity AND b.day < a.day) SELECT a_bout AS bout_id, a_side AS side, {", ".join(out)} FROM h GROUP BY a_bout, a_side"""


def _form_columns(prefix: str) -> list[str]:
    return [f"{prefix}{n}" for n in (*H.FORM, "sig_strikes_landed_per_min")]


@query(_form_sql(2))
def last_n_form(spark, folder):
    return rounded(H.last_n(long(spark, folder), 2), ["bout_id", "side"], _form_columns("recent_2_"))


@query(_form_sql(5))
def last_5_form(spark, folder):
    return rounded(H.last_n(long(spark, folder), 5), ["bout_id", "side"], _form_columns("recent_5_"))


_W = "pow(2.0, -(a.day - b.day) / 365.0)"


@query(
    f"""WITH {LONG_SQL} SELECT a.bout_id, a.side, {", ".join(f"round(CASE WHEN sum({_W}) > 1e-6 THEN sum({_W} * coalesce(b.{c}, 0)) / sum({_W}) ELSE 0 END, 6) AS exp_decay_{n}" for n, c in H.FORM.items())},
  round(CASE WHEN sum({_W}) > 1e-6 AND sum({_W} * coalesce(b.duration_seconds, 0)) > 1e-6 THEN sum({_W} * coalesce(b.sig_landed, 0)) * 60 / sum({_W} * coalesce(b.duration_seconds, 0)) ELSE 0 END, 6) AS exp_decay_sig_strikes_landed_per_min
FROM l a LEFT JOIN l b ON a.entity = b.entity AND b.day < a.day GROUP BY a.bout_id, a.side"""
)
def exp_decay_form(spark, folder):
    return rounded(H.decayed(long(spark, folder)), ["bout_id", "side"], _form_columns("exp_decay_"))


_EXPECTED = "1 / (1 + pow(10, (coalesce(s.m[o.blue_id], 500) - coalesce(s.m[o.red_id], 500)) / 400))"


elo_ratings_sql = f"""WITH RECURSIVE {CONTESTS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY day, bout_id) AS n, rank() OVER (ORDER BY day) AS first_n, CASE outcome WHEN 'red_win' THEN 1.0::DOUBLE WHEN 'blue_win' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM c),
s(n, m) AS (SELECT 0::BIGINT, MAP([]::BIGINT[], []::DOUBLE[]) UNION ALL SELECT o.n, map_concat(s.m, MAP([o.red_id, o.blue_id], [coalesce(s.m[o.red_id], 500) + 32 * (o.score - {_EXPECTED}), coalesce(s.m[o.blue_id], 500) + 32 * ({_EXPECTED} - o.score)])) FROM s JOIN o ON o.n = s.n + 1),
r AS (SELECT o.bout_id, coalesce(s.m[o.red_id], 500) AS red_elo, coalesce(s.m[o.blue_id], 500) AS blue_elo FROM o JOIN s ON s.n = o.first_n - 1)
SELECT bout_id, round(red_elo, 6) AS red_elo, round(blue_elo, 6) AS blue_elo, round(red_elo - blue_elo, 6) AS elo_diff, round(1 / (1 + pow(10, (blue_elo - red_elo) / 400)), 6) AS red_elo_win_prob FROM r"""


@query(elo_ratings_sql)
def elo_ratings(spark, folder):
    return rounded(elo(contests(spark, folder)), ["bout_id"], ["red_elo", "blue_elo", "elo_diff", "red_elo_win_prob"])


# --- derived features -------------------------------------------------------------------------------------------------


def _rated(spark, folder) -> DataFrame:
    return D.career_rates(H.career_totals(checkpoint(P.to_long(struck(spark, folder), ["sig_landed", "sig_attempted", "td_landed", "td_attempted", "kd", "sub_att", "ctrl_seconds", *P.STRIKES[:6]]))))


_STRIKES_SQL = f"""s0 AS (SELECT DISTINCT * FROM contest_stats), s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) = 1),
s2 AS (SELECT *, string_split(trim(regexp_replace(lower(stat_type), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_'), '_') AS w FROM s1 WHERE nullif(trim(regexp_replace(lower(stat_type), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_'), '') IS NOT NULL),
s AS (SELECT bout_id, fighter_id AS entity, {", ".join(f"sum(CASE WHEN list_contains(w, '{p}') THEN coalesce(fighter_sig_str_landed, 0) ELSE 0 END) AS {p}_landed" for p in ("head", "body", "leg"))} FROM s2 GROUP BY ALL)"""
_PARTS = ("head", "body", "leg")
_STRUCK_SQL = f"""{LONG_SQL}, {_STRIKES_SQL}, ls AS (SELECT l.*, {", ".join(f"a.{p}_landed AS {p}_landed, b.{p}_landed AS opp_{p}_landed" for p in _PARTS)} FROM l LEFT JOIN s a USING (bout_id, entity) LEFT JOIN s b ON b.bout_id = l.bout_id AND b.entity = l.opponent),
t AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in {**_OUTCOME_SQL, **_VOLUME_SQL}.items())}, {", ".join(f"{_sum(f'{p}_landed')} AS total_sig_strikes_{p}_landed, {_sum(f'opp_{p}_landed')} AS total_sig_strikes_{p}_absorbed" for p in _PARTS)} FROM ls),
k AS (SELECT count(*) AS n, {", ".join(f"greatest(coalesce(corr(total_sig_strikes_{p}_landed, total_kd), 0), 0) AS c_{p}, avg(total_sig_strikes_{p}_landed) AS m_{p}" for p in _PARTS)} FROM t WHERE total_sig_strikes_head_landed + total_sig_strikes_body_landed + total_sig_strikes_leg_landed > 0),
w AS (SELECT {", ".join(f"c_{p} * m_{p} / (c_head * m_head + c_body * m_body + c_leg * m_leg) AS w_{p}" for p in _PARTS)} FROM k)"""


@query(f"WITH {_STRUCK_SQL} SELECT round(w_head, 6) AS w_head, round(w_body, 6) AS w_body, round(w_leg, 6) AS w_leg FROM w")
def strike_weights(spark, folder):
    return rounded(D.strike_weights(H.career_totals(P.to_long(struck(spark, folder)))), [], ["w_head", "w_body", "w_leg"])


_ZS = ("kd_efficiency_weighted", "kd_per_min", "ko_rate", "kd_absorbed_efficiency", "kd_absorbed_per_min", "ko_loss_rate")
_POWER_SQL = f"""{_STRUCK_SQL}, p AS (SELECT t.*, {" + ".join(f"w_{p} * total_sig_strikes_{p}_landed" for p in _PARTS)} AS weighted_strikes, {" + ".join(f"w_{p} * total_sig_strikes_{p}_absorbed" for p in _PARTS)} AS weighted_strikes_absorbed FROM t, w),
q AS (SELECT *, total_kd / (weighted_strikes + 1e-6) AS kd_efficiency_weighted, {_ratio("total_kd * 60", "total_fight_duration_seconds")} AS kd_per_min, {_ratio("total_ko_wins", "total_fights")} AS ko_rate,
  total_kd_absorbed / (weighted_strikes_absorbed + 1e-6) AS kd_absorbed_efficiency, {_ratio("total_kd_absorbed * 60", "total_fight_duration_seconds")} AS kd_absorbed_per_min, {_ratio("total_ko_losses", "total_fights")} AS ko_loss_rate FROM p),
z AS (SELECT *, {", ".join(f"CASE WHEN stddev_pop({c}) OVER () >= 1e-6 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS z_{c}" for c in _ZS)} FROM q),
i AS (SELECT *, ({" + ".join(f"z_{c}" for c in _ZS[:3])}) / 3 AS power_index, ({" + ".join(f"z_{c}" for c in _ZS[3:])}) / 3 AS vulnerability_index FROM z)"""


@query(f"WITH {_POWER_SQL} SELECT bout_id, side, {', '.join(f'round({c}, 5) AS {c}' for c in ('weighted_strikes', 'kd_efficiency_weighted', 'kd_per_min', 'power_index', 'vulnerability_index'))} FROM i")
def power_index(spark, folder):
    rows = D.power(_rated(spark, folder))
    return rows.select("bout_id", "side", *[F.round(c, 5).alias(c) for c in ("weighted_strikes", "kd_efficiency_weighted", "kd_per_min", "power_index", "vulnerability_index")])


@query(f"WITH {_TOTALS_SQL}, x AS (SELECT *, {_RATES_SQL['win_pct']} AS win_pct FROM t) SELECT bout_id, side, round(CASE WHEN stddev_pop(win_pct) OVER () >= 1e-6 THEN (win_pct - avg(win_pct) OVER ()) / stddev_pop(win_pct) OVER () ELSE 0 END, 6) AS z_win_pct FROM x")
def shared_scores(spark, folder):
    rows = D.shared_scores(D.career_rates(H.career_totals(long(spark, folder))), ["win_pct"])
    return rounded(rows, ["bout_id", "side"], ["z_win_pct"])


def _momentum_sql() -> str:
    form = _form_sql(2)
    return f"""SELECT f.bout_id, f.side, round(recent_2_win_pct - win_pct + 1e-9, 5) AS momentum_win_pct, round(recent_2_sig_strikes_landed_per_min - sig_strikes_landed_per_min + 1e-9, 5) AS momentum_sig_strikes_per_min,
  round(recent_2_td_landed_per_fight - td_landed_per_fight + 1e-9, 5) AS momentum_td_landed_per_fight FROM ({form}) f JOIN ({_select(_RATES_SQL, "t", _TOTALS_SQL)}) r USING (bout_id, side)"""


@query(_momentum_sql())
def momentum(spark, folder):
    rates = rounded(D.career_rates(H.career_totals(long(spark, folder))), ["bout_id", "side"], list(_RATES_SQL))
    form = last_n_form(spark, folder)
    rows = D.momentum(form.join(rates, ["bout_id", "side"]))
    return rows.select("bout_id", "side", *[F.round(F.col(c) + NUDGE, 5).alias(c) for c in ("momentum_win_pct", "momentum_sig_strikes_per_min", "momentum_td_landed_per_fight")])


_DIFFS = ["total_fights", "total_wins", "win_pct", "sig_strikes_landed_per_fight", "td_landed_per_fight"]
_WIDE_SQL = f"""{_TOTALS_SQL}, r AS (SELECT *, {", ".join(f"{_RATES_SQL[n]} AS {n}" for n in _DIFFS if n in _RATES_SQL)} FROM t)"""


@query(f"WITH {_WIDE_SQL} SELECT a.bout_id, {', '.join(f'round(a.{n} - b.{n}, 6) AS diff_{n}' for n in _DIFFS)} FROM r a JOIN r b ON a.bout_id = b.bout_id AND a.side = 'red' AND b.side = 'blue'")
def paired_differences(spark, folder):
    wide = P.to_wide(D.career_rates(H.career_totals(long(spark, folder))), _DIFFS)
    return rounded(P.difference_aliases(P.side_differences(wide)), ["bout_id"], [f"diff_{n}" for n in _DIFFS])


def _style_sql() -> str:
    log = lambda x: f"ln(1 + greatest(coalesce({x}, 0), 0))"
    pos = lambda x: f"greatest(coalesce({x}, 0), 0)"
    unit = lambda x: f"least(greatest(coalesce({x}, 0), 0), 1)"
    rates = ", ".join(f"{_RATES_SQL[n]} AS {n}" for n in ("sig_strikes_landed_per_min", "sig_strikes_landed_per_fight", "kd_per_fight", "td_attempted_per_fight", "td_landed_per_fight", "ctrl_seconds_per_fight", "td_defense", "td_accuracy", "kd_absorbed_per_fight"))
    volume, power_ = f"{log('sig_strikes_landed_per_min')} + 0.5 * {log('sig_strikes_landed_per_fight')}", f"0.5 * {log('kd_per_fight')} + 0.5 * {log('60 * kd_per_min')} + {pos('ko_rate')} + 0.25 * power_index"
    one = {"striking_volume_score": volume, "power_score": power_, "striker_score": f"0.6 * ({volume}) + 0.4 * ({power_})", "grappler_score": f"{log('td_attempted_per_fight')} + {log('td_landed_per_fight')} + {log('ctrl_seconds_per_fight / 60')}"}
    one |= {"finish_score": f"{log('kd_per_fight')} + {pos('ko_rate')} + 0.5 * power_index", "vulnerability_score": f"{log('kd_absorbed_per_fight')} + {pos('ko_loss_rate')} + 0.5 * vulnerability_index"}
    pairs = [(s, o, "a" if s == "red" else "b", "b" if s == "red" else "a") for s, o in (("red", "blue"), ("blue", "red"))]
    out = [f"round({x}.{n}, 5) AS pre_fight_{s}_{n}" for s, _, x, _ in pairs for n in one]
    td = {s: f"{pos(f'{x}.td_landed_per_fight')} * (1 - {unit(f'{y}.td_defense')})" for s, _, x, y in pairs}
    press = {s: f"({pos(f'{x}.td_attempted_per_fight')} + {pos(f'{x}.ctrl_seconds_per_fight / 60')}) * (1 - {unit(f'{y}.td_defense')}) * (0.5 + {unit(f'{x}.td_accuracy')})" for s, _, x, y in pairs}
    out += [f"round(a.{n} - b.{n}, 5) AS diff_{n}" for n in ("striker_score", "grappler_score")] + [f"round({td['red']} - {td['blue']}, 5) AS diff_td_offense_vs_td_defense", f"round({press['red']} - {press['blue']}, 5) AS diff_grappling_pressure_vs_defense"]
    out += ["round(a.grappler_score * b.striker_score - a.striker_score * b.grappler_score, 5) AS diff_grappler_vs_striker_interaction", "round(a.finish_score * b.vulnerability_score - b.finish_score * a.vulnerability_score, 5) AS diff_finish_vs_durability"]
    return f"WITH {_POWER_SQL}, y AS (SELECT *, {rates} FROM i), x AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in one.items())} FROM y) SELECT a.bout_id, {', '.join(out)} FROM x a JOIN x b ON a.bout_id = b.bout_id AND a.side = 'red' AND b.side = 'blue'"


_STYLE = [f"pre_fight_{s}_{n}" for s in P.SIDES for n in ("striking_volume_score", "power_score", "striker_score", "grappler_score", "finish_score", "vulnerability_score")]
_STYLE += [f"diff_{n}" for n in ("striker_score", "grappler_score", "td_offense_vs_td_defense", "grappling_pressure_vs_defense", "grappler_vs_striker_interaction", "finish_vs_durability")]


@query(_style_sql())
def style_scores(spark, folder):
    rows = D.power(_rated(spark, folder))
    need = ["sig_strikes_landed_per_min", "sig_strikes_landed_per_fight", "kd_per_fight", "kd_per_min", "ko_rate", "ko_loss_rate", "power_index", "vulnerability_index", "td_attempted_per_fight", "td_landed_per_fight", "ctrl_seconds_per_fight", "sub_att_per_fight", "td_defense", "td_accuracy", "kd_absorbed_per_fight"]
    scored = D.style(P.to_wide(rows, need))
    return scored.select("bout_id", *[F.round(c, 5).alias(c) for c in _STYLE])


@query(f"WITH {CONTESTS_SQL} SELECT bout_id, round({_ratio('red_sig_landed', 'duration_seconds / 60')}, 6) AS red_fighter_sig_strikes_landed_per_minute, round({_ratio('blue_td_landed', 'blue_td_attempted')}, 6) AS blue_fighter_td_accuracy, round({_ratio('red_ctrl_seconds', 'duration_seconds')}, 6) AS red_fighter_ctrl_share FROM c")
def current_contest_rates(spark, folder):
    return rounded(D.contest_rates(contests(spark, folder)), ["bout_id"], ["red_fighter_sig_strikes_landed_per_minute", "blue_fighter_td_accuracy", "red_fighter_ctrl_share"])


# --- parsers ----------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT bout_id, {_of('red_fighter_sig_str', 1)} AS landed, {_of('red_fighter_sig_str', 2)} AS attempted FROM combined_data")
def parse_landed_attempted(spark, folder):
    c = F.col("red_fighter_sig_str")
    return read_table(spark, folder, "combined_data").select("bout_id", X.landed(c).alias("landed"), X.attempted(c).alias("attempted")).distinct()


@query(f"SELECT DISTINCT bout_id, {_clock('end_time')} AS seconds, (end_round - 1) * 300 + {_clock('end_time')} AS duration, {_clock(f'CASE WHEN trim(red_fighter_ctrl) NOT IN ({_TOKENS}) THEN trim(red_fighter_ctrl) END')} AS ctrl FROM combined_data")
def parse_clock(spark, folder):
    t = read_table(spark, folder, "combined_data")
    return t.select("bout_id", X.clock_seconds(F.col("end_time")).alias("seconds"), X.contest_seconds(F.col("end_round"), F.col("end_time")).alias("duration"), X.clock_seconds(X.clean_placeholder(F.col("red_fighter_ctrl"))).alias("ctrl")).distinct()


@query(f"SELECT DISTINCT bout_id, {_rounds('time_format')} AS rounds, {_class('bout_type')} AS weight_class FROM combined_data")
def parse_rounds_and_class(spark, folder):
    t = read_table(spark, folder, "combined_data")
    return t.select("bout_id", X.scheduled_rounds(F.col("time_format")).alias("rounds"), X.weight_class(F.col("bout_type")).alias("weight_class")).distinct()


_NUM = r"TRY_CAST(regexp_extract({c}, '\d+(?:\.\d+)?', 0) AS DOUBLE)"


@query(
    r"""WITH e AS (SELECT DISTINCT profile_id, translate(height, '’‘′″”“', '''''''"""  # noqa: ISC003
    + '"""'
    + r"""') AS h, str_acc, weight FROM entities_raw)
SELECT profile_id, round(coalesce(TRY_CAST(regexp_extract(h, '(\d+)\s*(?:''|ft)\s*(\d+(?:\.\d+)?)?', 1) AS DOUBLE) * 12 + coalesce(TRY_CAST(regexp_extract(h, '(\d+)\s*(?:''|ft)\s*(\d+(?:\.\d+)?)?', 2) AS DOUBLE), 0),
  TRY_CAST(regexp_extract(lower(h), '(\d+(?:\.\d+)?)\s*cm', 1) AS DOUBLE) / 2.54, TRY_CAST(regexp_extract(h, '\d+(?:\.\d+)?', 0) AS DOUBLE)), 6) AS inches,
  round(CASE WHEN contains(str_acc, '%') OR TRY_CAST(regexp_extract(str_acc, '\d+(?:\.\d+)?', 0) AS DOUBLE) > 1 THEN TRY_CAST(regexp_extract(str_acc, '\d+(?:\.\d+)?', 0) AS DOUBLE) / 100 ELSE TRY_CAST(regexp_extract(str_acc, '\d+(?:\.\d+)?', 0) AS DOUBLE) END, 6) AS accuracy,
  TRY_CAST(regexp_extract(weight, '\d+(?:\.\d+)?', 0) AS DOUBLE) AS weight_number FROM e"""
)
def parse_measures(spark, folder):
    t = read_table(spark, folder, "entities_raw").select("profile_id", "height", "str_acc", "weight").distinct()
    return t.select("profile_id", F.round(X.inches(F.col("height")), 6).alias("inches"), F.round(X.share(F.col("str_acc")), 6).alias("accuracy"), X.first_number(F.col("weight")).alias("weight_number"))


_KEY = r"trim(regexp_replace(regexp_replace(upper(strip_accents(coalesce({c}, ''))), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT DISTINCT bout_id, nullif(lower(regexp_replace(trim(red_fighter_name), '\s+', ' ', 'g')), '') AS simple, {_KEY.format(c='red_fighter_name')} AS name_key, least({_KEY.format(c='red_fighter_name')}, {_KEY.format(c='blue_fighter_name')}) || '__' || greatest({_KEY.format(c='red_fighter_name')}, {_KEY.format(c='blue_fighter_name')}) AS pair_key FROM combined_data")
def name_keys(spark, folder):
    t = read_table(spark, folder, "combined_data").select("bout_id", "red_fighter_name", "blue_fighter_name").distinct()
    red, blue = X.name_key(F.col("red_fighter_name")), X.name_key(F.col("blue_fighter_name"))
    rows = t.select("bout_id", X.simple_name(F.col("red_fighter_name")).alias("simple"), red.alias("name_key"), blue.alias("b"))
    return rows.select("bout_id", "simple", "name_key", X.unordered_key(F.col("name_key"), F.col("b")).alias("pair_key"))


_DATE = "coalesce(try_strptime(trim(dob), '%d/%m/%Y'), try_strptime(trim(dob), '%Y-%m-%d'), try_strptime(trim(dob), '%b %d, %Y'))::DATE"


@query(f"SELECT DISTINCT profile_id, {_DATE}::VARCHAR AS born FROM entities_raw")
def date_parse(spark, folder):
    return read_table(spark, folder, "entities_raw").select("profile_id", N.event_date(F.col("dob")).cast("string").alias("born")).distinct()


@query("SELECT DISTINCT bout_id, year(event_date) - year(red_fighter_dob) - CASE WHEN month(event_date) < month(red_fighter_dob) OR month(event_date) = month(red_fighter_dob) AND day(event_date) < day(red_fighter_dob) THEN 1 ELSE 0 END AS age FROM combined_data")
def age_at_event(spark, folder):
    return read_table(spark, folder, "combined_data").select("bout_id", N.age_at(F.col("event_date"), F.col("red_fighter_dob")).alias("age")).distinct()


# --- joins with profiles ----------------------------------------------------------------------------------------------

_PRESENT = ["height", "weight", "reach", "stance", "dob"]


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    t = X.clean_text_columns(read_table(spark, folder, "entities_raw").select("profile_id", "fighter_name", *_PRESENT).distinct())
    return H.best_profile(t.withColumn("name_key", X.name_key(F.col("fighter_name"))).where("name_key != ''"), "name_key", _PRESENT, "profile_id")


_CLEAN = lambda c: f"CASE WHEN trim({c}) NOT IN ({_TOKENS}) THEN trim({c}) END AS {c}"
_PROFILES_SQL = f"""e AS (SELECT DISTINCT profile_id, {", ".join(_CLEAN(c) for c in ["fighter_name", *_PRESENT])} FROM entities_raw), f AS (SELECT *, {_KEY.format(c="fighter_name")} AS name_key FROM e),
g AS (SELECT * FROM f WHERE name_key <> '' QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY {" + ".join(f"({c} IS NOT NULL)::INT" for c in _PRESENT)} DESC, profile_id) = 1)"""


@query(f"WITH {_PROFILES_SQL} SELECT name_key, profile_id, height, stance FROM g")
def best_profile(spark, folder):
    return profiles(spark, folder).select("name_key", "profile_id", "height", "stance")


@query(f"WITH {CONTESTS_SQL}, {_PROFILES_SQL} SELECT c.bout_id, a.profile_id AS red_profile, b.profile_id AS blue_profile, a.stance AS red_profile_stance FROM c LEFT JOIN g a ON a.name_key = {_KEY.format(c='red_name')} LEFT JOIN g b ON b.name_key = {_KEY.format(c='blue_name')}")
def entity_attributes_join(spark, folder):
    best = profiles(spark, folder)
    rows = O.contest_keys(contests(spark, folder))
    red, blue = (best.select(F.col("name_key").alias(f"{s}_key"), F.col("profile_id").alias(f"{s}_profile"), F.col("stance").alias(f"{s}_profile_stance")) for s in P.SIDES)
    return rows.join(red, "red_key", "left").join(blue, "blue_key", "left").select("bout_id", "red_profile", "blue_profile", "red_profile_stance")


@query(f"WITH {CONTESTS_SQL}, {_PROFILES_SQL} SELECT DISTINCT name_key FROM (SELECT {_KEY.format(c='red_name')} AS name_key FROM c UNION ALL SELECT {_KEY.format(c='blue_name')} FROM c) x WHERE name_key NOT IN (SELECT name_key FROM g)")
def unmatched_entities(spark, folder):
    rows = O.contest_keys(contests(spark, folder))
    every = rows.select(F.explode(F.array("red_key", "blue_key")).alias("name_key")).distinct()
    return every.join(profiles(spark, folder).select("name_key"), "name_key", "left_anti")


# --- quotes -----------------------------------------------------------------------------------------------------------

QUOTE_NAMES = {"odds_1": "fighter_1_odds", "odds_2": "fighter_2_odds"}


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    return O.standard_quotes(read_table(spark, folder, "quotes_raw"), QUOTE_NAMES)


_REAL = lambda c, n: f"CASE WHEN NOT isnan({c}) THEN {c} END AS {n}"
QUOTES_SQL = rf"""q0 AS (SELECT DISTINCT quote_id, event_date, fighter_1, fighter_2, {_REAL("fighter_1_odds", "odds_1")}, {_REAL("fighter_2_odds", "odds_2")}, coalesce(nullif(trim(regexp_replace(strip_accents(source), '\s+', ' ', 'g')), ''), 'UNKNOWN_SOURCE') AS source, quoted_at, {_KEY.format(c="fighter_1")} AS key_1, {_KEY.format(c="fighter_2")} AS key_2 FROM quotes_raw),
q AS (SELECT *, least(key_1, key_2) || '__' || greatest(key_1, key_2) AS pair_key FROM q0)"""
_COVER_SQL = f"{QUOTES_SQL}, v AS (SELECT source, count(*) AS n_rows, count(DISTINCT event_date::VARCHAR || '|' || pair_key) AS n_contests, sum((odds_1 IS NULL OR odds_2 IS NULL)::INT)::BIGINT AS n_missing, min(event_date) AS first_date, max(event_date) AS last_date FROM q GROUP BY source)"


@query(f"WITH {_COVER_SQL} SELECT * REPLACE (first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date) FROM v")
def odds_source_coverage(spark, folder):
    return dates_as_text(O.source_coverage(quotes(spark, folder)))


@query(f"WITH {_COVER_SQL} SELECT source FROM v WHERE source NOT IN ('UNKNOWN_SOURCE', 'NO_SOURCE_COLUMN') AND n_contests >= 0.8 * (SELECT max(n_contests) FROM v) ORDER BY n_contests DESC, n_missing, source LIMIT 1")
def pick_odds_source(spark, folder):
    return O.choose_source(O.source_coverage(quotes(spark, folder)))


@query(f"WITH {QUOTES_SQL}, u AS (SELECT source, unnest([odds_1, odds_2]) AS o FROM q) SELECT source, count(o) AS n_odds, CASE WHEN count(o) = 0 THEN 'unknown' WHEN bool_or(o < 0) OR avg((abs(o) >= 100)::INT) > 0.5 THEN 'american' ELSE 'decimal' END AS odds_format FROM u GROUP BY source")
def odds_format(spark, folder):
    return O.odds_format(quotes(spark, folder), ["source"])


_LATEST_SQL = f"{QUOTES_SQL}, lq AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY event_date, pair_key, source ORDER BY quoted_at DESC NULLS FIRST, quote_id DESC) = 1)"


@query(f"WITH {_LATEST_SQL} SELECT quote_id, source, pair_key FROM lq")
def odds_latest(spark, folder):
    return O.latest_quotes(quotes(spark, folder)).select("quote_id", "source", "pair_key")


def _price(i: int) -> str:
    return f"CASE WHEN abs(odds_{i}) >= 100 THEN CASE WHEN odds_{i} > 0 THEN 1 + odds_{i} / 100 ELSE 1 + 100 / abs(odds_{i}) END WHEN odds_{i} > 1 THEN odds_{i} END"


_PROB_SQL = f"{_LATEST_SQL}, d AS (SELECT *, {_price(1)} AS decimal_1, {_price(2)} AS decimal_2 FROM lq), ip AS (SELECT *, 1 / decimal_1 AS prob_1, 1 / decimal_2 AS prob_2, 1 / decimal_1 + 1 / decimal_2 AS overround, (1 / decimal_1) / (1 / decimal_1 + 1 / decimal_2) AS novig_1, (1 / decimal_2) / (1 / decimal_1 + 1 / decimal_2) AS novig_2 FROM d)"


@query(f"WITH {_PROB_SQL} SELECT quote_id, round(overround, 6) AS overround, round(novig_1, 6) AS novig_1, round(prob_2, 6) AS prob_2 FROM ip")
def implied_probs(spark, folder):
    return rounded(O.implied_probabilities(O.latest_quotes(quotes(spark, folder))), ["quote_id"], ["overround", "novig_1", "prob_2"])


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """Contests with the latest quote of the chosen source for their date and names."""
    every = quotes(spark, folder)
    chosen = O.choose_source(O.source_coverage(every)).select("source")
    q = O.implied_probabilities(O.latest_quotes(every.join(F.broadcast(chosen), "source", "left_semi")))  # one row
    return O.merge_quotes(contests(spark, folder), q)


_PICK_SQL = "SELECT source FROM v WHERE source NOT IN ('UNKNOWN_SOURCE', 'NO_SOURCE_COLUMN') AND n_contests >= 0.8 * (SELECT max(n_contests) FROM v) ORDER BY n_contests DESC, n_missing, source LIMIT 1"
_NB_SQL = f"{_COVER_SQL}, lq AS (SELECT * FROM q WHERE source = ({_PICK_SQL}) QUALIFY row_number() OVER (PARTITION BY event_date, pair_key ORDER BY quoted_at DESC NULLS FIRST, quote_id DESC) = 1), {_PROB_SQL.split('= 1), ', 1)[1]}"
_CK = f"least({_KEY.format(c='red_name')}, {_KEY.format(c='blue_name')}) || '__' || greatest({_KEY.format(c='red_name')}, {_KEY.format(c='blue_name')})"
_TURN = ", ".join(f"CASE WHEN key_1 = red_key THEN {n}_{i} ELSE {n}_{3 - i} END AS {s}_{name}" for n, name in (("decimal", "decimal_odds"), ("prob", "implied_prob_raw"), ("novig", "implied_prob_novig")) for i, s in ((1, "red"), (2, "blue")))
MERGED_SQL = f"{CONTESTS_SQL}, {_NB_SQL}, ck AS (SELECT *, {_KEY.format(c='red_name')} AS red_key, {_CK} AS pair_key FROM c), mg AS (SELECT ck.bout_id, ck.event_date, ck.day, ck.outcome, ck.red_win, ip.source IS NOT NULL AS matched, ip.overround AS odds_overround, {_TURN} FROM ck LEFT JOIN ip ON ip.event_date = ck.event_date AND ip.pair_key = ck.pair_key)"


@query(f"WITH {MERGED_SQL} SELECT bout_id, matched, round(red_decimal_odds, 6) AS red_decimal_odds, round(blue_implied_prob_novig, 6) AS blue_implied_prob_novig, round(odds_overround, 6) AS odds_overround FROM mg")
def odds_oriented_merge(spark, folder):
    return rounded(merged(spark, folder), ["bout_id", "matched"], ["red_decimal_odds", "blue_implied_prob_novig", "odds_overround"])


@query(f"WITH {CONTESTS_SQL}, {QUOTES_SQL} SELECT quote_id FROM q WHERE pair_key NOT IN (SELECT {_CK} FROM c)")
def odds_unmatched(spark, folder):
    return O.unmatched_quotes(quotes(spark, folder), contests(spark, folder)).select("quote_id")


@query(f"WITH {QUOTES_SQL}, k AS (SELECT event_date, pair_key, source, count(*) AS n, coalesce(sum((odds_1 <= 1 AND abs(odds_1) < 100)::INT), 0) AS low FROM q GROUP BY ALL) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum((n > 1)::INT)::BIGINT AS n_repeated_keys, sum(low)::BIGINT AS n_low_odds FROM k")
def odds_merge_quality(spark, folder):
    return O.merge_quality(quotes(spark, folder))


# --- splits -----------------------------------------------------------------------------------------------------------

_SPLIT_SQL = f"""{CONTESTS_SQL}, dd AS (SELECT event_date, row_number() OVER (ORDER BY event_date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT event_date FROM c)),
cut AS (SELECT max(CASE WHEN i = greatest(floor(n * 0.70::DOUBLE), 1) THEN event_date END) AS a, max(CASE WHEN i = greatest(floor(n * 0.85::DOUBLE), 1) THEN event_date END) AS b FROM dd),
sp AS (SELECT c.*, CASE WHEN event_date <= a THEN 'train' WHEN event_date <= b THEN 'validation' ELSE 'test' END AS split FROM c, cut)"""


@query(f"WITH {_SPLIT_SQL} SELECT bout_id, split FROM sp")
def chrono_split(spark, folder):
    return S.chronological_split(contests(spark, folder)).select("bout_id", "split")


@query(f"WITH {_SPLIT_SQL} SELECT split, count(*) AS n_rows, min(event_date)::VARCHAR AS first_date, max(event_date)::VARCHAR AS last_date, round(avg(red_win), 6) AS target_mean FROM sp GROUP BY split")
def split_summary(spark, folder):
    return dates_as_text(S.split_summary(S.chronological_split(contests(spark, folder))).withColumn("target_mean", F.round("target_mean", 6)))


@query(f"WITH {_SPLIT_SQL}, b AS (SELECT split, min(event_date) AS lo, max(event_date) AS hi, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS o FROM sp GROUP BY split) SELECT x.split AS earlier, y.split AS later, x.hi < y.lo AS dates_follow, (SELECT count(*) FROM (SELECT bout_id FROM sp WHERE split = x.split INTERSECT SELECT bout_id FROM sp WHERE split = y.split)) AS shared_keys, (SELECT count(*) FROM (SELECT event_date FROM sp WHERE split = x.split INTERSECT SELECT event_date FROM sp WHERE split = y.split)) AS shared_dates FROM b x JOIN b y ON x.o < y.o")
def split_audit(spark, folder):
    return S.split_audit(S.chronological_split(contests(spark, folder)))


_FOLDS_SQL = f"{CONTESTS_SQL}, yy AS (SELECT year(event_date) AS y, count(*) AS n FROM c GROUP BY 1), lg AS (SELECT y AS test_year, n AS n_test, lag(y) OVER (ORDER BY y) AS calibration_year, lag(n) OVER (ORDER BY y) AS n_calibration, sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)::BIGINT AS n_train FROM yy), fo AS (SELECT row_number() OVER (ORDER BY test_year) AS fold_id, calibration_year, test_year, n_train, n_calibration, n_test FROM lg WHERE n_train >= 250 AND n_calibration >= 50 AND n_test >= 50)"


@query(f"WITH {_FOLDS_SQL} SELECT * FROM fo")
def walk_forward_folds(spark, folder):
    return S.walk_forward_folds(contests(spark, folder))


@query(f"WITH {_FOLDS_SQL} SELECT fold_id, CASE WHEN year(event_date) < calibration_year THEN 'train' WHEN year(event_date) = calibration_year THEN 'calibration' ELSE 'test' END AS part, count(*) AS n_rows, round(avg(red_win), 6) AS target_mean FROM c JOIN fo ON year(event_date) <= test_year AND (year(event_date) <= calibration_year OR year(event_date) = test_year) GROUP BY 1, 2")
def fold_parts(spark, folder):
    c = contests(spark, folder)
    return S.fold_rows(c, S.walk_forward_folds(c)).groupBy("fold_id", "part").agg(F.count("*").alias("n_rows"), F.round(F.avg("red_win"), 6).alias("target_mean"))


_ATTRIBUTES = ["red_height", "blue_height", "red_reach", "blue_reach"]


@query(f"WITH {CONTESTS_SQL} SELECT bout_id, event_date::VARCHAR AS event_date, red_name, blue_name, red_win, weight_class, {', '.join(_ATTRIBUTES)} FROM c WHERE event_date >= DATE '2010-01-01'")
def model_safe_filter(spark, folder):
    c = contests(spark, folder).drop("red_stance", "blue_stance")
    return dates_as_text(S.modelling_table(c))


_SAFE_SQL = "'bout_id', 'event_date', 'red_win', 'weight_class_clean', 'red_fighter_name', 'blue_fighter_name', " + ", ".join(f"'{s}_fighter_{c}'" for s in ("red", "blue") for c in ("age", "height", "reach", "stance"))


@query(f"SELECT column_name FROM (DESCRIBE combined_data) WHERE column_name IN ({_SAFE_SQL}) OR starts_with(column_name, 'pre_fight_') OR starts_with(column_name, 'diff_') OR ends_with(column_name, '_diff')")
def model_safe_columns(spark, folder):
    names = S.safe_columns(read_table(spark, folder, "combined_data"))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


_WORDS_SQL = "['result', 'outcome', 'method', 'round', 'time', 'odds', 'referee', 'details', 'fighter_1_odds', 'fighter_2_odds', 'event_name', 'event_location']"


@query(f"SELECT column_name, array_to_string(list_filter({_WORDS_SQL}, lambda w: contains(column_name, w)), ', ') AS words FROM (SELECT column_name FROM (DESCRIBE combined_data) UNION SELECT column_name FROM (DESCRIBE quotes_raw)) d WHERE len(list_filter({_WORDS_SQL}, lambda w: contains(column_name, w))) > 0")
def suspicious_columns(spark, folder):
    found = S.suspects(sorted({*read_table(spark, folder, "combined_data").columns, *read_table(spark, folder, "quotes_raw").columns}))
    return spark.createDataFrame([(c, ", ".join(w)) for c, w in found.items()], "column_name string, words string")


# --- predictions, metrics ---------------------------------------------------------------------------------------------


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Merged contests with two made-up models: one from prior records, one flatter."""
    wide = P.to_wide(D.career_rates(H.career_totals(long(spark, folder))), ["win_pct"])
    p = F.round(0.5 + 0.35 * (F.col("pre_fight_red_win_pct") - F.col("pre_fight_blue_win_pct")), 9)
    rows = merged(spark, folder).join(wide, "bout_id").select("*", p.alias("p"), F.round(0.5 + (p - 0.5) / 2, 9).alias("p_flat"), F.year("event_date").alias("year"))
    return rows.select("*", F.col("red_win").alias("label"), F.round("red_implied_prob_novig", 9).alias("market"))


PRED_SQL = f"""{MERGED_SQL}, l AS ({_long_side("red", "blue")} UNION ALL {_long_side("blue", "red")}), w0 AS (SELECT bout_id, side, {_ratio(_sum("won"), _sum("1"))} AS win_pct FROM l),
pr0 AS (SELECT mg.*, round(0.5::DOUBLE + 0.35::DOUBLE * (a.win_pct - b.win_pct), 9) AS p FROM mg JOIN w0 a ON a.bout_id = mg.bout_id AND a.side = 'red' JOIN w0 b ON b.bout_id = mg.bout_id AND b.side = 'blue'),
pr AS (SELECT *, round(0.5::DOUBLE + (p - 0.5::DOUBLE) / 2, 9) AS p_flat, year(event_date) AS year, red_win AS label, round(red_implied_prob_novig, 9) AS market FROM pr0)"""
_EPS = "2.220446049250313e-16"
_LL = lambda p: f"avg(-CASE WHEN label = 1 THEN ln(least(greatest({p}, {_EPS}::DOUBLE), 1 - {_EPS}::DOUBLE)) ELSE ln(1 - least(greatest({p}, {_EPS}::DOUBLE), 1 - {_EPS}::DOUBLE)) END)"


def _metrics_sql(rows: str, by: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0::DOUBLE AS r FROM {rows}),
ev AS (SELECT {by}, count(*) AS n, round({_LL("p")}, 6) AS log_loss, round(CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))) END, 6) AS roc_auc, round(avg((p - label) ** 2), 6) AS brier,
  round(avg(((p >= 0.5) = (label = 1))::INT), 6) AS accuracy, round(coalesce(sum((p >= 0.5 AND label = 1)::INT) / nullif(sum((p >= 0.5)::INT), 0), 0), 6) AS precision, round(coalesce(sum((p >= 0.5 AND label = 1)::INT) / nullif(sum(label), 0), 0), 6) AS recall, round(coalesce(2 * sum((p >= 0.5 AND label = 1)::INT) / nullif(sum((p >= 0.5)::INT) + sum(label), 0), 0), 6) AS f1 FROM rk GROUP BY {by})"""


_METRICS = ["log_loss", "roc_auc", "brier", "accuracy", "precision", "recall", "f1"]


@query(f"WITH {PRED_SQL}, mm AS (SELECT 'all' AS part, p, label FROM pr), {_metrics_sql('mm', 'part')} SELECT * FROM ev")
def classification_metrics(spark, folder):
    rows = predictions(spark, folder).withColumn("part", F.lit("all"))
    return rounded(M.evaluate(rows, ["part"]), ["part", "n"], _METRICS)


_METHODS = ["p", "p_flat", "market"]


@query(f"WITH {PRED_SQL}, un AS (SELECT year, label, unnest([struct_pack(method := 'p', p := p), struct_pack(method := 'p_flat', p := p_flat), struct_pack(method := 'market', p := market)], recursive := true) FROM pr), mm AS (SELECT year || ' ' || method AS g, * FROM un WHERE p IS NOT NULL), {_metrics_sql('mm', 'g')} SELECT g.*, round(log_loss - max(CASE WHEN ends_with(g, ' market') THEN log_loss END) OVER (PARTITION BY split_part(g, ' ', 1)), 6) AS delta FROM ev g")
def yearly_method_metrics(spark, folder):
    long_ = M.unpivot_methods(predictions(spark, folder), ["year"], _METHODS).withColumn("g", F.concat_ws(" ", F.col("year").cast("string"), "method"))
    rows = rounded(M.evaluate(long_, ["year", "method", "g"]), ["year", "method", "g", "n"], _METRICS)
    return M.against(rows, ["year"], "method", "market").withColumn("delta", F.round("delta", 6)).drop("year", "method")


@query(f"WITH {PRED_SQL} SELECT year, sum((label = 0 AND p < 0.5)::INT)::BIGINT AS tn, sum((label = 0 AND p >= 0.5)::INT)::BIGINT AS fp, sum((label = 1 AND p < 0.5)::INT)::BIGINT AS fn, sum((label = 1 AND p >= 0.5)::INT)::BIGINT AS tp FROM pr GROUP BY year")
def confusion_matrix(spark, folder):
    return M.confusion(predictions(spark, folder).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), ["year"])


_BIN_SQL = "br AS (SELECT *, row_number() OVER (ORDER BY p, bout_id) AS r, count(*) OVER () AS n FROM pr WHERE p IS NOT NULL), bn AS (SELECT *, greatest(ceil(least(10, n) * (r - 1) / (n - 1)::DOUBLE) - 1, 0)::INT AS bin FROM br)"


@query(f"WITH {PRED_SQL}, {_BIN_SQL} SELECT bin, count(*) AS n_rows, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS observed, round(avg(market), 6) AS mean_market FROM bn GROUP BY bin")
def calibration_deciles(spark, folder):
    table = M.calibration(predictions(spark, folder), [], "bout_id", extra={"mean_market": "market"})
    return rounded(table, ["bin", "n_rows"], ["mean_p", "observed", "mean_market"])


@query(f"WITH {PRED_SQL}, {_BIN_SQL}, b AS (SELECT bin, avg(p) AS mean_p, avg(label) AS observed FROM bn GROUP BY bin) SELECT round(avg(abs(mean_p - observed)), 6) AS calibration_gap FROM b")
def calibration_gap(spark, folder):
    return rounded(M.calibration_gap(M.calibration(predictions(spark, folder), [], "bout_id"), []), [], ["calibration_gap"])


_BL = "least(greatest(w * p + (1 - w) * market, 1e-6), 1 - 1e-6)"


@query(f"WITH {PRED_SQL}, g AS (SELECT year, label, p, market, unnest(range(11)) / 10.0::DOUBLE AS w FROM pr WHERE market IS NOT NULL), lo AS (SELECT year, w, round(avg(-CASE WHEN label = 1 THEN ln({_BL}) ELSE ln(1 - {_BL}) END), 12) AS ll FROM g GROUP BY ALL) SELECT year, arg_min(w, struct_pack(a := ll, b := -w)) AS w, round(min(ll), 6) AS log_loss FROM lo GROUP BY year")
def blend_weight_search(spark, folder):
    rows = predictions(spark, folder).where("market IS NOT NULL")
    return M.blend_search(rows, ["year"], "p", "market").withColumn("log_loss", F.round("log_loss", 6))


# --- backtest ---------------------------------------------------------------------------------------------------------


def bets(spark: SparkSession, folder: str) -> DataFrame:
    return B.select_bets(B.edges(predictions(spark, folder)))


BETS_SQL = f"""{PRED_SQL}, ed AS (SELECT *, p - red_implied_prob_novig AS edge_red, 1 - p - blue_implied_prob_novig AS edge_blue FROM pr WHERE p IS NOT NULL AND red_implied_prob_novig IS NOT NULL AND blue_implied_prob_novig IS NOT NULL AND red_decimal_odds IS NOT NULL AND blue_decimal_odds IS NOT NULL),
th AS (SELECT ed.*, unnest([0.0::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.08::DOUBLE, 0.10::DOUBLE]) AS edge_threshold FROM ed),
ch AS (SELECT *, CASE WHEN greatest(edge_red, edge_blue) > edge_threshold THEN CASE WHEN edge_red >= edge_blue THEN 'red' ELSE 'blue' END ELSE 'skip' END AS selected_side FROM th),
bt AS (SELECT bout_id, event_date, edge_threshold, selected_side, CASE selected_side WHEN 'red' THEN edge_red WHEN 'blue' THEN edge_blue END AS selected_edge, CASE selected_side WHEN 'red' THEN red_decimal_odds WHEN 'blue' THEN blue_decimal_odds END AS selected_decimal_odds,
  CASE selected_side WHEN 'red' THEN p WHEN 'blue' THEN 1 - p END AS selected_model_prob, CASE selected_side WHEN 'red' THEN red_implied_prob_novig WHEN 'blue' THEN blue_implied_prob_novig END AS selected_market_prob,
  CASE WHEN selected_side <> 'skip' AND outcome IN ('red_win', 'blue_win') THEN outcome = selected_side || '_win' END AS bet_won FROM ch),
fl AS (SELECT *, 1.0::DOUBLE AS stake, CASE WHEN bet_won THEN selected_decimal_odds - 1 ELSE -1.0::DOUBLE END AS profit FROM bt WHERE selected_side <> 'skip' AND bet_won IS NOT NULL),
fc AS (SELECT *, sum(profit) OVER (PARTITION BY edge_threshold ORDER BY event_date, bout_id ROWS UNBOUNDED PRECEDING) AS cumulative_profit FROM fl)"""


@query(f"WITH {BETS_SQL} SELECT bout_id, edge_threshold, selected_side, round(selected_edge, 6) AS selected_edge, round(selected_decimal_odds, 6) AS selected_decimal_odds, bet_won::VARCHAR AS bet_won FROM bt")
def bet_selection(spark, folder):
    rows = bets(spark, folder).withColumn("bet_won", F.col("bet_won").cast("string"))
    return rounded(rows, ["bout_id", "edge_threshold", "selected_side", "bet_won"], ["selected_edge", "selected_decimal_odds"])


_SUM_SQL = "sm AS (SELECT edge_threshold, count(*) AS n_bets, sum(bet_won::INT)::BIGINT AS wins, sum(profit) AS total_profit, sum(profit) / sum(stake) AS roi FROM fc GROUP BY 1), dr AS (SELECT edge_threshold, max(pk - cumulative_profit) AS max_drawdown FROM (SELECT *, max(cumulative_profit) OVER (PARTITION BY edge_threshold ORDER BY event_date, bout_id ROWS UNBOUNDED PRECEDING) AS pk FROM fc) GROUP BY 1)"


@query(f"WITH {BETS_SQL}, {_SUM_SQL} SELECT edge_threshold, n_bets, wins, round(total_profit, 6) AS total_profit, round(roi, 6) AS roi, round(max_drawdown, 6) AS max_drawdown FROM sm JOIN dr USING (edge_threshold)")
def flat_backtest(spark, folder):
    return rounded(B.summary(B.flat_profit(bets(spark, folder)), ["edge_threshold"]), ["edge_threshold", "n_bets", "wins"], ["total_profit", "roi", "max_drawdown"])


@query(f"WITH {BETS_SQL}, {_SUM_SQL} SELECT edge_threshold, n_bets, round(roi, 6) AS roi FROM sm ORDER BY sm.roi DESC, total_profit DESC, n_bets DESC, edge_threshold LIMIT 1")
def best_threshold(spark, folder):
    return rounded(B.best_threshold(B.summary(B.flat_profit(bets(spark, folder)), ["edge_threshold"])), ["edge_threshold", "n_bets"], ["roi"])


_KB = "(selected_decimal_odds - 1)"
_KELLY_SQL = f"""{BETS_SQL}, k0 AS (SELECT *, unnest([0.25::DOUBLE, 0.5::DOUBLE]) AS kelly_fraction FROM fl), k1 AS (SELECT *, CASE WHEN {_KB} > 0 THEN least(greatest(({_KB} * selected_model_prob - (1 - selected_model_prob)) / {_KB}, 0), 0.25::DOUBLE) ELSE 0 END * kelly_fraction AS f FROM k0),
k2 AS (SELECT *, 1000 * exp(sum(ln(1 + f * CASE WHEN bet_won THEN {_KB} ELSE -1 END)) OVER (PARTITION BY edge_threshold, kelly_fraction ORDER BY event_date, bout_id ROWS UNBOUNDED PRECEDING)) AS bankroll FROM k1)"""


@query(f"WITH {_KELLY_SQL} SELECT edge_threshold, kelly_fraction, count(*) AS n_bets, round(ln(arg_max(bankroll, struct_pack(d := event_date, b := bout_id))), 5) AS log_final_bankroll, round(ln(max(bankroll)), 5) AS log_best_bankroll FROM k2 GROUP BY 1, 2")
def kelly_backtest(spark, folder):
    rows = B.kelly(bets(spark, folder))
    return rows.groupBy("edge_threshold", "kelly_fraction").agg(F.count("*").alias("n_bets"), F.round(F.ln(F.max_by("bankroll", F.struct("event_date", "bout_id"))), 5).alias("log_final_bankroll"), F.round(F.ln(F.max("bankroll")), 5).alias("log_best_bankroll"))


def flat_at(spark: SparkSession, folder: str) -> DataFrame:
    """The flat bets at the threshold with the best return."""
    flat = checkpoint(B.flat_profit(bets(spark, folder)))
    best = B.best_threshold(B.summary(flat, ["edge_threshold"])).select("edge_threshold")
    return flat.join(F.broadcast(best), "edge_threshold", "left_semi")  # one row


_AT = f"{_SUM_SQL}, at0 AS (SELECT * FROM fc WHERE edge_threshold = (SELECT edge_threshold FROM sm ORDER BY roi DESC, total_profit DESC, n_bets DESC, edge_threshold LIMIT 1))"


@query(f"WITH {BETS_SQL}, {_AT} SELECT bout_id, row_number() OVER w AS bet_number, round(sum(profit) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS running_profit, round(CASE WHEN count(*) OVER (w ROWS 49 PRECEDING) >= 10 THEN sum(profit) OVER (w ROWS 49 PRECEDING) / sum(stake) OVER (w ROWS 49 PRECEDING) END + 1e-9, 6) AS rolling_roi FROM at0 WINDOW w AS (ORDER BY event_date, bout_id)")
def rolling_roi(spark, folder):
    rows = G.rolling_return(flat_at(spark, folder), ["edge_threshold"])
    return rounded(rows.withColumn("rolling_roi", F.col("rolling_roi") + NUDGE), ["bout_id", "bet_number"], ["running_profit", "rolling_roi"])


_ENDS = {
    "odds": (("-inf", "odds < 1.5"), (1.5, "1.5 <= odds < 2.0"), (2.0, "2.0 <= odds < 3.0"), (3.0, "3.0 <= odds < 5.0"), (5.0, "odds >= 5.0")),
    "market": (("-inf", "longshot"), (0.25, "underdog"), (0.45, "near coin flip"), (0.55, "slight favorite"), (0.70, "heavy favorite")),
    "model": (("-inf", "<0.35"), (0.35, "0.35-0.45"), (0.45, "0.45-0.55"), (0.55, "0.55-0.65"), (0.65, ">0.65")),
    "edge": ((0.0, "0.00-0.02"), (0.02, "0.02-0.05"), (0.05, "0.05-0.08"), (0.08, "0.08-0.10"), (0.10, ">0.10")),
}


def _bucket_sql(kind: str, c: str) -> str:
    whens = " ".join(f"WHEN {c} IS NOT NULL THEN '{name}'" if lo == "-inf" else f"WHEN {c} >= {lo} THEN '{name}'" for lo, name in reversed(_ENDS[kind]))
    return f"CASE {whens} END"


def _segment_sql(kind: str) -> str:
    label = "selected_side" if kind == "side" else _bucket_sql(kind, G.SEGMENTS[kind])
    names = ["red", "blue"] if kind == "side" else [n for _, n in _ENDS[kind]]
    every = ", ".join(f"('{n}')" for n in names)
    return f"""WITH {BETS_SQL}, {_AT}, s1 AS (SELECT *, {label} AS bucket FROM at0), s2 AS (SELECT *, sum(profit) OVER (PARTITION BY bucket ORDER BY event_date, bout_id ROWS UNBOUNDED PRECEDING) AS e FROM s1), s3 AS (SELECT *, max(e) OVER (PARTITION BY bucket ORDER BY event_date, bout_id ROWS UNBOUNDED PRECEDING) - e AS d FROM s2),
s4 AS (SELECT bucket, count(*) AS n, sum(bet_won::INT) AS won, sum(profit) AS pf, sum(stake) AS st, avg(bet_won::INT) AS wr, avg(selected_edge) AS ae, avg(selected_decimal_odds) AS ao, avg(selected_model_prob) AS mp, avg(selected_market_prob) AS kp, max(d) AS dd FROM s3 GROUP BY bucket), ev(bucket) AS (VALUES {every})
SELECT bucket, coalesce(n, 0)::BIGINT AS n_bets, coalesce(won, 0)::BIGINT AS wins, round(coalesce(pf, 0), 6) AS total_profit, round(coalesce(pf / st, 0), 6) AS roi, round(wr, 6) AS win_rate, round(ae, 6) AS avg_edge, round(ao, 6) AS avg_odds, round(mp, 6) AS avg_model_prob, round(kp, 6) AS avg_market_prob, round(coalesce(dd, 0), 6) AS max_drawdown FROM ev FULL JOIN s4 USING (bucket)"""


def _segment_query(kind: str):
    def run(spark, folder):
        return rounded(G.segment(flat_at(spark, folder), kind), ["bucket", "n_bets", "wins"], ["total_profit", "roi", "win_rate", "avg_edge", "avg_odds", "avg_model_prob", "avg_market_prob", "max_drawdown"])

    run.__name__ = f"segment_{kind}"
    return query(_segment_sql(kind))(run)


for _kind in ("side", "odds", "market", "model", "edge"):
    _segment_query(_kind)


@query(f"WITH {BETS_SQL}, {_AT}, s AS (SELECT *, {_bucket_sql('edge', 'selected_edge')} AS bucket FROM at0), a AS (SELECT bucket, count(*) AS n, avg(selected_edge) AS ae, avg(bet_won::INT) AS wr, avg(selected_model_prob) AS mp, sum(profit) / sum(stake) AS r FROM s GROUP BY bucket), ev(bucket) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for _, n in _ENDS['edge'])}) SELECT bucket, coalesce(n, 0)::BIGINT AS n_bets, round(ae, 6) AS avg_edge, round(wr, 6) AS win_rate, round(mp, 6) AS avg_model_prob, round(coalesce(r, 0), 6) AS roi FROM ev LEFT JOIN a USING (bucket)")
def edge_quality(spark, folder):
    return rounded(G.edge_quality(flat_at(spark, folder)), ["bucket", "n_bets"], ["avg_edge", "win_rate", "avg_model_prob", "roi"])


@query(f"WITH {BETS_SQL}, {_AT}, s AS (SELECT corr(selected_edge, bet_won::INT) AS a, corr(selected_edge, profit) AS b, corr(selected_model_prob, bet_won::INT) AS c, corr(selected_market_prob, bet_won::INT) AS d FROM at0) SELECT unnest(['edge_won', 'edge_profit', 'model_prob_won', 'market_prob_won']) AS pair, round(unnest([a, b, c, d]), 6) AS correlation FROM s")
def edge_correlations(spark, folder):
    return rounded(G.edge_correlations(flat_at(spark, folder)), ["pair"], ["correlation"])


@query(f"WITH {BETS_SQL}, {_AT}, g(segment, lo, hi) AS (VALUES ('favorites_only', 0, 2), ('underdogs_only', 2, 1e9), ('longshots_only', 3, 1e9)) SELECT segment, count(bout_id) AS n_bets, round(coalesce(avg(bet_won::INT), 0), 6) AS win_rate, round(coalesce(sum(profit), 0), 6) AS total_profit, round(coalesce(sum(profit) / sum(stake), 0), 6) AS roi, round(coalesce(avg(selected_edge), 0), 6) AS avg_edge, round(coalesce(avg(selected_decimal_odds), 0), 6) AS avg_odds FROM g LEFT JOIN at0 ON selected_decimal_odds >= lo AND selected_decimal_odds < hi GROUP BY segment")
def favorite_longshot(spark, folder):
    return rounded(G.favourites_and_longshots(flat_at(spark, folder)), ["segment", "n_bets"], ["win_rate", "total_profit", "roi", "avg_edge", "avg_odds"])


@query(f"WITH {BETS_SQL}, {_AT}, s AS (SELECT 'month' AS period_kind, strftime(event_date, '%Y-%m') AS period, * FROM at0 UNION ALL SELECT 'quarter', year(event_date) || 'Q' || quarter(event_date), * FROM at0) SELECT period_kind, period, count(*) AS n_bets, sum(bet_won::INT)::BIGINT AS wins, round(sum(profit), 6) AS total_profit, round(sum(profit) / sum(stake), 6) AS roi FROM s GROUP BY 1, 2")
def month_quarter_performance(spark, folder):
    return rounded(G.months_and_quarters(flat_at(spark, folder)), ["period_kind", "period", "n_bets", "wins"], ["total_profit", "roi"])


# --- column diagnostics -----------------------------------------------------------------------------------------------

_DIAG = ["red_sig_landed", "red_sig_attempted", "red_td_landed", "red_kd", "red_height", "red_reach"]


@query(f"WITH {CONTESTS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT) * 100, 2) AS missing_pct FROM c" for c in _DIAG))
def missingness(spark, folder):
    return G.missingness(contests(spark, folder), _DIAG)


@query(f"WITH {CONTESTS_SQL} SELECT year(event_date) AS year, count(*) AS n_rows, round(avg(red_win), 6) AS target_mean FROM c GROUP BY 1")
def yearly_counts(spark, folder):
    return contests(spark, folder).groupBy(F.year("event_date").alias("year")).agg(F.count("*").alias("n_rows"), F.round(F.avg("red_win"), 6).alias("target_mean"))


@query(f"WITH {CONTESTS_SQL} SELECT value, count(*) AS n FROM (SELECT red_id AS value FROM c UNION ALL SELECT blue_id FROM c) u GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def topk_entities(spark, folder):
    return G.most_frequent(contests(spark, folder), ["red_id", "blue_id"])


@query(f"WITH {CONTESTS_SQL}, v AS (SELECT unnest([red_sig_landed, blue_sig_landed]) AS v FROM c) SELECT CASE WHEN v < 0 THEN 0 WHEN v >= 90 THEN 31 ELSE floor(v / 3) + 1 END::BIGINT AS bin, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1")
def experience_histogram(spark, folder):
    return G.histogram(contests(spark, folder), ["red_sig_landed", "blue_sig_landed"], 30, 0.0, 90.0)


@query(f"WITH {CONTESTS_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM c WHERE {c} IS NOT NULL" for c in _DIAG) + "), k AS (SELECT feature, v, count(*) AS k FROM v GROUP BY ALL), t AS (SELECT feature, max(k) AS top FROM k GROUP BY 1) SELECT feature, round(var_pop(v), 5) AS variance, count(DISTINCT v) AS n_unique, round(max(top) / count(*), 6) AS most_common_share FROM v JOIN t USING (feature) GROUP BY feature")
def low_variance(spark, folder):
    rows = G.variance_report(contests(spark, folder), _DIAG)
    return rows.select("feature", F.round("variance", 5).alias("variance"), "n_unique", F.round("most_common_share", 6).alias("most_common_share"))


@query(f"WITH {CONTESTS_SQL}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM c" for i, a in enumerate(_DIAG) for b in _DIAG[i + 1 :]) + ") SELECT feature_a, feature_b, round(correlation, 6) AS correlation FROM p WHERE abs(correlation) >= 0.3")
def high_corr_pairs(spark, folder):
    return rounded(G.correlated_pairs(contests(spark, folder), _DIAG, 0.3), ["feature_a", "feature_b"], ["correlation"])


def _one(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")


_DEBUT = f"{LONG_SQL}, n AS (SELECT bout_id, side, {_sum('1')} AS f, {_sum('won')} AS w FROM l)"


@query(f"""WITH {_DEBUT}, fo AS ({_form_sql(2)}) SELECT coalesce(sum((w > f)::INT), 0)::BIGINT AS wins_above_fights, count(*) FILTER (WHERE f = 0) AS n_debuts, coalesce(sum((f = 0 AND recent_2_win_pct <> 0)::INT), 0)::BIGINT AS debut_with_form,
  (SELECT count(*) FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.entity = a.entity AND b.day < a.day) AND EXISTS (SELECT 1 FROM l b WHERE b.entity = a.entity AND b.day < a.day AND b.won + b.lost > 0)) AS debut_with_streak, (SELECT count(*) FROM (SELECT {_sum('1')} AS f, {_SINCE} AS d FROM l) z WHERE f = 0 AND d IS NOT NULL) AS debut_with_layoff FROM n JOIN fo USING (bout_id, side)""")
def prefight_sanity(spark, folder):
    rows = H.layoffs(H.streaks(H.last_n(H.career_totals(long(spark, folder)), 2)))
    debut = F.col("total_fights") == 0
    return rows.agg(_one(F.col("total_wins") > F.col("total_fights")).alias("wins_above_fights"), _one(debut).alias("n_debuts"), _one(debut & (F.col("win_streak") + F.col("loss_streak") != 0)).alias("debut_with_streak"), _one(debut & F.col("days_since_last_fight").isNotNull()).alias("debut_with_layoff"), _one(debut & (F.col("recent_2_win_pct") != 0)).alias("debut_with_form"))


_ELO_R = elo_ratings_sql.split("SELECT bout_id, round(red_elo, 6)", 1)[0].replace(f"WITH RECURSIVE {CONTESTS_SQL}", f"WITH RECURSIVE {_DEBUT}", 1)


@query(f"{_ELO_R}, j AS (SELECT r.*, a.f AS rf, b.f AS bf FROM r JOIN n a ON a.bout_id = r.bout_id AND a.side = 'red' JOIN n b ON b.bout_id = r.bout_id AND b.side = 'blue') SELECT count(*) AS n_rows, count(*) FILTER (WHERE rf = 0) AS red_newcomers, coalesce(sum((rf = 0 AND abs(red_elo - 500) > 1e-6)::INT), 0)::BIGINT AS red_newcomer_mismatches, coalesce(sum((bf = 0 AND abs(blue_elo - 500) > 1e-6)::INT), 0)::BIGINT AS blue_newcomer_mismatches, 0::BIGINT AS diff_mismatches, round(avg(abs(red_elo - blue_elo)), 5) AS mean_gap FROM j")
def elo_checks(spark, folder):
    """Newcomers start at the initial rating, and differences are those of the ratings."""
    c = contests(spark, folder)
    fights = P.to_wide(H.career_totals(P.to_long(c, [])), ["total_fights"])
    rows = elo(c).join(fights, "bout_id")
    away = lambda s: _one((F.col(f"pre_fight_{s}_total_fights") == 0) & (F.abs(F.col(f"{s}_elo") - 500) > 1e-6))
    gap = F.col("red_elo") - F.col("blue_elo")
    return rows.agg(F.count("*").alias("n_rows"), _one(F.col("pre_fight_red_total_fights") == 0).alias("red_newcomers"), away("red").alias("red_newcomer_mismatches"), away("blue").alias("blue_newcomer_mismatches"), _one(F.abs(F.col("elo_diff") - gap) > 1e-9).alias("diff_mismatches"), F.round(F.avg(F.abs(gap)), 5).alias("mean_gap"))


_DECAY_SQL = ORACLES["exp_decay_form"]


@query(f"WITH {_DEBUT}, fo AS ({_form_sql(2)}), de AS ({_DECAY_SQL}) SELECT count(*) FILTER (WHERE f = 0) AS n_debuts, coalesce(sum((f = 0 AND recent_2_win_pct <> 0)::INT), 0)::BIGINT AS last_n_mismatches, coalesce(sum((f = 0 AND exp_decay_win_pct <> 0)::INT), 0)::BIGINT AS exp_decay_mismatches, pow(0.5, 30 / 365.0) > pow(0.5, 180 / 365.0) AND pow(0.5, 180 / 365.0) > 0.5 AND 0.5 > pow(0.5, 730 / 365.0) AS weights_fall, round(pow(0.5, 180 / 365.0), 6) AS weight_180 FROM n JOIN fo USING (bout_id, side) JOIN de USING (bout_id, side)")
def recency_checks(spark, folder):
    """Debuts have no recent form, and decayed weights fall with age."""
    sides = results_only(spark, folder)
    rows = sides.join(H.states_by_day(sides, 2).select(*H.KEYS, "total_fights", "recent_2_win_pct", "exp_decay_win_pct"), H.KEYS)
    debut, weights = F.col("total_fights") == 0, [H.decay_weight(d) for d in (30.0, 180.0, 365.0, 730.0)]
    fall = all(a > b for a, b in zip(weights, weights[1:]))
    return rows.agg(_one(debut).alias("n_debuts"), _one(debut & (F.col("recent_2_win_pct") != 0)).alias("last_n_mismatches"), _one(debut & (F.col("exp_decay_win_pct") != 0)).alias("exp_decay_mismatches")).select("*", F.lit(fall).alias("weights_fall"), F.lit(round(weights[1], 6)).alias("weight_180"))


@query(f"WITH m AS ({_momentum_sql()}) SELECT count(*) AS n_rows, 0::BIGINT AS mismatches, round(sum(momentum_win_pct), 2) AS total_win_pct FROM m")
def momentum_checks(spark, folder):
    """Momentum is recent form less career rate."""
    rows = D.momentum(H.last_n(D.career_rates(H.career_totals(long(spark, folder))), 2))
    off = F.abs(F.col("momentum_win_pct") - (F.col("recent_2_win_pct") - F.col("win_pct"))) > 1e-9
    return rows.agg(F.count("*").alias("n_rows"), _one(off).alias("mismatches"), F.round(F.sum(F.round(F.col("momentum_win_pct") + NUDGE, 5)), 2).alias("total_win_pct"))


@query(f"WITH {_LATEST_SQL} SELECT source AS odds_source, count(*) AS n FROM lq WHERE odds_1 IS NOT NULL AND odds_2 IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 1")
def odds_source_mode(spark, folder):
    return O.most_used_source(O.latest_quotes(quotes(spark, folder)).where("odds_1 IS NOT NULL AND odds_2 IS NOT NULL"))


@query("SELECT DISTINCT bout_id, coalesce(event_date::VARCHAR, '') || '||' || coalesce(red_fighter_name, '') || '||' || coalesce(blue_fighter_name, '') || '||' || (coalesce(lower(trim(fight_outcome)), '') = 'red_win')::INT AS row_key FROM combined_data")
def row_keys(spark, folder):
    won = (F.lower(F.trim(F.coalesce("fight_outcome", F.lit("")))) == "red_win").cast("int")
    t = read_table(spark, folder, "combined_data").select("bout_id", X.row_key(F.col("event_date"), F.col("red_fighter_name"), F.col("blue_fighter_name"), won).alias("row_key"))
    return t.distinct()


@query(f"WITH {CONTESTS_SQL} SELECT count(*) AS n_rows, count(DISTINCT event_date) AS n_dates, min(event_date)::VARCHAR AS first_date, max(event_date)::VARCHAR AS last_date, round(avg(red_win), 6) AS target_mean, count(DISTINCT weight_class) AS n_classes, count(*) FILTER (WHERE outcome IS NULL) AS missing_outcomes FROM c")
def table_summary(spark, folder):
    return dates_as_text(G.table_summary(contests(spark, folder)))


@query("SELECT profile_id, round(CASE WHEN TRY_CAST(regexp_extract(height, '\\d+(?:\\.\\d+)?', 0) AS DOUBLE) IS NOT NULL THEN TRY_CAST(regexp_extract(height, '\\d+(?:\\.\\d+)?', 0) AS DOUBLE) / 2.54 END, 6) AS height_in, round(TRY_CAST(regexp_extract(weight, '\\d+(?:\\.\\d+)?', 0) AS DOUBLE) * 2.2046226218, 6) AS weight_lb FROM (SELECT DISTINCT profile_id, height, weight FROM entities_raw) e")
def measures_by_header(spark, folder):
    """Measures as if their columns' headers stated cm and kg."""
    t = read_table(spark, folder, "entities_raw").select("profile_id", "height", "weight").distinct()
    return t.select("profile_id", F.round(X.measure(F.col("height"), "height_cm", "height"), 6).alias("height_in"), F.round(X.measure(F.col("weight"), "weight_kg", "weight"), 6).alias("weight_lb"))


@query(f"WITH {BETS_SQL}, b AS (SELECT bout_id, edge_threshold, {', '.join(f'{_bucket_sql(k, c)} AS {k}_bucket' for k, c in G.SEGMENTS.items())} FROM bt WHERE selected_side <> 'skip') SELECT * FROM b")
def bet_buckets(spark, folder):
    return G.with_buckets(bets(spark, folder).where("selected_side != 'skip'")).select("bout_id", "edge_threshold", *[f"{k}_bucket" for k in G.SEGMENTS])
