"""Registered queries of the general record-preparation operators, with their SQL where DuckDB can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators import entity_features as ef
from duelframe.operators import hot_deck, units
from duelframe.runtime import read_table

MEASURES = ("fighter_sig_str_landed", "fighter_sig_str_attempted", "diff_win_streak")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_deck.filled_from_same(hot_deck.fill_contests(read_table(spark, folder, "combined_data"), modal=True))


def p1_filled(spark: SparkSession, folder: str) -> DataFrame:
    return hot_deck.fill_contests(read_table(spark, folder, "combined_data"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "entities_raw").select("profile_id", "height", "weight", "reach", "notes").distinct()
    cells = units.long_measures(units.canonical_measures(rows), "profile_id")
    return cells.select("profile_id", "field_name", F.round("value").cast("bigint").alias("whole_units"))


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "entities_raw").distinct()
    return units.canonical_measures(rows).select("profile_id", "height_in", "weight_lb", "reach_in")


def p5_features(spark: SparkSession, folder: str) -> DataFrame:
    return ef.entity_features(read_table(spark, folder, "contest_stats"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = ef.long_rows(p5_features(spark, folder), "fighter_id", MEASURES)
    return cells.where(F.pmod("fighter_id", F.lit(10)) == 0).select(
        "fighter_id", "stat_type", "n_records", F.col(f"total_{MEASURES[0]}").alias("landed_total"), F.col(f"total_{MEASURES[1]}").alias("attempted_total"), F.col(f"total_{MEASURES[2]}").alias("streak_total"), "last_day"
    )


P1_SQL = """
WITH d AS (SELECT DISTINCT bout_id, event_date, red_fighter_id, blue_fighter_id, red_fighter_height, blue_fighter_height, red_fighter_reach, blue_fighter_reach, red_fighter_dob, blue_fighter_dob FROM combined_data),
o AS (
  SELECT bout_id, event_date, s.* FROM (SELECT bout_id, event_date, unnest([
    {'red': true, 'entity': red_fighter_id, 'f': 'red_fighter_height', 'x': red_fighter_height, 'b': NULL::DATE},
    {'red': false, 'entity': blue_fighter_id, 'f': 'red_fighter_height', 'x': blue_fighter_height, 'b': NULL::DATE},
    {'red': true, 'entity': red_fighter_id, 'f': 'red_fighter_reach', 'x': red_fighter_reach, 'b': NULL::DATE},
    {'red': false, 'entity': blue_fighter_id, 'f': 'red_fighter_reach', 'x': blue_fighter_reach, 'b': NULL::DATE},
    {'red': true, 'entity': red_fighter_id, 'f': 'red_fighter_dob', 'x': NULL::DOUBLE, 'b': red_fighter_dob},
    {'red': false, 'entity': blue_fighter_id, 'f': 'red_fighter_dob', 'x': NULL::DOUBLE, 'b': blue_fighter_dob}]) AS s FROM d)),
u AS (SELECT bout_id, red, entity, f, CASE
    WHEN f <> 'red_fighter_dob' THEN CASE WHEN NOT isnan(x) AND x BETWEEN 48 AND 96 THEN round(x)::BIGINT END
    WHEN b + INTERVAL 16 YEAR <= event_date AND b + INTERVAL 60 YEAR >= event_date THEN year(b) * 10000 + month(b) * 100 + day(b) END AS v FROM o),
c AS (SELECT entity, f, v, count(*) AS n FROM u WHERE v IS NOT NULL AND entity IS NOT NULL GROUP BY ALL),
m AS (SELECT entity, f, v FROM c QUALIFY row_number() OVER (PARTITION BY entity, f ORDER BY n DESC, v) = 1)
SELECT u.bout_id, u.f AS field_name, m.v::BIGINT AS filled FROM u JOIN m USING (entity, f) WHERE u.red AND u.v IS NULL
"""

_P1_FIELDS = {"fighter_height": "DOUBLE", "fighter_reach": "DOUBLE", "fighter_dob": "DATE"}


def _p1_filled_sql() -> str:
    """Nearest donors by two windows over each whole group, the fighter's and then the weight class's."""
    d = "SELECT DISTINCT bout_id, event_date, bout_type, red_fighter_id, blue_fighter_id, " + ", ".join(f"{s}_{f}" for f in _P1_FIELDS for s in ("red", "blue")) + " FROM combined_data"
    usable = {f: f"CASE WHEN NOT isnan({{s}}_{f}) AND {{s}}_{f} BETWEEN 48 AND 96 THEN round({{s}}_{f})::BIGINT END" for f in list(_P1_FIELDS)[:2]}
    b = "{s}_fighter_dob"
    usable["fighter_dob"] = f"CASE WHEN event_date IS NULL OR ({b} + INTERVAL 16 YEAR <= event_date AND {b} + INTERVAL 60 YEAR >= event_date) THEN year({b}) * 10000 + month({b}) * 100 + day({b}) END"
    group = r"coalesce(nullif(regexp_extract(lower(coalesce(bout_type, '')), '((?:women''s )?(?:light )?(?:straw|fly|bantam|feather|light|welter|middle|heavy|catch )weight)', 1), ''), 'any')"
    side = lambda s: f"SELECT bout_id AS k, coalesce((event_date - DATE '1970-01-01')::INT, -719162) AS day, {s == 'red'} AS red, {s}_fighter_id AS entity, {group} AS kin, " + ", ".join(f"({e.format(s=s)})::BIGINT AS v{i}" for i, e in enumerate(usable.values())) + " FROM d"
    donor = "CASE WHEN v{i} IS NOT NULL THEN struct_pack(day := day, k := k, v := v{i}) END"
    look = lambda g, x, order, i: f"last_value({donor.format(i=i)} IGNORE NULLS) OVER (PARTITION BY {g} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {x}{i}"
    both = lambda g, p, n: ", ".join(look(g, x, o, i) for i in range(3) for x, o in ((p, "day, k, red"), (n, "day DESC, k DESC, red DESC")))
    near = lambda p, n, i: f"CASE WHEN {p}{i} IS NOT NULL AND ({n}{i} IS NULL OR day - {p}{i}.day <= {n}{i}.day - day) THEN {p}{i} ELSE {n}{i} END"
    out = ["k AS bout_id"]
    for i, f in enumerate(_P1_FIELDS):
        gone, own = f"v{i} IS NULL", f"a{i}"
        give = f"CASE WHEN {gone} THEN coalesce({own}, b{i}) END"
        out += [f"coalesce(v{i}, ({give}).v) AS red_{f}", f"CASE WHEN NOT {gone} THEN NULL WHEN {own} IS NOT NULL THEN 'same fighter' WHEN b{i} IS NOT NULL THEN 'similar contests' ELSE 'none' END AS red_{f}_mark", f"({give}).k AS red_{f}_donor", f"abs(day - ({give}).day)::INT AS red_{f}_distance"]
    return f"""WITH d AS ({d}), o AS ({side("red")} UNION ALL {side("blue")}), w AS (SELECT *, {both("entity", "p", "n")}, {both("kin", "q", "r")} FROM o),
x AS (SELECT *, {", ".join(f"CASE WHEN entity IS NOT NULL THEN {near('p', 'n', i)} END AS a{i}, {near('q', 'r', i)} AS b{i}" for i in range(3))} FROM w WHERE red) SELECT {", ".join(out)} FROM x"""


P5_SQL = """
WITH d AS (SELECT DISTINCT * FROM contest_stats),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) = 1),
t AS (SELECT *, nullif(trim(regexp_replace(lower(stat_type), '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), '') AS kind FROM l)
SELECT fighter_id, kind AS stat_type, count(*) AS n_records, sum(coalesce(fighter_sig_str_landed, 0))::BIGINT AS landed_total,
  sum(coalesce(fighter_sig_str_attempted, 0))::BIGINT AS attempted_total, sum(coalesce(diff_win_streak, 0))::BIGINT AS streak_total,
  max(year(event_date) * 10000 + month(event_date) * 100 + day(event_date))::BIGINT AS last_day
FROM t WHERE kind IS NOT NULL AND fighter_id % 10 = 0 GROUP BY fighter_id, kind
"""

QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p3_found": p3_found, "p3_values": p3_values, "p5_found": p5_found, "p5_features": p5_features}
ORACLES = {"p1_found": P1_SQL, "p1_filled": _p1_filled_sql(), "p5_found": P5_SQL}
