"""Two-sided contests: cleaning, wide and long form, and differences between the sides.

The long form has two rows per contest, one for each side, with the side's own measures and the opponent's under
``opp_<measure>``. Every history operator works on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions import numeric as N
from duelframe.functions import text as X
from duelframe.operators.entity_features import clean_type, latest_versions
from duelframe.runtime import Written, collect_garbage

SIDES = ("red", "blue")
#: Measures of a side that a contest may have; absent ones are null.
STRIKES = [f"{part}_{what}" for part in ("head", "body", "leg", "distance", "clinch", "ground") for what in ("landed", "attempted")]
MEASURES = ["sig_landed", "sig_attempted", "total_landed", "total_attempted", "td_landed", "td_attempted", "kd", "sub_att", "rev", "ctrl_seconds", *STRIKES]


def clean_contests(df: DataFrame) -> DataFrame:
    """One row per contest: typed, with ``day`` (days since 1970), cleaned ``outcome``, ``red_win`` and length.

    Rows without a key, a date or either fighter are left out; rows with one key are copies and count once. ``outcome`` is in lower case, null where
    blank. ``duration_seconds`` and ``rounds`` come from round, clock and format. Attributes out of range stay as they are.
    Text columns "x of y" give landed and attempted; where a text is missing the numeric columns are used.
    """
    have = set(df.columns)
    get = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    out: list[Column] = [F.col("bout_id"), F.col("event_date").cast("date").alias("event_date"), F.unix_date(F.col("event_date").cast("date")).alias("day")]
    for s in SIDES:
        out += [get(f"{s}_fighter_id", "bigint").alias(f"{s}_id"), get(f"{s}_fighter_name").alias(f"{s}_name")]
    outcome = F.lower(X.clean_placeholder(get("fight_outcome")))
    out += [outcome.alias("outcome"), F.when(outcome == "red_win", 1).otherwise(0).alias("red_win"), F.lower(get("win_method")).alias("method"), get("end_round", "int").cast("int").alias("round")]
    out += [X.contest_seconds(get("end_round", "int"), get("end_time")).alias("duration_seconds"), X.scheduled_rounds(get("time_format")).alias("rounds"), X.weight_class(get("bout_type")).alias("weight_class")]
    for s in SIDES:
        p = f"{s}_fighter"
        for name, column in (("sig", "sig_str"), ("total", "total_str"), ("td", "td")):
            for what, parse in (("landed", X.landed), ("attempted", X.attempted)):
                out.append(F.coalesce(parse(get(f"{p}_{column}")), get(f"{p}_{column}_{what}", "double").cast("double")).alias(f"{s}_{name}_{what}"))
        out += [get(f"{p}_{c}", "double").try_cast("double").alias(f"{s}_{c}") for c in ("kd", "sub_att", "rev")]
        out.append(X.clock_seconds(X.clean_placeholder(get(f"{p}_ctrl"))).alias(f"{s}_ctrl_seconds"))
        out += [N.real(get(f"{p}_{c}", "double")).alias(f"{s}_{c}") for c in ("height", "reach", "weight")]
        out += [X.clean_placeholder(get(f"{p}_stance")).alias(f"{s}_stance"), get(f"{p}_dob", "date").cast("date").alias(f"{s}_dob")]
    rows = df.select(*out).where("bout_id IS NOT NULL AND event_date IS NOT NULL AND red_id IS NOT NULL AND blue_id IS NOT NULL")
    return rows.dropDuplicates(["bout_id"])  # by key, so that columns a query doesn't use are neither read nor shuffled


def strike_totals(stats: DataFrame) -> DataFrame:
    """``bout_id, entity`` and landed/attempted by target and position, from typed strike records in their latest version."""
    latest = latest_versions(stats.select("record_id", "loaded_at", "bout_id", "fighter_id", clean_type(F.col("stat_type")).alias("kind"), "fighter_sig_str_landed", "fighter_sig_str_attempted"), "record_id", "loaded_at", ["bout_id", "fighter_id", "kind", "fighter_sig_str_landed", "fighter_sig_str_attempted"])
    words = F.split("kind", "_")
    values = {"landed": F.coalesce("fighter_sig_str_landed", F.lit(0)), "attempted": F.coalesce("fighter_sig_str_attempted", F.lit(0))}
    sums = [F.sum(F.when(F.array_contains(words, part), values[what]).otherwise(0)).cast("double").alias(f"{part}_{what}") for part in ("head", "body", "leg", "distance", "clinch", "ground") for what in values]
    return latest.where("kind IS NOT NULL").groupBy("bout_id", F.col("fighter_id").alias("entity")).agg(*sums)


def with_strikes(contests: DataFrame, totals: DataFrame) -> DataFrame:
    """The contests with each side's strike totals; null where a side has no records.

    The records of a contest are joined by its key alone, by which the contests lie already.
    """
    of_contest = totals.groupBy("bout_id").agg(F.collect_list(F.struct("entity", *STRIKES)).alias("__s"))
    kept = Written(contests.sparkSession).keep(of_contest, "strikes")
    out = contests.join(kept, "bout_id", "left")
    collect_garbage(contests.sparkSession)

    def records(s: str) -> Column:
        return F.get(F.filter("__s", lambda x: x["entity"] == F.col(f"{s}_id")), F.lit(0))

    own = {s: records(s) for s in SIDES}
    return out.select(*contests.columns, *[own[s][c].alias(f"{s}_{c}") for s in SIDES for c in STRIKES])


def to_long(contests: DataFrame, measures: list[str] | None = None, entity: str = "id") -> DataFrame:
    """Two rows per contest: ``bout_id, day, side, entity, opponent, won, lost`` with own and ``opp_`` measures."""
    measures = [m for m in (measures if measures is not None else MEASURES) if f"red_{m}" in contests.columns]

    def side(own: str, other: str) -> Column:
        won, lost = F.col("outcome") == f"{own}_win", F.col("outcome") == f"{other}_win"
        fields = [F.lit(own).alias("side"), F.col(f"{own}_{entity}").alias("entity"), F.col(f"{other}_{entity}").alias("opponent")]
        fields += [F.coalesce(w.cast("int"), F.lit(0)).alias(n) for n, w in (("won", won), ("lost", lost))]
        fields += [F.col(f"{own}_{m}").alias(m) for m in measures] + [F.col(f"{other}_{m}").alias(f"opp_{m}") for m in measures]
        return F.struct(*fields)

    keep = [c for c in ("bout_id", "day", "method", "round", "duration_seconds", "rounds") if c in contests.columns]
    return contests.select(*keep, F.inline(F.array(side("red", "blue"), side("blue", "red"))))


def to_wide(long: DataFrame, columns: list[str], prefix: str = "pre_fight_") -> DataFrame:
    """One row per contest: ``<prefix>red_<column>`` and ``<prefix>blue_<column>``; both rows of a contest must be there."""
    aggs = [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{prefix}{s}_{c}") for c in columns for s in SIDES]
    return long.groupBy("bout_id").agg(*aggs)


def side_differences(df: DataFrame) -> DataFrame:
    """Adds red minus blue of every numeric pair: ``pre_fight_red_X`` gives ``pre_fight_X_diff``, ``red_X`` gives ``X_diff``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for name, kind in kinds.items():
        if not isinstance(kind, T.NumericType) or name.endswith("_id"):
            continue
        for prefix in ("pre_fight_", ""):
            if name.startswith(f"{prefix}red_"):
                rest = name[len(prefix) + 4 :]
                other, target = f"{prefix}blue_{rest}", f"{prefix}{rest.removeprefix('fighter_')}_diff"
                if other in kinds and isinstance(kinds[other], T.NumericType) and target not in kinds:
                    out.setdefault(target, F.col(name).cast("double") - F.col(other).cast("double"))
                break
    return df.select("*", *[c.alias(n) for n, c in out.items()])


#: Short names of differences, made by rule: diff_X of pre_fight_X_diff, totals without "total_" where it is a volume.
ALIASED = ["total_fights", "total_wins", "total_losses", "total_kd", "win_pct", "td_accuracy", "sig_strike_accuracy", "td_defense"]
ALIASED_VOLUMES = ["sig_strikes_landed", "sig_strikes_attempted", "total_strikes_landed", "total_strikes_attempted", "td_landed", "td_attempted", "sub_att", "ctrl_seconds"]
ALIASED_RATES = [f"{m}_per_fight" for m in ("sig_strikes_landed", "sig_strikes_attempted", "td_landed", "td_attempted", "sub_att", "ctrl_seconds", "kd", "kd_absorbed")] + [f"{m}_per_min" for m in ("sig_strikes_landed", "td_landed", "sub_att", "ctrl_seconds")]


def difference_aliases(df: DataFrame) -> DataFrame:
    """Adds ``diff_*`` names of the differences that the table has."""
    sources = {f"diff_{m}": f"pre_fight_{m}_diff" for m in ALIASED + ALIASED_RATES}
    sources |= {f"diff_{m}": f"pre_fight_total_{m}_diff" for m in ALIASED_VOLUMES}
    sources |= {f"diff_{m}": f"{m}_diff" for m in ("age", "reach", "height")}
    return df.select("*", *[F.col(source).cast("double").alias(name) for name, source in sources.items() if source in df.columns and name not in df.columns])
