"""Chronological splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chronological_split(df: DataFrame, day: str = "event_date", train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """``df`` with ``split``: shares of the distinct dates, so that no date lies in two splits.

    The cut dates are the ones at position int(share * dates) of the distinct dates (at least the first). Rows without a
    date have no split. Only the distinct dates are numbered, never the rows.
    """
    dates = df.select(F.col(day).alias("d")).where("d IS NOT NULL").distinct()
    numbered = dates.select("d", F.row_number().over(Window.orderBy("d")).alias("i"))  # as many rows as there are dates
    n = dates.agg(F.count("*").alias("n"))
    at = lambda share: F.greatest(F.floor(F.col("n") * F.lit(share)), F.lit(1))
    cuts = numbered.crossJoin(F.broadcast(n)).agg(F.max(F.when(F.col("i") == at(train), F.col("d"))).alias("__a"), F.max(F.when(F.col("i") == at(validation), F.col("d"))).alias("__b"))
    split = F.when(F.col(day) <= F.col("__a"), "train").when(F.col(day) <= F.col("__b"), "validation").when(F.col(day).isNotNull(), "test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("__a", "__b")  # one row


def train_and_validation(df: DataFrame) -> DataFrame:
    return df.where("split != 'test'")


def split_summary(df: DataFrame, day: str = "event_date", target: str = "red_win") -> DataFrame:
    """Rows, date range and mean target of each split."""
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.avg(target).alias("target_mean"))


def split_audit(df: DataFrame, key: str = "bout_id", day: str = "event_date") -> DataFrame:
    """For each pair of splits the keys and dates that lie in both, and whether the dates follow each other."""
    order = F.create_map(F.lit("train"), F.lit(1), F.lit("validation"), F.lit(2), F.lit("test"), F.lit(3))
    spans = df.groupBy("split").agg(F.min(day).alias("lo"), F.max(day).alias("hi")).withColumn("o", order[F.col("split")])
    pairs = spans.alias("a").join(spans.alias("b"), F.col("a.o") < F.col("b.o")).select(F.col("a.split").alias("earlier"), F.col("b.split").alias("later"), (F.col("a.hi") < F.col("b.lo")).alias("dates_follow"))

    def shared(column: str, name: str) -> DataFrame:
        # the splits that a value lies in, then the pairs of them
        sets = df.groupBy(column).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
        p = sets.select(F.explode("s").alias("earlier"), "s").select("earlier", F.explode("s").alias("later"))
        return p.groupBy("earlier", "later").agg(F.count("*").alias(name))

    out = pairs.join(shared(key, "shared_keys"), ["earlier", "later"], "left").join(shared(day, "shared_dates"), ["earlier", "later"], "left")
    return out.select("earlier", "later", "dates_follow", F.coalesce("shared_keys", F.lit(0)).alias("shared_keys"), F.coalesce("shared_dates", F.lit(0)).alias("shared_dates"))


def walk_forward_folds(df: DataFrame, day: str = "event_date", least_train: int = 250, least_calibration: int = 50, least_test: int = 50) -> DataFrame:
    """``fold_id, calibration_year, test_year, n_train, n_calibration, n_test``.

    A test year is calibrated on the year before it among those present and trained on all earlier ones; folds that are too
    small are left out and not numbered. Works on one row per year.
    """
    years = df.where(F.col(day).isNotNull()).groupBy(F.year(day).alias("y")).agg(F.count("*").alias("n"))
    w = Window.orderBy("y")  # one row per year
    lagged = years.select(F.col("y").alias("test_year"), F.col("n").alias("n_test"), F.lag("y").over(w).alias("calibration_year"), F.lag("n").over(w).alias("n_calibration"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -2)).alias("n_train"))
    kept = lagged.where((F.col("n_train") >= least_train) & (F.col("n_calibration") >= least_calibration) & (F.col("n_test") >= least_test))
    return kept.select(F.row_number().over(Window.orderBy("test_year")).alias("fold_id"), "calibration_year", "test_year", "n_train", "n_calibration", "n_test")


def fold_rows(df: DataFrame, folds: DataFrame, day: str = "event_date") -> DataFrame:
    """The rows of each fold with ``fold_id`` and ``part`` (train, calibration, test)."""
    year = F.year(day)
    rows = df.join(F.broadcast(folds.select("fold_id", "calibration_year", "test_year")), year <= F.col("test_year"))  # one row per year
    part = F.when(year < F.col("calibration_year"), "train").when(year == F.col("calibration_year"), "calibration").when(year == F.col("test_year"), "test")
    return rows.withColumn("part", part).where("part IS NOT NULL").drop("calibration_year", "test_year")


#: What a modelling table may hold besides ``pre_fight_*``, ``diff_*`` and ``*_diff``. Names and classes are
#: also those of this package's contest table.
SAFE_NAMES = (
    "bout_id", "event_date", "red_win", "weight_class", "weight_class_clean", "red_name", "blue_name", "red_fighter_name", "blue_fighter_name",
    "red_fighter_age", "blue_fighter_age", "red_fighter_height", "blue_fighter_height", "red_fighter_reach", "blue_fighter_reach", "red_fighter_stance", "blue_fighter_stance",
    "red_age", "blue_age", "red_height", "blue_height", "red_reach", "blue_reach", "red_stance", "blue_stance",
    "red_grappler_vs_blue_striker", "red_striker_vs_blue_grappler", "red_finish_vs_blue_durability", "blue_finish_vs_red_durability",
    "red_td_offense_vs_blue_td_defense", "blue_td_offense_vs_red_td_defense", "red_grappling_pressure_vs_blue_defense", "blue_grappling_pressure_vs_red_defense",
)
#: Words in a feature's name that point to the contest itself.
SUSPECT_WORDS = ("result", "outcome", "method", "round", "time", "odds", "referee", "details", "fighter_1_odds", "fighter_2_odds", "event_name", "event_location")
#: Names in which "round" is a matter of earlier contests.
EARLIER_ROUNDS = ("five_round", "past_5_round", "third_round")


def safe_columns(df: DataFrame, strict: bool = False) -> list[str]:
    """Columns that a model may see; ``strict`` also drops differences of the contest's own statistics."""
    ok = [c for c in df.columns if c in SAFE_NAMES or c.startswith(("pre_fight_", "diff_")) or c.endswith("_diff")]
    return [c for c in ok if not (strict and c.endswith("_diff") and not c.startswith("pre_fight_") and c not in ("age_diff", "reach_diff", "height_diff"))]


def modelling_table(df: DataFrame, since: str = "2010-01-01", strict: bool = False, day: str = "event_date") -> DataFrame:
    return df.select(*safe_columns(df, strict)).where(F.col(day) >= F.lit(since).cast("date"))


def suspects(columns: list[str]) -> dict[str, list[str]]:
    """The feature names with words that point to the contest itself, and those words."""
    out = {}
    for c in columns:
        words = [w for w in SUSPECT_WORDS if w in c.lower() and not (w == "round" and any(e in c.lower() for e in EARLIER_ROUNDS))]
        if words:
            out[c] = words
    return out
