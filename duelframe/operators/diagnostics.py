"""Tables that take a set of bets apart: buckets, time, correlation, rolling return; and column diagnostics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.numeric import BUCKETS, bucket
from duelframe.operators.backtest import drawdown, running
from duelframe.operators.metrics import ranked

SEGMENTS = {"odds": "selected_decimal_odds", "market": "selected_market_prob", "model": "selected_model_prob", "edge": "selected_edge"}


def with_buckets(bets: DataFrame) -> DataFrame:
    return bets.select("*", *[bucket(F.col(c), kind).alias(f"{kind}_bucket") for kind, c in SEGMENTS.items()])


def _all_buckets(bets: DataFrame, kind: str) -> DataFrame:
    rows = [(i, name) for i, (_, name) in enumerate(BUCKETS[kind])] if kind in BUCKETS else [(0, "red"), (1, "blue")]
    return bets.sparkSession.createDataFrame(rows, "position int, bucket string")


def segment(bets: DataFrame, kind: str) -> DataFrame:
    """Count, wins, profit, return, drawdown and means of each bucket; a bucket without bets is a row with 0 bets.

    Bets below the first bucket form one more row with a null bucket. ``kind`` is side, odds, market, model or edge.
    """
    label = F.col("selected_side") if kind == "side" else bucket(F.col(SEGMENTS[kind]), kind)
    rows = bets.withColumn("bucket", label)
    agg = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("bet_won").cast("int")).alias("won"), F.sum("profit").alias("sum_profit"), F.sum("stake").alias("sum_stake"), F.avg(F.coalesce(F.col("bet_won").cast("int"), F.lit(0))).alias("win_rate"), *[F.avg(f"selected_{c}").alias(f"avg_{n}") for c, n in (("edge", "edge"), ("decimal_odds", "odds"), ("model_prob", "model_prob"), ("market_prob", "market_prob"))])
    falls = drawdown(running(rows, ["bucket"], "profit", "e"), ["bucket"], "e")
    stats = agg.join(falls, agg["bucket"].eqNullSafe(falls["bucket"])).drop(falls["bucket"])
    every = _all_buckets(bets, kind)
    out = every.join(stats, "bucket", "full")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n_bets"), F.coalesce("won", F.lit(0)).alias("wins"), z("sum_profit").alias("total_profit"), F.when(F.col("sum_stake") > 0, F.col("sum_profit") / F.col("sum_stake")).otherwise(0.0).alias("roi"), "win_rate", "avg_edge", "avg_odds", "avg_model_prob", "avg_market_prob", z("max_drawdown").alias("max_drawdown")).orderBy(F.desc("roi"), F.desc("total_profit"), F.desc("n_bets"))


def edge_quality(bets: DataFrame) -> DataFrame:
    """Per edge bucket: bets, mean edge, win rate, mean model and market probability, return."""
    rows = bets.withColumn("bucket", bucket(F.col("selected_edge"), "edge")).where("bucket IS NOT NULL")
    agg = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("selected_edge").alias("avg_edge"), F.avg(F.col("bet_won").cast("int")).alias("win_rate"), F.avg("selected_model_prob").alias("avg_model_prob"), F.avg("selected_market_prob").alias("avg_market_prob"), (F.sum("profit") / F.sum("stake")).alias("r"))
    return _all_buckets(bets, "edge").join(agg, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n_bets"), "avg_edge", "win_rate", "avg_model_prob", "avg_market_prob", F.coalesce("r", F.lit(0.0)).alias("roi"))


def edge_correlations(bets: DataFrame) -> DataFrame:
    """Pearson correlations of edge, model and market probability with winning, and of edge with profit."""
    won = F.col("bet_won").cast("double")
    pairs = {"edge_won": ("selected_edge", won), "edge_profit": ("selected_edge", F.col("profit")), "model_prob_won": ("selected_model_prob", won), "market_prob_won": ("selected_market_prob", won)}
    stats = bets.agg(*[F.corr(F.col(a), b).alias(n) for n, (a, b) in pairs.items()])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(n).alias("correlation")) for n in pairs])))


def favourites_and_longshots(bets: DataFrame) -> DataFrame:
    """Three overlapping groups by odds (below 2, from 2, from 3): counts, win rate, means, profit and return; 0 in an empty group."""
    o = F.col("selected_decimal_odds")
    groups = {"favorites_only": o < 2, "underdogs_only": o >= 2, "longshots_only": o >= 3}
    rows = bets.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))).alias("segment"))
    won = F.coalesce(F.col("bet_won").cast("int"), F.lit(0))
    stats = rows.groupBy("segment").agg(F.count("*").alias("n_bets"), F.avg(won).alias("win_rate"), F.sum("profit").alias("total_profit"), (F.sum("profit") / F.sum("stake")).alias("roi"), F.avg("selected_edge").alias("avg_edge"), F.avg("selected_decimal_odds").alias("avg_odds"))
    every = bets.sparkSession.createDataFrame([(n,) for n in groups], "segment string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return every.join(stats, "segment", "left").select("segment", F.coalesce("n_bets", F.lit(0)).alias("n_bets"), *map(zero, ("win_rate", "total_profit", "roi", "avg_edge", "avg_odds")))


def months_and_quarters(bets: DataFrame) -> DataFrame:
    """Both gradings of time in one pass over the bets."""
    rows = bets.select("*", F.date_format("event_date", "yyyy-MM").alias("month"), F.concat(F.year("event_date").cast("string"), F.lit("Q"), F.quarter("event_date").cast("string")).alias("quarter"))
    grouped = rows.groupingSets([["month"], ["quarter"]], "month", "quarter").agg(F.grouping("month").alias("g"), F.count("*").alias("n_bets"), F.sum(F.col("bet_won").cast("int")).alias("wins"), F.sum("profit").alias("total_profit"), (F.sum("profit") / F.sum("stake")).alias("roi"))
    return grouped.select(F.when(F.col("g") == 0, "month").otherwise("quarter").alias("period_kind"), F.coalesce("month", "quarter").alias("period"), "n_bets", "wins", "total_profit", "roi")


#: Bets that one task rolls over.
ROLL_ROWS = 100_000


def rolling_return(bets: DataFrame, by: list[str], width: int = 50, least: int = 10) -> DataFrame:
    """Number of the bet, running profit, and the return over the last ``width`` bets (null before ``least``) in date order.

    Bets are numbered by a range-partitioned sort and rolled over in blocks of numbers; a block also gets the ``width`` - 1
    bets before it.
    """
    rows = ranked(running(bets, by, "profit", "running_profit"), by, ["event_date", "bout_id"]).drop("n")
    block = F.floor((F.col("r") - 1) / ROLL_ROWS)
    late = (F.col("r") - 1) % ROLL_ROWS >= ROLL_ROWS - (width - 1)
    places = F.when(late, F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))
    spread = rows.select("*", F.inline(places))
    last = Window.partitionBy(*by, "b").orderBy("r").rowsBetween(1 - width, 0)
    roi = F.when(F.col("r") >= least, F.sum("profit").over(last) / F.sum("stake").over(last))
    return spread.withColumn("rolling_roi", roi).where("own").drop("b", "own").withColumnRenamed("r", "bet_number")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, missing_pct``: share of null and NaN values in percent, two decimals; null for an empty table."""
    kinds = dict(df.dtypes)
    gone = lambda c: (F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()).cast("int")
    stats = df.agg(*[F.round(F.avg(gone(c)) * 100, 2).alias(c) for c in columns])
    return stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_pct")) for c in columns])))


def variance_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance, distinct values and the share of the most common one, for each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("k"))
    total, mean = F.sum("k"), F.sum(F.col("k") * F.col("v")) / F.sum("k")
    first = counts.groupBy("feature").agg(total.alias("n"), mean.alias("m"), F.count("*").alias("n_unique"), F.max("k").alias("top"))
    spread = counts.join(F.broadcast(first.select("feature", "m")), "feature").groupBy("feature").agg(F.sum(F.col("k") * (F.col("v") - F.col("m")) ** 2).alias("ss"))  # one row per column
    return first.join(spread, "feature").select("feature", (F.col("ss") / F.col("n")).alias("variance"), "n_unique", (F.col("top") / F.col("n")).alias("most_common_share"))


def correlated_pairs(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of columns whose correlation is at least this in size."""
    pairs = list(combinations(columns, 2))
    stats = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = stats.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])))
    return rows.where(F.abs("correlation") >= least)


def histogram(df: DataFrame, columns: list[str], bins: int = 30, lo: float = 0.0, hi: float = 30.0) -> DataFrame:
    """Counts of the stacked columns in equal bins of [lo, hi); values outside fall into bin 0 and bins + 1."""
    value: Column = F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v")
    return df.select(value).where("v IS NOT NULL").groupBy(F.width_bucket("v", F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of the stacked columns."""
    rows = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("value")).where("value IS NOT NULL")
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def table_summary(df: DataFrame, day: str = "event_date", target: str = "red_win") -> DataFrame:
    """One row: rows, dates and their range, mean target, weight classes, missing outcomes."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(day).alias("n_dates"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.round(F.avg(target), 6).alias("target_mean"), F.countDistinct("weight_class").alias("n_classes"), F.sum(F.col("outcome").isNull().cast("int")).alias("missing_outcomes"))
