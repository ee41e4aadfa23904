"""Bet selection and staking, for all thresholds and fractions in one pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.runtime import checkpoint, parallelism

#: Edge thresholds, Kelly fractions, cap of a full Kelly stake, starting bankroll.
THRESHOLDS = (0.0, 0.02, 0.05, 0.08, 0.10)
FRACTIONS, CAP, BANKROLL = (0.25, 0.5), 0.25, 1000.0


def _each(values: tuple[float, ...], name: str) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)


def edges(merged: DataFrame, p: str = "p") -> DataFrame:
    """Model probabilities less the market's, both sides; rows with a missing value are left out."""
    need = [p, "red_implied_prob_novig", "blue_implied_prob_novig", "red_decimal_odds", "blue_decimal_odds"]
    rows = merged.where(" AND ".join(f"{c} IS NOT NULL" for c in need))
    return rows.select("*", (F.col(p) - F.col("red_implied_prob_novig")).alias("edge_red"), (1 - F.col(p) - F.col("blue_implied_prob_novig")).alias("edge_blue"))


def select_bets(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, p: str = "p") -> DataFrame:
    """One row per contest and threshold: the side with the larger edge (red on ties) if it exceeds the threshold, else skip."""
    each = rows.select("*", _each(thresholds, "edge_threshold"))
    edge = F.greatest("edge_red", "edge_blue")
    red = F.col("edge_red") >= F.col("edge_blue")
    win_red, win_blue = F.col("outcome") == "red_win", F.col("outcome") == "blue_win"
    decided = F.coalesce(win_red | win_blue, F.lit(False))

    def pick(side: str, won: Column) -> Column:
        model = F.col(p) if side == "red" else 1 - F.col(p)
        return F.struct(F.lit(side).alias("selected_side"), F.col(f"edge_{side}").alias("selected_edge"), F.col(f"{side}_decimal_odds").alias("selected_decimal_odds"), model.alias("selected_model_prob"), F.col(f"{side}_implied_prob_novig").alias("selected_market_prob"), F.when(decided, won).alias("bet_won"))

    none = F.struct(F.lit("skip").alias("selected_side"), *[F.lit(None).cast("double").alias(c) for c in ("selected_edge", "selected_decimal_odds", "selected_model_prob", "selected_market_prob")], F.lit(None).cast("boolean").alias("bet_won"))
    chosen = F.when(edge > F.col("edge_threshold"), F.when(red, pick("red", win_red)).otherwise(pick("blue", win_blue))).otherwise(none)
    return each.select("bout_id", "event_date", "edge_threshold", chosen.alias("c")).select("bout_id", "event_date", "edge_threshold", "c.*")


def bets_at(bets: DataFrame, threshold: float) -> DataFrame:
    return bets.where((F.round("edge_threshold", 10) == F.round(F.lit(threshold), 10)) & (F.col("selected_side") != "skip"))


def running(df: DataFrame, by: list[str], value: str, out: str, fold: Callable[[str], Column] = F.sum, upto: int = 0) -> DataFrame:
    """``df`` with ``out``: the sum (or max, or product) of a value so far in date order within its group.

    Rows are range-partitioned by group and date, so that a block is a run of that order with about as many rows as any
    other; blocks are folded and chained by their totals, so a group of any size is many tasks. ``upto`` -1 leaves the row
    itself out. Null where nothing comes before.
    """
    # both sides of the join below come from these rows: without the checkpoint each nested total would double the work
    rows = checkpoint(df.repartitionByRange(parallelism(df.sparkSession), *by, "event_date", "bout_id").withColumn("__b", F.spark_partition_id()))
    keys = [*by, "__b"]
    totals = rows.groupBy(*keys).agg(fold(value).alias("__t"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], fold("__t").over(before).alias("__e"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    own = fold(value).over(Window.partitionBy(*keys).orderBy("event_date", "bout_id").rowsBetween(Window.unboundedPreceding, upto))
    joined = rows.join(earlier, same).withColumn("__o", own)
    both = {F.sum: F.col("__e") + F.col("__o"), F.max: F.greatest("__e", "__o"), F.product: F.col("__e") * F.col("__o")}[fold]
    value_so_far = F.when(F.col("__e").isNull(), F.col("__o")).when(F.col("__o").isNull(), F.col("__e")).otherwise(both)
    return joined.select(*df.columns, value_so_far.alias(out))


def flat_profit(bets: DataFrame, by: tuple[str, ...] = ("edge_threshold",)) -> DataFrame:
    """Stake 1 on each decided bet: ``profit`` and ``cumulative_profit`` in date order within a threshold."""
    placed = bets.where("selected_side != 'skip' AND bet_won IS NOT NULL")
    profit = F.when(F.col("bet_won"), F.col("selected_decimal_odds") - 1).otherwise(-1.0)
    return running(placed.select("*", F.lit(1.0).alias("stake"), profit.alias("profit")), [*by], "profit", "cumulative_profit")


def kelly(bets: DataFrame, fractions: tuple[float, ...] = FRACTIONS, bankroll: float = BANKROLL, cap: float = CAP) -> DataFrame:
    """Fractional Kelly stakes and the bankroll after each bet.

    A bet's fraction doesn't depend on the bankroll, so the bankroll is the start times the running product of growth
    factors, and a stake the bankroll before it times the fraction.
    """
    placed = bets.where("selected_side != 'skip' AND bet_won IS NOT NULL").select("*", _each(fractions, "kelly_fraction"))
    b, p = F.col("selected_decimal_odds") - 1, F.col("selected_model_prob")
    full = F.when(b > 0, F.least(F.greatest((b * p - (1 - p)) / b, F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    rows = placed.withColumn("full_kelly_fraction", full).withColumn("fraction_of_bankroll", F.col("full_kelly_fraction") * F.col("kelly_fraction"))
    growth = 1 + F.col("fraction_of_bankroll") * F.when(F.col("bet_won"), b).otherwise(-1.0)
    grown = running(rows.withColumn("__g", growth), ["edge_threshold", "kelly_fraction"], "__g", "__before", F.product, -1)
    previous = bankroll * F.coalesce("__before", F.lit(1.0))
    after = previous * F.col("__g")
    return grown.select(*rows.columns, after.alias("bankroll"), (previous * F.col("fraction_of_bankroll")).alias("stake"), (after - previous).alias("profit"))


def drawdown(df: DataFrame, by: list[str], equity: str = "cumulative_profit") -> DataFrame:
    """Greatest fall of the equity from its peak so far; the first peak is the first equity, not the start."""
    peaks = running(df.select(*by, "event_date", "bout_id", equity), by, equity, "__peak", F.max)
    return peaks.groupBy(*by).agg(F.max(F.col("__peak") - F.col(equity)).alias("max_drawdown"))


def summary(bets: DataFrame, by: list[str], equity: str = "cumulative_profit") -> DataFrame:
    """Bets, wins, win rate, profit, stake, return, mean edge and odds, greatest drawdown of each group."""
    total = bets.groupBy(*by).agg(F.count("*").alias("n_bets"), F.sum(F.col("bet_won").cast("int")).alias("wins"), F.avg(F.col("bet_won").cast("int")).alias("win_rate"), F.sum("profit").alias("total_profit"), F.sum("stake").alias("total_staked"), F.avg("selected_edge").alias("avg_edge"), F.avg("selected_decimal_odds").alias("avg_odds"))
    roi = F.when(F.col("total_staked") > 0, F.col("total_profit") / F.col("total_staked")).otherwise(0.0)
    return total.withColumn("roi", roi).join(drawdown(bets, by, equity), by)


def best_threshold(results: DataFrame) -> DataFrame:
    """The threshold with the best return (then profit, then the larger number of bets)."""
    return results.orderBy(F.desc("roi"), F.desc("total_profit"), F.desc("n_bets"), "edge_threshold").limit(1)
