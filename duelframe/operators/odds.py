"""Price quotes: coverage by source, format, latest quotes, and the oriented merge with contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.functions import text as X
from duelframe.operators.history import latest_quote


def standard_quotes(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """``event_date, fighter_1, fighter_2, odds_1, odds_2, source, quoted_at, key_1, key_2, pair_key``, missing columns null.

    ``names`` gives the input's column for each of these where it differs. A table without a source column gets
    NO_SOURCE_COLUMN. Repeated rows count once.
    """
    names = names or {}
    have = set(df.columns)

    def get(target: str, kind: str):
        c = names.get(target, target)
        return F.col(c).try_cast(kind) if c in have else F.lit(None).cast(kind)

    source = X.source_name(get("source", "string")) if names.get("source", "source") in have else F.lit("NO_SOURCE_COLUMN")
    extra = [F.col(names.get("quote_id", "quote_id")).alias("quote_id")] if names.get("quote_id", "quote_id") in have else []
    rows = df.select(*extra, get("event_date", "date").alias("event_date"), get("fighter_1", "string").alias("fighter_1"), get("fighter_2", "string").alias("fighter_2"), N.real(get("odds_1", "double")).alias("odds_1"), N.real(get("odds_2", "double")).alias("odds_2"), source.alias("source"), get("quoted_at", "timestamp").alias("quoted_at")).distinct()
    keyed = rows.select("*", X.name_key(F.col("fighter_1")).alias("key_1"), X.name_key(F.col("fighter_2")).alias("key_2"))
    return keyed.select("*", X.unordered_key(F.col("key_1"), F.col("key_2")).alias("pair_key"))


def source_coverage(quotes: DataFrame) -> DataFrame:
    """Rows, contests, missing prices and date range of each source."""
    missing = (F.col("odds_1").isNull() | F.col("odds_2").isNull()).cast("int")
    contest = F.concat_ws("|", F.col("event_date").cast("string"), "pair_key")
    return quotes.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct(contest).alias("n_contests"), F.sum(missing).alias("n_missing"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


def choose_source(coverage: DataFrame, preferred: str | None = None, share: float = 0.8, fallback: str = "zewn") -> DataFrame:
    """One row ``source``: the preferred one if it covers enough, else the best named one, else one like ``fallback``, else any.

    A source is named if it is neither unknown nor absent; enough is ``share`` of the most contests that a source covers.
    """
    top = coverage.agg(F.max("n_contests").alias("top"))
    rows = coverage.crossJoin(F.broadcast(top))  # one row
    named = ~F.col("source").isin("UNKNOWN_SOURCE", "NO_SOURCE_COLUMN")
    enough = F.col("n_contests") >= share * F.col("top")
    first = (F.col("source") == F.lit(preferred)) & enough if preferred else F.lit(False)
    rank = F.when(first, 0).when(named & enough, 1).when(F.contains(X.text_key(F.col("source")), F.lit(fallback)), 2).otherwise(3)
    return rows.select("source", rank.alias("k"), "n_contests", "n_missing").orderBy("k", F.desc("n_contests"), "n_missing", "source").limit(1).select("source")


def odds_format(quotes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``n_odds, odds_format``: american if any price is negative or most are at least 100 in size, unknown without prices."""
    prices = quotes.select(*(by or []), F.explode(F.array("odds_1", "odds_2")).alias("o"))
    stats = prices.groupBy(*(by or [])).agg(F.count("o").alias("n_odds"), F.max((F.col("o") < 0).cast("int")).alias("neg"), F.avg((F.abs("o") >= 100).cast("int")).alias("big"))
    kind = F.when(F.col("n_odds") == 0, "unknown").when((F.col("neg") == 1) | (F.col("big") > 0.5), "american").otherwise("decimal")
    return stats.select(*(by or []), "n_odds", kind.alias("odds_format"))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The last quote of each contest and source; a quote without a time is taken as the last."""
    return latest_quote(quotes, ["event_date", "pair_key", "source"], "quoted_at", "quote_id")


def implied_probabilities(quotes: DataFrame) -> DataFrame:
    """Decimal prices of either format, raw and no-vig probabilities and the overround of each quote."""
    price = lambda c: F.when(F.abs(c) >= 100, N.american_to_decimal(c)).when(c > 1, c)
    rows = quotes.select("*", price(F.col("odds_1")).alias("decimal_1"), price(F.col("odds_2")).alias("decimal_2"))
    rows = rows.select("*", (1 / F.col("decimal_1")).alias("prob_1"), (1 / F.col("decimal_2")).alias("prob_2"))
    total, a, b = N.no_vig(F.col("prob_1"), F.col("prob_2"))
    return rows.select("*", total.alias("overround"), a.alias("novig_1"), b.alias("novig_2"))


def contest_keys(contests: DataFrame) -> DataFrame:
    keyed = contests.select("*", X.name_key(F.col("red_name")).alias("red_key"), X.name_key(F.col("blue_name")).alias("blue_key"))
    return keyed.select("*", X.unordered_key(F.col("red_key"), F.col("blue_key")).alias("pair_key"))


def merge_quotes(contests: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each contest with the quote of its date and pair, prices turned to red and blue; nulls and ``matched`` false without one.

    ``quotes`` holds one row per date and pair (one source, latest) with ``implied_probabilities``.
    """
    q = quotes.select("event_date", "pair_key", "key_1", F.lit(True).alias("__m"), F.col("source").alias("odds_source"), "overround", *[f"{n}_{i}" for n in ("decimal", "prob", "novig") for i in (1, 2)])
    rows = contest_keys(contests).join(q, ["event_date", "pair_key"], "left")
    same = F.col("key_1") == F.col("red_key")
    out = [F.when(same, F.col(f"{n}_{i}")).otherwise(F.col(f"{n}_{3 - i}")).alias(f"{s}_{name}") for n, name in (("decimal", "decimal_odds"), ("prob", "implied_prob_raw"), ("novig", "implied_prob_novig")) for i, s in ((1, "red"), (2, "blue"))]
    return rows.select("bout_id", "event_date", "red_name", "blue_name", "red_win", "outcome", F.coalesce("__m", F.lit(False)).alias("matched"), "odds_source", F.col("overround").alias("odds_overround"), *out)


def unmatched_quotes(quotes: DataFrame, contests: DataFrame) -> DataFrame:
    """Quotes whose pair of names no contest has on any date."""
    return quotes.join(contest_keys(contests).select("pair_key"), "pair_key", "left_anti")


def merge_quality(quotes: DataFrame) -> DataFrame:
    """One row: keys that occur more than once, prices that are not positive decimals, rows, keys."""
    keys = quotes.groupBy("event_date", "pair_key", "source").agg(F.count("*").alias("n"), F.sum(((F.col("odds_1") <= 1) & (F.abs("odds_1") < 100)).cast("int")).alias("low"))
    return keys.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("n_repeated_keys"), F.coalesce(F.sum("low"), F.lit(0)).alias("n_low_odds"))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, failing at run time if a combination of keys occurs twice; the check is part of the plan."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.assert_true(F.col("__n") == 1, F.lit(f"keys are not unique: {keys}")).isNull()).drop("__n")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def most_used_source(quotes: DataFrame) -> DataFrame:
    """One row: the source with most quotes, the first by name of equally frequent ones."""
    return quotes.groupBy(F.col("source").alias("odds_source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "odds_source").limit(1)
