"""Linking two tables without a key by soft logic.

Each candidate pair has a truth value in [0, 1]. Weighted rules over similarities, an exclusivity constraint and
transitivity among the records of one contest become a convex problem of hinge losses. It is solved by alternating
directions: one half of the problem splits by quote (rules on single pairs, exclusivity), the other by bet (transitivity),
and each half is solved where its group lies. No rule reaches beyond a connected set of pairs, so a set of bounded size is
solved whole within one task; only larger sets alternate over shuffles. The values at the optimum are the confidences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.runtime import Written, checkpoint, parts_for


@dataclass(frozen=True)
class Rules:
    """Weights of the rules and the step of the solver."""

    names_and_date: float = 2.0  # both names alike and near dates -> same
    names_and_odds: float = 1.0  # both names alike and like odds -> same
    odds: float = 2.0  # unlike odds -> not the same
    date: float = 1.0  # far dates -> not the same
    prior: float = 0.4  # nothing is the same without a reason
    transitive: float = 0.5  # a bet's quotes that are alike are all its contest's, or none is
    rho: float = 4.0
    #: Rounds after which the solver gives up with an error.
    rounds: int = 2400
    #: Rounds between two checkpoints, after which the solver may stop.
    together: int = 6
    #: Largest primal and dual residual at the end.
    close: float = 0.01
    #: What a day between the two dates takes from their likeness, and what more than two days take besides.
    day_cost: float = 0.08
    days_cost: float = 0.2
    #: Difference of the logarithms of two prices at which they are no longer alike, and over which likeness falls to 0.
    odds_apart: float = 0.3
    odds_slope: float = 0.22

    @property
    def days(self) -> int:
        """Days at which the dates' likeness is 0: pairs further apart are no candidates."""
        return math.ceil((1 - self.days_cost) / self.day_cost)


#: Days of one bucket of the candidate join.
BUCKET = 16
#: Pairs of a connected set that one task solves whole.
WHOLE = 100_000
#: Similarity of a pair whose quote names only one side.
ONE_NAME = 0.8
#: Least confidence of a link.
LEAST = 0.5


def decimal_odds(odds: Column) -> Column:
    """Decimal odds of either format: American odds are at least 100 away from 0. Null for null, NaN and impossible values."""
    american = F.when(odds >= 100, 1 + odds / 100).when(odds <= -100, 1 - 100 / odds)
    return F.when(F.isnan(odds), None).when(F.abs(odds) >= 100, american).when(odds > 1, odds)


def _persons(df: DataFrame, key: str, column: str, people: DataFrame, side: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(column).alias("name")).join(people, "name").select("id", F.lit(side).alias("side"), "entity", (1 / (1 + 0.25 * F.col("cost"))).alias("sim"))


def candidates(bets: DataFrame, quotes: DataFrame, people: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``bet_id, quote_id, s_name, s_date, s_odds, apart`` of all pairs that share their people and whose dates are alike at all.

    ``bets (bet_id, day, red, blue, side, odds)``, ``quotes (quote_id, day, first, second, odds_1, odds_2)``,
    ``people (name, entity, cost)``. A pair of which both sides name both people shares both; where one of them names a
    single readable person, the pair shares that one, and its prices must be alike where both are known (unlike prices
    weigh more than one name and a date do). Days meet in buckets and prices in bands, so a person's rows are spread
    over them. ``s_odds`` is null where either price is.
    """
    red = _persons(bets, "bet_id", "red", people, "red").select("id", F.col("entity").alias("r"), F.col("sim").alias("sr"))
    blue = _persons(bets, "bet_id", "blue", people, "blue").select("id", F.col("entity").alias("b"), F.col("sim").alias("sb"))
    named = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    known = bets.select(F.col("bet_id").alias("id"), "day", "side", "odds", (named("red") & named("blue")).alias("bet_whole")).join(red, "id", "left").join(blue, "id", "left").where("r IS NOT NULL OR b IS NOT NULL")
    known = checkpoint(known.select(F.col("id").alias("bet_id"), F.col("day").alias("bet_day"), "side", "odds", "bet_whole", "r", "b", "sr", "sb", F.floor(F.col("day") / BUCKET).alias("bucket")))
    one = _persons(quotes, "quote_id", "first", people, "1").select("id", F.col("entity").alias("p1"), F.col("sim").alias("s1"))
    two = _persons(quotes, "quote_id", "second", people, "2").select("id", F.col("entity").alias("p2"), F.col("sim").alias("s2"))
    base = quotes.select(F.col("quote_id").alias("id"), "day", "odds_1", "odds_2", (named("first") & named("second")).alias("quote_whole"))
    reach = F.explode(F.sequence(F.floor((F.col("day") - rules.days) / BUCKET), F.floor((F.col("day") + rules.days) / BUCKET)))
    spread = checkpoint(base.join(one, "id", "left").join(two, "id", "left").where("p1 IS NOT NULL OR p2 IS NOT NULL").select("*", reach.alias("bucket")))
    pair = lambda x, y: [F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")]
    quoted_both, bet_both = F.col("p1").isNotNull() & F.col("p2").isNotNull(), F.col("r").isNotNull() & F.col("b").isNotNull()
    both = spread.where(quoted_both & (F.col("p1") != F.col("p2"))).select("*", *pair("p1", "p2")).join(known.where(bet_both).select("*", *pair("r", "b")), ["lo", "hi", "bucket"]).drop("lo", "hi")
    both = both.withColumn("same_way", F.col("p1") == F.col("r")).withColumn("s_name", (F.col("s1") + F.col("s2")) / 2 * (F.col("sr") + F.col("sb")) / 2)
    # a name that is missing, or that is near nobody, leaves the other side to be found by date and odds
    slot = lambda c, n: F.struct(F.col(f"p{n}").alias("p"), F.lit(n == 1).alias("is_first"), F.col(f"s{n}").alias("sq"), F.col(f"odds_{n}").alias("own"), F.col(f"odds_{3 - n}").alias("other"))
    slots = spread.select("*", F.inline(F.array(slot("p", 1), slot("p", 2)))).where("p IS NOT NULL")
    side = lambda c, name: F.struct(F.col(c).alias("p"), F.lit(name == "red").alias("is_red"), F.col(f"s{c}").alias("sp"), (F.col("side") == name).alias("on_it"))
    sides = known.select("*", F.inline(F.array(side("r", "red"), side("b", "blue")))).where("p IS NOT NULL")
    band = lambda c: F.floor(F.ln(c) / rules.odds_apart)

    def meet(slots: DataFrame, sides: DataFrame) -> DataFrame:
        """Pairs by one person whose prices are alike, or of which one is unknown."""
        price = F.when(F.col("on_it"), F.col("own")).otherwise(F.col("other"))
        turned = slots.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("on_it")).withColumn("price", price)
        banded = turned.where("price IS NOT NULL").select("*", F.explode(F.sequence(band(F.col("price")) - 1, band(F.col("price")) + 1)).alias("band"))
        keys = ["p", "bucket", "on_it"]
        near = banded.drop("price").join(sides.where("odds IS NOT NULL").withColumn("band", band(F.col("odds"))), [*keys, "band"]).drop("band")
        some = turned.where("price IS NOT NULL").drop("price").join(sides.where("odds IS NULL"), keys)
        return near.unionByName(turned.where("price IS NULL").drop("price").join(sides, keys)).unionByName(some)

    # single quotes with all bets, and the other quotes of the persons of single bets with these
    alone = checkpoint(sides.where(~bet_both))
    others = slots.where(quoted_both).join(alone.select("p").distinct(), "p", "left_semi")
    lone = meet(slots.where(~quoted_both), sides).unionByName(meet(others, alone)).withColumn("same_way", F.col("is_red") == F.col("is_first"))
    # a side that names another whom we can't read may well mean another contest
    unread = F.when((~quoted_both & F.col("quote_whole")) | (~bet_both & F.col("bet_whole")), 0.85).otherwise(1.0)
    lone = lone.withColumn("s_name", F.col("sq") * F.col("sp") * ONE_NAME * unread)
    columns = ["bet_id", F.col("id").alias("quote_id"), "bet_day", "day", "side", "odds", "odds_1", "odds_2", "same_way", "s_name"]
    rows = both.select(*columns).unionByName(lone.select(*columns))
    gap = F.abs(F.col("day") - F.col("bet_day"))
    rows = rows.where(gap <= rules.days)
    s_date = F.greatest(F.lit(0.0), F.lit(1.0) - rules.day_cost * gap - F.when(gap > 2, rules.days_cost).otherwise(0.0))
    quoted = F.when((F.col("side") == "red") == F.col("same_way"), F.col("odds_1")).otherwise(F.col("odds_2"))
    apart = F.abs(F.ln(quoted / F.col("odds")))
    # two books differ by a few percent; a quarter apart is another contest
    s_odds = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rules.odds_apart - apart) / rules.odds_slope))
    scored = rows.select("bet_id", "quote_id", "s_name", s_date.alias("s_date"), s_odds.alias("s_odds"), apart.alias("apart"))
    best = F.max_by(F.struct("s_name", "s_date", "s_odds", "apart"), F.struct("s_name", F.coalesce("s_odds", F.lit(0.0)))).alias("b")
    return scored.groupBy("bet_id", "quote_id").agg(best).select("bet_id", "quote_id", "b.*")


def _segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, starts of the groups in that order, and each row's group."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, starts, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))


def _zero(slope, lo: np.ndarray, hi: np.ndarray, steps: int = 26) -> np.ndarray:
    """Where a rising function crosses zero in [lo, hi], element by element."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, lo, mid), np.where(up, mid, hi)
    return (lo + hi) / 2


def pair_step(v: np.ndarray, quote: np.ndarray, s_name: np.ndarray, s_date: np.ndarray, s_odds: np.ndarray, rules: Rules) -> np.ndarray:
    """The values that are best for the rules on single pairs, near v, with at most 1 in sum for each quote.

    The rules' slope rises in steps at four places, so a value's optimum is the least of the optima that the steps up to
    each place would give, held above that place. A quote whose values exceed 1 presses them all down by one price.
    """
    odds = np.isfinite(s_odds)
    s_odds = np.where(odds, s_odds, 0.5)
    places = np.stack([s_name + s_date - 1, s_name + s_odds - 1, s_odds, s_date], axis=1)
    steps = np.stack([np.full(len(v), rules.names_and_date), rules.names_and_odds * odds, rules.odds * odds, np.full(len(v), rules.date)], axis=1)
    steps[:, :2] *= places[:, :2] > 0
    order = np.argsort(places, axis=1, kind="stable")
    places, steps = np.take_along_axis(places, order, 1), np.take_along_axis(steps, order, 1)
    pull = rules.prior - np.where(order == 0, steps, 0).sum(1) - np.where(order == 1, steps, 0).sum(1)
    slopes = pull[:, None] + np.concatenate([np.zeros((len(v), 1)), np.cumsum(steps, 1)], 1)
    from_ = np.concatenate([np.zeros((len(v), 1)), np.maximum(places, 0.0)], 1)
    free = v[:, None] - slopes / rules.rho

    def at(rows: np.ndarray | slice, press: np.ndarray | float) -> np.ndarray:
        return np.clip(np.maximum(free[rows] - np.asarray(press)[..., None] / rules.rho, from_[rows]).min(1), 0.0, 1.0)

    x = at(slice(None), 0.0)
    order, starts, group = _segments(quote)
    over = order[(np.add.reduceat(x[order], starts) > 1)[group]]
    if len(over):
        _, begins, ids = _segments(quote[over])  # rows of a quote lie together in ``over``
        lo, hi = np.zeros(len(begins)), np.full(len(begins), rules.rho * 2 + 8.0)
        for _ in range(40):
            mid = (lo + hi) / 2
            more = np.add.reduceat(at(over, mid[ids]), begins) > 1
            lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        x[over] = at(over, hi[ids])
    return x


def bet_step(v: np.ndarray, bet: np.ndarray, alike: np.ndarray, rules: Rules) -> np.ndarray:
    """The values that are best for transitivity, near v.

    A bet has one hidden value m, "its contest is quoted"; a quote that is alike the bet's others to degree s should have a
    value within 1 - s of it. So transitivity costs one rule for each quote instead of one for each pair of quotes.
    """
    order, starts, group = _segments(bet)
    ids = np.empty(len(v), np.int64)
    ids[order] = group
    slack = 1.0 - alike
    reach = rules.transitive / rules.rho

    def given(m: np.ndarray) -> np.ndarray:
        lo, hi = m[ids] - slack, m[ids] + slack
        return np.where(v > hi, np.maximum(hi, v - reach), np.where(v < lo, np.minimum(lo, v + reach), v))

    def pull(m: np.ndarray) -> np.ndarray:  # rises in m: what the rules push m down by
        y = given(m)
        lo, hi = m[ids] - slack, m[ids] + slack
        push = np.where(y <= lo + 1e-12, np.minimum(rules.transitive, rules.rho * np.maximum(0, lo - v)), 0) - np.where(y >= hi - 1e-12, np.minimum(rules.transitive, rules.rho * np.maximum(0, v - hi)), 0)
        return np.add.reduceat(push[order], starts)

    m = _zero(pull, np.zeros(len(starts)), np.ones(len(starts)))
    return np.clip(given(m), 0.0, 1.0)


def connected_bets(pairs: DataFrame) -> DataFrame:
    """``bet_id, label`` of the bets that some quote connects with others: the smallest bet of the connected set.

    Each round takes the least label of a bet's neighbours and then the label's own label, so that the rounds grow with the
    logarithm of a chain's length; a table is written each round.
    """
    spark = pairs.sparkSession
    store = Written(spark)
    several = pairs.groupBy("quote_id").agg(F.min("bet_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = pairs.select("quote_id", "bet_id").join(several, "quote_id").where("bet_id != first").select(F.col("first").alias("a"), F.col("bet_id").alias("b")).distinct()
    edges = store.keep(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = store.keep(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while not labels.isEmpty():
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("above"))
        new = store.keep(least.join(up, "label", "left").select("v", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "new")
        changed = not new.where("label != old").isEmpty()
        labels = store.keep(new.select("v", "label"), "labels")
        if not changed:
            break
    return labels.select(F.col("v").alias("bet_id"), "label")


STATE = "bet_id bigint, quote_id bigint, s_name double, s_date double, s_odds double, alike double, apart double, x double, y double, u double, dual double"


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def solve_sets(p: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """Connected sets (``label``) solved to the end, each stopping by itself: ``y`` and the residuals ``primal`` and ``dual``.

    RuntimeError if ``rules.rounds`` don't suffice.
    """
    p = p.sort_values(["label", "quote_id", "bet_id"], ignore_index=True)
    names = ("s_name", "s_date", "s_odds", "alike")
    bet, quote, label = (p[c].to_numpy() for c in ("bet_id", "quote_id", "label"))
    values = {c: p[c].to_numpy(dtype=float) for c in names}
    found, primal, dual = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    at = np.arange(len(p))
    y, u = np.maximum(0.0, values["s_name"] + values["s_date"] - 1), np.zeros(len(p))
    for _ in range(rules.rounds):
        x = pair_step(y - u, quote, values["s_name"], values["s_date"], values["s_odds"], rules)
        new = bet_step(x + u, bet, values["alike"], rules)
        u, moved, gap = u + x - new, np.abs(new - y), np.abs(x - new)
        y = new
        starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        sizes = np.diff(np.r_[starts, len(label)])
        done = np.repeat(np.maximum.reduceat(np.maximum(moved, gap), starts) < rules.close, sizes)
        if done.any():
            rows = at[done]
            found[rows], primal[rows], dual[rows] = y[done], gap[done], moved[done]
            keep = ~done
            at, y, u, bet, quote, label = at[keep], y[keep], u[keep], bet[keep], quote[keep], label[keep]
            values = {c: v[keep] for c, v in values.items()}
            if not len(at):
                return p.assign(y=found, primal=primal, dual=dual)
    raise RuntimeError(f"not converged after {rules.rounds} rounds: the residual is {max(gap.max(), moved.max())}")


def solve(pairs: DataFrame, rules: Rules = Rules(), whole: int = WHOLE) -> DataFrame:
    """``bet_id, quote_id, apart``, the optimal values ``y`` and the residuals ``primal`` and ``dual`` they ended with.

    Connected sets of up to ``whole`` pairs are solved in one task each, larger ones by rounds over shuffles.
    """
    spark = pairs.sparkSession
    labels = connected_bets(pairs)
    rows = pairs.join(labels, "bet_id", "left").withColumn("label", F.coalesce("label", "bet_id"))
    large = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("label")
    large = checkpoint(large)  # fewer than pairs / whole
    some = not large.isEmpty()
    small = rows.join(large, "label", "left_anti") if some else rows
    out = "bet_id bigint, quote_id bigint, apart double, y double, primal double, dual double"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _whole(batches)
        if p is not None:
            yield solve_sets(p, rules)[["bet_id", "quote_id", "apart", "y", "primal", "dual"]]

    solved = small.repartition(parts_for(spark, pairs.count(), whole, 5_000), "label").mapInPandas(local, out)
    if not some:
        return solved
    return solved.unionByName(_solve_large(rows.join(large, "label", "left_semi").drop("label"), rules))


def _solve_large(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Alternating directions over shuffles: a round goes from groups of quotes to groups of bets."""
    parts = parts_for(pairs.sparkSession, pairs.count(), WHOLE, 5_000)

    def by_quote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _whole(batches)
        if p is not None:
            p["x"] = pair_step((p["y"] - p["u"]).to_numpy(), p["quote_id"].to_numpy(), *(p[c].to_numpy(dtype=float) for c in ("s_name", "s_date", "s_odds")), rules)
            yield p

    def by_bet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _whole(batches)
        if p is not None:
            before = p["y"]
            p["y"] = bet_step((p["x"] + p["u"]).to_numpy(), p["bet_id"].to_numpy(), p["alike"].to_numpy(), rules)
            p["u"] = p["u"] + p["x"] - p["y"]
            p["dual"] = (p["y"] - before).abs()
            yield p

    start = F.greatest(F.lit(0.0), F.col("s_name") + F.col("s_date") - 1)
    state = pairs.select("bet_id", "quote_id", "s_name", "s_date", "s_odds", "alike", "apart", start.alias("x"), start.alias("y"), F.lit(0.0).alias("u"), F.lit(1.0).alias("dual"))
    gap = None
    for _ in range(0, rules.rounds, rules.together):
        for _ in range(rules.together):
            state = state.repartition(parts, "quote_id").mapInPandas(by_quote, STATE).repartition(parts, "bet_id").mapInPandas(by_bet, STATE)
        state = checkpoint(state)
        primal = F.abs(F.col("x") - F.col("y"))
        gap = state.agg(F.max(F.greatest(primal, "dual"))).first()[0]
        if gap is None or gap < rules.close:
            return state.select("bet_id", "quote_id", "apart", "y", primal.alias("primal"), "dual")
    raise RuntimeError(f"not converged after {rules.rounds} rounds: the largest residual is {gap}")


def link(bets: DataFrame, quotes: DataFrame, people: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``bet_id, quote_id, confidence, residual``: the bet of each quote that has one.

    A quote goes to its most confident bet, if that is at least ``LEAST``; of equally confident bets the one with nearer
    odds, then the smaller id. ``residual`` is the solver's larger one at that pair. Rows without a date or without any readable name link to nothing. Repeated rows must be made
    one before; either table may be empty.
    """
    pairs = checkpoint(candidates(bets, quotes, checkpoint(people), rules))  # people are joined four times
    # how alike a quote is to the bet's others: its odds against their middle, in the same scale as s_odds
    middle = F.percentile_approx("apart", 0.5, 100)
    typical = pairs.groupBy("bet_id").agg(middle.alias("middle"))
    apart = F.abs(F.col("apart") - F.col("middle"))
    alike = F.coalesce(F.greatest(F.lit(0.0), 1 - apart / rules.odds_apart), F.lit(0.5)) * F.col("s_date")
    rows = pairs.join(typical, "bet_id").select("bet_id", "quote_id", "s_name", "s_date", "s_odds", "apart", alike.alias("alike"))
    solved = solve(checkpoint(rows), rules)
    order = Window.partitionBy("quote_id").orderBy(F.round("y", 3).desc(), F.col("apart").asc_nulls_last(), "bet_id")
    return solved.where(F.col("y") >= LEAST).withColumn("i", F.row_number().over(order)).where("i = 1").select("bet_id", "quote_id", F.round("y", 6).alias("confidence"), F.round(F.greatest("primal", "dual"), 6).alias("residual"))
