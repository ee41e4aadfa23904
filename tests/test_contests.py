"""History operators against sequential Python, and the smaller operators on hand-made rows."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duelframe.functions import numeric as N
from duelframe.functions import text as X
from duelframe.operators import backtest as B
from duelframe.operators import diagnostics as G
from duelframe.operators import history as H
from duelframe.operators import metrics as M
from duelframe.operators import odds as O
from duelframe.operators import splits as S
from duelframe.operators.paired import clean_contests, side_differences, to_long
from duelframe.operators.rating import elo

SCHEMA = "bout_id bigint, event_date date, day int, red_id bigint, blue_id bigint, outcome string, method string, round int, rounds int, duration_seconds double, red_sig_landed double, blue_sig_landed double, red_kd double, blue_kd double, red_win int"


def random_contests(n=150, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.sample(range(1, 9), 2)
        day = 18_000 + rng.randrange(0, 60) * 30
        out = rng.choice(["red_win", "blue_win", "draw", None])
        rows.append((i, dt.date(1970, 1, 1) + dt.timedelta(days=day), day, a, b, out, rng.choice(["ko/tko", "submission", "decision - split", None]), rng.choice([1, 2, 3, 5, None]), rng.choice([3, 5, None]), rng.choice([100.0, 300.0, None]), float(rng.randrange(50)), None if rng.random() < 0.1 else float(rng.randrange(50)), 1.0, 0.0, int(out == "red_win")))
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_contests()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def walk(rows, snapshot, update):
    """Sequential state by entity with same-day exclusivity."""
    out, state = {}, defaultdict(dict)
    for day in sorted({r[2] for r in rows}):
        today = sorted(r for r in rows if r[2] == day)
        for r in today:
            for side, own, other in (("red", r[3], r[4]), ("blue", r[4], r[3])):
                out[r[0], side] = snapshot(state[own], day)
        for r in today:
            for side, own in (("red", r[3]), ("blue", r[4])):
                update(state[own], r, side, r[5] == f"{side}_win", r[5] in ("red_win", "blue_win") and r[5] != f"{side}_win")
    return out


def test_totals_and_streaks(table, rows):
    def update(s, r, side, won, lost):
        s["n"] = s.get("n", 0) + 1
        s["w"] = s.get("w", 0) + won
        s["sig"] = s.get("sig", 0) + ((r[10] if side == "red" else r[11]) or 0)
        s["up"], s["down"] = (s.get("up", 0) + 1, 0) if won else (0, s.get("down", 0) + 1) if lost else (s.get("up", 0), s.get("down", 0))
        s["last"] = r[2]

    want = walk(rows, lambda s, day: (s.get("n", 0), s.get("w", 0), s.get("sig", 0), s.get("up", 0), s.get("down", 0), day - s["last"] if "last" in s else None), update)
    got = H.layoffs(H.streaks(H.career_totals(to_long(table))))
    assert {(r.bout_id, r.side): (r.total_fights, r.total_wins, r.total_sig_strikes_landed, r.win_streak, r.loss_streak, r.days_since_last_fight) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 5])
def test_last_n(table, rows, n):
    def update(s, r, side, won, lost):
        s.setdefault("h", []).append((won, (r[10] if side == "red" else r[11]) or 0, r[9] or 0))

    def snapshot(s, day):
        h = s.get("h", [])[-n:]
        t = sum(x[2] for x in h)
        return (sum(x[0] for x in h) / len(h), sum(x[1] for x in h) * 60 / t if t else 0.0) if h else (0.0, 0.0)

    want = walk(rows, snapshot, update)
    got = {(r.bout_id, r.side): (r[f"recent_{n}_win_pct"], r[f"recent_{n}_sig_strikes_landed_per_min"]) for r in H.last_n(to_long(table), n).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_decay(table, rows):
    def update(s, r, side, won, lost):
        s.setdefault("h", []).append((r[2], won))

    def snapshot(s, day):
        w = [(0.5 ** ((day - d) / 90), x) for d, x in s.get("h", [])]
        total = sum(a for a, _ in w)
        return sum(a * x for a, x in w) / total if total > 1e-6 else 0.0

    want = walk(rows, snapshot, update)
    got = {(r.bout_id, r.side): r.exp_decay_win_pct for r in H.decayed(to_long(table), 90.0).collect()}
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_elo(table, rows):
    ratings, want = {}, {}
    for day in sorted({r[2] for r in rows}):
        today = sorted(r for r in rows if r[2] == day)
        for r in today:
            want[r[0]] = (ratings.get(r[3], 500.0), ratings.get(r[4], 500.0))
        for r in today:
            a, b = ratings.get(r[3], 500.0), ratings.get(r[4], 500.0)
            e, s = 1 / (1 + 10 ** ((b - a) / 400)), {"red_win": 1.0, "blue_win": 0.0}.get(r[5], 0.5)
            ratings[r[3]], ratings[r[4]] = a + 32 * (s - e), b + 32 * (e - s)
    got = {r.bout_id: (r.red_elo, r.blue_elo) for r in elo(table).collect()}
    assert all(got[k] == pytest.approx(want[k]) for k in want) and len(got) == len(want)


def test_bad_parameters(table):
    with pytest.raises(ValueError):
        H.last_n(to_long(table), 0)
    with pytest.raises(ValueError):
        H.decayed(to_long(table), 0)


def test_empty_history(spark):
    empty = to_long(spark.createDataFrame([], SCHEMA))
    assert H.streaks(H.career_totals(empty)).count() == 0 and H.last_n(empty).count() == 0 and elo(spark.createDataFrame([], SCHEMA)).count() == 0


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("value", "want"), [("4:05", 245.0), ("1:00:01", 3601.0), ("12", 12.0), ("--", None), (None, None), ("a:b", None)])
def test_clock(spark, value, want):
    assert one(spark, X.clock_seconds, value) == want


def test_text_functions(spark):
    assert one(spark, X.landed, "3 of 12") == 3.0 and one(spark, X.attempted, "3 of 12") == 12.0 and one(spark, X.landed, "3/12") is None
    assert one(spark, X.name_key, "José  Núñez") == "JOSE NUNEZ" and one(spark, X.name_key, "Błachowicz") == "B ACHOWICZ" and one(spark, X.name_key, None) == ""
    assert one(spark, X.weight_class, "UFL Women's Flyweight Bout") == "Women's Flyweight" and one(spark, X.weight_class, "Light Heavyweight") == "Light Heavyweight" and one(spark, X.weight_class, "x") is None
    assert one(spark, X.scheduled_rounds, "5 Rnd (5-5-5-5-5)") == 5 and one(spark, X.scheduled_rounds, "1 Rnd + OT (12-3)") == 1 and one(spark, X.scheduled_rounds, "(5-5-5)") == 3 and one(spark, X.scheduled_rounds, "No Time Limit") is None
    assert one(spark, X.share, "55%") == 0.55 and one(spark, X.share, "0.4") == 0.4 and one(spark, X.inches, "5' 11\"") == 71.0
    assert one(spark, X.source_name, None) == "UNKNOWN_SOURCE" and one(spark, X.text_key, "A b--C!") == "a_b_c"


def test_numeric_functions(spark):
    assert one(spark, N.american_to_probability, 150.0, "double") == 0.4 and one(spark, N.american_to_probability, -150.0, "double") == 0.6 and one(spark, N.american_to_probability, 0.0, "double") is None
    assert one(spark, lambda c: N.bucket(c, "odds"), 2.0, "double") == "2.0 <= odds < 3.0" and one(spark, lambda c: N.bucket(c, "edge"), -0.1, "double") is None
    assert one(spark, N.event_date, "14/03/2026") == dt.date(2026, 3, 14) and one(spark, N.event_date, "Mar 04, 2026") == dt.date(2026, 3, 4) and one(spark, N.event_date, "x") is None
    assert one(spark, N.real, float("nan"), "double") is None


def test_clean_contests_tolerates_missing_columns(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1, 2, "RED_WIN "), (1, dt.date(2020, 1, 1), 1, 2, "RED_WIN "), (2, None, 1, 2, "x")], "bout_id bigint, event_date date, red_fighter_id bigint, blue_fighter_id bigint, fight_outcome string")
    got = clean_contests(df).collect()
    assert len(got) == 1 and got[0].red_win == 1 and got[0].red_sig_landed is None


def test_differences(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0, 3, 1)], "bout_id int, pre_fight_red_x double, pre_fight_blue_x double, red_age int, blue_age int")
    row = side_differences(df).first()
    assert row.pre_fight_x_diff == 3.0 and row.age_diff == 2.0


def test_split_by_distinct_dates(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    df = spark.createDataFrame([(d,) for d in days for _ in range(3)], "event_date date")
    n = {r.split: r.n_rows for r in S.split_summary(S.chronological_split(df).withColumn("red_win", F.lit(1))).collect()}
    assert n == {"train": 42, "validation": 9, "test": 9}


def test_quantile_bins(spark):
    df = spark.range(1155).select((F.col("id") / 2000.0).alias("p"), "id", (F.col("id") % 2).alias("label"))
    got = {r.bin: r.n_rows for r in M.calibration(df, [], "id").collect()}
    assert [got[i] for i in range(10)] == [116, 115, 116, 115, 116, 115, 115, 116, 115, 116]
    few = spark.createDataFrame([(0.5, i, 1) for i in range(7)], "p double, id int, label int")
    assert M.calibration(few, [], "id").count() == 7


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.8), ("a", 0, 0.1), ("b", 1, 0.5)], "g string, label int, p double")
    got = {r.g: r for r in M.evaluate(df, ["g"]).collect()}
    assert got["a"].roc_auc == pytest.approx(0.625) and got["b"].roc_auc is None


BETS = "bout_id bigint, event_date date, outcome string, p double, red_implied_prob_novig double, blue_implied_prob_novig double, red_decimal_odds double, blue_decimal_odds double"


def make_bets(spark, n=40, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        q = rng.uniform(0.2, 0.8)
        rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), rng.choice(["red_win", "blue_win", "draw"]), rng.uniform(0.1, 0.9), q, 1 - q, 0.95 / q, 0.95 / (1 - q)))
    return B.select_bets(B.edges(spark.createDataFrame(rows, BETS)))


def test_kelly_follows_the_loop(spark):
    got = B.kelly(make_bets(spark), (0.5,)).where("edge_threshold = 0.02").orderBy("event_date", "bout_id").collect()
    bank = 1000.0
    for r in got:
        b = r.selected_decimal_odds - 1
        full = min(max((b * r.selected_model_prob - (1 - r.selected_model_prob)) / b, 0), 0.25)
        assert r.stake == pytest.approx(bank * full * 0.5)
        bank += r.stake * (b if r.bet_won else -1)
        assert r.bankroll == pytest.approx(bank)


def test_drawdown_starts_at_first_equity_and_empty_buckets_stay(spark):
    bets = B.flat_profit(make_bets(spark))
    rows = bets.where("edge_threshold = 0").orderBy("event_date", "bout_id").collect()
    peak, worst, total = -math.inf, 0.0, 0.0
    for r in rows:
        total += r.profit
        peak = max(peak, total)
        worst = max(worst, peak - total)
    assert B.summary(bets, ["edge_threshold"]).where("edge_threshold = 0").first().max_drawdown == pytest.approx(worst)
    few = bets.where("selected_decimal_odds < 1.5")
    assert {r.bucket: r.n_bets for r in G.segment(few, "odds").collect()}["odds >= 5.0"] == 0


def test_latest_quote_without_time_wins(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), "A", "B", 2.0, 1.8, "s", t), (2, dt.date(2020, 1, 1), "b", "a", 1.9, 2.1, "s", None)], "quote_id int, event_date date, fighter_1 string, fighter_2 string, odds_1 double, odds_2 double, source string, quoted_at timestamp")
    assert [r.quote_id for r in O.latest_quotes(O.standard_quotes(df)).collect()] == [2]


def test_one_to_one_join_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="not unique"):
        O.join_one_to_one(a, a.distinct(), ["k"]).collect()
