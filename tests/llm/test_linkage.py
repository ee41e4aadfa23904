"""Ranking, names and soft-logic linkage."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.llm import names, ranking, softlogic


def fit_exact(pairs, n, ridge=1.0):
    """Newton's method with dense matrices."""
    s, phi = np.zeros(n), lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for _ in range(60):
        g, h = -ridge * s, ridge * np.eye(n)
        for i, j in pairs:
            d = s[i] - s[j]
            r = phi(d) / cdf(d)
            w = phi(d) ** 2 / (cdf(d) * cdf(-d))
            g[i] += r
            g[j] -= r
            h[i, i] += w
            h[j, j] += w
            h[i, j] -= w
            h[j, i] -= w
        s = s + np.linalg.solve(h, g)
    return s, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.fixture(scope="module")
def results():
    rng = random.Random(2)
    true = {i: rng.gauss(0, 1) for i in range(12)}
    out = []
    for _ in range(250):
        i, j = rng.sample(range(12), 2)
        out.append((i, j) if rng.gauss(true[i] - true[j], 1) > 0 else (j, i))
    return out


def test_strengths_equal_dense_newton(spark, results):
    want, error = fit_exact(results, 12)
    df = spark.createDataFrame([(f"p{i:02d}", f"p{j:02d}", 1) for i, j in results], "winner string, loser string, item int")
    got = {int(r.item[1:]): r for r in ranking.rank_items(df).collect()}
    assert [got[i].strength for i in range(12)] == pytest.approx(want.tolist(), abs=2e-3)
    order = sorted(range(12), key=lambda i: got[i].position)
    assert order == sorted(range(12), key=lambda i: -got[i].strength)
    assert [got[i].std_error for i in range(12)] == pytest.approx(error.tolist(), rel=0.01)
    assert got[0].n_won == sum(i == 0 for i, _ in results)


def test_blocks_change_nothing(spark, results, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 5)
    want, error = fit_exact(results, 12)
    df = spark.createDataFrame(results, "winner int, loser int")
    got = {r.item: r for r in ranking.rank_items(df).collect()}
    assert [got[i].strength for i in range(12)] == pytest.approx(want.tolist(), abs=2e-3)
    assert max(abs(got[i].std_error / error[i] - 1) for i in range(12)) < 0.03


def test_standard_errors(spark):
    rng = random.Random(5)
    pairs = [tuple(rng.sample(range(60), 2)) for _ in range(900)] + [(60, 61), (61, 62), (62, 63), *[(64, i) for i in range(60)]]
    _, error = fit_exact(pairs, 65)
    df = spark.createDataFrame([(i, j) for i, j in pairs], "winner int, loser int")
    got = {r.item: r.std_error for r in ranking.rank_items(df).collect()}
    off = [abs(got[i] - error[i]) / error[i] for i in range(65)]
    assert np.mean(off) < 0.02 and max(off) < 0.1
    few = [p for p in pairs if max(p) < 8]
    exact = fit_exact(few, 8)[1]
    got = {r.item: r.std_error for r in ranking.rank_items(spark.createDataFrame(few, "winner int, loser int")).collect()}
    assert [got[i] for i in sorted(got)] == pytest.approx([exact[i] for i in sorted(got)], rel=2e-3)


def test_no_convergence_is_an_error(spark, results, monkeypatch):
    monkeypatch.setattr(ranking, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError, match="converge"):
        ranking.rank_items(spark.createDataFrame(results, "winner int, loser int"))


def test_ranking_edges(spark):
    empty = spark.createDataFrame([], "winner string, loser string")
    assert ranking.rank_items(empty).count() == 0
    df = spark.createDataFrame([("a", "b"), ("c", "d"), (None, "a"), ("a", "a"), ("b", None)], "winner string, loser string")
    got = {r.item: r for r in ranking.rank_items(df).collect()}
    assert set(got) == set("abcd") and got["a"].strength == pytest.approx(got["c"].strength) and got["a"].position == 1 and got["b"].strength < 0


def test_normal_is_exact():
    d = np.linspace(-6, 6, 401)
    _, up, down = ranking.normal(d)
    assert np.abs(up - [0.5 * math.erfc(-x / math.sqrt(2)) for x in d]).max() < 1e-9 and np.abs(up + down - 1).max() < 1e-9


letters = st.text("abcd", max_size=7)


@given(st.lists(st.text("abcdé", max_size=9), min_size=1, max_size=8), st.lists(st.text("abcxé", max_size=64), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_distances_of_a_batch(texts, pivots):
    got = names.distances(texts, pivots)
    assert got.tolist() == [[names.levenshtein(t, p, 99) for p in pivots] for t in texts]


def test_forms_are_learned(spark):
    people = [(f"{g} {s}", 2) for g, s in [("Rafael", x + "kahol") for x in ("Du", "Mu", "Lo", "Ty")] + [("Leandro", x + "viren") for x in ("Du", "Mu", "Lo", "Ty")]]
    typed = [f"Rafa {x}kahol" for x in ("Du", "Mu", "Lo")] + [f"Tuto {x}viren" for x in ("Du", "Mu", "Lo")] + ["Tuto Tyvirem", "Hammer Dukahol", "Hammer Muviren", "Hammer Tykahol"]
    linked = names.link_spellings(table(spark, [(t, 1) for t in typed]), table(spark, people), {})
    got = {r.name: r.display for r in linked.collect()}
    assert got["Tuto Tyvirem"] == "Leandro Tyviren" and got["Rafa Dukahol"] == "Rafael Dukahol" and got["Hammer Tykahol"] == "Rafael Tykahol"
    people_table = names.registry_entities(table(spark, people))
    ways = names._readings(table(spark, [(t, 1) for t in typed]).withColumn("qid", names.F.xxhash64("name")), ["rafael", "leandro"], {})
    assert names.learned_forms(ways, people_table) == {"tuto": ["leandro"], "rafa": ["rafael"]}


def test_unreadable_names_are_their_own_group(spark):
    linked = names.link_spellings(table(spark, [("王 明", 1), ("-", 1), ("Rafael Kholaliz", 1)]), table(spark, [("Rafael Kholaliz", 2)]))
    assert {r.name: r.display for r in linked.collect()} == {"王 明": "王 明", "-": "-", "Rafael Kholaliz": "Rafael Kholaliz"}


@given(letters, letters, letters)
@settings(max_examples=200, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = lambda x, y: names.levenshtein(x, y, 20)
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)
    assert names.levenshtein(a, b, 2) == min(d(a, b), 3)


def test_cells_lose_no_pair(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(names, "CELL_NAMES", 20)  # many pivots
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8)))
    points = [(i, rng.choice(["ann", "bob"]), word()) for i in range(150)] + [(900, "ann", "z" * 60)]
    queries = [(i, rng.choice(["ann", "bob", "eve"]), word()) for i in range(80)] + [(901, "ann", "z" * 59 + "y"), (902, "ann", "z" * 1000)]
    schema = "pid bigint, given string, surname string"
    p, q = spark.createDataFrame(points, schema), spark.createDataFrame(queries, schema.replace("pid", "qid"))
    got = sorted((r.qid, r.pid, r.edits) for r in names.radius_join(q, p).collect())
    want = sorted((i, j, names.levenshtein(s, t, 9)) for i, g, s in queries for j, h, t in points if g == h and names.levenshtein(s, t, 2) <= 2)
    assert got == want


@pytest.mark.parametrize("part_points", [names.PART_POINTS, 40])
def test_keys_find_all_within_the_radius(spark, monkeypatch, part_points):
    rng = random.Random(7)
    monkeypatch.setattr(names, "PAIRS_AT_ONCE", 100)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
    points = [(i, rng.choice(["ann", "bob"]), word()) for i in range(150)] + [(900, "ann", "z" * 60), (903, "ann", "z" * 39), (904, "ann", "z" * 41)]
    queries = [(i, rng.choice(["ann", "bob", "eve"]), word()) for i in range(80)] + [(901, "ann", "z" * 59 + "y"), (902, "ann", "z" * 1000), (905, "ann", "z" * 40)]
    schema = "pid bigint, given string, surname string"
    p, q = spark.createDataFrame(points, schema), spark.createDataFrame(queries, schema.replace("pid", "qid"))
    got = sorted((r.qid, r.pid, r.edits) for r in names.key_join(q, p, part_points=part_points).collect())
    assert got == sorted((i, j, names.levenshtein(s, t, 9)) for i, g, s in queries for j, h, t in points if g == h and names.levenshtein(s, t, 2) <= 2)
    assert names.key_join(q, p.limit(0)).count() == names.key_join(q.limit(0), p).count() == 0


def test_possible_people_without_pivots(spark, monkeypatch):
    """Distances to pivots, whose number grows with the persons, made the work for names grow as their square."""

    def pivots(*_):
        raise AssertionError("pivots")

    monkeypatch.setattr(names, "choose_pivots", pivots)
    people = table(spark, [("Rafael Kholaliz", 5), ("Rafael Kholariz", 5), ("Rebecca Gurtuagril", 5)])
    near = names.possible_people(table(spark, [("Rafael Kholaliz", 1), ("Rafael Kholalis", 1), ("Hammer Gurtuagril", 1), ("Nobody Knownhere", 1)]), people)
    key = {r.display: r.entity for r in names.registry_entities(people).collect()}
    got = {(r.name, r.entity) for r in near.collect()}
    assert got == {("Rafael Kholaliz", key["Rafael Kholaliz"]), ("Rafael Kholalis", key["Rafael Kholaliz"]), ("Hammer Gurtuagril", key["Rebecca Gurtuagril"])}


GIVEN = ["francisco", "francisca", "rafael", "rebecca", "jose", "gabriel", "gabriela", "matheus", "michael", "leandro"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Kholaliz, Rafael", ("rafael", "kholaliz")), ("KHOLALIZ Rafael", ("rafael", "kholaliz")), ("R. Kholaliz", ("rafael", "kholaliz")), ("R.Kholaliz", ("rafael", "kholaliz")), ("Kholaliz R.", ("rafael", "kholaliz")), ("Mr Rafael Kholaliz", ("rafael", "kholaliz")), ('Rafael "Iron Otter" Kholaliz', ("rafael", "kholaliz")), ("Rafael Kholaliz aka Iron Otter", ("rafael", "kholaliz")), ("RafaelKholaliz", ("rafael", "kholaliz")), ("Rafael-Kholaliz", ("rafael", "kholaliz")), ("Rafael Khola liz", ("rafael", "kholaliz")), ("Rafael E. Kholaliz", ("rafael", "kholaliz")), ("kholaliz rafael", ("rafael", "kholaliz")), ("Becky Kholaliz", ("rebecca", "kholaliz")), ("Rfaael Kholaliz *", ("rafael", "kholaliz")), ("Pepe Kholaliz (c)", ("jose", "kholaliz")), ("Hammer Kholaliz", ("", "kholaliz"))],
)
def test_readings(text, want):
    assert want in {(g, s) for g, s, _ in names.Reader(GIVEN).readings(text)}


@pytest.mark.parametrize("text", [None, "", "  ", "-", "()", "...", "x"])
def test_no_reading(text):
    assert [s for _, s, _ in names.Reader(GIVEN).readings(text) if len(s) > 1] == []


def table(spark, values):
    return spark.createDataFrame([(v, n) for v, n in values], "name string, n bigint")


def test_linking(spark):
    people = [("Rafael Kholaliz", 50), ("RAFAEL KHOLALIZ", 3), ("Francisco Roultavaff", 9), ("Rebecca Gurtuagril", 5), ("Michael Gurtuagril", 5), ("Leandro Roldenzalt", 9), ("Leandro Roldenzala", 9), ("Rafael Miangellar", 2), ("Rebecca Brerosirt", 2), ("Michael Bondordun", 2), ("Leandro Tombiedl", 2), ("Francisco Bivrupir", 2)]
    typed = ["Rafael Kholaliz", "rafael kholliz", "Kholaliz, R.", "F. Roultavaff", "Mike Gurtuagril", "Becky Gurtuagril", "Leandro Roldenzalt", "Leandro Roldenzala", "Leandr0 Roldenzala", "Nobody Knownhere", "Otter Kholaliz", "x" * 3000, "Rebecca Unlistedname", "Unlistedname R.", "Rebecca Unlistedmane"]
    linked = names.link_spellings(table(spark, [(t, 1) for t in typed]), table(spark, people))
    got = {r.name: r.display for r in linked.collect()}
    assert {t for t, d in got.items() if d == "Rafael Kholaliz"} == {"Rafael Kholaliz", "rafael kholliz", "Kholaliz, R.", "Otter Kholaliz"}
    assert got["Mike Gurtuagril"] == "Michael Gurtuagril" and got["Becky Gurtuagril"] == "Rebecca Gurtuagril"
    assert got["Rebecca Unlistedname"] == got["Unlistedname R."] == got["Rebecca Unlistedmane"]
    assert got["Leandr0 Roldenzala"] == "Leandro Roldenzala" != got["Leandro Roldenzalt"]
    pairs = {(r.name_a, r.name_b) for r in names.spelling_pairs(linked).collect()}
    assert ("Leandr0 Roldenzala", "Leandro Roldenzala") in pairs and all(a < b for a, b in pairs)
    assert names.link_spellings(table(spark, []), table(spark, people)).count() == 0
    assert names.spellings(spark.createDataFrame([(None,), (" ",), ("a",), ("a",)], "x string"), "x").collect() == [("a", 2)]


def test_pair_step_is_optimal():
    rng, rules = np.random.default_rng(1), softlogic.Rules()
    v, name, date, odds = rng.uniform(-0.5, 1.5, 30), rng.uniform(0, 1, 30), rng.uniform(0.5, 1, 30), np.where(rng.random(30) < 0.3, np.nan, rng.uniform(0, 1, 30))
    quote = rng.integers(0, 12, 30)

    def loss(x):
        o, s = np.isfinite(odds), np.nan_to_num(odds, nan=0.5)
        up1, up2 = np.maximum(0, name + date - 1), np.maximum(0, name + s - 1)
        return (rules.prior * x + rules.rho / 2 * (x - v) ** 2 + rules.names_and_date * np.maximum(0, up1 - x) + o * (rules.odds * np.maximum(0, x - s) + rules.names_and_odds * np.maximum(0, up2 - x)) + rules.date * np.maximum(0, x - date)).sum()

    x = softlogic.pair_step(v, quote, name, date, odds, rules)
    sums = np.bincount(quote, x)
    assert x.min() >= 0 and x.max() <= 1 and sums.max() <= 1 + 1e-4
    for _ in range(3000):  # no feasible neighbour is better
        y = np.clip(x + rng.normal(0, 0.05, 30) * (rng.random(30) < 0.2), 0, 1)
        if np.bincount(quote, y).max() <= sums.max() + 1e-9:
            assert loss(y) >= loss(x) - 1e-3


def test_bet_step_is_optimal():
    rng, rules = np.random.default_rng(2), softlogic.Rules()
    v, alike, bet = rng.uniform(0, 1, 20), rng.uniform(0.5, 1, 20), np.repeat([0, 1, 2, 3], 5)
    grid = np.linspace(0, 1, 2001)

    def loss(y):
        total = rules.rho / 2 * ((y - v) ** 2).sum()
        for b in range(4):
            m = grid[:, None]
            total += rules.transitive * np.maximum(0, np.abs(y[bet == b] - m) - (1 - alike[bet == b])).sum(1).min()
        return total

    y = softlogic.bet_step(v, bet, alike, rules)
    for _ in range(500):
        assert loss(np.clip(y + rng.normal(0, 0.05, 20), 0, 1)) >= loss(y) - 1e-3


def test_links(spark):
    people = spark.createDataFrame([(n, e, 0.0) for n, e in (("A", 1), ("B", 2), ("C", 3), ("D", 4), ("a.", 1))], "name string, entity bigint, cost double")
    bet = "bet_id bigint, day int, red string, blue string, side string, odds double"
    quote = "quote_id bigint, day int, first string, second string, odds_1 double, odds_2 double"
    bets = spark.createDataFrame([(1, 100, "A", "B", "red", 2.0), (2, 100, "A", "C", "red", 1.2), (3, 107, "A", "B", "blue", 1.5), (4, None, "C", "D", "red", 2.0), (5, 100, None, "D", "red", 2.0)], bet)
    quotes = spark.createDataFrame([(10, 100, "A", "B", 2.02, 1.8), (11, 101, "B", "a.", 1.8, 1.99), (12, 100, None, "A", 3.0, 1.21), (13, 107, "A", "B", 2.6, 1.51), (14, 100, "B", "C", 2.0, 1.8), (15, 103, None, None, 2.0, 1.8), (16, 100, "A", "B", None, float("nan")), (17, None, "A", "B", 2.0, 1.8)], quote)
    got = {r.quote_id: r for r in softlogic.link(bets, quotes, people).collect()}
    assert {q: r.bet_id for q, r in got.items()} == {10: 1, 11: 1, 12: 2, 13: 3, 16: 1}
    assert all(0.5 <= r.confidence <= 1 for r in got.values())
    assert softlogic.link(bets.limit(0), quotes, people).count() == 0 and softlogic.link(bets, quotes.limit(0), people).count() == 0


def test_odds_formats(spark):
    df = spark.createDataFrame([(1.5,), (150.0,), (-200.0,), (0.0,), (float("nan"),), (None,), (-5.0,)], "o double")
    assert [r[0] for r in df.select(softlogic.decimal_odds(df.o)).collect()] == [1.5, 2.5, 1.5, None, None, None, None]


def test_solver_ends_converged_or_says_so(spark):
    rows = [(b, q, 0.9, 0.5 + 0.1 * b, 0.3 * q, 0.5, 0.1) for b in (1, 2, 3) for q in (1, 2, 3)]
    pairs = spark.createDataFrame(rows, "bet_id bigint, quote_id bigint, s_name double, s_date double, s_odds double, alike double, apart double")
    rules = softlogic.Rules(close=1e-4)
    at_once = {(r.bet_id, r.quote_id): r for r in softlogic.solve(pairs, rules).collect()}
    in_rounds = {(r.bet_id, r.quote_id): r for r in softlogic.solve(pairs, rules, whole=1).collect()}
    assert set(at_once) == set(in_rounds) and len(at_once) == 9
    for k, r in at_once.items():
        assert max(r.primal, r.dual) < rules.close and r.y == pytest.approx(in_rounds[k].y, abs=2e-3)
    with pytest.raises(RuntimeError, match="not converged"):
        softlogic.solve(pairs, softlogic.Rules(rounds=6, close=0.0), whole=1).collect()
    p = pairs.withColumn("label", softlogic.F.lit(1)).toPandas()
    with pytest.raises(RuntimeError, match="not converged"):
        softlogic.solve_sets(p, softlogic.Rules(rounds=6, close=0.0))


def test_connected_bets(spark):
    chain = [(b, q) for q in range(40) for b in (q, q + 1)] + [(100, 200), (101, 200), (102, 201), (7, 300), (100, 301)]
    pairs = spark.createDataFrame(chain, "bet_id bigint, quote_id bigint")
    got = {r.bet_id: r.label for r in softlogic.connected_bets(pairs).collect()}
    assert got == {**{b: 0 for b in range(41)}, 100: 100, 101: 100}
    assert softlogic.connected_bets(pairs.limit(0)).count() == 0


def test_links_by_one_name(spark):
    people = spark.createDataFrame([(n, e, 0.0) for n, e in (("A", 1), ("B", 2), ("C", 3))], "name string, entity bigint, cost double")
    bets = spark.createDataFrame([(1, 100, "?", "B", "red", 2.0), (2, 100, "A", "C", "blue", None), (3, 200, None, None, "red", 2.0)], "bet_id bigint, day int, red string, blue string, side string, odds double")
    quotes = spark.createDataFrame([(10, 100, "B", "C", 1.8, 2.02), (11, 100, "A", None, None, 3.0), (12, 101, "C", "", 1.5, 2.9), (13, 100, None, "B", 9.0, 1.8), (14, 111, "A", "C", 2.0, 2.0)], "quote_id bigint, day int, first string, second string, odds_1 double, odds_2 double")
    got = {r.quote_id: r.bet_id for r in softlogic.link(bets, quotes, people).collect()}
    assert got == {10: 1, 11: 2, 12: 2}
