"""General record preparation: edge cases with defined results."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.operators import entity_features as ef
from duelframe.operators import hot_deck, units

CONTEST = "bout_id bigint, event_date date, red_fighter_id bigint, blue_fighter_id bigint, bout_type string, red_fighter_height double, blue_fighter_height double, red_fighter_reach double, blue_fighter_reach double, red_fighter_dob date, blue_fighter_dob date"
DAY = dt.date(2020, 1, 1)
BORN = dt.date(1990, 5, 6)


def contest(i, red, blue, height=None, day=0, other=70.0, reach=72.0, dob=BORN, kind="Lightweight Bout"):
    return (i, DAY + dt.timedelta(days=day), red, blue, kind, height, other, reach, 71.0, dob, BORN)


def filled(spark, rows, **kw):
    return {r.bout_id: r for r in hot_deck.fill_contests(spark.createDataFrame(rows, CONTEST), **kw).collect()}


def test_hot_deck_takes_the_modal_value_from_the_nearest_donor(spark):
    rows = [contest(1, 1, 9, 70.0, 0), contest(2, 1, 9, 70.0, 100), contest(3, 1, 9, 75.0, 119), contest(4, 1, 9, None, 120), contest(5, 1, 9, float("nan"), 90)]
    near = filled(spark, rows)[4]
    assert (near.red_fighter_height, near.red_fighter_height_donor, near.red_fighter_height_distance) == (75, 3, 1)
    got = filled(spark, [*rows, rows[3]], modal=True)
    assert len(got) == 5
    assert (got[4].red_fighter_height, got[4].red_fighter_height_mark, got[4].red_fighter_height_donor, got[4].red_fighter_height_distance) == (70, "same fighter", 2, 20)
    assert got[5].red_fighter_height_donor == 2 and got[5].red_fighter_height_distance == 10
    assert got[3].red_fighter_height == 75 and got[3].red_fighter_height_mark is None


def test_hot_deck_uses_the_other_side_then_similar_contests(spark):
    rows = [contest(1, 1, 2, 66.0, 0, other=64.0), contest(2, 2, 1, None, 400), contest(3, 7, 8, None, 5, other=None), contest(4, 5, 6, None, 0, other=None, kind="Heavyweight Bout")]
    got = filled(spark, rows)
    assert (got[2].red_fighter_height, got[2].red_fighter_height_mark) == (64, "same fighter")
    assert got[3].red_fighter_height_mark == "similar contests" and got[3].red_fighter_height_donor in (1, 2)
    assert got[4].red_fighter_height is None and got[4].red_fighter_height_mark == "none"


def test_hot_deck_range_and_age_rules(spark):
    rows = [contest(1, 1, 2, 47.0, 0, other=999.0, dob=dt.date(1900, 1, 1)), contest(2, 1, 2, 71.0, 5, dob=dt.date(2010, 1, 1)), contest(3, 1, 2, 71.0, 6)]
    got = filled(spark, rows)
    assert got[1].red_fighter_height == 71 and got[1].red_fighter_dob == 19900506 and got[2].red_fighter_dob == 19900506


def test_hot_deck_null_keys_ties_empty(spark):
    assert filled(spark, []) == {}
    rows = [contest(1, None, None, None, 0), contest(2, 3, None, 70.0, 0), contest(3, 3, None, 68.0, 1), contest(4, 3, None, None, 2)]
    got = filled(spark, rows, modal=True)
    assert got[4].red_fighter_height == 68  # the smaller of equally frequent values
    assert got[1].red_fighter_height_mark == "similar contests"


def test_hot_deck_ignores_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [contest(i, int(rng.integers(1, 4)), int(rng.integers(4, 7)), [None, 70.0, 71.0][rng.integers(0, 3)], int(rng.integers(0, 300))) for i in range(120)]
    strip = lambda g: {k: (v.red_fighter_height, v.red_fighter_height_mark, v.red_fighter_height_distance) for k, v in g.items()}
    for modal in (False, True):
        assert strip(filled(spark, rows, block_rows=7, modal=modal)) == strip(filled(spark, rows, block_rows=10_000, modal=modal))


@pytest.mark.parametrize(
    ("text", "inches"),
    [("5' 11\"", 71), ("5’ 10”", 70), ("5′10″", 70), ("5ft10", 70), ("5 ft 10 in", 70), ("62 in", 62), ("62.0''", 62), ("1,68 metres", 66), ("1m93", 76), ("1930 mm", 76), ("about 5 foot 10", 70), ("1.60m (5'3\")", 63), ("6-5", 77), ("~78 in.", 78), ("175cm wingspan", 69), ("1.70 m tip to tip", 67), ("6 ft", 72)],
)
def test_lengths(text, inches):
    value, si = units.parse_quantity(text, units.LENGTH)
    assert si and round(value / 0.0254) == inches


@pytest.mark.parametrize(("text", "pounds"), [("251 pounds", 251), ("66,2 kg", 146), ("13st 6", 188), ("11 st 0 lb", 154), ("10 stone 2", 142), ("252#", 252), ("KG 60.8", 134), ("147 lb (66.7 kg)", 147), ("114305 g", 252)])
def test_weights(text, pounds):
    value, si = units.parse_quantity(text, units.MASS)
    assert si and round(value / 0.45359237) == pounds


@pytest.mark.parametrize("text", [None, "", "  ", "--", "---", "N/A", "unknown", "tbd", "no idea", "(("])
def test_no_measure(text):
    assert units.parse_quantity(text, units.LENGTH) is None


def test_units_have_dimensions_and_offsets():
    force = units.UNITS["kg"] * units.UNITS["m"] * units.UNITS["s"] ** -2
    assert force.exponents == (1, 1, -2, 0) and force.scale == 1.0
    assert units.UNITS["F"].convert(212.0, units.UNITS["C"]) == pytest.approx(100.0)
    with pytest.raises(ValueError):
        units.UNITS["kg"].convert(1, units.UNITS["m"])


@pytest.mark.parametrize(
    ("text", "to", "value"),
    [("36 km/h", "m/s", 10.0), ("60 miles per hour", "mi / h", 60.0), ("2 kg·m/s²", "kg m / s^2", 2.0), ("1 ft^2", "in squared", 144.0), ("5 lb per square", "kg", None), ("3 kg", "m", None), ("-40 °F", "°C", -40.0), ("12", "m", None), (None, "m", None), ("2 m**3", "cm³", 2e6), ("9 °C/h", "kelvin per hour", 9.0)],
)
def test_products_of_units(text, to, value):
    assert units.parse_measurement(text, to) == (None if value is None else pytest.approx(value))


def test_notes_state_units():
    assert units.stated_unit("camp sheet, centimetres / kilograms", units.LENGTH) == "cm"
    assert units.stated_unit("tale of the tape in in/lb", units.LENGTH) == "in"
    assert units.stated_unit("checked at the weigh-in", units.LENGTH) is None
    assert units.stated_unit("sizes taken in cm and kilos", units.LENGTH) == "cm"
    assert units.stated_unit(None, units.MASS) is None


def test_bare_numbers_need_the_row():
    tall, small = units.resolve_row({"height": "195.6", "weight": "112.0", "reach": None}, None), units.resolve_row({"height": "62", "weight": "112.0", "reach": ""}, None)
    assert round(tall["weight"]) == 247 and round(small["weight"]) == 112
    assert round(units.resolve_row({"height": None, "weight": "112", "reach": None}, "cm, kg")["weight"]) == 247
    assert round(units.resolve_row({"height": None, "weight": "111.6", "reach": None}, None)["weight"]) == 246


def test_canonical_measures_table(spark):
    rows = [(1, "183 cm", "13st 6", None, None, 5), (2, None, None, "", "", 6), (3, "x" * 100_000 + " 70 in", "tbd", "70", None, 7)]
    df = spark.createDataFrame(rows, "profile_id int, height string, weight string, reach string, notes string, height_in int")
    got = {r.profile_id: r for r in units.canonical_measures(df).collect()}
    assert round(got[1].height_in) == 72 and round(got[1].weight_lb) == 188 and got[1].reach_in is None
    assert got[2].height_in is None and round(got[3].height_in) == 70 and round(got[3].reach_in) == 70
    assert units.canonical_measures(df.limit(0)).count() == 0
    assert units.long_measures(units.canonical_measures(df), "profile_id").count() == 4


@given(st.integers(48, 95), st.sampled_from(["{f}' {i}\"", "{f}ft{i}", "{n} in", "{cm:.1f} cm", "{cm:.0f}cm", "{m:.2f} m", "{n}\""]))
@settings(max_examples=60, deadline=None)
def test_written_heights_read_back(n, form):
    text = form.format(f=n // 12, i=n % 12, n=n, cm=n * 2.54, m=n * 0.0254)
    value, _ = units.parse_quantity(text, units.LENGTH)
    assert abs(value / 0.0254 - n) < 0.3


STATS = "record_id bigint, bout_id bigint, fighter_id bigint, event_date date, stat_type string, fighter_sig_str_landed int, fighter_sig_str_attempted int, diff_win_streak int, loaded_at timestamp, __m0 string"


def stat(r, f, kind, landed, day=0, at=0):
    return (r, 1, f, DAY + dt.timedelta(days=day), kind, landed, None if landed is None else 2 * landed, -1, dt.datetime(2021, 1, 1) + dt.timedelta(seconds=at), "extra")


def features(spark, rows, **kw):
    df = spark.createDataFrame(rows, STATS)
    long = ef.long_rows(ef.entity_features(df, **kw), "fighter_id", ("fighter_sig_str_landed", "fighter_sig_str_attempted", "diff_win_streak"))
    return {(r[0], r[1]): tuple(r[2:]) for r in long.collect()}


def test_features_versions_nulls_and_types(spark):
    rows = [stat(1, 10, "Head/clinch R1: jab", 3), stat(1, 10, "Head/clinch R1: jab", 5, at=9), stat(2, 10, "head_clinch_r1_jab_", None, day=4), stat(3, 10, None, 7), stat(4, 10, " -- ", 7), stat(5, 11, "x", 1), stat(5, 11, None, 1, at=5), stat(6, None, "x", 1)]
    got = features(spark, [*rows, rows[0], rows[1]])
    assert got == {(10, "head_clinch_r1_jab"): (2, 5, 10, -2, 20200105)}


def test_features_empty_and_null_dates(spark):
    assert features(spark, []) == {}
    row = list(stat(1, 10, "x", 1))
    row[3] = None
    assert features(spark, [tuple(row)]) == {(10, "x"): (1, 1, 2, -1, None)}


@pytest.mark.parametrize("settings_", [{}, {"bucket_rows": 50}, {"cells": 3}])
def test_features_equal_brute_force(spark, monkeypatch, settings_):
    monkeypatch.setattr(ef, "BLOCK_CELLS", settings_.get("cells", ef.BLOCK_CELLS))
    settings_ = {k: v for k, v in settings_.items() if k != "cells"}
    rng = np.random.default_rng(1)
    rows = [stat(i, 1 if rng.random() < 0.4 else int(rng.integers(2, 30)), f"t{rng.integers(0, 7)}", int(rng.integers(0, 9)), int(rng.integers(0, 99))) for i in range(600)]
    p = pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])
    p["day"] = p.event_date.map(lambda d: d.year * 10000 + d.month * 100 + d.day)
    want = p.groupby(["fighter_id", "stat_type"]).agg(n=("record_id", "size"), a=("fighter_sig_str_landed", "sum"), b=("fighter_sig_str_attempted", "sum"), c=("diff_win_streak", "sum"), d=("day", "max"))
    assert features(spark, rows, **settings_) == {k: tuple(int(x) for x in v) for k, v in zip(want.index, want.to_numpy())}


def test_features_of_many_hot_entities(spark):
    rows = [stat(i * 40 + j, i, "t", 1) for i in range(30) for j in range(40)]
    assert features(spark, rows, bucket_rows=39) == {(f, "t"): (40, 40, 80, -40, 20200101) for f in range(30)}


def test_wide_features(spark):
    df = ef.entity_features(spark.createDataFrame([stat(1, 10, "a", 3), stat(2, 11, "b", 4)], STATS))
    got = {r.fighter_id: r for r in ef.wide_features(df, "fighter_id", ["a", "b"], "n_records").collect()}
    assert (got[10].n_records__a, got[10].n_records__b, got[11].n_records__b) == (1, 0, 1)
