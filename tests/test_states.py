"""States made together equal those made one by one, and are made in few passes."""

import os
from functools import reduce

import pytest
from pyspark.sql import functions as F

from duelframe.operators import history as H
from duelframe.plans import contest_queries as Q
from duelframe.plans import model_queries
from duelframe.runtime import _checkpoint_dir


def same(a, b, columns):
    """Both tables have the same values of the columns, a null only where the other has one."""
    wrong = [(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 1e-9 * (1 + F.abs(F.col(f"a.{c}")))) | (F.isnull(f"a.{c}") != F.isnull(f"b.{c}")) for c in columns]
    joined = a.alias("a").join(b.alias("b"), ["bout_id", "side"])
    return joined.count() == a.count() == b.count() > 0 and joined.where(reduce(lambda x, y: x | y, wrong)).count() == 0


def test_states_by_day(spark, tiny):
    long = Q.P.to_long(Q.struck(spark, tiny)).cache()
    together = long.select("bout_id", "side", *H.KEYS).join(H.states_by_day(long), H.KEYS)
    steps = (H.career_totals, H.endurance, H.layoffs, H.career_span, H.streaks, H.last_n, H.decayed)
    for step in steps:
        alone = step(long)
        assert same(together, alone, [c for c in alone.columns if c not in long.columns])


def test_forms_by_day(spark, tiny):
    long = Q.long(spark, tiny).cache()
    together = long.select("bout_id", "side", *H.KEYS).join(H.forms_by_day(long, (1, 3), (180.0, 730.0)), H.KEYS)
    for v in (1, 3):
        assert same(together, H.last_n(long, v), [f"recent_{v}_{m}" for m in H.FORM])
    for i, v in enumerate((180.0, 730.0)):
        assert same(together, H.decayed(long, v, f"exp_decay_{i}_"), [f"exp_decay_{i}_{m}" for m in H.FORM])


def test_recency_checks_read_the_contests_twice(spark, tiny):
    plan = Q.QUERIES["recency_checks"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_feature_table_keeps_little(spark, tiny):
    def held():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(_checkpoint_dir(spark).removeprefix("file:")) for f in files)

    before = held()
    rows = model_queries.feature_table(spark, tiny)
    bouts = rows.select("bout_id").count()
    assert len(rows.columns) > 500 and bouts > 0 and held() - before < 3000 * bouts
