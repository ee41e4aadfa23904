"""Every registered query that has SQL must equal DuckDB's answer on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from duelframe.plans import contest_queries, model_queries, prep_queries

NAMES = [n for m in (contest_queries, model_queries, prep_queries) for n in m.ORACLES]


def _rows(frame):
    def cell(x):
        if x is None or str(x) in ("NaT", "nan", "<NA>"):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, bool):
            return str(x)
        return f"{x:.5g}" if isinstance(x, float) and not math.isnan(x) and x != int(x) else str(int(x)) if isinstance(x, int | float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(cell(v)) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tiny, duck, name):
    ours = entry.queries()[name](spark, tiny).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry is not None
