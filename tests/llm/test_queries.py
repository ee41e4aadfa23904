"""The registered queries of the package on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from duelframe.llm import queries

SCHEMAS = {
    "p2_found": [("fighter_name", "string")],
    "p4_found": [("name_a", "string"), ("name_b", "string")],
    "p6_found": [("bet_id", "bigint"), ("quote_id", "bigint")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_shared": [("doc_id", "bigint"), ("n_chars", "bigint"), ("shared_chars", "bigint"), ("shared_share", "double"), ("n_texts", "bigint"), ("n_copies", "bigint")],
    "p9_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns_and_rows(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    assert df.dtypes == SCHEMAS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "eval_items"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(tiny) / t}.parquet'")
        assert sorted(rows) == sorted(tuple(map(str, r)) for r in con.sql(queries.ORACLES[name]).fetchall())
