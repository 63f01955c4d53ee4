"""Registered queries of this subpackage against their DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from loomline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = db.execute(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.column_names)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns]) for r in rows)
    assert plain(r.asDict() for r in got.collect()) == plain(want.to_pylist())
