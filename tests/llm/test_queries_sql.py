"""Registered queries of this package against their SQL."""

import duckdb
import pytest

from spanloom.llm import queries, sql
from tests.conftest import SF


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    rel = con.execute(sql.oracle_sql()[name])
    have = [c[0] for c in rel.description]
    assert sorted(have) == sorted(df.columns)
    want = sorted(repr([plain(r[have.index(c)]) for c in sorted(have)]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(have)]) for r in df.collect()) == want
