"""The queries of this subpackage that SQL can state, against DuckDB."""

import duckdb
import pytest

from scripts.check_oracle import TABLES, digest
from shotspark.llm import registry
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(registry.oracle()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(registry.oracle()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, cur.fetchall())[0]


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{n}" for n in range(1, 14)]
