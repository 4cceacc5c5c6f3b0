"""Every registered query with an oracle gives the oracle's rows at the smallest scale."""

import duckdb
import pytest

from beaconry.plans.catalog import ENTRIES
from tools.check_oracle import TABLES, rows_of


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.oracle])
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'").fetchall()
    res = con.execute(ENTRIES[name].oracle)
    cols = [d[0] for d in res.description]
    df = ENTRIES[name].run(spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.oracle])
def test_query_without_oracle_runs(spark, sf, name):
    assert ENTRIES[name].run(spark, sf).count() > 0
