"""Every query of the engine's own registry against its SQL in DuckDB."""

import duckdb
import pytest

from loomgraph.plans import registry
from loomgraph.sources.corpus import NAMES


def rows(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in NAMES:
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    told = con.execute(registry.oracle_sql()[name])
    named = [d[0] for d in told.description]
    assert sorted(named) == columns
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(tuple(r[named.index(c)] for c in columns) for r in told.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
