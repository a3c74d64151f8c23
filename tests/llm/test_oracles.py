import duckdb
import pytest

from tesserae.llm import registry
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    res = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert rows_of(df.collect(), [df.columns.index(c) for c in order]) == rows_of(res.fetchall(), [names.index(c) for c in order])
