"""The operators that SQL can express, against their SQL; and how all of them take empty tables and odd columns."""

import duckdb
import pytest
from termloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({registry.oracle_sql()[name]}) t").fetchall()
    rounded = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert rounded(got.select(names).collect()) == rounded(want)


def test_names():
    assert [f"op{n}_" for n in range(1, 11)] == [f"{x.split('_')[0]}_" for x in sorted(registry.queries(), key=lambda x: int(x.split("_")[0][2:]))]
