import duckdb
import pytest

from skarn.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_main_text", "op12_importance", "op13_variants"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = c.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    kinds = {"BIGINT": "bigint", "VARCHAR": "string"}
    assert dict(got.dtypes) == {k: kinds[str(t)] for k, t in zip(want.columns, want.types, strict=True)}
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))
