import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, table

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    without = {name for name in set(QUERIES) - set(ORACLES) if name[:2] != "op" and name != "pipeline"}
    assert without == {"cluster_kmeans", "build_index"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:2] != "op" and n != "pipeline"))
def test_query(spark, base, name):
    result = QUERIES[name](spark, SF)
    got = table(result.columns, [tuple(r) for r in result.collect()])
    if name in ORACLES:
        answer = base.execute(ORACLES[name])
        assert got == table([d[0] for d in answer.description], answer.fetchall())
    assert got[1] or name.startswith("network_edges")


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["entity_mention", "absolute_count", "frequency_pct", "frequency_label"]
    assert rows.count() > 0
