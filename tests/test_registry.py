"""Every query of the engine's registry against DuckDB on the smallest tables."""

import os

import pytest

from tessera import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, connection, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in queries.ORACLES:
        assert got
        return
    want = connection.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    order = [df.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[i] for i in order) for r in got))) == sorted(map(str, want.fetchall()))


def exchanged(plan):
    """Bytes that went through a plan's exchanges."""
    children, size = plan.children(), plan.metrics().get("dataSize")
    return (size.get().value() if size.isDefined() else 0) + sum(exchanged(children.apply(i)) for i in range(children.size()))


def test_sketches_are_not_kept_for_each_value(spark, tmp_path):
    sizes, rows = {}, {}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (0, 100, 1100):
            table = spark.range(n, numPartitions=1).selectExpr("nullif(id, 7) as o_custkey", "array('F', 'O', null)[id % 3] as o_orderstatus")
            table.write.parquet(f"{tmp_path}/{n}/orders.parquet")
            df = queries.QUERIES["stats_ndv_hll"](spark, f"{tmp_path}/{n}")
            rows[n] = [tuple(r) for r in df.collect()]
            sizes[n] = exchanged(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert set(map(tuple, rows.values())) == {((True, True),)}
    assert 0 < sizes[1100] - sizes[100] < 1000 * 200, sizes


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 26
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
