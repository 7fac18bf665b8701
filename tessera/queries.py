"""The registry of the engine's own queries, each with the SQL it must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions.statistics import distinct_counts
from .operators.hash_join import hash_join, partition
from .operators.ordered_map import OrderedMap
from .operators.row_ids import RID, at_rid, with_rids
from .plans import cost
from .plans.parser import parse_predicate
from .session import Engine
from .sources.log import Log, Record

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = 'select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = "ASIA"'

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _select(name: str, text: str, tables: str, oracle: str, views: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark).register_folder(folder, *tables.split())
        for view, query in (views or {}).items():
            engine.execute(f"create view {view} as {query}")
        return engine.sql(text)

    QUERIES[name], ORACLES[name] = run, oracle


def _change(name: str, table: str, oracle: str, *statements: str) -> None:
    """Statements on the engine's own version of a table, then its rows."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark).register_folder(folder, table)
        for s in statements:
            getattr(engine, s)() if s in ("begin_work", "commit", "rollback") else engine.execute(s)
        return engine.table(table)

    QUERIES[name], ORACLES[name] = run, oracle


def _query(name: str, oracle: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


_select("scan_region", "select r_regionkey, r_name from region", "region", "SELECT r_regionkey, r_name FROM region")
_select("project_reorder", "select n_name, n_nationkey from nation", "nation", "SELECT n_name, n_nationkey FROM nation")
_select("project_bag", "select o_orderstatus from orders", "orders", "SELECT o_orderstatus FROM orders")
_select("filter_int", "select l_orderkey, l_linenumber from lineitem where l_linenumber = 1", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1")
_select("filter_string", 'select c_custkey from customer where c_mktsegment = "BUILDING"', "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_select("filter_conjunction", 'select l_orderkey from lineitem where l_returnflag = "R" and l_linestatus = "F"', "lineitem", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
_select("filter_ampamp", 'select l_orderkey from lineitem where l_returnflag = "R" && l_linestatus = "F"', "lineitem", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
_select("filter_field_field", "select l_orderkey, l_linenumber from lineitem where l_partkey = l_suppkey", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
_select("filter_const_left", "select n_name from nation where 1 = n_regionkey", "nation", "SELECT n_name FROM nation WHERE 1 = n_regionkey")
_select("filter_mixed_class", "select r_name from region where r_name = 1", "region", "SELECT r_name FROM region WHERE false")
_select("filter_const_true", "select r_name from region where 1 = 1", "region", "SELECT r_name FROM region WHERE 1 = 1")
_select("filter_const_false", "select r_name from region where 1 = 2", "region", "SELECT r_name FROM region WHERE 1 = 2")
_select("product_two", "select r_name, n_name from region, nation", "region nation", "SELECT r_name, n_name FROM region, nation")
_select("product_three", "select r_name, n_name, s_name from region, nation, supplier", "region nation supplier", "SELECT r_name, n_name, s_name FROM region, nation, supplier")
_select("product_self", "select r_name from region, region", "region", "SELECT a.r_name FROM region a, region b")
_select("product_empty_outer", "select n_name from e, nation", "region nation", "SELECT n_name FROM (SELECT r_name FROM region WHERE r_name = 'NONE') e, nation", {"e": 'select r_name from region where r_name = "NONE"'})
_select("join_equi", "select c_name, n_name from customer, nation where c_nationkey = n_nationkey", "customer nation", "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
_select("join_three_way", FLAGSHIP, "customer nation region", "SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'")
_select("join_plus_filter", 'select l_orderkey, l_linenumber from lineitem, orders where l_orderkey = o_orderkey and o_orderstatus = "F"', "lineitem orders", "SELECT l_orderkey, l_linenumber FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderstatus = 'F'")

_B = 'select c_custkey, c_name from customer where c_mktsegment = "BUILDING"'
_BSQL = "(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING') b"
_select("view_simple", "select c_name from b", "customer", f"SELECT c_name FROM {_BSQL}", {"b": _B})
_select("view_join_table", "select c_name, o_orderkey from b, orders where c_custkey = o_custkey", "customer orders", f"SELECT c_name, o_orderkey FROM {_BSQL}, orders WHERE c_custkey = o_custkey", {"b": _B})
_select(
    "view_nested", "select o_orderkey from w", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') v WHERE o_custkey = 7) w",
    {"v": 'select o_orderkey, o_custkey, o_orderpriority from orders where o_orderstatus = "F"', "w": "select o_orderkey from v where o_custkey = 7"},
)

_change("insert_values", "region", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(5 AS INTEGER), 'ATLANTIS'", 'insert into region (r_regionkey, r_name) values (5, "ATLANTIS")')
_change("insert_defaults", "region", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(6 AS INTEGER), ''", "insert into region (r_regionkey) values (6)")
_change("update_const", "nation", "SELECT n_nationkey, n_name, CAST(CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation", "update nation set n_regionkey = 9 where n_regionkey = 1")
_change("update_field", "nation", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation", "update nation set n_regionkey = n_nationkey where n_regionkey = 2")
_change("update_all", "nation", "SELECT n_nationkey, 'X' AS n_name, n_regionkey FROM nation", 'update nation set n_name = "X"')
_change("delete_where", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 3)", "delete from nation where n_regionkey = 3")
_change("delete_all", "region", "SELECT r_regionkey, r_name FROM region WHERE false", "delete from region")
_change("tx_rollback", "region", "SELECT r_regionkey, r_name FROM region", "begin_work", "delete from region", "rollback")
_change("tx_commit", "region", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0", "begin_work", "delete from region where r_regionkey = 0", "commit")


@_query("dml_counts", "SELECT 'update' AS op, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', count(*) FROM nation WHERE n_regionkey = 3")
def _dml_counts(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark).register_folder(folder, "nation")
    updated = engine.execute("update nation set n_regionkey = 9 where n_regionkey = 1")
    return spark.createDataFrame([("update", updated), ("delete", engine.execute("delete from nation where n_regionkey = 3"))], "op string, n bigint")


@_query("ddl_create_insert", "SELECT * FROM (VALUES ('htylor', CAST(20 AS BIGINT), CAST(2020 AS BIGINT))) t(name, majorId, gradyear)")
def _ddl(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    for s in (
        "create table student (name varchar(16), majorId int, gradyear int)", 'insert into student (name, majorId, gradyear) values ("htylor", 30, 2020)',
        'insert into student (name, majorId, gradyear) values ("jtom", 35, 2022)', "update student set majorId = 20 where majorId = 30 and gradyear = 2020", "delete from student where majorId = 35",
    ):
        engine.execute(s)
    return engine.sql("select name, majorId, gradyear from student")


@_query("index_lookup", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def _index_lookup(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark).register_folder(folder, "orders")
    engine.execute("create index cust on orders (o_custkey)")
    return engine.lookup("cust", 7).select("o_orderkey")


@_query("hash_join", "SELECT c_custkey AS key, concat(c_name, o_orderstatus) AS data FROM customer JOIN orders ON c_custkey = o_custkey")
def _hash_join(spark: SparkSession, folder: str) -> DataFrame:
    return hash_join(_table(spark, folder, "customer"), _table(spark, folder, "orders"), "c_custkey", "c_name", "o_custkey", "o_orderstatus")


def _orders(spark: SparkSession, folder: str) -> OrderedMap:
    return OrderedMap(_table(spark, folder, "orders"), "o_orderkey", "o_custkey")


_KV = "SELECT o_orderkey AS key, o_custkey AS value FROM orders"
_query("omap_get", f"{_KV} WHERE o_orderkey = 965")(lambda s, d: _orders(s, d).get(965))
_query("omap_scan", f"{_KV} WHERE o_orderkey BETWEEN 100 AND 199")(lambda s, d: _orders(s, d).scan(100, 199))
_query("omap_set", f"{_KV} WHERE o_orderkey NOT IN (965, -5) UNION ALL SELECT CAST(965 AS BIGINT), CAST(-1 AS BIGINT) UNION ALL SELECT CAST(-5 AS BIGINT), CAST(42 AS BIGINT)")(lambda s, d: _orders(s, d).set(965, -1).set(-5, 42).entries())
_query("omap_remove", f"{_KV} WHERE o_orderkey <> 965")(lambda s, d: _orders(s, d).remove(965).entries())


@_query("catalog_tblcat", "SELECT * FROM (VALUES ('tblcat', CAST(40 AS BIGINT)), ('fldcat', 80), ('viewcat', 140), ('idxcat', 80), ('t', 33)) c(tblname, slotsize)")
def _tblcat(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute("create table t (a int, b varchar(9))")
    return engine.sql("select tblname, slotsize from tblcat")


@_query("catalog_fldcat", "SELECT * FROM (VALUES ('a', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(8 AS BIGINT)), ('b', 1, 9, 16), ('c', 0, 0, 33)) f(fldname, type, length, \"offset\")")
def _fldcat(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute("create table t (a int, b varchar(9), c int)")
    return engine.sql('select fldname, type, length, offset from fldcat where tblname = "t"')


@_query("catalog_views_indexes", "SELECT 'v' AS viewname, 'SELECT n_name FROM nation WHERE n_regionkey=1' AS viewdef, 'i' AS \"indexName\", 'nation' AS \"tableName\", 'n_name' AS \"fieldName\"")
def _viewcat(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark).register_folder(folder, "nation")
    engine.execute("create view v as select n_name from nation where n_regionkey = 1")
    engine.execute("create index i on nation (n_name)")
    return engine.sql("select viewname, viewdef, indexName, tableName, fieldName from viewcat, idxcat")


@_query("log_reverse", "SELECT CAST(71 - i AS BIGINT) AS lsn, concat('record', 71 - i) AS value FROM range(1, 71) t(i)")
def _log_reverse(spark: SparkSession, folder: str) -> DataFrame:
    log = Log()
    for i in range(1, 71):
        log.append(Record("SETSTRING", 1, "f", 1, 1, f"record{i}"))
    return log.newest_first(spark).select("lsn", "value")


@_query("log_unfinished", "SELECT CAST(2 AS BIGINT) AS txnum")
def _log_unfinished(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    engine.begin().commit()
    engine.begin()
    engine.begin().rollback()
    return engine.log.unfinished(spark)


@_query("stats_records", "SELECT 'nation' AS tblname, count(*) AS records FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def _records(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda t: _table(spark, folder, t).agg(F.count(F.lit(1)).alias("records")).select(F.lit(t).alias("tblname"), "records")
    return one("nation").unionByName(one("orders"))


@_query("stats_ndv_exact", "SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus FROM orders")
def _ndv(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_counts(_table(spark, folder, "orders").select("o_custkey", "o_orderstatus"), exact=True)


@_query("stats_ndv_hll", "SELECT true AS o_custkey, true AS o_orderstatus")
def _hll(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketch is within 3 % of the exact count; its standard error is statistics.RSD."""
    orders = _table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    # Two aggregates: one of both would group by the values that are counted exactly, and give each group sketches of its own.
    both = distinct_counts(orders).alias("sketch").crossJoin(distinct_counts(orders, exact=True).alias("exact"))
    near = lambda c: F.abs(F.col(f"sketch.{c}") - F.col(f"exact.{c}")) <= 0.03 * F.col(f"exact.{c}")
    return both.select(*[near(c).alias(c) for c in orders.columns])


@_query("stats_blocks", "SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS blocks FROM lineitem")
def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("fk", _table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")))
    return spark.createDataFrame([(engine.stats("fk").blocks,)], "blocks bigint")


@_query("reduction_factor", "SELECT count(DISTINCT o_custkey) * count(DISTINCT o_orderstatus) AS factor FROM orders")
def _factor(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark).register_folder(folder, "orders")
    factor = cost.reduction_factor(parse_predicate('o_custkey = 7 and o_orderstatus = "F"'), engine.stats("orders", exact=True).distinct)
    return spark.createDataFrame([(factor,)], "factor bigint")


_COST_SQL = """
WITH n AS (SELECT count(*) AS r, CAST(ceil(count(*) / 12.0) AS BIGINT) AS b, count(DISTINCT n_regionkey) AS v FROM nation),
g AS (SELECT count(*) AS r, CAST(ceil(count(*) / 16.0) AS BIGINT) AS b, count(DISTINCT r_regionkey) AS v FROM region),
o AS (SELECT n.b + n.r * g.b + n.r * g.r * 0.2 AS ab, g.b + g.r * n.b + n.r * g.r * 0.2 AS ba, n.r AS nr, n.b AS nb, n.v AS nv, g.r AS gr, g.b AS gb, g.v AS gv FROM n, g),
p AS (SELECT *, CASE WHEN ab <= ba THEN nb + nr * gb ELSE gb + gr * nb END AS pb, nr * gr AS pr, nb + nr * 0.2 + gb + gr * 0.2 + least(ab, ba) AS pc FROM o),
s AS (SELECT *, pr // greatest(nv, gv) AS sr FROM p)
SELECT kind, blocks, records, round(cost, 3) AS cost FROM (
  SELECT 'product' AS kind, CAST(pb AS BIGINT) AS blocks, CAST(pr AS BIGINT) AS records, CAST(pc AS DOUBLE) AS cost FROM s
  UNION ALL SELECT 'select', CAST(pb AS BIGINT), CAST(sr AS BIGINT), CAST(pc + pb + sr * 0.2 AS DOUBLE) FROM s
  UNION ALL SELECT 'project', CAST(pb AS BIGINT), CAST(sr AS BIGINT), CAST(pc + 2 * (pb + sr * 0.2) AS DOUBLE) FROM s)
"""


@_query("plan_cost", _COST_SQL)
def _plan_cost(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark, block_size=400).register_folder(folder, "nation", "region")
    plan = engine.plan_frame("select n_name from nation, region where n_regionkey = r_regionkey", exact=True)
    return plan.filter("kind <> 'table'").select("kind", "blocks", "records", F.round("cost", 3).alias("cost"))


@_query("plan_index_cost", """
WITH n AS (SELECT count(*) AS r, CAST(ceil(count(*) / 12.0) AS BIGINT) // 100 AS b, count(*) // count(DISTINCT n_regionkey) AS k FROM nation)
SELECT 'index' AS kind, b AS blocks, k AS records, CAST(b + k * 0.2 AS DOUBLE) AS cost FROM n
UNION ALL SELECT 'select', b, k, CAST(2 * (b + k * 0.2) AS DOUBLE) FROM n UNION ALL SELECT 'project', b, k, CAST(3 * (b + k * 0.2) AS DOUBLE) FROM n
""")
def _plan_index(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark, block_size=400).register_folder(folder, "nation")
    engine.execute("create index by_region on nation (n_regionkey)")
    plan = engine.plan_frame("select n_name from nation where n_regionkey = 1", exact=True)
    return plan.select("kind", "blocks", "records", F.round("cost", 3).alias("cost"))


@_query("plan_table_cost", "SELECT CAST(ceil(count(*) / 12.0) AS BIGINT) AS blocks, count(*) AS records, CAST(ceil(count(*) / 12.0) + count(*) * 0.2 AS DOUBLE) AS cost FROM nation")
def _plan_table(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark, block_size=400).register_folder(folder, "nation")
    return engine.plan_frame("select n_name from nation", exact=True).filter("kind = 'table'").select("blocks", "records", F.round("cost", 3).alias("cost"))


def _scratch(spark: SparkSession) -> str:
    """A folder of its own below the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}"


@_query("insert_delta", "SELECT i AS a, concat('v', i) AS b, CAST(6 AS BIGINT) AS folders FROM range(5) t(i)")
def _insert_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Each commit of an insert adds a folder of its rows; a later session reads them all."""
    root = _scratch(spark)
    engine = Engine(spark, root)
    engine.execute("create table t (a int, b varchar(9))")
    for i in range(5):
        engine.execute(f'insert into t (a, b) values ({i}, "v{i}")')
    again = Engine(spark, root)
    return again.table("t").withColumn("folders", F.lit(len(again.catalog.tables["t"].folders)).cast("bigint"))


@_query("log_recovered", "SELECT CAST(3 AS BIGINT) AS txnum, 'SETINT' AS op, '7' AS value UNION ALL SELECT 3, 'ROLLBACK', NULL UNION ALL SELECT 3, 'START', NULL")
def _log_recovered(spark: SparkSession, folder: str) -> DataFrame:
    """What a session leaves open is in the log that the next one opens, which rolls it back."""
    root = _scratch(spark)
    engine = Engine(spark, root)
    engine.execute("create table t (a int)")
    engine.execute("insert into t (a) values (6)")
    engine.begin().execute("insert into t (a) values (7)")
    again = Engine(spark, root)
    if again.recover() != [3] or again.table("t").count() != 1:
        raise EngineError("recovery went wrong")
    return again.log.frame(spark).filter("txnum = 3").select("txnum", "op", "value")


@_query("index_pruned", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def _index_pruned(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark, _scratch(spark))
    engine.register("orders", _table(spark, folder, "orders").select("o_orderkey", "o_custkey"))
    engine.execute("create index by_customer on orders (o_custkey)")
    engine.build_index("by_customer")
    return engine.lookup("by_customer", 7)


@_query("row_ids", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def _row_ids(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation").select("n_nationkey", "n_name")
    rid = with_rids(nation).filter("n_nationkey = 7").select(f"{RID}.*").first()
    return at_rid(nation, rid.file, rid.row)


@_query("partition_by_key", "SELECT CAST(sum(n) AS BIGINT) AS records, CAST(max(keys) AS BIGINT) AS keys, CAST(1 AS BIGINT) AS buckets_of_a_key FROM (SELECT count(*) AS n, (SELECT count(DISTINCT o_custkey) FROM orders) AS keys FROM orders)")
def _partition_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a key lie in one partition."""
    dealt = partition(_table(spark, folder, "orders").select("o_custkey"), 8, "o_custkey").withColumn("bucket", F.spark_partition_id())
    of = dealt.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("b"))
    return of.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("keys"), F.max("b").alias("buckets_of_a_key"))


def entry(spark: SparkSession, folder: str = "/root/testdata/sf0.001") -> DataFrame:
    return QUERIES["join_three_way"](spark, folder)
