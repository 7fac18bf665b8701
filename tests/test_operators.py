import random

from tessera.functions.statistics import block_count
from tessera.operators.hash_join import hash_join, partition
from tessera.operators.ordered_map import OrderedMap
from tessera.plans import ast, cost
from tessera.plans.parser import parse_predicate
from tessera.sources.catalog import layout


def test_hash_join(spark):
    r = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D"), (5, "E"), (6, "E")], "key int, data string")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "key int, data string")
    assert [tuple(x) for x in hash_join(r, s).collect()] == [(1, "Aa"), (2, "Bb"), (3, "Cc"), (4, "Dd"), (5, "Ee")]


def test_hash_join_duplicates(spark):
    r = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "key int, data string, at int")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "key int, data string")
    assert sorted(x.data for x in hash_join(r, s).collect()) == ["Aa", "Ab", "Ba", "Bb"]
    assert sorted(x.data for x in hash_join(r, s, build_last_wins=True, order="at").collect()) == ["Ba", "Bb"]


def test_partition_takes_negative_keys(spark):
    df = spark.createDataFrame([(k,) for k in range(-5, 6)], "key int")
    assert {(r.key, r.part) for r in partition(df, 3).collect()} == {(k, k % 3) for k in range(-5, 6)}


def values(df):
    return [r.value for r in df.collect()]


def test_ordered_map(spark):
    m = OrderedMap(spark.createDataFrame([], "key long, value long"))
    assert values(m.get(1)) == [] and values(m.scan(0, 9)) == []
    keys = [10, 23, 33, 35, 15, 2, 13, 39, 12, 45, 11, 14, 46, 37, 38, 40, 47, 48]
    m = m.set_all(spark.createDataFrame([(k, k) for k in keys], "key long, value long")).set(14, 15)
    assert values(m.scan(9, 16)) == [10, 11, 12, 13, 15, 15] and values(m.get(14)) == [15] and values(m.get(20)) == []
    m = m.remove(45).remove(46)
    assert values(m.scan(36, 41)) == [37, 38, 39, 40]
    for k in (37, 10, 48, 38, 47, 33, 40):
        m = m.remove(k)
    for k in (40, 41, 16):
        m = m.set(k, k)
    assert [r.key for r in m.scan(1, 42).collect()] == [2, 11, 12, 13, 14, 15, 16, 23, 35, 39, 40, 41]
    assert values(m.scan(42, 1)) == [] and values(m.remove(999).get(16)) == [16]


def test_ordered_map_against_dict(spark):
    rng = random.Random(4)
    m, d = OrderedMap(spark.createDataFrame([(k, k * 2) for k in range(50)], "key long, value long")), {k: k * 2 for k in range(50)}
    for _ in range(12):
        k = rng.randrange(60)
        if rng.random() < 0.5:
            m, d[k] = m.set(k, -k), -k
        else:
            m = m.remove(k)
            d.pop(k, None)
    assert [(r.key, r.value) for r in m.scan(5, 55).collect()] == sorted((k, v) for k, v in d.items() if 5 <= k <= 55)


def test_layout():
    p = layout((ast.ColumnDef("age", ast.INT), ast.ColumnDef("name", ast.VARCHAR, 9), ast.ColumnDef("height", ast.INT)))
    assert p.offsets == {"age": 8, "name": 16, "height": 33} and p.slot_size == 41
    assert block_count(60, p, 400) == 7 and block_count(0, p, 400) == 0


def test_cost_model():
    table = cost.table("student", 2, 50, {"sname": 50, "majorId": 50, "gradyear": 50})
    one = cost.select(table, parse_predicate("gradyear=2000"))
    assert (one.records, one.blocks, one.distinct["gradyear"]) == (1, 2, 1)
    assert cost.select(table, parse_predicate("majorId=10 and majorId=gradyear")).records == 0
    assert cost.project(table, ("sname",)).records == 50
    p = cost.product(one, cost.project(one, ("majorId",)))
    assert (p.records, p.blocks) == (1, 4)
    assert abs(table.cost - 12) < 1e-9 and abs(one.cost - (12 + 2 + 0.2)) < 1e-9
    assert cost.reduction_factor(parse_predicate("1 = 2"), {}) == cost.NEVER and cost.reduction_factor(parse_predicate("1 = 1"), {}) == 1
    assert cost.reduction_factor(parse_predicate("a = 1 and b = 1 and c = 1"), {"a": 2**40, "b": 2**40}) == cost.NEVER
    found = cost.index(cost.table("t", 250, 1000, {"k": 50, "v": 9}), "k")
    assert (found.blocks, found.records, found.distinct) == (2, 20, {"k": 1, "v": 9})
    small, big = cost.table("s", 1, 2, {}), cost.table("b", 100, 5000, {})
    assert cost.product(big, small).children[0] == small
