import pytest

from tessera import Engine
from tessera.errors import EngineError, LockTimeout, NameError_, SqlSyntaxError, TypeError_, WriteConflict
from tessera.sources.log import Record


def rows(df):
    return sorted(tuple(r) for r in df.collect())


#: The rows of the two fixture tables, and the results that follow from them.
@pytest.fixture
def engine(spark):
    e = Engine(spark, block_size=400)
    e.register("student", spark.createDataFrame([("Tom", 1), ("Jim", 2), ("John", 3)], "name string, id bigint"))
    e.register("exam", spark.createDataFrame([(1, "math", "A"), (1, "algorithm", "B"), (2, "writing", "C"), (2, "physics", "C"), (3, "chemical", "B"), (3, "english", "C")], "stuid bigint, exam string, grad string"))
    return e


def test_projection_and_filter(spark):
    e = Engine(spark)
    e.register("student", spark.createDataFrame([("jim", 16, 233), ("tom", 18, 567), ("hanmeimei", 19, 890), ("rosa", 1259, 890)], "name string, age bigint, id bigint"))
    assert rows(e.sql("SELECT name,age FROM student WHERE id=890")) == [("hanmeimei", 19), ("rosa", 1259)]


def test_join(engine):
    assert rows(engine.sql('select name from student,exam where id=stuid and grad="A"')) == [("Tom",)]


def test_join_is_planned_as_one(engine):
    plan = engine.sql("select name from student, exam where id = stuid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan or "Join Cross, (" in plan


def test_typed_equality(engine):
    assert rows(engine.sql('select name from student where name = 1')) == []
    assert rows(engine.sql('select name from student where id = "1"')) == []
    assert rows(engine.sql('select name from student where "a" = "a"')) == [("Jim",), ("John",), ("Tom",)]


def test_leftmost_name_wins(engine, spark):
    engine.register("other", spark.createDataFrame([("Ann", 9)], "name string, id bigint"))
    assert rows(engine.sql("select name, id from other, student")) == [("Ann", 9)] * 3
    assert len(rows(engine.sql("select name, name from student, student"))) == 9


def test_names_are_case_sensitive(engine):
    with pytest.raises(NameError_):
        engine.sql("select NAME from student")
    with pytest.raises(NameError_):
        engine.sql("select name from Student")


def test_empty_outer_gives_nothing(engine):
    engine.execute('create view none as select exam from exam where grad = "Z"')
    assert rows(engine.sql("select name from none, student")) == []


def test_ddl_and_dml(spark):
    e = Engine(spark)
    assert e.execute("create table student (name varchar(16),majorId int,gradyear int)") is True
    assert e.execute('insert into student (name,majorId,gradyear) values ("htylor",30,2020)') is True
    e.execute('insert into student (name,majorId,gradyear) values ("jtom",35,2022)')
    assert e.execute("update student set majorId=20 where majorId=30 and gradyear=2020") == 1
    assert e.execute("delete from student where majorId=35") == 1
    assert rows(e.table("student")) == [("htylor", 20, 2020)]
    e.execute("insert into student (majorId) values (5)")
    assert rows(e.sql("select name, majorId, gradyear from student where majorId = 5")) == [("", 5, 0)]


@pytest.mark.parametrize(
    "statement, error",
    [
        ('insert into t (a) values ("x")', TypeError_), ('insert into t (b) values ("long text")', TypeError_), ("insert into t (c) values (1)", NameError_), ("insert into t (a, a) values (1, 2)", NameError_), ("insert into u (a) values (1)", NameError_),
        ('update t set a = "x"', TypeError_), ("update t set a = b", TypeError_), ("update t set b = d", TypeError_), ("create table t (a int)", NameError_), ("create table tblcat (a int)", NameError_), ("create table v (x int, x int)", NameError_),
        ("create view w as select zzz from t", NameError_), ("create view w as select a from w", NameError_), ("create index i on t (zzz)", NameError_), ("select a from t", SqlSyntaxError), ("delete from tblcat", NameError_), ("update t set a = 1 where zzz = 1", NameError_),
    ],
)
def test_rejected(spark, statement, error):
    e = Engine(spark)
    e.execute("create table t (a int, b varchar(4), d varchar(9))")
    e.execute('insert into t (a, b, d) values (1, "abc", "123456")')
    with pytest.raises(error):
        e.execute(statement)
    assert rows(e.table("t")) == [(1, "abc", "123456")]


def test_nulls_from_outside(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, None), (2, "x")], "a int, b string"))
    assert rows(e.sql('select a from t where b = "x"')) == [(2,)]
    assert e.execute('delete from t where b = "x"') == 1
    assert e.execute('update t set b = "y" where b = "x"') == 0
    assert [tuple(r) for r in e.table("t").collect()] == [(1, None)]
    with pytest.raises(TypeError_):
        e.execute("insert into t (a) values (3000000000)")


def test_views_nest(engine):
    engine.execute('create view good as select stuid, exam from exam where grad = "B"')
    engine.execute("create view best as select name, exam from student, good where id = stuid")
    assert rows(engine.sql("select name, exam from best")) == [("John", "chemical"), ("Tom", "algorithm")]


def test_index_follows_the_data(engine):
    engine.execute("create index i on exam (stuid)")
    assert len(engine.lookup("i", 2).collect()) == 2
    engine.execute("delete from exam where stuid = 2")
    assert engine.lookup("i", 2).collect() == [] and engine.lookup("i", "2").collect() == []
    engine.execute("create index j on exam (stuid)")
    assert engine.catalog.indexes_of("exam")["stuid"].name == "j"


def test_transactions(engine):
    tx = engine.begin()
    tx.execute("delete from student")
    assert rows(tx.table("student")) == [] and len(rows(engine.table("student"))) == 3
    tx.rollback()
    assert len(rows(engine.table("student"))) == 3
    with engine.begin() as tx:
        tx.execute('update student set name = "X" where id = 1')
        reader = engine.begin()
    assert rows(engine.sql("select name from student where id = 1")) == [("X",)]
    assert rows(reader.sql("select name from student where id = 1")) == [("Tom",)]
    with pytest.raises(WriteConflict):
        reader.execute("delete from student")
    with pytest.raises(EngineError):
        tx.execute("delete from student")


def test_one_writer_for_a_table(engine):
    engine.lock_wait = 0.05
    one, two = engine.begin(), engine.begin()
    one.execute("delete from student where id = 1")
    with pytest.raises(LockTimeout):
        two.execute("delete from student where id = 2")
    assert two.execute("delete from exam where stuid = 1") == 2
    one.rollback()
    assert two.execute("delete from student where id = 2") == 1
    two.commit()
    assert rows(engine.sql("select id from student")) == [(1,), (3,)]


def test_error_in_a_transaction_block_rolls_back(engine):
    with pytest.raises(NameError_), engine.begin() as tx:
        tx.execute("delete from student")
        tx.execute("delete from nowhere")
    assert len(rows(engine.table("student"))) == 3


def test_committed_state_survives(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("create table t (a int, b varchar(5))")
    e.execute('insert into t (a, b) values (1, "x")')
    e.execute("create view v as select a from t where b = 'x'")
    e.execute("create index i on t (a)")
    e.begin().execute("delete from t")  # never committed
    again = Engine(spark, str(tmp_path / "db"))
    assert rows(again.sql("select a from v")) == [(1,)] and len(again.lookup("i", 1).collect()) == 1
    assert again.execute("delete from t") == 1
    assert rows(Engine(spark, str(tmp_path / "db")).table("t")) == []


def test_long_lineage_is_cut(spark):
    e = Engine(spark)
    e.execute("create table t (a int)")
    for i in range(20):
        e.execute(f"insert into t (a) values ({i})")
    assert len(rows(e.table("t"))) == 20
    assert e.catalog.tables["t"].depth < 18


def test_catalog_tables(spark):
    e = Engine(spark)
    e.execute("create table p (age int, name varchar(9), height int)")
    assert rows(e.sql('select fldname, offset from fldcat where tblname = "p"')) == [("age", 8), ("height", 33), ("name", 16)]
    assert rows(e.sql('select slotsize from tblcat where tblname = "p"')) == [(41,)]
    assert len(rows(e.sql("select fldname from fldcat where tblname = 'fldcat'"))) == 5


def test_statistics(spark):
    e = Engine(spark, block_size=400)
    e.execute("create table mytable (A int, B varchar(9), C int)")
    data = [(i % 50, f"rec{i % 50}", i) for i in range(50)] + [(0, "", c) for c in range(45, 55)]
    table = e.catalog.tables["mytable"]
    df = spark.createDataFrame(data, table.load().schema)
    e._catalog.tables["mytable"] = type(table)("mytable", table.columns, lambda: df, 2)
    s = e.stats("mytable", exact=True)
    assert (s.records, s.blocks, s.distinct["C"]) == (60, 7, 55)


def test_log_texts(engine):
    texts = ["<START 13>", "<SETSTRING 1 dummy_id 1 13 origin string>", "<SETINT 1 dummy_id 1 13 11>", "<COMMIT 12>", "<CHECKPOINT>", "<ROLLBACK 13>"]
    assert [str(Record.parse(t)) for t in texts] == texts
    engine.begin().commit()
    newest = [r.op for r in engine.log.newest_first(engine.spark).collect()]
    assert newest == ["COMMIT", "START", "CHECKPOINT"]


def test_inserts_add_folders_and_other_changes_rewrite(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("create table t (a int, b varchar(9))")
    for i in range(3):
        e.execute(f'insert into t (a, b) values ({i}, "x")')
    first = e.catalog.tables["t"].folders
    assert len(first) == 4 and rows(e.table("t")) == [(0, "x"), (1, "x"), (2, "x")]
    with e.begin() as tx:
        tx.execute('insert into t (a, b) values (3, "y")')
        tx.execute('insert into t (a, b) values (4, "y")')
    assert e.catalog.tables["t"].folders[:4] == first and len(e.catalog.tables["t"].folders) == 5
    assert e.execute('update t set b = "z" where a = 1') == 1 and len(e.catalog.tables["t"].folders) == 1
    assert rows(Engine(spark, str(tmp_path / "db")).sql('select a from t where b = "y"')) == [(3,), (4,)]


def test_the_log_outlives_its_session(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.execute("create table t (a int, b varchar(20))")
    e.execute('insert into t (a, b) values (1, "two words")')
    e.begin().execute("update t set a = 5")
    again = Engine(spark, str(tmp_path / "db"))
    assert [r.txnum for r in again.log.unfinished(spark).collect()] == [3]
    sets = again.log.frame(spark).filter("op like 'SET%'").orderBy("lsn").select("op", "txnum", "file", "offset", "value").collect()
    assert list(map(tuple, sets)) == [("SETINT", 2, "t", 8, "1"), ("SETSTRING", 2, "t", 16, "two words"), ("SETINT", 3, "t", 8, "5")]
    assert again.recover() == [3] and again.recover() == [] and rows(again.table("t")) == [(1, "two words")]
    assert again.begin().number == 4


def test_an_index_reads_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    e = Engine(spark, str(tmp_path / "db"))
    e.register("t", spark.range(4000).selectExpr("id * 7919 % 1000 as k", "id as v").repartition(8))
    e.execute("create index by_k on t (k)")
    want = rows(e.lookup("by_k", 37))
    e.build_index("by_k", 8)
    assert rows(e.lookup("by_k", 37)) == want and len(want) == 4
    files = e.lookup("by_k", 37).inputFiles()
    hit = 0
    for f in files:
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        hit += sum(meta.row_group(i).column(0).statistics.min <= 37 <= meta.row_group(i).column(0).statistics.max for i in range(meta.num_row_groups))
    assert len(files) == 8 and hit == 1
    e.execute("delete from t where v = 37")  # the copy is of the version before
    assert set(rows(e.lookup("by_k", 37))) <= set(want)


def test_waiting_for_a_lock_ends_while_another_table_is_written(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), lock_wait=0.2)
    for t in "ab":
        e.execute(f"create table {t} (x int)")
    holder = e.begin()
    holder.execute("insert into a (x) values (1)")
    with pytest.raises(LockTimeout):
        e.execute("insert into a (x) values (2)")
    e.execute("insert into b (x) values (3)")
    holder.commit()
    assert rows(e.table("a")) == [(1,)] and rows(e.table("b")) == [(3,)]
