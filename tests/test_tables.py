import pytest

from sluice.operators import mutations
from sluice.operators.session import Session
from sluice.plans import pipe


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def affected(df):
    return df.first()["rows_affected"]


@pytest.fixture
def accounts(db):
    db.table("accounts").insert([{"id": i, "name": f"n{i}", "balance": 100 * i, "active": i % 2 == 1} for i in range(1, 6)])
    return db


def test_inserted_types_and_rows(accounts):
    assert accounts.table("accounts").schema.simpleString() == "struct<id:bigint,name:string,balance:bigint,active:boolean>"
    assert accounts.query("COUNT accounts").first()[0] == 5


def test_update_delete_truncate(accounts):
    assert affected(accounts.query("UPDATE accounts SET balance = 0, name = 'x' WHERE balance > 300")) == 2
    assert rows(accounts.query("FROM accounts | WHERE name = 'x' | SELECT id, balance")) == [(4, 0), (5, 0)]
    assert affected(accounts.query("UPDATE accounts SET balance = balance + 1")) == 5
    assert affected(accounts.query("DELETE FROM accounts WHERE active = true")) == 3
    assert affected(accounts.query("DELETE accounts WHERE id = 77")) == 0
    assert affected(accounts.query("TRUNCATE TABLE accounts")) == 2
    assert accounts.table("accounts").schema.names == ["id", "name", "balance", "active"]


def test_delete_keeps_rows_with_a_null_condition(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(mutations.delete(df, pipe.condition(df, "v > 1"))) == [(1, None)]


def test_columns(accounts):
    accounts.query("ALTER TABLE accounts ADD COLUMN tier text DEFAULT 'new'")
    accounts.query("ALTER TABLE accounts RENAME COLUMN name TO title;")
    accounts.query("ALTER TABLE accounts DROP COLUMN active")
    assert accounts.table("accounts").schema.names == ["id", "title", "balance", "tier"]
    assert rows(accounts.query("FROM accounts | SELECT tier | DISTINCT")) == [("new",)]
    t = accounts.table("accounts")
    for bad, error in ((lambda: t.add_column("id", "int"), ValueError), (lambda: t.drop_column("no"), KeyError), (lambda: t.rename_column("id", "title"), ValueError), (lambda: t.update({"no": 1}), KeyError)):
        with pytest.raises(error):
            bad()


def test_last_column_stays(spark):
    with pytest.raises(ValueError):
        mutations.drop_column(spark.range(1), "id")


def test_upsert(accounts):
    accounts.table("accounts").upsert([{"id": 5, "balance": 1}, {"id": 9, "balance": 2}, {"id": 9, "balance": 3}, {"id": None, "balance": 4}], "id")
    assert rows(accounts.query("FROM accounts | WHERE balance < 10 | SELECT id, name, balance")) == [(5, "n5", 1), (9, None, 3), (None, None, 4)]


def test_sql_statements(db):
    db.query("CREATE TABLE t (id int, x float, s text, v vector)")
    assert affected(db.query("INSERT INTO t VALUES (1, -2.5, 'a, (b)', [1, 2]), (2, NULL, NULL, NULL)")) == 2
    assert rows(db.query("FROM t | SELECT id, x, s")) == [(1, -2.5, "a, (b)"), (2, None, None)]
    assert rows(db.query("SELECT id FROM t WHERE x IS NOT NULL")) == [(1,)]
    db.query("INSERT INTO t (id, s) VALUES (3, 'it''s')")
    assert rows(db.query("FROM t | WHERE id = 3 | SELECT s")) == [("it's",)]
    assert [r[0] for r in db.query("DESCRIBE t").collect()] == ["id", "x", "s", "v"]
    db.query("CREATE TABLE t (only int)")
    assert db.table("t").count() == 0 and db.table("t").schema.names == ["only"]
    db.query("RENAME TABLE t TO u")
    assert db.tables() == ["u"]
    db.query("OPTIMIZE TABLE u")
    db.query("DROP TABLE u")
    db.query("DROP TABLE IF EXISTS u")
    with pytest.raises(FileNotFoundError):
        db.query("DROP TABLE u")
    assert "Scan" in db.query("EXPLAIN SELECT 1").first()[0]


def test_databases_and_sub_tables(db):
    db.query("CREATE DATABASE school")
    db.query("CREATE DATABASE IF NOT EXISTS school")
    with pytest.raises(ValueError):
        db.query("CREATE DATABASE school")
    db.query("USE school")
    db.table("students").insert([{"id": 1}, {"id": 2}])
    db.table("students.a").insert([{"id": 7}])
    assert rows(db.query("FROM students")) == [(1,), (2,)]
    assert rows(db.query("FROM school.students.a")) == [(7,)]
    assert rows(db.query("SELECT id FROM students.a")) == [(7,)]
    assert [(r.table, r.type, r.parent, r.rows) for r in db.query("SHOW TABLES").collect()] == [("students", "table", None, 2), ("students.a", "sub-table", "students", 1)]
    assert {(r.database, r.tables) for r in db.query("SHOW DATABASES").collect()} == {("default", 0), ("school", 2)}
    db.query("USE default")
    with pytest.raises(ValueError):
        db.query("DROP DATABASE default")
    db.query("DROP DATABASE school")
    assert db.databases() == ["default"]


def test_ragged_rows(db):
    db.query("CREATE TABLE r (a int, b text)")
    db.table("r").insert([[1], [2, "x"]])
    assert rows(db.query("FROM r")) == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        db.table("r").insert([[1, "x", 3]])


def test_versions(accounts):
    t = accounts.table("accounts")
    before = t.df()
    t.delete()
    assert before.count() == 5 and t.count() == 0 and t.df(0).count() == 5
    t.vacuum()
    assert t.count() == 0


def test_fluent_queries(accounts):
    q = accounts.find("accounts")
    assert q.where("balance >= 300").order_by("id", descending=True).limit(2).pluck("id") == [5, 4]
    assert q.where(name="n2").first()["id"] == 2 and q.find_one(id=77) is None
    assert len(q.find(active=True, limit=2)) == 2
    assert (q.sum("balance"), q.avg("balance"), q.min("id"), q.max("id"), q.sum("balance", "id > 99")) == (1500, 300.0, 1, 5, 0)
    assert q.exists("id = 3") and not q.exists("id = 33")
    assert q.search("N3").pluck("id") == [3] and q.search("%").count() == 0
    assert q.last("id")["id"] == 5 and q.page(2, 2, "id").pluck("id") == [3, 4]
    assert sorted(q.distinct("active").pluck("active")) == [False, True]
    assert q.order_by("id").select("id", "name").to_list()[0] == [1, "n1"]
    assert q.pipe("| WHERE id = 1 | SELECT id").to_dicts() == [{"id": 1}]
    assert len(list(q)) == 5


def test_vector_search(spark):
    from sluice.operators.query import Query

    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.9, 0.1]), (4, "b", None)], "id int, topic string, v array<float>")
    q = Query(df)
    assert q.vector_search("v", [1, 0], 2).pluck("id") == [1, 3]
    assert q.vector_search("v", [1, 0], 1, filter="topic = 'b'").pluck("id") == [3]
    assert q.vector_search("v", [1, 0], 3, metric="l2").pluck("id") == [1, 3, 2]
    with pytest.raises(ValueError):
        q.vector_search("v", [1, 0], metric="none")


def test_concurrent_writers_lose_no_row(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from sluice.operators.tables import Table

    place = f"file://{tmp_path}/t"
    Table(spark, place).insert([{"id": 0, "v": 0}])

    def writer(w):
        t = Table(spark, place)
        for k in range(4):
            t.insert([{"id": 10 * w + k, "v": 0}])
        t.update({"v": F.col("v") + 1}, F.col("id") == 0)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writer, (1, 2, 3)))
    got = rows(Table(spark, place).df())
    assert got == sorted([(0, 3), *((10 * w + k, 0) for w in (1, 2, 3) for k in range(4))], key=repr)


def test_insert_reads_and_rewrites_nothing(spark, tmp_path):
    from sluice.operators.tables import Table

    t = Table(spark, f"file://{tmp_path}/t")
    t.insert([{"id": 1, "v": 2}])
    before = set(t.df().inputFiles())
    t.insert([{"id": 2}])
    assert before < set(t.df().inputFiles()) and rows(t.df()) == [(1, 2), (2, None)]
    assert t.batch_insert([{"id": k, "v": k} for k in range(3, 8)], size=2) == 5
    t.optimize()
    assert len(t.df().inputFiles()) == 1 and t.count() == 7
