import sqlite3

import pytest

from sluice.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return f"file://{path}"


def test_csv_types(spark, tmp_path):
    text = "user_id,full_name,score,ok\n" + "".join(f"{i},name {i},{i}.5,{'true' if i % 2 else 'false'}\n" for i in range(100))
    df = readers.read_csv(spark, put(tmp_path / "a.csv", text))
    assert df.schema.simpleString() == "struct<user_id:bigint,full_name:string,score:double,ok:boolean>"
    assert df.count() == 100


def test_dirty_csv(spark, tmp_path):
    text = 'id,age,name\n1,30,"a, b"\n\n2,N/A,"say ""x"""\n3,none,c\n4\n5,7,d,extra,more\n6,nil,\x00e\n'
    df = readers.read_csv(spark, put(tmp_path / "d.csv", text))
    assert rows(df) == sorted([(1, 30, "a, b"), (2, None, 'say "x"'), (3, None, "c"), (4, None, None), (5, 7, "d"), (6, None, "e")], key=repr)


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1254", "iso-8859-9", "latin-1"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = put(tmp_path / "e.csv", "id;city\n1;Köln\n", encoding)
    assert rows(readers.read_csv(spark, path, delimiter=";", encoding=encoding)) == [(1, "Köln")]
    assert rows(readers.read_csv(spark, path, delimiter=";")) == [(1, "Köln")]


def test_sniffed_encodings():
    assert [readers.sniff_encoding(b) for b in ("ab€".encode()[:-1], "\ufeffa".encode(), "\ufeffa".encode("utf-16"), "ş".encode("cp1254"), b"")] == ["utf-8", "utf-8", "utf-16", "windows-1254", "utf-8"]


def test_broken_jsonl(spark, tmp_path):
    text = '{"id": 1, "t": "a"}\n\n{"id": 2, "t": \n{"id": 3, "t": "c", "late": 5}\nnot json\n'
    assert rows(readers.read_jsonl(spark, put(tmp_path / "b.jsonl", text)).select("id", "t", "late")) == sorted([(1, "a", None), (3, "c", 5)], key=repr)


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}]', '{"data": [{"a": 1}, {"a": 2}]}', '[{"a": 1}, {"a": 2}, {"a": 3', '[\n {"a": 1},\n {"a": 2}\n]'])
def test_json_forms(spark, tmp_path, text):
    assert rows(readers.read_json(spark, put(tmp_path / "j.json", text))) == [(1,), (2,)]


def test_json_single_object(spark, tmp_path):
    assert rows(readers.read_json(spark, put(tmp_path / "o.json", '{"a": 1}'))) == [(1,)]


DUMP = """-- dump
CREATE TABLE `products` (
  `id` int(11) NOT NULL, `title` varchar(100) DEFAULT NULL, `price` decimal(10,2), `stock` int,
  PRIMARY KEY (`id`)
);
INSERT INTO `products` VALUES (1,'a (b), \\'c\\'',10.5,3),(2,'it''s
two',99.0,NULL);
INSERT INTO products (id, title, price, stock) VALUES (3, NULL, 60, 1), (4, 'open
"""


def test_sql_dump(spark, tmp_path):
    df = readers.read_sql_dump(spark, put(tmp_path / "d.sql", DUMP))
    assert df.schema.simpleString() == "struct<id:bigint,title:string,price:double,stock:bigint>"
    assert rows(df) == [(1, "a (b), 'c'", 10.5, 3), (2, "it's\ntwo", 99.0, None), (3, None, 60.0, 1)]


def test_sql_dump_without_ddl_and_with_fragments(spark, tmp_path):
    text = "INSERT INTO t VALUES (1),(1,'a'),(1,'a','x'),(2,'b','y');"
    assert rows(readers.read_sql_dump(spark, put(tmp_path / "f.sql", text))) == [(1, "a", "x"), (2, "b", "y")]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, who TEXT, amount REAL, shipped BOOLEAN, raw BLOB)")
    db.executemany("INSERT INTO orders VALUES (?,?,?,?,?)", [(i, f"w{i}", i / 2, i % 2, b"\x01\xff") for i in range(1, 51)])
    db.commit()
    df = readers.read_sqlite(spark, str(tmp_path / "s.db"), table="orders")
    assert df.schema.simpleString() == "struct<id:bigint,who:string,amount:double,shipped:boolean,raw:string>"
    assert df.count() == 50 and df.filter("shipped").count() == 25 and df.first()["raw"] == "01ff"
    q = readers.read_sqlite(spark, str(tmp_path / "s.db"), query="SELECT id, amount FROM orders WHERE id < 3")
    assert rows(q) == [("1", "0.5"), ("2", "1.0")]
    cursor = db.execute("SELECT id, who FROM orders WHERE id <= 3")
    assert rows(readers.read_cursor(spark, cursor, chunk=2)) == [("1", "w1"), ("2", "w2"), ("3", "w3")]


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "sql"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a, \"b\" 'c' \\ d\ne", 1.5, True), (2, None, None, False)], "id long, s string, x double, ok boolean")
    path = f"file://{tmp_path}/out"
    if kind == "csv":
        df = df.filter("id = 2")
    writers.export(df, path, kind, "t")
    read = {"csv": readers.read_csv, "json": readers.read_json, "jsonl": readers.read_jsonl, "sql": readers.read_sql_dump}[kind]
    assert rows(read(spark, path, schema=df.schema)) == rows(df)


def test_empty_table_exports(spark, tmp_path):
    df = spark.createDataFrame([], "id long, s string")
    for kind in ("csv", "json", "jsonl", "sql"):
        writers.export(df, f"file://{tmp_path}/{kind}", kind)
    assert readers.read_json(spark, f"file://{tmp_path}/json", schema=df.schema).count() == 0
    with pytest.raises(ValueError):
        writers.export(df, "x", "xlsx")


def test_dirty_values(spark):
    from pyspark.sql import functions as F

    from sluice.functions.scalars import TYPES, cast_value

    df = spark.createDataFrame([(x,) for x in ["42", " 42.9 ", "-3.9", "NaN", "", "abc", "1e3", "9" * 30, "on", "\\N"]], "s string")
    got = df.select(cast_value(F.col("s"), TYPES["int64"]), cast_value(F.col("s"), TYPES["double"]), cast_value(F.col("s"), TYPES["bool"]), cast_value(F.col("s"), TYPES["string"])).collect()
    assert [r[0] for r in got] == [42, 42, -3, None, None, None, 1000, None, None, None]
    assert got[1][1] == 42.9 and got[3][1] is None and got[8][2] is True and got[5][2] is False and got[4][2] is None
    assert got[9][3] is None and got[4][3] == ""


def test_csv_keeps_line_feeds_and_stray_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", 1.5), (2, 'say "x", y\n\nz', None), (3, "plain", 2.0)], "id long, t string, v double")
    writers.export(df, f"{tmp_path}/x.csv")
    back = readers.import_file(spark, f"{tmp_path}/x.csv")
    assert back.schema.simpleString() == "struct<id:bigint,t:string,v:double>"
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    (tmp_path / "stray.csv").write_text('id,t\n1,a"b\n2,c\n3,d"e\n4,f\n')
    assert readers.read_csv(spark, f"{tmp_path}/stray.csv").count() == 4


def test_dumps_of_two_tables_and_broken_rows(spark, tmp_path):
    (tmp_path / "two.sql").write_text(
        "CREATE TABLE a (x int, s text);\nCREATE TABLE b (y text, z int);\nINSERT INTO b VALUES ('7', 8);\n"
        "INSERT INTO a VALUES (1, 'one'), (2, 'two\n(3, 'three'), (4, 'four');\nINSERT INTO a (s, x) VALUES ('five', 5);\n"
    )
    a = readers.read_sql_dump(spark, f"{tmp_path}/two.sql")
    assert a.schema.simpleString() == "struct<x:bigint,s:string>"
    got = {tuple(r) for r in a.collect()}
    assert {(1, "one"), (4, "four"), (5, "five")} <= got and not any(r[1] == "8" for r in got)
    assert [tuple(r) for r in readers.read_sql_dump(spark, f"{tmp_path}/two.sql", table="b").collect()] == [("7", 8)]
    (tmp_path / "raw.sql").write_text("(1, 'a'),\n(2, 'b')\n")
    assert sorted(tuple(r) for r in readers.read_sql_dump(spark, f"{tmp_path}/raw.sql").collect()) == [(1, "a"), (2, "b")]


def test_short_ways_in(spark, tmp_path):
    from sluice import api

    db = api.connect(f"file://{tmp_path}/db", spark)
    t = db.table("t")
    t.insert([{"id": 1, "name": "Ada"}, {"id": 2, "name": "Bob"}])
    for kind in ("csv", "json", "jsonl", "sql", "parquet"):
        api.export_file(t, f"{tmp_path}/out.{kind}")
        other = api.open_table(f"file://{tmp_path}/{kind}", spark)
        assert api.import_file(other, f"{tmp_path}/out.{kind}") == 2
        assert sorted(map(tuple, other.df().select("id", "name").collect())) == [(1, "Ada"), (2, "Bob")]
    assert [r.id for r in api.find(t, name="Bob").collect()] == [2] and api.find(t).count() == 2
    assert [r.id for r in api.search(t, "ADA").collect()] == [1]
    with pytest.raises(ValueError):
        api.import_file(t, "x.doc")
