import pytest
from pyspark.sql import functions as F

from sluice.plans import pipe
from sluice.plans.pipe import PipeError, apply_pipe, compile_pipe


@pytest.fixture(scope="module")
def sensors(spark):
    rows = [(10 * i + 1_700_000_000, f"dev{i % 10}", ["Salon", "Mutfak", "ofis", "Depo"][i % 4], 18.0 + i % 25, 100 - i // 20) for i in range(1000)]
    return spark.createDataFrame(rows, "ts long, device string, room string, temp double, battery int").cache()


@pytest.fixture(scope="module")
def shop(spark):
    users = spark.createDataFrame([(1, "Ada", 30), (2, "Bo", 41), (3, "Cy", None), (4, "Di", 25), (5, "Ed", 19)], "id long, name string, age int")
    orders = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (3, 2, 5.0), (4, 3, 7.5), (5, 4, 1.0), (6, 999, 99.0)], "order_id long, user_id long, amount double")
    return {"users": users, "orders": orders}.__getitem__


def values(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_filter_compute_group_sort(sensors):
    got = apply_pipe(sensors, "| WHERE room = 'Salon' | COMPUTE f = temp * 2 | AGGREGATE count(*) AS n, max(f) AS m BY device | SORT n DESC, device | LIMIT 2")
    want = sensors.filter("room = 'Salon'").groupBy("device").agg(F.count("*").alias("n"), F.max(F.col("temp") * 2).alias("m")).orderBy(F.desc("n"), "device").limit(2)
    assert values(got) == values(want)


def test_like_ignores_case_and_has_no_escape(spark, sensors):
    assert apply_pipe(sensors, "WHERE room LIKE 'OF%'").count() == 250
    df = spark.createDataFrame([("a\\b",), ("ab",)], "s string")
    assert apply_pipe(df, "WHERE s LIKE 'A\\\\B'").count() == 1


def test_joins_fan_out_and_keep_left_rows(shop):
    assert compile_pipe("FROM users | JOIN orders ON id = user_id", shop).count() == 5
    left = compile_pipe("FROM users | LEFT JOIN orders ON users.id = orders.user_id | SORT amount DESC", shop)
    assert left.count() == 6
    assert left.first()["amount"] is None  # null is the greatest value


def test_join_names_clashes_after_the_table(spark):
    tables = {"a": spark.createDataFrame([(1, "x")], "id int, v string"), "b": spark.createDataFrame([("1", "y")], "id string, v string")}
    got = compile_pipe("FROM a | JOIN b ON id = id | COMPUTE both = v + b.v", tables.__getitem__)
    assert got.columns == ["id", "v", "b.id", "b.v", "both"]
    assert got.first()["both"] == "xy"


def test_arithmetic_rules(spark):
    df = spark.createDataFrame([(7, -3, 0)], "a int, b int, z int")
    row = apply_pipe(df, "COMPUTE q = a / 2, z0 = a / z, m = a % b, n = b % a, mz = a % z, s = 'x' + a, l = 100 - a, r = round(2.5), r3 = round(3.5)").first()
    assert (row.q, row.z0, row.m, row.n, row.mz, row.s, row.l, row.r, row.r3) == (3.5, None, -2, 4, None, "x7", 93, 2.0, 4.0)


def test_text_against_numbers(spark):
    df = spark.createDataFrame([(5, "5"), (12, "abc")], "n int, s string")
    assert values(apply_pipe(df, "WHERE n = '5'"), "n") == [(5,)]
    assert values(apply_pipe(df, "WHERE s = 5"), "n") == [(5,)]
    assert values(apply_pipe(df, "WHERE n > 'abc'"), "n") == []
    assert values(apply_pipe(df, "WHERE n = s"), "n") == [(5,)]


def test_literals_and_escapes(spark):
    df = spark.createDataFrame([("O'Brien",)], "s string")
    for text in ("s = 'O''Brien'", "s = 'O\\'Brien'", 's = "O\'Brien"'):
        assert apply_pipe(df, f"WHERE {text}").count() == 1


def test_null_logic(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert apply_pipe(df, "WHERE n != 2").count() == 1
    assert apply_pipe(df, "WHERE n IS NULL").count() == 1
    assert apply_pipe(df, "WHERE NOT n IS NULL").count() == 1
    assert values(apply_pipe(df, "AGGREGATE count(*) AS a, count(n) AS b, sum(n) AS c")) == [(2, 1, 1)]


def test_stages_run_in_written_order(spark):
    df = spark.range(10)
    assert apply_pipe(df, "LIMIT 5 | WHERE id > 100").count() == 0
    assert apply_pipe(df, "WHERE id > 2 | WHERE id < 5").count() == 2
    assert apply_pipe(df, "AGGREGATE sum(id) AS s | WHERE s > 1000").count() == 0


def test_aliases_of_aggregates(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v int")
    assert apply_pipe(df, "AGGREGATE count(*), count(), sum(v), stddev(v) AS s BY g").columns == ["g", "count", "count", "sum_v", "s"]


def test_vectors_in_all_forms(spark):
    import struct

    raw = bytearray(struct.pack("<3f", 1.0, -2.5, 0.0))
    df = spark.createDataFrame([([1.0, 0.0], "[1, 0]", raw, "")], "v array<float>, t string, b binary, e string")
    row = apply_pipe(df, "COMPUTE c = cos_sim(v, [1, 0, 5]), d = dot_product(t, v), e2 = l2_distance(v, [4, 4]), m = l1_distance([1, -1], v), b0 = dot_product(b, [2, 2, 2]), none = cosine_similarity(e, v)").first()
    assert (row.c, row.d, row.e2, row.m, row.b0, row.none) == (1.0, 1.0, 5.0, 1.0, -3.0, 0.0)


@pytest.mark.parametrize("text", ["WHERE", "WHERE id = ", "WHERE id = 1 2", "SELECT nothing", "JUMP 3", "LIMIT x", "COMPUTE id", "WHERE id LIKE", "WHERE (id = 1", "WHERE id = 'a", "COMPUTE v = dot_product(id)", "WHERE id = 1 SORT id"])
def test_junk_is_an_error(spark, text):
    with pytest.raises(PipeError):
        apply_pipe(spark.range(1), text)


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = compile_pipe("FROM lineitem | WHERE l_quantity > 49 AND l_returnflag = 'R' | SELECT l_orderkey", lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "l_quantity,49.0)" in pushed and "l_returnfl" in pushed
    assert "ReadSchema: struct<l_orderkey:bi" in plan and "l_shipdate" not in plan


def test_constant_vectors_stay_in_codegen(spark, sf):
    df = compile_pipe("FROM embeddings | COMPUTE s = l2_distance(embedding, [1, 2, 3]) | SELECT vec_id, s", lambda n: spark.read.parquet(f"{sf}/{n}.parquet"))
    assert "zip_with" not in df._jdf.queryExecution().executedPlan().toString()


def test_tokens_know_digit_names_and_comments():
    assert [t.text for t in pipe.tokenize("2024_sales.x # c\n <> 1e5 -- d")][:-1] == ["2024_sales.x", "<>", "1e5"]


def test_streams_take_the_same_stages(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    from sluice.streaming import run_pipe

    q = run_pipe(stream, "WHERE event_type = 'click' | AGGREGATE count(*) AS n BY event_type", "clicks")
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").count()
    assert spark.table("clicks").first()["n"] == want
