"""Registered queries of the engine and their SQL for DuckDB: one for each operator, over whole tables."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.cluster import shared_path
from sluice.functions import scalars
from sluice.functions import sql as sql_functions
from sluice.operators import mutations, search
from sluice.operators.session import Session
from sluice.operators.tables import Files, Table
from sluice.plans.pipe import compile_pipe, condition, expression
from sluice.sources import readers, writers

Run = Callable[[SparkSession, str], DataFrame]

#: A fixed query vector of 64 components for the vector queries.
VECTOR = [round(((k * 37) % 64 - 31.5) / 64, 4) for k in range(64)]
_LIST = "[" + ", ".join(str(x) for x in VECTOR) + "]"
_DUCK = f"{_LIST}::DOUBLE[]"
_E = "embedding::DOUBLE[]"

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipe_query(name: str, text: str, sql: str) -> None:
    """Register a query of the pipe language."""
    QUERIES[name] = lambda spark, sf_dir: compile_pipe(text, tables(spark, sf_dir))
    ORACLE_SQL[name] = sql


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its name."""

    def put(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


FLAGSHIP = "FROM orders | WHERE o_totalprice > 100000 | AGGREGATE count(*) AS cnt, avg(o_totalprice) AS avg_price BY o_orderpriority | HAVING cnt > 10 | SORT avg_price DESC"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders by priority."""
    return compile_pipe(FLAGSHIP, tables(spark, sf_dir))


# stages

pipe_query("flagship", FLAGSHIP + " | COMPUTE avg_price = round(avg_price, 4)", "SELECT o_orderpriority, count(*) AS cnt, round_even(avg(o_totalprice), 4) AS avg_price FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 10")
pipe_query("scan_project", "FROM nation | SELECT n_nationkey, n_name", "SELECT n_nationkey, n_name FROM nation")
pipe_query("scan_count", "FROM lineitem | AGGREGATE count(*) AS n", "SELECT count(*) AS n FROM lineitem")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    pipe_query(f"filter_{_name}", f"FROM part | WHERE p_size {_op} 25 | SELECT p_partkey, p_size", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op.replace('!=', '<>')} 25")
pipe_query("filter_and_or", "FROM orders | WHERE o_totalprice > 200000 AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' | SELECT o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
pipe_query("filter_parentheses_not", "FROM orders | FILTER NOT (o_orderstatus = 'F' OR o_orderstatus = 'O') | SELECT o_orderkey, o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderstatus = 'O')")
pipe_query("filter_in_between", "FROM part | WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500 | SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_retailprice BETWEEN 900 AND 1500")
pipe_query("filter_negative", "FROM customer | WHERE c_acctbal < -500 | SELECT c_custkey, c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
pipe_query("filter_literal_left", "FROM part | WHERE 25 > p_size | SELECT p_partkey", "SELECT p_partkey FROM part WHERE 25 > p_size")
pipe_query("filter_computed", "FROM lineitem | COMPUTE net = l_extendedprice * (1 - l_discount) | WHERE net > 50000 | SELECT l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
pipe_query("filter_null", "FROM events | COMPUTE k = CASE WHEN event_type = 'click' THEN NULL ELSE event_type END | WHERE k IS NULL | SELECT event_id", "SELECT event_id FROM events WHERE event_type = 'click'")
pipe_query("filter_comments", "# large parts\nFROM part -- all of them\n| WHERE p_size >= 49 # two sizes\n| SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size >= 49")
for _name, _pattern in (("prefix", "s%"), ("suffix", "%l"), ("contains", "%OL%"), ("underscore", "_r%")):
    pipe_query(f"filter_like_{_name}", f"FROM part | WHERE p_type LIKE '{_pattern}' OR p_name LIKE '{_pattern}' | SELECT p_partkey", f"SELECT p_partkey FROM part WHERE p_type ILIKE '{_pattern}' OR p_name ILIKE '{_pattern}'")
pipe_query("compute_arithmetic", "FROM lineitem | COMPUTE net = l_extendedprice * (1 - l_discount) | COMPUTE charge = net * (1 + l_tax) | SELECT l_orderkey, l_linenumber, net, charge", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
pipe_query("compute_overwrite", "FROM part | COMPUTE p_size = p_size + 1 | COMPUTE p_size = p_size * 2 | SELECT p_partkey, p_size", "SELECT p_partkey, (p_size + 1) * 2 AS p_size FROM part")
pipe_query("safe_divide", "FROM part | COMPUTE r = p_retailprice / (p_size - 25) | COMPUTE r = round(r, 6) | SELECT p_partkey, r", "SELECT p_partkey, round_even(p_retailprice / nullif(p_size - 25, 0), 6) AS r FROM part")
pipe_query("floor_mod", "FROM customer | COMPUTE m = c_custkey % 7, k = (c_nationkey - 12) % 5, z = c_custkey % (c_nationkey - c_nationkey) | SELECT c_custkey, m, k, z", "SELECT c_custkey, c_custkey % 7 AS m, ((c_nationkey - 12) % 5 + 5) % 5 AS k, NULL::BIGINT AS z FROM customer")
pipe_query("literal_left_arithmetic", "FROM part | COMPUTE a = 100 - p_size, b = 'x' + p_brand | SELECT p_partkey, a, b", "SELECT p_partkey, 100 - p_size AS a, 'x' || p_brand AS b FROM part")
pipe_query("text_concat", "FROM customer | COMPUTE t = c_mktsegment + '-' + c_nationkey | SELECT c_custkey, t", "SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS t FROM customer")
pipe_query("text_number_compare", "FROM part | WHERE p_size = '25' | SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size = 25")
pipe_query("int_float_compare", "FROM part | WHERE p_size > 24.5 AND p_size < 25.5 | SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size > 24.5 AND p_size < 25.5")
pipe_query("unary_minus", "FROM customer | COMPUTE n = -c_acctbal | WHERE n > - 100 | SELECT c_custkey, n", "SELECT c_custkey, -c_acctbal AS n FROM customer WHERE -c_acctbal > -100")
pipe_query("select_expression", "FROM orders | SELECT o_orderkey, o_totalprice * 2 AS twice | LIMIT 100000000", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")

# joins

pipe_query("join_inner", "FROM customer | JOIN nation ON c_nationkey = n_nationkey | SELECT c_custkey, n_name", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
pipe_query("join_swapped", "FROM customer | INNER JOIN nation ON nation.n_nationkey = customer.c_nationkey | SELECT c_custkey, n_name", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
pipe_query("join_left", "FROM documents | LEFT JOIN labels ON doc_id = doc_id | SELECT doc_id, lang, quality, toxic", "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
pipe_query("join_left_where", "FROM documents | LEFT OUTER JOIN labels ON documents.doc_id = labels.doc_id | WHERE quality IS NULL AND lang = 'en' | SELECT doc_id", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL AND lang = 'en'")
pipe_query("join_name_clash", "FROM documents | JOIN labels ON doc_id = doc_id | COMPUTE other = labels.doc_id | SELECT doc_id, other, quality", "SELECT d.doc_id, l.doc_id AS other, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
pipe_query("join_two_tables", "FROM customer | JOIN nation ON c_nationkey = n_nationkey | JOIN region ON n_regionkey = r_regionkey | AGGREGATE count(*) AS n BY r_name", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
pipe_query("join_two_keys", "FROM lineitem | JOIN orders ON l_orderkey = o_orderkey AND l_suppkey = o_custkey | SELECT l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey = o_custkey")
pipe_query("join_aggregate", "FROM lineitem | JOIN orders ON l_orderkey = o_orderkey | WHERE o_orderstatus = 'F' | AGGREGATE sum(l_quantity) AS q, count(*) AS n BY o_orderpriority", "SELECT o_orderpriority, sum(l_quantity) AS q, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_cast_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key of text on one side and of numbers on the other."""
    t = tables(spark, sf_dir)
    nation = t("nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    return compile_pipe("FROM customer | JOIN nation ON c_nationkey = n_nationkey | SELECT c_custkey, n_name", lambda n: nation if n == "nation" else t(n))


# aggregation

pipe_query("agg_global", "FROM lineitem | AGGREGATE count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS first, max(l_shipdate) AS last", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
pipe_query("agg_global_empty", "FROM part | WHERE p_size > 1000 | AGGREGATE count(*) AS n, sum(p_size) AS s, min(p_size) AS m", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, min(p_size) AS m FROM part WHERE p_size > 1000")
pipe_query("agg_group_multi", "FROM lineitem | AGGREGATE count(*) AS n, sum(l_quantity) AS q BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
pipe_query("agg_count", "FROM events | AGGREGATE count() AS n, count(value) AS v BY event_type", "SELECT event_type, count(*) AS n, count(value) AS v FROM events GROUP BY 1")
pipe_query("agg_count_distinct", "FROM events | AGGREGATE count(DISTINCT user_id) AS users GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
pipe_query("agg_sum", "FROM lineitem | AGGREGATE sum(l_quantity) BY l_returnflag", "SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1")
pipe_query("agg_avg", "FROM lineitem | AGGREGATE avg(l_discount) AS a BY l_returnflag | COMPUTE a = round(a, 6)", "SELECT l_returnflag, round_even(avg(l_discount), 6) AS a FROM lineitem GROUP BY 1")
pipe_query("agg_min_max", "FROM part | AGGREGATE min(p_name) AS a, max(p_retailprice) AS b BY p_brand", "SELECT p_brand, min(p_name) AS a, max(p_retailprice) AS b FROM part GROUP BY 1")
pipe_query("agg_median", "FROM part | AGGREGATE median(p_retailprice) AS m BY p_brand | COMPUTE m = round(m, 6)", "SELECT p_brand, round_even(median(p_retailprice), 6) AS m FROM part GROUP BY 1")
pipe_query("agg_stddev", "FROM part | AGGREGATE stddev(p_retailprice) AS s BY p_brand | COMPUTE s = round(s, 4)", "SELECT p_brand, round_even(stddev_samp(p_retailprice), 4) AS s FROM part GROUP BY 1")
pipe_query("agg_expression", "FROM lineitem | AGGREGATE sum(l_quantity * l_linenumber) AS s BY l_linestatus", "SELECT l_linestatus, sum(l_quantity * l_linenumber) AS s FROM lineitem GROUP BY 1")
pipe_query("having_alias", "FROM orders | AGGREGATE count(*) AS n BY o_custkey HAVING n > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")

# order

pipe_query("sort_limit", "FROM orders | SORT o_totalprice DESC, o_orderkey | LIMIT 20 | SELECT o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
pipe_query("sort_unprojected", "FROM part | SORT p_retailprice, p_partkey | SELECT p_partkey | LIMIT 15", "SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey LIMIT 15")
pipe_query("sort_nulls_last", "FROM documents | LEFT JOIN labels ON doc_id = doc_id | SORT quality, doc_id | LIMIT 500 | SELECT doc_id, quality", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS LAST, d.doc_id LIMIT 500")
pipe_query("sort_nulls_first_descending", "FROM documents | LEFT JOIN labels ON doc_id = doc_id | SORT quality DESC, doc_id | LIMIT 500 | SELECT doc_id, quality", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, d.doc_id LIMIT 500")
pipe_query("sort_aggregate", "FROM lineitem | AGGREGATE sum(l_quantity) AS q BY l_suppkey | SORT q DESC, l_suppkey | LIMIT 10", "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_suppkey LIMIT 10")
pipe_query("limit_offset", "FROM orders | SORT o_orderkey | LIMIT 10 OFFSET 30 | SELECT o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30")
pipe_query("distinct_rows", "FROM orders | SELECT o_orderstatus, o_orderpriority | DISTINCT", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# functions

pipe_query("fn_abs", "FROM customer | COMPUTE a = abs(c_acctbal) | SELECT c_custkey, a", "SELECT c_custkey, abs(c_acctbal) AS a FROM customer")
pipe_query("fn_round", "FROM lineitem | COMPUTE a = round(l_extendedprice, 1), b = round(l_extendedprice) | SELECT l_orderkey, l_linenumber, a, b", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 1) AS a, round_even(l_extendedprice, 0) AS b FROM lineitem")
pipe_query("fn_upper_lower", "FROM part | COMPUTE u = upper(p_type), l = lower(p_brand) | SELECT p_partkey, u, l", "SELECT p_partkey, upper(p_type) AS u, lower(p_brand) AS l FROM part")
pipe_query("fn_trim", "FROM part | COMPUTE t = trim('\\t ' + p_brand + ' \\n') | SELECT p_partkey, t", "SELECT p_partkey, p_brand AS t FROM part")
pipe_query("fn_length", "FROM documents | COMPUTE n = length(text), m = len(doc_id) | SELECT doc_id, n, m", "SELECT doc_id, length(text) AS n, length(doc_id::VARCHAR) AS m FROM documents")

_VECTORS = {
    "cosine": ("cosine_similarity", f"list_cosine_similarity({_E}, {_DUCK})"),
    "cosine_distance": ("cosine_distance", f"1 - list_cosine_similarity({_E}, {_DUCK})"),
    "l2": ("l2_distance", f"list_distance({_E}, {_DUCK})"),
    "dot": ("dot_product", f"list_inner_product({_E}, {_DUCK})"),
    "manhattan": ("manhattan_distance", f"list_sum(list_transform(list_zip({_E}, {_DUCK}), lambda p: abs(p[1] - p[2])))"),
}
for _name, (_function, _sql) in _VECTORS.items():
    pipe_query(f"vec_{_name}", f"FROM embeddings | COMPUTE s = {_function}(embedding, {_LIST}) | COMPUTE s = round(s, 6) | SELECT vec_id, s", f"SELECT vec_id, round_even({_sql}, 6) AS s FROM embeddings")
pipe_query("vec_two_columns", "FROM embeddings | COMPUTE s = dot_product(embedding, embedding) | COMPUTE s = round(s, 5) | SELECT vec_id, s", f"SELECT vec_id, round_even(list_inner_product({_E}, {_E}), 5) AS s FROM embeddings")
pipe_query("vec_norm", "FROM embeddings | COMPUTE s = l2_norm(embedding) | COMPUTE s = round(s, 6) | SELECT vec_id, s", f"SELECT vec_id, round_even(sqrt(list_inner_product({_E}, {_E})), 6) AS s FROM embeddings")
pipe_query("vec_threshold", f"FROM embeddings | WHERE cosine_similarity(embedding, {_LIST}) > 0.1 | SELECT vec_id", f"SELECT vec_id FROM embeddings WHERE list_cosine_similarity({_E}, {_DUCK}) > 0.1")


def _vector_search(metric: str, where: str | None = None) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables(spark, sf_dir)("embeddings")
        found = search.vector_search(rows, "embedding", VECTOR, 10, None if where is None else condition(rows, where), metric, ["vec_id"])
        return found.select("vec_id", F.bround("score", 6).alias("score"))

    return run


for _metric, _key, _order in (("cosine", "cosine", "DESC"), ("l2", "l2", "ASC"), ("dot", "dot", "DESC"), ("manhattan", "manhattan", "ASC")):
    QUERIES[f"vec_search_{_metric}"] = _vector_search(_metric)
    ORACLE_SQL[f"vec_search_{_metric}"] = f"SELECT vec_id, round_even(s, 6) AS score FROM (SELECT vec_id, {_VECTORS[_key][1]} AS s FROM embeddings) ORDER BY s {_order}, vec_id LIMIT 10"
QUERIES["vec_hybrid"] = _vector_search("cosine", "label < 3")
ORACLE_SQL["vec_hybrid"] = f"SELECT vec_id, round_even(s, 6) AS score FROM (SELECT vec_id, {_VECTORS['cosine'][1]} AS s FROM embeddings WHERE label < 3) ORDER BY s DESC, vec_id LIMIT 10"


@query(f"SELECT vec_id, round_even(list_cosine_similarity({_E}, {_DUCK}), 6) AS s FROM embeddings")
def sql_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector functions as SQL functions."""
    sql_functions.register(spark)
    tables(spark, sf_dir)("embeddings").createOrReplaceTempView("sluice_embeddings")
    literal = "array(" + ", ".join(f"{x}D" for x in VECTOR) + ")"
    return spark.sql(f"SELECT vec_id, bround(cosine_similarity(embedding, {literal}), 6) AS s FROM sluice_embeddings")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand HAVING count(*) > 5")
def select_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL."""
    tables(spark, sf_dir)("part").createOrReplaceTempView("sluice_part")
    return spark.sql("SELECT p_brand, count(*) AS n FROM sluice_part WHERE p_size > 10 GROUP BY p_brand HAVING count(*) > 5")


# statements

def statements(name: str, oracle: str, names: str, *texts: str) -> None:
    """A query that runs these statements one after another in a session of its own with copies of tables, and returns what the last one gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Session(spark, shared_path(spark, "db"))
        for n in names.split():
            db.table(n).overwrite(tables(spark, sf_dir)(n))
        for t in texts[:-1]:
            db.query(t)
        return db.query(texts[-1])

    QUERIES[name], ORACLE_SQL[name] = run, oracle


_BRANDS = "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand HAVING count(*) > 5"
_NATIONS = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
statements("st_select", _BRANDS, "part", _BRANDS)
statements("st_select_join", _NATIONS, "customer nation", _NATIONS)
statements("st_pipe", "SELECT r_name FROM region WHERE r_regionkey > 1", "region", "FROM region | WHERE r_regionkey > 1 | SELECT r_name")
statements("st_create_insert", "SELECT 1::BIGINT AS id, 'a' AS name UNION ALL SELECT 2, concat('it', chr(39), 's') UNION ALL SELECT 3, NULL", "", "CREATE TABLE t (id bigint, name text)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (2, 'it''s'), (3, NULL)", "SELECT id, name FROM t")
statements("st_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", "customer", "UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < 0", "SELECT c_custkey, c_acctbal FROM customer")
statements("st_delete", "SELECT p_partkey FROM part WHERE p_size <= 25", "part", "DELETE FROM part WHERE p_size > 25", "SELECT p_partkey FROM part")
statements("st_truncate", "SELECT r_name FROM region WHERE false", "region", "TRUNCATE TABLE region", "SELECT r_name FROM region")
statements("st_alter", "SELECT r_regionkey, r_name AS title, 'new' AS tier FROM region", "region", "ALTER TABLE region ADD COLUMN tier text DEFAULT 'new'", "ALTER TABLE region RENAME COLUMN r_name TO title", "SELECT * FROM region")
statements("st_drop_column", "SELECT n_nationkey, n_name FROM nation", "nation", "ALTER TABLE nation DROP COLUMN n_regionkey", "SELECT * FROM nation")
statements("st_rename_table", "SELECT r_regionkey, r_name FROM region", "region", "RENAME TABLE region TO zone", "SELECT r_regionkey, r_name FROM zone")
statements("st_databases", "SELECT r_regionkey FROM region", "region", "CREATE DATABASE other", "USE other", "CREATE TABLE t (id int)", "USE default", "DROP DATABASE other", "SELECT r_regionkey FROM region")
statements("st_optimize", "SELECT o_orderkey FROM orders", "orders", "OPTIMIZE orders", "SELECT o_orderkey FROM orders")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation")
def st_show_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are left after one is dropped, with their numbers of rows."""
    db = Session(spark, shared_path(spark, "db"))
    for n in ("nation", "region"):
        db.table(n).overwrite(tables(spark, sf_dir)(n))
    db.query("DROP TABLE region")
    return db.query("SHOW TABLES").select(F.col("table").alias("name"), F.col("rows").alias("n"))


@query("SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size > 40")
def sqlite_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQLite file, read in ranges of row ids. It is made here from a small table; it needs a shared folder that is a local one."""
    rows = tables(spark, sf_dir)("part").select("p_partkey", "p_size").filter("p_size > 40").toLocalIterator()
    place = shared_path(spark, "part.db")
    Files(spark).make(place.rpartition("/")[0])
    path = Files(spark).path(place).toUri().getPath()
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE part (p_partkey INTEGER, p_size INTEGER)")
    db.executemany("INSERT INTO part VALUES (?, ?)", (tuple(r) for r in rows))
    db.commit()
    db.close()
    return readers.import_file(spark, path, table="part")


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def cursor_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a DB-API cursor."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)")
    db.executemany("INSERT INTO region VALUES (?, ?)", [tuple(r) for r in tables(spark, sf_dir)("region").select("r_regionkey", "r_name").collect()])
    return readers.read_cursor(spark, db.execute("SELECT * FROM region"))


@query("SELECT 160 AS n, 3 AS changed")
def table_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers of one table at once: no row and no change is lost."""
    place = shared_path(spark, "table")
    Table(spark, place).overwrite(spark.range(100).selectExpr("id", "0L AS v"))

    def writer(w: int) -> None:
        t = Table(spark, place)
        for k in range(4):
            t.insert(spark.range(5).selectExpr(f"1000 * {w} + 10 * {k} + id AS id", "0L AS v"))
        t.update({"v": F.col("v") + 1}, F.col("id") == 0)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(writer, (1, 2, 3)))
    return Table(spark, place).df().agg(F.count("*").cast("int").alias("n"), F.max("v").cast("int").alias("changed"))


# searches

@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%bolt%' OR p_brand ILIKE '%bolt%' OR p_type ILIKE '%bolt%'")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.text_search(tables(spark, sf_dir)("part"), "BOLT").select("p_partkey", "p_name")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal > 0")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.distinct_values(tables(spark, sf_dir)("customer"), "c_mktsegment", F.col("c_acctbal") > 0)


@query("SELECT count(*) > 0 AS found FROM part WHERE p_size = 50")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.exists(tables(spark, sf_dir)("part"), F.col("p_size") == 50)
    return spark.range(1).select(F.lit(found).alias("found"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(tables(spark, sf_dir)("orders"), 3, 50, ["o_orderkey"]).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size = 10")
def find_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir)("part")
    return part.filter(search.matching(part, p_brand="Brand#11", p_size=10)).select("p_partkey")


# changes

@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN 'none' ELSE p_brand END AS p_brand FROM part")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir)("part").select("p_partkey", "p_size", "p_brand")
    return mutations.update(part, {"p_size": 0, "p_brand": "none"}, condition(part, "p_size > 40"))


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality <> 1")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for which the condition is null stay."""
    rows = compile_pipe("FROM documents | LEFT JOIN labels ON doc_id = doc_id | SELECT doc_id, quality", tables(spark, sf_dir))
    return mutations.delete(rows, condition(rows, "quality = 1"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_nationkey, 'N' || n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey + 100, 'N' || (n_nationkey + 100), NULL FROM nation WHERE n_nationkey < 5")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables(spark, sf_dir)("nation")
    few = nation.filter("n_nationkey < 5").select("n_nationkey")
    keys = few.union(few.select((F.col("n_nationkey") + 100).alias("n_nationkey")))
    return mutations.upsert(nation.select("n_nationkey", "n_name", "n_regionkey"), keys.select("n_nationkey", F.concat(F.lit("N"), "n_nationkey").alias("n_name")), "n_nationkey")


@query("SELECT r_regionkey, r_name, 1.5::DOUBLE AS weight FROM region")
def add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.add_column(tables(spark, sf_dir)("region"), "weight", "double", 1.5).select("r_regionkey", "r_name", "weight")


@query("SELECT n_nationkey, n_name AS title FROM nation")
def rename_and_drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables(spark, sf_dir)("nation").select("n_nationkey", "n_name", "n_regionkey")
    return mutations.drop_column(mutations.rename_column(nation, "n_name", "title"), "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.delete(tables(spark, sf_dir)("region").select("r_regionkey", "r_name"))


@query("SELECT c_custkey, c_acctbal + 10 AS c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 0 UNION ALL SELECT -1, 0")
def table_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, changed and read: insert, update, delete, one version after another."""
    t = Table(spark, shared_path(spark, "table"))
    t.overwrite(tables(spark, sf_dir)("customer").select("c_custkey", "c_acctbal"))
    now = t.df()
    t.update({"c_acctbal": expression(now, "c_acctbal + 10")}, condition(now, "c_acctbal >= 0"))
    t.delete(F.expr("c_acctbal < 0 and c_custkey % 2 <> 0"))
    t.insert({"c_custkey": -1, "c_acctbal": 0.0})
    return t.df()


# files

def _round_trip(kind: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = tables(spark, sf_dir)("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        path = shared_path(spark, f"export.{kind}")
        said = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("a \"b\", 'c'\n"), "c_name", F.lit("\nz"))).otherwise(F.col("c_name"))
        writers.export(rows.withColumn("c_name", said), path, table="customer")
        return readers.import_file(spark, path)

    return run


for _kind in ("csv", "json", "jsonl", "sql"):
    QUERIES[f"round_trip_{_kind}"] = _round_trip(_kind)
    ORACLE_SQL[f"round_trip_{_kind}"] = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN concat('a \"b\", ', chr(39), 'c', chr(39), chr(10), c_name, chr(10), 'z') ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer"


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE event_id END AS whole, event_id % 4 = 2 AS flag FROM events")
def dirty_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no number becomes null, text in a number's clothes a number."""
    dirty = F.when(F.col("event_id") % 4 == 0, " n/a ").when(F.col("event_id") % 4 == 1, "abc").when(F.col("event_id") % 4 == 2, F.concat("event_id", F.lit(".0"))).otherwise(F.col("event_id").cast("string"))
    flag = F.when(F.col("event_id") % 4 == 2, "Yes").otherwise("off")
    rows = tables(spark, sf_dir)("events").select("event_id", dirty.alias("d"), flag.alias("f"))
    return rows.select("event_id", scalars.cast_value(F.col("d"), scalars.TYPES["int64"]).alias("whole"), scalars.cast_value(F.col("f"), scalars.TYPES["bool"]).alias("flag"))
