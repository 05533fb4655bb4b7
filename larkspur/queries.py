"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import dml as D
from larkspur.operators import relational as R
from larkspur.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None, *tables: str):
    """Register a function of the named tables."""

    def wrap(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: f(*([spark] if not tables else []), *[load(spark, d, t) for t in tables])
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return f

    return wrap


# scans and sources

@query("SELECT * FROM orders", "orders")
def seq_scan(o):
    return R.seq_scan(o)

@query("SELECT * FROM orders WHERE o_orderkey = 4242", "orders")
def index_point_lookup(o):
    return R.index_scan(o, ["o_orderkey"], (4242,), (4242,))

@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900", "orders")
def index_range_scan(o):
    return R.index_scan(o, ["o_orderkey"], (100,), (900,)).select("o_orderkey", "o_custkey", "o_totalprice")

@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 900", "orders")
def index_range_exclusive(o):
    return R.index_scan(o, ["o_orderkey"], (100,), (900,), False, False).select("o_orderkey", "o_totalprice")

@query("SELECT NULLIF(o_custkey, 7) AS k, o_orderkey FROM orders WHERE o_custkey >= 5 AND o_custkey <> 7", "orders")
def index_range_unbounded(o):
    keyed = o.select(F.nullif(c("o_custkey"), lit(7)).alias("k"), "o_orderkey")
    return R.index_scan(keyed, ["k"], (5,), None)

@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE
    (l_orderkey > 50 OR (l_orderkey = 50 AND l_linenumber >= 2)) AND (l_orderkey < 90 OR (l_orderkey = 90 AND l_linenumber < 4))""", "lineitem")
def index_composite_range(l):
    return R.index_scan(l, ["l_orderkey", "l_linenumber"], (50, 2), (90, 4), True, False).select("l_orderkey", "l_linenumber", "l_quantity")

@query("SELECT * FROM (VALUES (1, 25), (2, 50), (3, NULL)) AS t(id, age)")
def values_inline(spark):
    return R.values(spark, [(1, 25), (2, 50), (3, None)], "id int, age int")

@query("SELECT 1 + 2 AS three, TRUE AS yes, CAST(NULL AS INTEGER) AS nothing")
def select_without_from(spark):
    return spark.sql("SELECT 1 + 2 AS three, TRUE AS yes, CAST(NULL AS INT) AS nothing")


# filters and scalar expressions

def _filter(name: str, predicate, sql: str) -> None:
    QUERIES[name] = lambda spark, d: R.filter_rows(load(spark, d, "lineitem"), predicate()).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    SQL[name] = f"SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE {sql}"

_filter("filter_eq", lambda: c("l_quantity") == 17, "l_quantity = 17")
_filter("filter_neq", lambda: c("l_returnflag") != "N", "l_returnflag <> 'N'")
_filter("filter_lt", lambda: c("l_quantity") < 5, "l_quantity < 5")
_filter("filter_lte", lambda: c("l_quantity") <= 5, "l_quantity <= 5")
_filter("filter_gt", lambda: c("l_quantity") > 45, "l_quantity > 45")
_filter("filter_gte", lambda: c("l_quantity") >= 45, "l_quantity >= 45")
_filter("filter_and_or", lambda: ((c("l_quantity") > 40) & (c("l_discount") > 0.05)) | (c("l_linestatus") == "F"), "(l_quantity > 40 AND l_discount > 0.05) OR l_linestatus = 'F'")
_filter("filter_in", lambda: c("l_linenumber").isin(2, 4, 6), "l_linenumber IN (2, 4, 6)")

@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' OR p_name LIKE 'part_1%'", "part")
def filter_like(p):
    return R.filter_rows(p, c("p_type").like("%A%") | c("p_name").like("part_1%")).select("p_partkey", "p_type")

@query("""SELECT n_nationkey, (NULLIF(n_regionkey, 0) > 1 AND NULLIF(n_nationkey, 3) > 5) AS both_true,
    (NULLIF(n_regionkey, 0) > 1 OR NULLIF(n_nationkey, 3) > 5) AS either_true, NULLIF(n_regionkey, 0) = 2 AS eq FROM nation""", "nation")
def expr_3vl(n):
    a, b = F.nullif(c("n_regionkey"), lit(0)), F.nullif(c("n_nationkey"), lit(3))
    return R.project(n, "n_nationkey", ((a > 1) & (b > 5)).alias("both_true"), ((a > 1) | (b > 5)).alias("either_true"), (a == 2).alias("eq"))

@query("SELECT l_orderkey, l_linenumber + 3 AS plus, l_linenumber - 10 AS minus, l_linenumber * 7 AS times FROM lineitem", "lineitem")
def expr_arith_int(l):
    n = c("l_linenumber")
    return R.project(l, "l_orderkey", (n + 3).alias("plus"), (n - 10).alias("minus"), (n * 7).alias("times"))

@query("""SELECT l_orderkey, ROUND(l_extendedprice * (1 - l_discount), 4) AS net, ROUND(l_quantity + l_tax, 4) AS plus,
    ROUND(l_quantity - l_discount, 4) AS minus FROM lineitem""", "lineitem")
def expr_arith_float(l):
    return R.project(l, "l_orderkey", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net"), F.round(c("l_quantity") + c("l_tax"), 4).alias("plus"), F.round(c("l_quantity") - c("l_discount"), 4).alias("minus"))

@query("SELECT p_partkey, CAST((10 - p_size) // 3 AS INTEGER) AS quotient FROM part", "part")
def expr_int_div(p):
    return R.project(p, "p_partkey", S.int_div(10 - c("p_size"), lit(3)).alias("quotient"))

@query("SELECT p_partkey, ROUND(p_retailprice / p_size, 6) AS quotient FROM part", "part")
def expr_float_div(p):
    return R.project(p, "p_partkey", F.round(c("p_retailprice") / c("p_size"), 6).alias("quotient"))


# projections

@query("SELECT c_name, c_custkey FROM customer", "customer")
def project_columns(t):
    return R.project(t, "c_name", "c_custkey")

@query("SELECT c_custkey * 2 AS twice, c_acctbal > 0 AS positive, 7 AS seven FROM customer", "customer")
def project_exprs(t):
    return R.project(t, (c("c_custkey") * 2).alias("twice"), (c("c_acctbal") > 0).alias("positive"), lit(7).alias("seven"))

@query("SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def project_star_join(n, r):
    return R.index_join(n, r, "n_regionkey", "r_regionkey").select("*")


# aggregates

@query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", "lineitem")
def agg_count_star(l):
    return R.aggregate(l, ["l_returnflag"], F.count(lit(1)).alias("n"))

@query("SELECT user_id, COUNT(NULLIF(event_type, 'error')) AS n, COUNT(*) AS n_all FROM events GROUP BY user_id", "events")
def agg_count_col(e):
    v = F.nullif(c("event_type"), lit("error"))
    return R.aggregate(e, ["user_id"], F.count(v).alias("n"), S.count_all(v).alias("n_all"))

@query("SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(SUM(NULLIF(l_linenumber, 1)) AS BIGINT) AS s_null FROM lineitem GROUP BY l_returnflag", "lineitem")
def agg_sum(l):
    return R.aggregate(l, ["l_returnflag"], F.sum("l_linenumber").alias("s"), F.sum(F.nullif(c("l_linenumber"), lit(1))).alias("s_null"))

@query("SELECT event_type, ROUND(AVG(value), 6) AS mean FROM events GROUP BY event_type", "events")
def agg_avg(e):
    return R.aggregate(e, ["event_type"], F.round(F.avg("value"), 6).alias("mean"))

@query("SELECT p_brand, CAST(SUM(p_size - 30) // COUNT(p_size) AS INTEGER) AS mean FROM part GROUP BY p_brand", "part")
def agg_avg_int_trunc(p):
    return R.aggregate(p, ["p_brand"], S.trunc_avg(c("p_size") - 30).alias("mean"))

@query("SELECT l_suppkey, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last, MIN(l_quantity) AS low, MAX(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey", "lineitem")
def agg_min_max(l):
    return R.aggregate(l, ["l_suppkey"], F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.min("l_quantity").alias("low"), F.max("l_returnflag").alias("flag"))

@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem")
def agg_group_multi(l):
    return R.aggregate(l, ["l_returnflag", "l_linestatus"], F.count(lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))

@query("SELECT l_linenumber * 2 + 1 AS g, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber * 2 + 1", "lineitem")
def agg_group_expr(l):
    return R.aggregate(l, [(c("l_linenumber") * 2 + 1).alias("g")], F.count(lit(1)).alias("n"))

@query("SELECT NULLIF(event_type, 'error') AS g, COUNT(*) AS n FROM events GROUP BY 1", "events")
def agg_group_null(e):
    return R.aggregate(e, [F.nullif(c("event_type"), lit("error")).alias("g")], F.count(lit(1)).alias("n"))

@query("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MAX(l_quantity) AS top FROM lineitem", "lineitem")
def agg_global(l):
    return R.aggregate(l, [], F.count(lit(1)).alias("n"), F.sum("l_linenumber").alias("s"), F.max("l_quantity").alias("top"))

@query("SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity < 0", "lineitem")
def agg_empty_global(l):
    return R.aggregate(l.filter(c("l_quantity") < 0), [], F.count(lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))

@query("SELECT l_linestatus, CAST(SUM(l_linenumber) + 10 * COUNT(*) AS BIGINT) AS mix FROM lineitem GROUP BY l_linestatus", "lineitem")
def agg_expr_over_agg(l):
    return R.aggregate(l, ["l_linestatus"], (F.sum("l_linenumber") + 10 * F.count(lit(1))).alias("mix"))

@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 25", "orders")
def agg_order_by_agg(o):
    return R.top_k(R.aggregate(o, ["o_custkey"], F.count(lit(1)).alias("n")), 25, c("n").desc(), c("o_custkey"))


# joins

@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey", "nation", "region")
def nlj_inner_theta(n, r):
    return R.nested_loop_join(n, r, c("n_regionkey") > c("r_regionkey")).select("n_name", "r_name")

@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey < r_regionkey AND n_nationkey > 4", "nation", "region")
def nlj_left_theta(n, r):
    return R.nested_loop_join(n, r, (c("n_regionkey") < c("r_regionkey")) & (c("n_nationkey") > 4), "left").select("n_name", "r_name")

@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "supplier", "nation")
def nlj_inner_equi(s, n):
    return R.nested_loop_join(s, n, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")

@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey", "supplier", "nation")
def nlj_left_equi(s, n):
    return R.nested_loop_join(s, n.filter("n_regionkey = 1"), c("s_nationkey") == c("n_nationkey"), "left").select("s_suppkey", "n_name")

@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def index_join_inner(o, t):
    return R.index_join(o, t, "o_custkey", "c_custkey").select("o_orderkey", "c_name")

@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey", "orders", "customer")
def index_join_left(o, t):
    return R.index_join(o, t.filter("c_acctbal > 0"), "o_custkey", "c_custkey", "left").select("o_orderkey", "c_name")

@query("SELECT l_orderkey, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "lineitem", "orders")
def hash_join_inner(l, o):
    return R.hash_join(l, o, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "l_quantity", "o_custkey")

@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", "orders", "lineitem")
def hash_join_left(o, l):
    return R.hash_join(o, l, [("o_orderkey", "l_orderkey")], "left").select("o_orderkey", "l_linenumber", "l_quantity")

@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber""", "lineitem")
def hash_join_multikey(l):
    b = l.select(c("l_orderkey").alias("k1"), c("l_partkey").alias("k2"), c("l_linenumber").alias("k3"), "l_quantity")
    return R.hash_join(l.drop("l_quantity"), b, [("l_orderkey", "k1"), ("l_partkey", "k2"), ("l_linenumber", "k3")]).select("l_orderkey", "l_linenumber", "l_quantity")

@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 0) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 0)", "nation")
def hash_join_null_safe(n):
    key = F.nullif(c("n_regionkey"), lit(0))
    a, b = n.select(c("n_name").alias("left_name"), key.alias("a")), n.select(c("n_name").alias("right_name"), key.alias("b"))
    return R.hash_join(a, b, [("a", "b")], null_safe=True).select("left_name", "right_name")

@query("SELECT o_orderkey, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45", "orders", "lineitem")
def left_join_where(o, l):
    return R.hash_join(o, l, [("o_orderkey", "l_orderkey")], "left").filter("l_quantity > 45").select("o_orderkey", "l_quantity")

@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
def self_join(n):
    a, b = n.alias("a"), n.alias("b")
    return R.nested_loop_join(a, b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("n1"), c("b.n_name").alias("n2"))


# sorts and limits

@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey", "orders")
def sort_multi_key(o):
    return R.sort(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderdate", "o_orderkey")

@query("SELECT p_partkey, p_size FROM part ORDER BY p_size * -1, p_partkey", "part")
def sort_expr(p):
    return R.sort(p, c("p_size") * -1, c("p_partkey")).select("p_partkey", "p_size")

@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey", "customer")
def sort_unprojected_key(t):
    return R.project(R.sort(t, "c_acctbal", "c_custkey"), "c_custkey")

@query("SELECT * FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber", "lineitem")
def external_sort(l):
    return R.sort(l, "l_shipdate", "l_orderkey", "l_linenumber")

@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100", "orders")
def limit_n(o):
    return R.limit(R.sort(o, "o_orderkey"), 100).select("o_orderkey")

@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
def topk(o):
    return R.top_k(o.select("o_orderkey", "o_totalprice"), 20, c("o_totalprice").desc(), c("o_orderkey"))


# windows

def _window(name: str, keys: str, by: list[str], order: list[str], sql: str, **columns: str) -> None:
    def run(spark, d):
        e = load(spark, d, "events").withColumn("v", F.pmod(c("event_id"), lit(97)))
        return R.window_columns(e.select("event_id", "user_id", "event_type", "ts", "v"), by, order, **columns).drop("ts")

    QUERIES[name] = run
    over = f"OVER ({'PARTITION BY ' + ', '.join(by) if by else ''} {'ORDER BY ' + ', '.join(x + ' NULLS FIRST' for x in order) if order else ''})"
    SQL[name] = f"SELECT event_id, user_id, event_type, v, {sql.replace('OVER', over)} FROM (SELECT *, event_id % 97 AS v FROM events)"

_window("window_sum_running", "", ["user_id"], ["v"], "CAST(SUM(v) OVER AS BIGINT) AS s", s="sum:v")
_window("window_sum_partition", "", ["event_type"], [], "CAST(SUM(v) OVER AS BIGINT) AS s", s="sum:v")
_window("window_count", "", ["user_id"], ["v"], "COUNT(*) OVER AS n", n="count:*")
_window("window_avg", "", ["user_id"], ["v"], "AVG(v) OVER AS m", m="avg:v")
_window("window_min_max", "", ["user_id"], ["ts", "event_id"], "MIN(v) OVER AS low, MAX(v) OVER AS high", low="min:v", high="max:v")
_window("window_rank", "", ["user_id"], ["v"], "RANK() OVER AS r", r="rank:")
_window("window_multi", "", ["user_id"], ["v"], "CAST(SUM(v) OVER AS BIGINT) AS s, COUNT(v) OVER AS n, AVG(v) OVER AS m, RANK() OVER AS r", s="sum:v", n="count:v", m="avg:v", r="rank:")

_window("window_global_running", "", [], ["v"], "CAST(SUM(v) OVER AS BIGINT) AS s, COUNT(*) OVER AS n, AVG(v) OVER AS m, MIN(event_id) OVER AS low, MAX(event_id) OVER AS high, RANK() OVER AS r", s="sum:v", n="count:*", m="avg:v", low="min:event_id", high="max:event_id", r="rank:")
_window("window_global_total", "", [], [], "CAST(SUM(v) OVER AS BIGINT) AS s, COUNT(v) OVER AS n, AVG(v) OVER AS m, MIN(v) OVER AS low, MAX(v) OVER AS high", s="sum:v", n="count:v", m="avg:v", low="min:v", high="max:v")

@query("SELECT event_id, CAST(SUM(event_id % 97) OVER (ORDER BY ts, event_id) AS BIGINT) AS s FROM events", "events")
def window_global(e):
    e = e.withColumn("v", F.pmod(c("event_id"), lit(97)))
    return R.global_running_sum(e, ["ts", "event_id"], "v", "s").select("event_id", "s")


# changes

@query("SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (25, 'ATLANTIS', 4), (25, 'ATLANTIS', 4), (26, NULL, NULL)) AS t(a, b, c)", "nation")
def insert_rows(n):
    return D.insert_rows(n, R.values(n.sparkSession, [(25, "ATLANTIS", 4), (25, "ATLANTIS", 4), (26, None, None)], "a int, b string, c int"))

@query("SELECT n_nationkey, n_name, CASE WHEN NULLIF(n_regionkey, 0) > 2 THEN n_regionkey * 10 ELSE n_regionkey END AS n_regionkey FROM nation", "nation")
def update_rows(n):
    return D.update_rows(n, {"n_regionkey": c("n_regionkey") * 10}, F.nullif(c("n_regionkey"), lit(0)) > 2)

@query("SELECT CASE WHEN n_nationkey < 10 THEN n_regionkey ELSE n_nationkey END AS n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation", "nation")
def update_swap(n):
    return D.update_rows(n, {"n_nationkey": c("n_regionkey"), "n_regionkey": c("n_nationkey")}, c("n_nationkey") < 10)

@query("SELECT * FROM nation WHERE NOT COALESCE(NULLIF(n_regionkey, 0) > 2, FALSE)", "nation")
def delete_rows(n):
    return D.delete_rows(n, F.nullif(c("n_regionkey"), lit(0)) > 2)


def _ddl(name: str, script: str, last: str, sql: str) -> None:
    def run(spark, d):
        from larkspur.plans.catalog import Catalog
        from larkspur.plans.frontend import Frontend

        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        front = Frontend(Catalog(spark, f"{shared}/larkspur_{name}"))
        front.run(script)
        return front.run(last)[-1].rows

    QUERIES[name], SQL[name] = run, sql

_USERS = "CREATE TABLE IF NOT EXISTS users_x (id INT, age INT); INSERT INTO users_x VALUES (1, 25), (2, 50), (2, NULL);"
_ddl("create_table", _USERS.replace("users_x", "users_a"), "SELECT id, age FROM users_a", "SELECT * FROM (VALUES (1, 25), (2, 50), (2, NULL)) AS t(id, age)")
_ddl("drop_table", _USERS.replace("users_x", "users_b") + "DROP TABLE users_b; CREATE TABLE users_b (id INT, ok BOOL)", "SELECT id, ok FROM users_b", "SELECT 1 AS id, TRUE AS ok WHERE FALSE")
_ddl("create_index", _USERS.replace("users_x", "users_c") + "CREATE INDEX by_age ON users_c (age, id); UPDATE users_c SET age = age + 1 WHERE id = 2", "SELECT id, age FROM users_c WHERE age >= 25", "SELECT * FROM (VALUES (1, 25), (2, 51)) AS t(id, age)")
_ddl("drop_index", _USERS.replace("users_x", "users_d") + "CREATE INDEX by_age ON users_d (age); DROP INDEX by_age; DELETE FROM users_d WHERE age = 25", "SELECT id, age FROM users_d", "SELECT * FROM (VALUES (2, 50), (2, NULL)) AS t(id, age)")


@query("""SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price
    FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", "lineitem")
def pricing_summary(l):
    kept = R.filter_rows(R.seq_scan(l, ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"]), c("l_quantity") > 10)
    sums = R.aggregate(kept, ["l_returnflag", "l_linestatus"], F.count(lit(1)).alias("n"), F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))
    return R.sort(sums, "l_returnflag", "l_linestatus")


# extensions: what SQL text may say here and the classic surface leaves out

def _text(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query given as SQL text, run by the front end's own path over temp views."""

    def run(spark, d):
        for t in tables.split():
            load(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name], SQL[name] = run, oracle or sql

_text("ext_order_desc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 10")
_text("ext_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_text("ext_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_text("ext_three_way_join", "lineitem orders customer", "SELECT c_mktsegment, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment")
_text("ext_semi_join", "orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
_text("ext_anti_join", "orders lineitem", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_text("ext_full_join", "supplier nation", "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_nationkey < 5) s FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 2) n ON s_nationkey = n_nationkey")
_text("ext_set_operations", "nation region", "SELECT n_regionkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2 UNION ALL SELECT 99")
_text("ext_window_sql", "events", "SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events", "SELECT event_id, user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS n, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
_text("ext_cte_subquery", "orders", "WITH big AS (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(top) FROM big)")
_text("ext_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
