"""NULL-heavy fixtures with hand-made answers, strategies against each other, and the SQL front end."""

import io

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import dml as D
from larkspur.operators import relational as R
from larkspur.plans.catalog import Catalog, CatalogError
from larkspur.plans.frontend import Frontend, split_statements
from larkspur.plans.shell import loop
from larkspur.sources.tables import render


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def kv(spark):
    return spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 3)], "k string, v int")


def test_window_nulls_first_and_peers(kv):
    got = R.window_columns(kv, ["k"], ["v"], s="sum:v", r="rank:")
    assert rows(got) == sorted([("a", None, None, 1), ("a", 1, 2, 2), ("a", 1, 2, 2), ("b", 3, 3, 1)], key=repr)


def test_window_without_order(kv):
    assert rows(R.window_columns(kv, ["k"], [], s="sum:v", r="rank:")) == sorted([("a", None, 2, 1), ("a", 1, 2, 1), ("a", 1, 2, 1), ("b", 3, 3, 1)], key=repr)


def test_global_running_sum_equals_window(spark):
    df = spark.range(500).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"))
    got = R.global_running_sum(df, ["k"], "v", "s")
    want = R.window_columns(df, [], ["k"], s="sum:v")
    assert rows(got.select("k", "v", "s")) == rows(want.select("k", "v", "s"))


def test_truncation(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (7, -2)], "a int, b int")
    assert [r[0] for r in df.select(S.int_div(F.col("a"), F.col("b"))).collect()] == [-3, 3, -3]
    assert df.agg(S.trunc_avg(F.col("b"))).collect()[0][0] == 0
    assert df.filter("a > 99").agg(S.trunc_avg(F.col("b"))).collect()[0][0] is None


def test_null_safe_and_plain_join(kv):
    other = kv.select(F.col("k").alias("k2"), F.col("v").alias("v2"))
    assert R.hash_join(kv, other, [("k", "k2"), ("v", "v2")]).count() == 5
    assert R.hash_join(kv, other, [("k", "k2"), ("v", "v2")], null_safe=True).count() == 6


def test_join_strategies_agree(kv, monkeypatch):
    other = kv.select(F.col("k").alias("k2"), F.col("v").alias("v2"))
    small = rows(R.index_join(kv, other, "v", "v2", "left"))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(R.small, "__defaults__", (0,))
    assert small == rows(R.index_join(kv, other, "v", "v2", "left")) == rows(R.hash_join(kv, other, [("v", "v2")], "left"))


def test_update_is_bag_and_snapshot(kv):
    assert rows(D.update_rows(kv, {"v": F.col("v") + 1}, F.col("v") >= 1)) == sorted([("a", 2), ("a", 2), ("a", None), ("b", 4)], key=repr)
    assert rows(D.delete_rows(kv, F.col("v") == 1)) == sorted([("a", None), ("b", 3)], key=repr)
    with pytest.raises(TypeError):
        D.insert_rows(kv, kv.select("v", "k"))


def test_index_scan_leaves_out_null_keys(kv):
    assert R.index_scan(kv, ["v"]).count() == 3
    assert R.index_scan(kv, ["k", "v"], ("a", 1), ("b", 3), high_in=False).count() == 2


@pytest.fixture
def front(spark, tmp_path):
    return Frontend(Catalog(spark, f"file://{tmp_path}"))


def test_script(front):
    tags = [r.tag for r in front.run("CREATE TABLE t (id INT4, ok BOOL, f FLOAT4); -- note; here\nINSERT INTO t VALUES (1, true, 1.5), (2, NULL, NULL); INSERT INTO t (ok, id) VALUES (false, 3); UPDATE t SET id = id + 10 WHERE ok; DELETE FROM t WHERE id = 2")]
    assert tags == ["CREATE TABLE t", "INSERT 2", "INSERT 1", "UPDATE 1", "DELETE 1"]
    assert rows(front.run("SELECT * FROM t")[0].rows) == [(11, True, 1.5), (3, False, None)]


def test_strict_types_and_missing_names(front):
    front.run("CREATE TABLE t (id INT, ok BOOLEAN)")
    for bad in ("INSERT INTO t VALUES (1, 2)", "INSERT INTO t VALUES (1)", "CREATE TABLE t (id INT)", "DROP TABLE nope", "DROP INDEX nope", "CREATE INDEX i ON t (nope)", "CREATE TABLE u (x VARCHAR)", "MERGE INTO t"):
        with pytest.raises(CatalogError):
            front.run(bad)
    assert front.run("DROP TABLE IF EXISTS nope; CREATE TABLE IF NOT EXISTS t (id INT)")[-1].tag == "CREATE TABLE t"


def test_statement_split():
    assert split_statements("SELECT ';' ; /* a;b */ SELECT 1 -- x;\n;") == ["SELECT ';'", "SELECT 1"]


def test_shell(front):
    out = io.StringIO()
    loop(front, ["CREATE TABLE s (id INT);\n", "INSERT INTO s\n", "VALUES (1);\n", "SELECT * FROM s;\n", "SELECT nope FROM s;\n", "\\q\n", "SELECT 2;\n"], out)
    said = out.getvalue()
    assert "INSERT 1" in said and "1 row" in said and "error:" in said and "2" not in said.split("error:")[1].split("\n")[-1]


def test_render(kv):
    assert render(kv, 2).endswith("first 2 rows")


def test_explain_pushes_filters(spark):
    df = R.index_scan(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), ["o_orderkey"], (5,), (9,)).select("o_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_streaming_windows_equal_batch(spark, tmp_path):
    from larkspur.streaming.incremental import windowed_aggregate

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    agg = windowed_aggregate(stream, "ts", "1 day", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"))
    q = agg.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert rows(spark.table("daily")) == rows(want)


def test_join_hints_agree(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey")
    l = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_quantity")
    want = rows(R.hash_join(o, l, [("o_orderkey", "l_orderkey")], "left"))
    for hint in ("merge", "broadcast", "shuffle_hash"):
        assert rows(o.join(l.hint(hint), F.col("o_orderkey") == F.col("l_orderkey"), "left")) == want


def test_external_sort_order(spark):
    df = spark.createDataFrame([(3, None), (1, 2.0), (None, 1.0), (1, None)], "a int, b double")
    assert [tuple(r) for r in R.sort(df, "a", "b").collect()] == [(None, 1.0), (1, None), (1, 2.0), (3, None)]
    assert [tuple(r) for r in R.sort(df, "a", "b", nulls_first=False).collect()] == [(1, 2.0), (1, None), (3, None), (None, 1.0)]


def test_index_rewrite_orders_table(front):
    front.run("CREATE TABLE o (k INT, v INT); INSERT INTO o VALUES (3, 1), (1, 2), (2, NULL); CREATE INDEX i ON o (k)")
    assert [r["k"] for r in front.catalog.read("o").coalesce(1).collect()] == [1, 2, 3]
    assert front.catalog.table("o").version == 2
    front.run("DROP INDEX i; DROP TABLE o")
    with pytest.raises(CatalogError):
        front.run("DELETE FROM o")


def test_update_types_are_strict(front):
    front.run("CREATE TABLE s (id INT, f FLOAT, ok BOOLEAN); INSERT INTO s VALUES (1, 2.5, true)")
    for bad in ("id = 1.5", "ok = 1", "f = 1", "nope = 1", "id = 'x'"):
        with pytest.raises(CatalogError):
            front.run(f"UPDATE s SET {bad}")
    front.run("UPDATE s SET id = id * 2 + 1, f = f * 2, ok = NULL")
    assert rows(front.run("SELECT * FROM s")[0].rows) == [(3, 5.0, None)]


def test_halloween_and_old_row(front):
    front.run("CREATE TABLE h (a INT, b INT); INSERT INTO h VALUES (1, 2), (3, 4); UPDATE h SET a = b, b = a; UPDATE h SET a = a + 100 WHERE a < 1000")
    assert rows(front.run("SELECT * FROM h")[0].rows) == [(102, 1), (104, 3)]


def test_qualified_names_and_append(front):
    front.run("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (2, 2), (3, NULL)")
    before = front.catalog.table("t").paths
    assert len(before) == 2  # a second INSERT leaves the first one's folder alone
    assert front.run("UPDATE t SET t.b = t.a + 10 WHERE t.a = 1")[0].tag == "UPDATE 1"
    assert front.run("DELETE FROM t WHERE t.b IS NULL")[0].tag == "DELETE 1"
    assert rows(front.run("SELECT t.a, t.b FROM t")[0].rows) == [(1, 11), (2, 2)]
    assert front.run("UPDATE t SET a = 0 WHERE t.a > 99; DELETE FROM t WHERE a > 99")[-1].tag == "DELETE 0"


def test_only_touched_files_are_rewritten(front):
    front.run("CREATE TABLE f (a INT); INSERT INTO f VALUES (1); INSERT INTO f VALUES (2); INSERT INTO f VALUES (3)")
    old = set(front.catalog.read("f").inputFiles())
    front.run("UPDATE f SET a = 20 WHERE a = 2")
    assert len(old & set(front.catalog.read("f").inputFiles())) == len(old) - 1
    assert rows(front.run("SELECT a FROM f")[0].rows) == [(1,), (20,), (3,)]
    assert front.catalog.vacuum("f") == 1 and rows(front.run("SELECT a FROM f")[0].rows) == [(1,), (20,), (3,)]


def test_constraints_hold_or_raise(front):
    front.run("CREATE TABLE k (id INT PRIMARY KEY, b INT NOT NULL, c INT UNIQUE, d INT); CREATE TABLE m (a INT, b INT, UNIQUE (a, b)); INSERT INTO k VALUES (1, 1, NULL, 1), (2, 1, NULL, 1); INSERT INTO m VALUES (1, 1), (1, 2), (1, NULL), (1, NULL)")
    for bad in ("INSERT INTO k VALUES (1, 5, 5, 5)", "INSERT INTO k VALUES (3, 1, 7, 1), (3, 1, 8, 1)", "INSERT INTO k VALUES (NULL, 1, 1, 1)", "INSERT INTO k (id) VALUES (9)", "UPDATE k SET id = 7", "UPDATE k SET b = NULL WHERE id = 1", "INSERT INTO m VALUES (1, 2)", "CREATE TABLE x (a INT CHECK (a > 1))", "CREATE TABLE x (a INT DEFAULT 3)", "CREATE TABLE x (a INT, FOREIGN KEY (a) REFERENCES k (id))", "CREATE TABLE x (a INT, PRIMARY KEY (nope))"):
        with pytest.raises(CatalogError):
            front.run(bad)
    front.run("UPDATE k SET id = id + 1, d = NULL; INSERT INTO k VALUES (1, 1, 5, NULL)")
    assert rows(front.run("SELECT id FROM k")[0].rows) == [(1,), (2,), (3,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_left_theta_join_is_not_broadcast(spark, kv, monkeypatch):
    other = kv.select(F.col("k").alias("k2"), F.col("v").alias("v2"))
    on = (F.col("v") < F.col("v2")) | (F.col("k2") == "zz")
    want = rows(R.nested_loop_join(kv, other, on, "left"))
    monkeypatch.setattr(R.small, "__defaults__", (0,))
    got = R.nested_loop_join(kv, other, on, "left")
    assert rows(got) == want and got.columns == ["k", "v", "k2", "v2"] and "BroadcastNestedLoop" not in plan_of(got)


def test_large_hash_joins_may_spill(spark):
    wide = spark.range(1 << 40).select(F.col("id").alias("a"), F.col("id").alias("x"))
    huge = spark.range(1 << 40).select(F.col("id").alias("b"), F.col("id").alias("y"))
    assert "SortMergeJoin" in plan_of(R.hash_join(wide, huge, [("a", "b")]))
    assert "SortMergeJoin" in plan_of(R.index_join(wide, huge, "a", "b"))


def test_global_windows_equal_windows(spark):
    df = spark.range(300).select(F.when(F.col("id") % 11 > 0, F.col("id") % 37).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") * 7 % 50).alias("v"))
    what = dict(s="sum:v", n="count:v", a="count:*", m="avg:v", low="min:v", high="max:v", r="rank:")
    for order in (["k"], ["k", "v"], []):
        got = R.window_columns(df, [], order, **what)
        want = R.window_columns(df.withColumn("one", F.lit(1)), ["one"], order, **what).drop("one")
        assert rows(got.select(want.columns)) == rows(want)
        assert "SinglePartition" not in plan_of(got).split("BroadcastExchange")[0] or not order
