"""Operators that write, raise or stream, and properties that SQL doesn't show."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from lakeops.functions import scalar as fn
from lakeops.operators import cdc, history, joins, layout, merge, model
from lakeops.operators.aggregates import running_sum, surrogate_key
from lakeops.plans import inputs, relational
from lakeops.plans.inputs import orders_log
from lakeops.sources import files as io
from lakeops.streaming import streams

SF = "/root/testdata/sf0.001"
KEYS, COLS = ["o_orderkey"], ["o_custkey", "o_orderstatus", "price"]


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


@pytest.mark.parametrize("v_from,v_to", [(1, 4), (2, 6), (3, 7)])
def test_net_changes_lead_from_state_to_state(spark, v_from, v_to):
    log = orders_log(spark, SF)
    delta = cdc.net_changes(log, v_from, v_to, KEYS, COLS)
    assert same(merge.apply_changes(cdc.state_at(log, v_from, KEYS, COLS), delta, KEYS), cdc.state_at(log, v_to, KEYS, COLS))


def test_two_source_rows_for_a_target_row_are_refused(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(Exception, match="Duplicate row detected"):
        merge.merge_into(target, source, ["k"], [merge.Clause("update")]).collect()
    apart = spark.createDataFrame([(2, "b"), (2, "c")], "k int, v string")
    assert merge.merge_into(target, apart, ["k"], [merge.Clause("insert")]).count() == 3


def test_soft_delete_matches_null_keys_and_comes_back(spark):
    target = spark.createDataFrame([(None, 1, "x", "N"), (2, 1, "y", "Y")], "a int, b int, v string, deleted_ind string")
    feed = spark.createDataFrame([("DELETE", False, None, 1, "x"), ("INSERT", False, 2, 1, "z")], "_action string, _is_update boolean, a int, b int, v string")
    out = {(r.a, r.v, r.deleted_ind) for r in merge.soft_delete_merge(target, feed, ["a", "b"]).collect()}
    assert out == {(None, "x", "Y"), (2, "z", "N")}


def test_not_in_with_a_null_gives_nothing(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert joins.anti_join(left, spark.createDataFrame([(1,), (None,)], "j int"), "k", "j", null_aware=True).count() == 0
    assert joins.anti_join(left, spark.createDataFrame([(1,)], "j int"), "k", "j", null_aware=True).collect()[0].k == 2
    assert joins.anti_join(left, spark.createDataFrame([], "j int"), "k", "j", null_aware=True).count() == 3


def test_overdrawn_transfers_change_nothing(spark):
    accounts = spark.createDataFrame([(1, 10), (2, 5)], "account_id int, balance int")
    good = spark.createDataFrame([(1, 2, 4)], "source int, target int, amount int")
    bad = spark.createDataFrame([(1, 2, 4), (2, 1, 50)], "source int, target int, amount int")
    assert {(r.account_id, int(r.balance), r.applied) for r in merge.balanced_transfer(accounts, good).collect()} == {(1, 6, True), (2, 9, True)}
    assert {(r.account_id, int(r.balance), r.applied) for r in merge.balanced_transfer(accounts, bad).collect()} == {(1, 10, False), (2, 5, False)}


def test_calendar(spark):
    rows = model.dim_date(spark, "2020-01-01", "2030-12-31").collect()
    assert len(rows) == 4018 and len(rows[0]) == 21
    day = next(r for r in rows if r.full_date == datetime.date(2024, 2, 29))
    assert (day.date_key, day.quarter, day.month_name, day.is_weekend, day.quarter_end) == (20240229, 1, "February", False, datetime.date(2024, 3, 31))


def test_run_order(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")], "task string, after string")
    assert {r.task: r.level for r in history.task_graph_run_order(edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_range_filter_reaches_the_scan(spark, capsys):
    spark.read.parquet(f"{SF}/orders.parquet").where(fn.month_range("o_orderdate", 1997)).explain("formatted")
    assert "GreaterThanOrEqual(o_orderdate" in capsys.readouterr().out


def test_distance(spark):
    row = spark.range(1).select(fn.geo_distance(*map(F.lit, (2.3522, 48.8566, -0.1276, 51.5072))).alias("m")).first()
    assert abs(row.m - 343_900) < 1500


def test_copy_into_loads_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "in/b.csv").write_text("k,v\n3,z\nbad,w\n")
    args = (spark, str(tmp_path / "in"), io.FileFormat(), {"k": "int", "v": "string"}, str(tmp_path / "t"), str(tmp_path / "ledger"), "2030-01-01")
    first = {r.file.rsplit("/", 1)[1]: (r.status, r.row_count, r.error_count) for r in io.copy_into(*args).collect()}
    assert first == {"a.csv": ("LOADED", 2, 0), "b.csv": ("PARTIALLY_LOADED", 1, 1)}
    assert io.copy_into(*args).count() == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_error_policies(spark):
    rows = spark.createDataFrame([("f", "1"), ("f", "x"), ("g", "2"), ("g", "3")], "_file string, k string")
    count = lambda p: io.on_error(rows, {"k": "int"}, p).count()
    assert (count("CONTINUE"), count("SKIP_FILE"), count("SKIP_FILE_2"), count("SKIP_FILE_40%"), count("SKIP_FILE_60%")) == (3, 2, 3, 2, 3)
    with pytest.raises(ValueError):
        io.on_error(rows, {"k": "int"}, "ABORT")


def test_source_types():
    schema = io.map_source_types([("a", "serial"), ("b", "numeric"), ("c", "numeric(10,2)"), ("d", "bytea"), ("e", "interval"), ("f", "jsonb")])
    assert [f.dataType.simpleString() for f in schema] == ["int", "decimal(38,6)", "decimal(10,2)", "binary", "string", "variant"]


def test_file_stream_loads_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k\n1\n2\n")
    run = lambda: streams.file_ingest_stream(spark, str(tmp_path / "in"), {"k": "int"}, str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in/b.csv").write_text("k\n3\nbad\n")
    run()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_skipped_files_are_tried_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "in/b.csv").write_text("k,v\n3,z\nbad,w\n4,q\n")
    target, ledger = str(tmp_path / "t"), str(tmp_path / "ledger")
    load = lambda at: {r.file.rsplit("/", 1)[1]: (r.status, r.row_count, r.error_count, r.load) for r in io.copy_into(spark, str(tmp_path / "in"), io.FileFormat(), {"k": "int", "v": "string"}, target, ledger, at, "SKIP_FILE").collect()}
    assert load("2030-01-01") == {"a.csv": ("LOADED", 2, 0, 1), "b.csv": ("LOAD_FAILED", 0, 1, 1)}
    assert load("2030-01-02") == {"b.csv": ("LOAD_FAILED", 0, 1, 2)}
    spark.createDataFrame([(9, "half")], "k int, v string").write.parquet(f"{target}/load=3")  # a load that broke off
    (tmp_path / "in/b.csv").write_text("k,v\n3,z\n4,q\n")
    assert load("2030-01-03") == {"b.csv": ("LOADED", 2, 0, 3)}
    assert sorted(r.k for r in io.committed(spark, target, ledger).collect()) == [1, 2, 3, 4]


def test_files_of_bounded_size(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS v")
    io.unload(df, str(tmp_path / "u"), "csv", max_file_bytes=20_000, header="true")
    files = [p.stat().st_size for p in (tmp_path / "u").glob("part-*")]
    assert max(files) <= 20_000 and len(files) < 40
    assert spark.read.option("header", "true").csv(str(tmp_path / "u")).count() == 5000


def test_wrong_number_of_columns_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5\n")
    read = lambda strict: io.read_files(spark, str(tmp_path / "a.csv"), io.FileFormat(column_count=strict), "a int, b int").collect()
    assert len(read(False)) == 2
    with pytest.raises(Exception, match="wrong number of columns"):
        read(True)


def test_types_of_texts(spark):
    rows = spark.createDataFrame([("1", "1.5", "2024-01-01", "2024-01-01 10:00:00", "true", "x", None), ("-2", "2", "2024-02-01", "2024-01-01 11:00:00", "false", "1", None), (None, "3", None, None, None, "2", None)], "a string, b string, c string, d string, e string, f string, g string")
    got = [(r.column_name, r.type, r.nullable) for r in io.infer_schema(rows).orderBy("ordinal").collect()]
    assert got == [("a", "bigint", True), ("b", "double", False), ("c", "date", True), ("d", "timestamp", True), ("e", "boolean", True), ("f", "string", False), ("g", "string", True)]


@pytest.mark.parametrize("kind", ["bigint", "double", "boolean"])
def test_texts_are_looked_at_before_a_cast(spark, kind):
    texts = ["1", "0", "-12", "+7", " 5\t", "\x7f5\x00", "17.0", " -1.5 ", "5.", ".5", "1e5", "+1E-5", "1d", "2.5F", "Infinity", "-inf", "+INF", "nan", "NaN", "0x1p3", "0x1.8P-1d", "\t7\n"]
    texts += ["", " ", ".", "+", "e5", "1e", "1995-01-01", "true", " TRUE", "f", "Yes", "no ", "yess", "N", "x", "--1", "1_0", "infinite", "1 2", "0x1", "1dd", "\u0661", "\u00a05"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    looks, cast = F.col("v").rlike(io._LOOKS[kind]), F.col("v").try_cast(kind).isNotNull()
    assert rows.where(cast).count() >= 7
    assert rows.where(cast & ~looks).count() == 0  # nothing that fits is left out
    assert rows.where(looks & ~cast).count() == 0  # nothing else of these comes to the cast
    plan = io.infer_schema(rows)._jdf.queryExecution().optimizedPlan().toString()
    casts = [x for x in plan.split("count(")[1:] if f"as {kind}" in x.lower()]
    assert casts and all("RLIKE" in x for x in casts)


@pytest.mark.parametrize("name", ["a12", "a13", "a16"])
def test_joins_of_many_rows_are_dealt_by_rows(spark, monkeypatch, name):
    query, sf = getattr(relational, name), "/root/testdata/sf0.001"
    want = sorted(map(str, query(spark, sf).collect()))
    monkeypatch.setattr(inputs, "TASK_ROWS", 600, raising=False)  # 6,000 lines: 10 tasks
    df = query(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 10\)", plan) and not re.search(r"hashpartitioning\(l_(order|part)key#\d+L,? [^)]*\b4\)", plan)
    assert sorted(map(str, df.collect())) == want


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_and_dense_keys_over_ranges(spark, parts):
    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id % 5 AS v").repartition(parts)
    want = 0
    for r in running_sum(rows, [F.col("k")], ["v"]).orderBy("k").collect():
        want += r.v
        assert r.sum_v == want
    assert [r.sk for r in surrogate_key(rows, [F.col("k")]).orderBy("k").collect()] == list(range(1, 1001))


def test_overlaps_equal_brute_force(spark):
    import random

    r = random.Random(4)
    zones = [(c, f"f{i}", float(low), float(low + r.randrange(6))) for c in ("a", "b") for i in range(40) for low in [r.randrange(30)]]
    found = {(x.column_name, x.file): (x.overlaps, x.depth) for x in layout.overlaps(spark.createDataFrame(zones, "column_name string, file string, low double, high double")).collect()}
    for c, f, low, high in zones:
        others = [(b, e) for k, g, b, e in zones if k == c and g != f]
        assert found[c, f] == (sum(b <= high and e >= low for b, e in others), 1 + sum(b <= low <= e for b, e in others))


def test_null_keys_keep_one_version(spark):
    dim = merge.scd2_init(spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string"), ["k"], ["v"], "2025-01-01")
    src = spark.createDataFrame([(None, "a"), (1, "c")], "k int, v string")
    once = merge.scd2_merge(dim, src, ["k"], ["v"], "2025-02-01")
    assert once.count() == 3 and merge.scd2_merge(once, src, ["k"], ["v"], "2025-03-01").count() == 3
    feed = spark.createDataFrame([("INSERT", True, None, "z"), ("DELETE", True, None, "a"), ("DELETE", False, 1, "b"), ("INSERT", False, 5, "n")], "_action string, _is_update boolean, k int, v string")
    out = sorted(((r.k, r.v, r.is_current) for r in merge.scd2_apply_changes(dim, feed, ["k"], ["v"], "2025-02-01").collect()), key=str)
    assert out == sorted([(None, "a", False), (None, "z", True), (1, "b", False), (5, "n", True)], key=str)


def test_states_and_merges_sort_no_log(spark):
    """No sort-based aggregation in change capture and merges."""
    log = orders_log(spark, SF)
    for df in (cdc.state_at(log, 7, KEYS, COLS), cdc.net_changes(log, 1, 7, KEYS, COLS), cdc.diff_snapshots(cdc.state_at(log, 1, KEYS, COLS), cdc.state_at(log, 7, KEYS, COLS), KEYS, COLS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_changes_merge_batch_by_batch(spark, tmp_path):
    schema = "k int, v string"
    feed = "_action string, _is_update boolean, k int, v string, seq int"
    path, run = str(tmp_path / "in"), lambda: streams.cdc_stream_merge(spark.readStream.schema(feed).parquet(str(tmp_path / "in")), str(tmp_path / "t"), schema, ["k"], str(tmp_path / "ck"), "seq")
    spark.createDataFrame([("INSERT", False, 1, "a", 1), ("INSERT", False, 2, "b", 2), ("DELETE", True, 1, "a", 3), ("INSERT", True, 1, "b", 3), ("DELETE", True, 1, "b", 4), ("INSERT", True, 1, "c", 4)], feed).write.parquet(path)
    run()
    assert sorted(map(tuple, streams.latest_state(spark, str(tmp_path / "t"), schema).collect())) == [(1, "c"), (2, "b")]
    spark.createDataFrame([("DELETE", False, 2, "b", 5), ("INSERT", False, 2, "n", 6), ("DELETE", False, 1, "c", 7)], feed).write.mode("append").parquet(path)
    run()
    run()
    assert sorted(map(tuple, streams.latest_state(spark, str(tmp_path / "t"), schema).collect())) == [(2, "n")]


def test_layered_stream_over_batches(spark, tmp_path):
    go = lambda: streams.medallion_stream(spark, str(tmp_path / "b"), "sensor string, v double", str(tmp_path / "s"), str(tmp_path / "g"), str(tmp_path / "ck"), lambda d: d.where("v IS NOT NULL"), ["sensor"], ["v"], "sensor string, n long, sum_v double, cnt_v long")
    gold = lambda: sorted(map(tuple, streams.latest_state(spark, str(tmp_path / "g"), "sensor string, n long, sum_v double, cnt_v long").collect()))
    for n, rows in enumerate(([("s1", 1.0), ("s1", 3.0), ("s2", None)], [("s1", 2.0), ("s2", 5.0)], [("s2", 1.0)])):
        spark.createDataFrame(rows, "sensor string, v double").write.mode("append" if n else "overwrite").parquet(str(tmp_path / "b"))
        go()
    assert gold() == [("s1", 3, 6.0, 3), ("s2", 2, 6.0, 2)]


def test_row_stream_writes_each_offset_once(spark, tmp_path):
    shape = "channel string, offset long, v string"
    run = lambda: streams.row_ingest_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "o"), str(tmp_path / "ck"))
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], shape).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("a", 2, "again"), ("a", 3, "w")], shape).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r.channel, r.offset, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "w"), ("b", 1, "z")]


def test_gates(spark):
    some, none = spark.range(3), spark.range(0)
    assert streams.gate([some, none], need_all=False) and not streams.gate([some, none], need_all=True) and streams.gate([some, some], need_all=True)
