"""Tables as sets of files, loads at once, kept states and refreshed chains."""

import random
import re
import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lakeops.operators import cdc, joins, layout, views
from lakeops.operators.merge import Clause, merge_into
from lakeops.sources import files as io
from lakeops.sources.commits import Commits
from lakeops.sources.filetable import FileTable
from lakeops.sources.history import History
from lakeops.streaming import stateful, streams

UPSERT = [Clause("delete", "s.v < 0"), Clause("update"), Clause("insert")]


def names(table, version=None):
    return {r.file: (r.low, r.high) for r in table.files(version).collect()}


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def target(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    return FileTable.create(rows, str(tmp_path / "t"), ["k"], 10)


def test_a_merge_keeps_the_files_it_does_not_touch(spark, target):
    before, rows = names(target), target.read()
    source = spark.createDataFrame([(150, 99), (155, -1), (2000, 5)], "k long, v long")
    change = target.merge(source, UPSERT)
    after = names(target)
    gone = set(before) - set(after)
    assert len(before) == 10 and [before[f][0] <= 150 <= before[f][1] for f in gone] == [True]
    assert set(before) - gone <= set(after)
    assert (change.version, change.kept, change.rewritten) == (2, 9, 1) and change.added == len(set(after) - set(before))
    assert content(target.read()) == content(merge_into(rows, source, ["k"], UPSERT))
    assert content(target.read(1)) == content(rows)


def test_files_in_range_without_the_key_are_kept(spark, tmp_path):
    even = spark.range(0, 1000, 2).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    table = FileTable.create(even, str(tmp_path / "t"), ["k"], 5)
    source = spark.createDataFrame([(k, 7) for k in (1, 301, 777)], "k long, v int")
    assert table.in_range(table.files(), source).count() == 3 and table.touched(source).count() == 0
    change = table.merge(source, UPSERT)
    assert (change.kept, change.rewritten) == (5, 0) and table.read().count() == 503


def test_range_pruning_equals_a_look_at_each_file(spark, target):
    r = random.Random(2)
    for _ in range(5):
        keys = [r.randrange(-50, 1100) for _ in range(r.choice([1, 3, 30]))]
        source = spark.createDataFrame([(k, 0) for k in keys], "k long, v long")
        got = {x.file for x in target.in_range(target.files(), source).collect()}
        assert got == {f for f, (a, b) in names(target).items() if any(a <= k <= b for k in keys)}


def test_null_keys_and_text_keys(spark, tmp_path):
    rows = [(None, 1, "x"), ("a", None, "y"), ("b", 2, "z"), ("c", 3, "w")]
    table = FileTable.create(spark.createDataFrame(rows, "a string, b int, v string"), str(tmp_path / "t"), ["a", "b"], 3)
    source = spark.createDataFrame([(None, 1, "X"), ("a", None, "Y"), ("d", 4, "new")], "a string, b int, v string")
    table.merge(source, [Clause("update"), Clause("insert")], null_safe=True)
    assert content(table.read()) == sorted([(None, 1, "X"), ("a", None, "Y"), ("b", 2, "z"), ("c", 3, "w"), ("d", 4, "new")], key=repr)


def test_an_empty_change_and_an_empty_table(spark, target, tmp_path):
    nothing = spark.createDataFrame([], "k long, v long")
    assert target.merge(nothing, UPSERT).version == 1
    empty = FileTable.create(nothing, str(tmp_path / "e"), ["k"])
    empty.merge(spark.createDataFrame([(1, 2)], "k long, v long"), UPSERT)
    assert content(empty.read()) == [(1, 2)]
    with pytest.raises(ValueError, match="there is a table"):
        FileTable.create(nothing, str(tmp_path / "e"), ["k"])


def test_a_change_with_a_note_is_made_once(spark, target):
    source = spark.createDataFrame([(1, 50)], "k long, v long")
    assert [target.merge(source, UPSERT, note="batch 7").version for _ in range(2)] == [2, 2]


def test_two_source_rows_are_refused(spark, target):
    with pytest.raises(Exception, match="Duplicate row"):
        target.merge(spark.createDataFrame([(1, 5), (1, 6)], "k long, v long"), UPSERT)
    assert target.commits.latest() == 1


def at_once(jobs):
    """Runs jobs in threads that start together; their results."""
    start, out = threading.Barrier(len(jobs)), [None] * len(jobs)

    def run(n):
        start.wait()
        out[n] = jobs[n]()

    threads = [threading.Thread(target=run, args=(n,)) for n in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_a_number_is_taken_once(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    assert sorted(at_once([lambda n=n: commits.put(1, str(n)) for n in range(6)])) == [False] * 5 + [True]
    assert commits.put(2, "two") and commits.numbers() == [1, 2] and commits.text(2) == "two"
    assert len(list((tmp_path / "c").glob(".*[!c]"))) == 0  # nothing is left beside them but checksums


def test_merges_at_once_are_put_one_after_the_other(spark, target):
    sources = [spark.createDataFrame([(k, 100 + k)], "k long, v long") for k in (5, 6, 995)]
    found = at_once([lambda s=s: target.merge(s, UPSERT).version for s in sources])
    assert sorted(found) == [2, 3, 4]
    assert content(target.read().where("v >= 100")) == [(5, 105), (6, 106), (995, 1095)]


def test_loads_at_once_lose_nothing_and_load_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(6):
        (tmp_path / f"in/{n}.csv").write_text("k,v\n" + "".join(f"{n * 10 + i},x\n" for i in range(5)))
    target, ledger = str(tmp_path / "t"), str(tmp_path / "ledger")
    load = lambda: io.copy_into(spark, str(tmp_path / "in"), io.FileFormat(), {"k": "int", "v": "string"}, target, ledger, "2030-01-01").count()
    assert sorted(at_once([load, load, load])) == [0, 0, 6]
    (tmp_path / "in/late.csv").write_text("k,v\n77,y\n")
    assert sorted(at_once([load, load])) == [0, 1]
    rows = io.committed(spark, target, ledger)
    assert sorted(r.k for r in rows.collect()) == sorted([n * 10 + i for n in range(6) for i in range(5)] + [77])
    assert len(list((tmp_path / "t").glob("load=*"))) == 2  # what the others wrote is gone


# States kept by streams.

FEED = "_action string, _is_update boolean, k int, v string, seq int"


def feed(spark, rows, path, n):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append" if n else "overwrite").parquet(path)


def changes_of(r, n):
    """Changes of keys in order, and the table that they lead to."""
    state, rows = {}, []
    for seq in range(n):
        k = r.randrange(12)
        if k in state and r.random() < 0.3:
            rows.append(("DELETE", False, k, state.pop(k), seq))
        elif k in state:
            rows.append(("DELETE", True, k, state[k], seq))
            state[k] = f"v{seq}"
            rows.append(("INSERT", True, k, state[k], seq))
        else:
            state[k] = f"v{seq}"
            rows.append(("INSERT", False, k, state[k], seq))
    return rows, sorted(state.items())


def test_changes_in_any_order_end_in_one_state(spark, tmp_path):
    r = random.Random(4)
    rows, want = changes_of(r, 80)
    r.shuffle(rows)
    path, out, ck = (str(tmp_path / n) for n in ("in", "t", "ck"))
    for n in range(7):  # compactions at every second batch
        feed(spark, rows[n::7], path, n)
        stateful.cdc_merge(spark.readStream.schema(FEED).parquet(path), out, "k int, v string", ["k"], "seq", ck, 2)
    assert content(stateful.merged(spark, out, "k int, v string", ["k"])) == sorted(want, key=repr)
    assert {p.name for p in (tmp_path / "t").glob("batch=*")} == {"batch=4", "batch=5", "batch=6"}


def test_a_stream_that_broke_off_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    """The sink fails after it has written, so the batch comes again; the state store gives what it gave."""
    r = random.Random(5)
    rows, want = changes_of(r, 60)
    path, out, ck = (str(tmp_path / n) for n in ("in", "t", "ck"))
    run = lambda: stateful.cdc_merge(spark.readStream.schema(FEED).parquet(path), out, "k int, v string", ["k"], "seq", ck, 2)
    feed(spark, rows[:30], path, 0)
    run()
    feed(spark, rows[30:], path, 1)
    whole = stateful.latest
    for number in (1, 2):
        feed(spark, [("INSERT", False, 100 + number, "x", 1000)], path, number)

        def broken(*args, number=number):
            raise OSError("no more")

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", after(DataFrameWriter.parquet, f"{out}/batch={number}", broken))
            with pytest.raises(Exception, match="no more"):
                run()
        run()
    assert whole is stateful.latest
    assert content(stateful.merged(spark, out, "k int, v string", ["k"])) == sorted([*want, (101, "x"), (102, "x")], key=repr)


def after(write, path, then):
    def both(self, at, *args, **kwargs):
        write(self, at, *args, **kwargs)
        if at == path:
            then()

    return both


def test_windows_of_time_are_updated_and_closed(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "t", "ck"))
    shape = "sensor string, at timestamp, v int"
    batches = [
        [("a", "2024-01-01 00:10:00", 3), ("a", "2024-01-01 00:50:00", 5), ("b", "2024-01-01 01:10:00", None)],
        [("a", "2024-01-01 00:20:00", 1), ("b", "2024-01-01 05:00:00", 2)],  # the first is late, but not too late
        [("a", "2024-01-01 00:30:00", 100), ("a", "2024-01-01 05:01:00", 4)],  # the first is too late
    ]
    schema = stateful.rolled_schema({"sensor": "string"}, {"v": "long"}, "1 hour")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "sensor string, at string, v int").withColumn("at", F.col("at").cast("timestamp")).write.mode("append" if n else "overwrite").parquet(path)
        stateful.sensor_rollup(spark.readStream.schema(shape).parquet(path), out, {"sensor": "string"}, {"v": "long"}, ck, "at", "1 hour", "1 hour")
    got = stateful.latest(spark, out, schema, ["sensor", "window_start", "window_end"])
    assert sorted((r.sensor, r.window_start.hour, r.n, r.cnt_v, r.sum_v, r.min_v, r.max_v) for r in got.collect()) == [("a", 0, 3, 3, 9, 1, 5), ("a", 5, 1, 1, 4, 4, 4), ("b", 1, 1, 0, None, None, None), ("b", 5, 1, 1, 2, 2, 2)]


def test_keys_that_fall_silent_are_told_once(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("in", "t", "ck"))
    batches = [
        [("a", 0), ("a", 50), ("b", 10), ("c", 60), (None, 5)],
        [("a", 400), ("c", 100)],  # a was down from 150 and is back; b is down from 110
        [("b", 450), ("d", 460)],
        [("d", 2000)],  # all others are down
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "sensor string, s long").select("sensor", F.timestamp_seconds("s").alias("at")).write.mode("append" if n else "overwrite").parquet(path)
        stream = stateful.silences(spark.readStream.schema("sensor string, at timestamp").parquet(path), "sensor", "at", 100)
        streams.drained(stream, ck, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    got = [(r.key, r.status, r.t) for r in spark.read.parquet(out).select("key", "status", F.unix_seconds("at").alias("t")).collect()]
    want = [("a", "DOWN", 150), ("a", "UP", 400), ("a", "DOWN", 500), ("b", "DOWN", 110), ("b", "UP", 450), ("b", "DOWN", 550), ("c", "DOWN", 200), ("d", "DOWN", 560), ("d", "UP", 2000), (None, "DOWN", 105)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# Views refreshed from deltas.


def random_delta(r, rows, n):
    """Some of the rows taken away and some new ones, and the rows after it."""
    gone = r.sample(rows, min(len(rows), n))
    new = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(8)])) for _ in range(n)]
    left = list(rows)
    for x in gone:
        left.remove(x)
    return [(*x, -1) for x in gone] + [(*x, 1) for x in new], left + new


def extremes(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    out = []
    for k, vs in groups.items():
        some = [v for v in vs if v is not None]
        out.append((k, len(vs), len(set(some)), min(some, default=None), max(some, default=None)))
    return sorted(out, key=repr)


def test_extremes_and_distinct_values_follow_deltas(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(8)])) for _ in range(25)]
    view = views.ExtremesView.create(spark.createDataFrame(rows, "k string, v int"), str(tmp_path / "v"), ["k"], "v", 2)
    assert content(view.read()) == extremes(rows)
    for n in (3, 12, 6):
        before = content(view.read())
        changes, rows = random_delta(r, rows, n)
        delta = view.apply(spark.createDataFrame(changes, "k string, v int, _sign long"))
        assert content(view.read()) == extremes(rows)
        signs = {tuple(x[:-1]): x[-1] for x in map(tuple, delta.collect())}
        assert sorted([x for x in before if signs.get(x) != -1] + [x for x, s in signs.items() if s == 1], key=repr) == extremes(rows)
    view.apply(spark.createDataFrame([(*x, -1) for x in rows], "k string, v int, _sign long"))
    assert content(view.read()) == []


def test_taking_away_what_is_not_there_is_refused(spark, tmp_path):
    view = views.ExtremesView.create(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "v"), ["k"], "v")
    with pytest.raises(Exception, match="taken away more often"):
        view.apply(spark.createDataFrame([("a", 2, -1)], "k string, v int, _sign long"))


def test_only_groups_that_lost_their_extreme_are_read_again(spark, tmp_path, monkeypatch):
    rows = [(k, v) for k in "abcd" for v in range(10)]
    view = views.ExtremesView.create(spark.createDataFrame(rows, "k string, v int"), str(tmp_path / "v"), ["k"], "v", 4)
    again = []
    whole = FileTable.rows_with
    monkeypatch.setattr(FileTable, "rows_with", lambda self, changed, version=None, on=(): (again.extend(x.k for x in changed.select("k").collect()) if on else None) or whole(self, changed, version, on))
    view.apply(spark.createDataFrame([("a", 9, -1), ("b", 5, -1), ("c", 42, 1)], "k string, v int, _sign long"))
    assert again == ["a"]
    assert content(view.read()) == [("a", 9, 9, 0, 8), ("b", 9, 9, 0, 9), ("c", 11, 11, 0, 42), ("d", 10, 10, 0, 9)]


STEPS = {
    "sums": views.Summed("orders", ("c",), ("v",)),
    "large": views.Filtered("sums", "sum_v > 20", {"c": "c", "total": "sum_v"}),
    "named": views.Joined("large", "customers", ("c",)),
    "by_city": views.Summed("named", ("city",), ("total",)),
    "range": views.Extremes("named", ("city",), "total"),
    "top": views.Computed(("by_city",), lambda t: t.orderBy(F.desc("sum_total"), "city").limit(1), ("city",)),
}


def chain_of(spark, tmp_path, name="chain"):
    orders = FileTable.create(spark.range(200).select(F.col("id").alias("o"), (F.col("id") % 20).alias("c"), (F.col("id") % 7).cast("int").alias("v")), str(tmp_path / f"{name}-o"), ["o"], 5)
    customers = FileTable.create(spark.range(20).select(F.col("id").alias("c"), F.concat(F.lit("city "), F.col("id") % 3).alias("city")), str(tmp_path / f"{name}-c"), ["c"], 2)
    return orders, customers, views.Chain(spark, str(tmp_path / name), {"orders": orders, "customers": customers}, STEPS, 3)


def recomputed(orders, customers):
    """All steps by plain queries."""
    sums = orders.read().groupBy("c").agg(F.sum("v").alias("total")).where("total > 20")
    named = sums.join(customers.read(), "c")
    city = named.groupBy("city").agg(F.count("*").alias("n"), F.sum("total").alias("s"), F.count_distinct("total").alias("d"), F.min("total").alias("lo"), F.max("total").alias("hi"))
    return sorted((r.city, r.n, r.s, r.d, r.lo, r.hi) for r in city.collect())


def kept(chain):
    sums = {r.city: (r.n, r.sum_total) for r in chain.read("by_city").collect()}
    ends = {r.city: (r.n_distinct, r.least, r.most) for r in chain.read("range").collect()}
    assert [tuple(r)[:3] for r in chain.read("top").collect()] == sorted(((c, *x) for c, x in sums.items()), key=lambda x: (-x[2], x[0]))[:1]
    return sorted((c, *x, *ends[c]) for c, x in sums.items())


def test_a_chain_refreshed_from_deltas_equals_recomputation(spark, tmp_path):
    orders, customers, chain = chain_of(spark, tmp_path)
    assert kept(chain) == recomputed(orders, customers)
    orders.merge(spark.createDataFrame([(7, 7, 60), (300, 8, 5), (11, 0, -1)], "o long, c long, v int"), [Clause("delete", "s.v < 0"), Clause("update"), Clause("insert")])
    customers.merge(spark.createDataFrame([(3, "elsewhere")], "c long, city string"), [Clause("update")])
    stale = kept(chain)
    assert stale != recomputed(orders, customers)
    how = chain.refresh()
    assert how == {**dict.fromkeys(STEPS, "delta"), "top": "made anew"}
    assert kept(chain) == recomputed(orders, customers)
    assert set(chain.refresh().values()) == {"unchanged"}


def test_a_refresh_touches_the_files_of_changed_groups_only(spark, tmp_path):
    orders, _, chain = chain_of(spark, tmp_path)
    sums = chain.views["sums"].table
    before = names(sums)
    orders.merge(spark.createDataFrame([(4, 4, 1)], "o long, c long, v int"), [Clause("update")])
    chain.refresh()
    gone = set(before) - set(names(sums))
    assert len(before) == 3 and [before[f][0] <= 4 <= before[f][1] for f in gone] == [True]


def test_a_refresh_that_broke_off_is_begun_anew(spark, tmp_path, monkeypatch):
    orders, customers, chain = chain_of(spark, tmp_path)
    orders.merge(spark.createDataFrame([(7, 7, 60)], "o long, c long, v int"), [Clause("update")])

    def broken(self, delta):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr(views.ExtremesView, "apply", broken)
        with pytest.raises(OSError, match="no more"):
            chain.refresh()
    orders.merge(spark.createDataFrame([(8, 8, 70)], "o long, c long, v int"), [Clause("update")])
    chain.refresh()
    assert kept(chain) == recomputed(orders, customers)


# Past states from snapshots.

LOG = "version int, ts timestamp, stmt_id string, op string, k long, v string"


def random_log(spark, r, versions):
    rows, live = [], set()
    for version in versions:
        for k in r.sample(range(30), r.choice([0, 1, 6])):
            op = r.choice("UD") if k in live else "I"
            (live.discard if op == "D" else live.add)(k)
            rows.append((version, f"2024-01-{version:02} 00:00:00", f"Q{version}", op, k, f"v{version}"))
    return spark.createDataFrame(rows, LOG.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))


def test_past_states_equal_the_whole_log(spark, tmp_path):
    log = random_log(spark, random.Random(6), range(1, 18)).cache()
    kept = History.create(log, str(tmp_path / "h"), ["k"], ["v"], 5, 3)
    for low, high in ((1, 3), (4, 11), (12, 17)):
        kept.append(log.where(F.col("version").between(low, high)))
    assert sorted(kept._marks()) == [0, 5, 10, 15]
    for version in (0, 1, 4, 5, 6, 10, 13, 15, 17, 99):
        assert content(kept.as_of(version)) == content(cdc.state_at(log, version, ["k"], ["v"])), version
    plan = kept.as_of(13)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^]]*range#\d+L? >= 2\), \(range#\d+L? <= 2\)", plan)) == 2  # no range before the snapshot at 10, none after 13
    with pytest.raises(ValueError, match="comes after"):
        kept.append(log.where("version = 17"))
    assert kept.expire(12) == [0, 1]
    for version in (10, 12, 17):
        assert content(kept.as_of(version)) == content(cdc.state_at(log, version, ["k"], ["v"]))
    with pytest.raises(ValueError, match="older than what is kept"):
        kept.as_of(9)
    assert kept.expire(12) == []


def test_a_file_that_two_versions_share_is_kept(spark, target):
    target.merge(spark.createDataFrame([(5, 50)], "k long, v long"), UPSERT)
    target.merge(spark.createDataFrame([(995, 50)], "k long, v long"), UPSERT)
    rows = content(target.read())
    assert target.expire(3) == 2 and content(target.read()) == rows and target.commits.numbers() == [3]


# Joins in order, and layouts by several columns.


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of_join_equals_brute_force(spark, parts):
    """One key has most of the rows, so that it goes on over ranges; ties, gaps, nulls, and facts before any version."""
    r = random.Random(parts)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    facts = [(n, key(), r.choice([None, *range(60)])) for n in range(300)]
    dims = [(key(), r.choice([None, *range(60)]), r.choice([None, *range(20, 80)]), n) for n in range(40)]
    f = spark.createDataFrame(facts, "f int, k string, t int")
    d = spark.createDataFrame(dims, "k string, since int, until int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = content(joins.join_as_of_sorted(f, d, "k", "t", "since", "until"))
        kept = content(joins.join_as_of_sorted(f, d, "k", "t", "since", "until", how="inner"))
        open_ended = content(joins.join_as_of_sorted(f, d.drop("until"), "k", "t", "since").select("f", "since"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for n, k, t in facts:
        mine = [x for x in dims if x[0] == k is not None and x[1] is not None and t is not None and x[1] <= t]
        last = max((x[1] for x in mine), default=None)
        ends = {(x[2] is not None, x[2] or 0) for x in mine if x[1] == last}
        best = [x for x in mine if x[1] == last and (x[2] is not None, x[2] or 0) == max(ends)]
        want.append((n, k, t, [x[1:] for x in best if x[2] is None or t < x[2]]))
    assert [x[0] for x in sorted(got)] == [w[0] for w in want]
    for x, (_, _, _, choices) in zip(sorted(got), want, strict=True):
        assert x[3:] in choices if choices else x[3:] == (None, None, None)
    assert kept == [x for x in got if x[5] is not None]
    assert {n: s for n, s in open_ended} == {n: max((x[1] for x in dims if x[0] == k is not None and x[1] is not None and t is not None and x[1] <= t), default=None) for n, k, t in facts}


def test_bits_are_interleaved_by_rank(spark):
    df = spark.createDataFrame([(a * a * a, b) for a in range(16) for b in range(16)] + [(None, 3)], "a long, b int")
    got = {(x.a, x.b): x.z for x in df.select("a", "b", layout.interleaved(df, ["a", "b"], 4).alias("z")).collect()}
    assert got[None, 3] == min(z for (a, b), z in got.items() if b == 3)
    a_rank = {a: sorted({x for x, _ in got if x is not None}).index(a) for a, _ in got if a is not None}
    quarter = lambda i, j: [z for (a, b), z in got.items() if a is not None and a_rank[a] // 8 == i and b // 8 == j]
    assert max(quarter(0, 0)) < min(quarter(1, 1))
    assert len({z for (a, _), z in got.items() if a is not None}) >= 200


def test_bloom_filters_miss_no_file_and_few_are_wrong(spark, tmp_path):
    path, index = str(tmp_path / "d"), str(tmp_path / "i")
    rows = spark.range(4000).select((F.col("id") * 7).alias("v"), F.lit(1).alias("x"))
    rows.where("v < 14000").repartitionByRange(5, "v").write.parquet(path)
    assert layout.extend_bloom(spark, path, index, "v", 2) == 5
    rows.where("v >= 14000").repartitionByRange(5, "v").write.mode("append").parquet(path)
    assert layout.extend_bloom(spark, path, index, "v", 2) == 5
    assert layout.extend_bloom(spark, path, index, "v", 2) == 0
    values = [*range(0, 28000, 700), *range(1, 28000, 700)]  # the first are there, the others aren't
    found = {}
    for r in layout.bloom_files(spark.read.parquet(index), values, 2).collect():
        found.setdefault(int(r.value), set()).add(r.file.rsplit("/", 1)[1])
    held = {}
    for r in spark.read.parquet(path).where(F.col("v").isin(values)).select("v", F.input_file_name().alias("f")).collect():
        held.setdefault(r.v, set()).add(r.f.rsplit("/", 1)[1])
    assert all(held[v] <= found[v] for v in held) and len(held) == 40
    assert sum(len(f - held.get(v, set())) for v, f in found.items()) <= 8  # of 80 * 10
    assert sorted(r.v for r in layout.rows_by_bloom(spark, index, "v", [700, 1401, 27300], 2).collect()) == [700, 27300]
    merged = spark.read.parquet(index).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("file", F.lit("all"))
    assert {int(r.value) for r in layout.bloom_files(merged, values, 2).collect()} >= set(held)


@pytest.mark.parametrize("n", [3, 5000])
def test_bloom_filters_are_made_without_a_sort_of_rows(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 3).cast("string").alias("f"))
    made = layout.bloom_index(rows, F.col("id"), F.col("f"), 2)
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    bucket, bits = layout._bloom_places(F.col("id"), 2, 5)
    want = rows.select(F.col("f").alias("file"), bucket.alias("bucket"), F.explode(bits).alias("bit")).groupBy("file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    both = [{(r.file, r.bucket): bytes(r.bits) for r in x.collect()} for x in (made, want)]
    assert both[0] == both[1] and both[0]
