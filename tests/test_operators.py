"""Operators on hand-made rows: nulls, ties, late data."""

import datetime as dt
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not

from __spark_entry__ import queries
from sprucelake.operators.groups import gap_filled, sessions, top_per_group, two_step
from sprucelake.operators.joins import asof_join, band_join, join_small, salted_join
from sprucelake.operators.vectors import nearest, nearest_in_blocks
from sprucelake.plans.relational import sketches_checked
from sprucelake.plans.streams import rocks_db
from sprucelake.sources.row_groups import RowGroups, push_filters
from sprucelake.streaming import events as E

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_asof_ties_nulls_tolerance(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(1)), (3, "b", at(9)), (4, None, at(5)), (5, "a", at(30)), (6, "a", None), (7, None, None)], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(5), 7), ("a", at(5), 9), ("a", at(2), 1), ("b", at(10), 3), ("a", None, 4), (None, at(1), 8)], "k string, u timestamp_ntz, v int")
    rows = {r.i: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert rows == {1: 9, 2: None, 3: None, 4: None, 5: 9, 6: None, 7: None}
    near = {r.i: r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], tolerance="3 hours").collect()}
    assert near[1] == 9 and near[5] is None


def test_asof_of_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", at(5), 3)], "l int, k0 string, t timestamp_ntz, side int")
    right = spark.createDataFrame([("a", at(4), 7)], "k0 string, t timestamp_ntz, r int")
    out = asof_join(left, right, ["k0"], "t", "t", ["r"])
    assert out.columns == ["l", "k0", "t", "side", "r"] and [tuple(r) for r in out.collect()] == [(1, "a", at(5), 3, 7)]
    with pytest.raises(ValueError):
        asof_join(left, right.withColumn("side", F.lit(1)), ["k0"], "t", "t", ["side"])


def test_asof_keeps_every_left_row(spark):
    rng = random.Random(1)
    left = [(i, rng.randint(0, 3), at(rng.randint(0, 50))) for i in range(200)]
    right = [(rng.randint(0, 3), at(rng.randint(0, 50)), j) for j in range(100)]
    out = asof_join(spark.createDataFrame(left, "i int, k int, t timestamp_ntz"), spark.createDataFrame(right, "k int, u timestamp_ntz, v int"), ["k"], "t", "u", ["v"])
    expected = {i: max(((u, v) for kk, u, v in right if kk == k and u <= t), default=(None, None))[1] for i, k, t in left}
    assert {r.i: r.v for r in out.collect()} == expected


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-50, 50)) for i in range(150)]
    bands = [(j, lo, lo + rng.uniform(0, 30)) for j in range(40) for lo in [rng.uniform(-60, 50)]]
    out = band_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(bands, "j int, lo double, hi double"), "p", "lo", "hi", 7.0)
    assert sorted((r.i, r.j) for r in out.collect()) == sorted((i, j) for i, p in points for j, lo, hi in bands if lo <= p <= hi)


@pytest.mark.parametrize("join", [lambda a, b: salted_join(a, b, ["k"], 5), lambda a, b: join_small(a, b, ["k"]), lambda a, b: join_small(a, b, ["k"], most_rows=1)])
def test_joins_of_hot_and_null_keys(spark, join):
    a = [(1 if i % 3 else i, i) for i in range(90)] + [(None, 99)]
    b = [(k, f"v{k}") for k in range(40)] + [(None, "none"), (1, "again")]
    out = join(spark.createDataFrame(a, "k int, i int"), spark.createDataFrame(b, "k int, v string"))
    assert sorted((r.k, r.i, r.v) for r in out.collect()) == sorted((k, i, v) for k, i in a for kk, v in b if k is not None and k == kk)


def test_top_two_step_gaps_sessions(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, None), ("b", 1, 1.0), (None, 1, 2.0)], "k string, i int, v double")
    top = top_per_group(df, ["k"], [F.desc_nulls_last("v"), F.col("i")], 1).collect()
    assert sorted((r.k or "", r.i) for r in top) == [("", 1), ("a", 1), ("b", 1)]
    assert {r.k: r.s for r in two_step(df, ["k"], {"s": F.col("v")}).collect()} == {"a": 10.0, "b": 1.0, None: 2.0}
    hours = spark.createDataFrame([("a", at(0), 1), ("a", at(3), 4), ("b", at(2), 9)], "k string, t timestamp_ntz, n int")
    assert [(r.k, r.t, r.n) for r in gap_filled(hours, ["k"], "t", "1 hour", ["n"]).orderBy("k", "t").collect()] == [("a", at(0), 1), ("a", at(1), 1), ("a", at(2), 1), ("a", at(3), 4), ("b", at(2), 9)]
    visits = spark.createDataFrame([("a", at(h)) for h in (0, 1, 3, 3, 10)], "k string, t timestamp_ntz")
    assert [r.session for r in sessions(visits, ["k"], "t", "2 hours").orderBy("t").collect()] == [0, 0, 1, 1, 2]


def test_nearest_refuses_unbounded_queries(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert nearest(v.where("vec_id < 2"), v, 2).count() == 4
    with pytest.raises(ValueError):
        nearest(v, v, 2, most_queries=3)


def test_nearest_in_blocks_equals_one_block(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "vec_id long, embedding array<float>").repartition(3)
    rows = lambda df: sorted((r.query_id, r.vec_id, r.cosine, r["rank"]) for r in df.collect())
    assert rows(nearest_in_blocks(v, v, 3, block=7)) == rows(nearest(v, v, 3)) and len(rows(nearest(v, v, 3))) == 120
    assert nearest_in_blocks(v.where("false"), v, 3).count() == 0


def test_nearest_query_set(spark, sf):
    asked = {r.query_id for r in queries()["nearest_vectors"](spark, sf).collect()}
    assert asked == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    row = lambda i, h: (i, at(h), 1, "click", 1.0, "{}")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    write = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/events-{name}.parquet")
    write("1", [row(1, 0), row(2, 13)])
    stream = E.tumbling(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/events-*.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 minutes"))
    out = lambda: stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    out()
    write("2", [row(3, 1), row(4, 14), row(5, 40)])  # row 3 comes twelve hours late
    out()
    rows = {r.start: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows[at(0)] == 1 and rows[at(12)] == 2 and at(36) not in rows


@pytest.fixture
def event_files(spark, tmp_path):
    """Two files of events, read one a batch, with users in both, in one, and two sessions over both."""
    schema = E.SCHEMA
    rows = [(1, at(0), 1), (2, at(1), 1), (3, at(0), 2), (4, at(2), 1), (5, at(9), 1), (6, at(10), 3), (7, at(30), 3)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame([(i, t, u, "click", 1.0, "{}") for i, t, u in part], schema).coalesce(1).write.parquet(f"{tmp_path}/events-{n}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events-*.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 minutes")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_update_stream_over_several_batches(event_files):
    out = E.run_batches(E.running_counts(event_files), "two", "update", ["user_id"])
    assert {r.user_id: r.n for r in out.collect()} == {1: 4, 2: 1, 3: 2}


def test_timers_over_several_batches(event_files):
    out = E.run(E.idle_sessions(event_files), "timers")
    assert sorted((r.user_id, r.start, r.n) for r in out.collect()) == [(1, at(0), 3), (1, at(9), 1), (2, at(0), 1), (3, at(10), 1)]


def test_time_to_live(event_files):
    assert {r.user_id: r.event_id for r in E.run(E.first_seen(event_files), "seen", single_batch=True).collect()} == {1: 1, 2: 3, 3: 6}


def test_sessions_of_rows_out_of_order(spark, tmp_path):
    """A user at 10:00, then 9:50, then 11:55: one session of three, as session_window has it."""
    rows = [[(1, at(10), 1)], [(2, at(9) + dt.timedelta(minutes=50), 1)], [(3, at(11) + dt.timedelta(minutes=55), 1), (4, at(11), 2)], [(5, at(40), 3)]]
    for n, part in enumerate(rows):
        spark.createDataFrame([(i, t, u, "click", 1.0, "{}") for i, t, u in part], E.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events-{n}.parquet")
    stream = lambda: spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events-*.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "30 minutes")
    with rocks_db(spark):
        out = {(r.user_id, r.start, r.n) for r in E.run(E.idle_sessions(stream()), "disorder").collect()}
    assert out == {(1, at(9) + dt.timedelta(minutes=50), 3), (2, at(11), 1)}
    assert out == {(r.user_id, r.start, r.n) for r in E.run(E.user_sessions(stream()), "window").collect()}


def test_order_behind_the_watermark(spark):
    """Random disorder within the watermark; what is behind it is left out, and no place is given twice."""
    rng = random.Random(9)
    rows = [(i, at(i / 3), rng.randint(1, 3), "click", 1.0, "{}") for i in range(120)]
    batch = {i: min(5, i // 20 + (rng.random() < 0.4)) for i in range(120)} | {7: 5}
    df = spark.createDataFrame([(*r, batch[r[0]]) for r in rows], f"{E.SCHEMA}, b int")
    with rocks_db(spark):
        out = E.run(E.in_order(E.replayed(df, F.col("b"), 6, "15 hours").select("event_id", "ts", "user_id")), "order").collect()
    expected = {}
    for user in (1, 2, 3):
        own = [r[0] for r in rows if r[2] == user and r[0] != 7 and r[1] < at(119 / 3 - 15)]
        expected |= {i: n for n, i in enumerate(own, 1)}
    assert {r.event_id: r.place for r in out} == expected


def test_state_by_shards_of_users(spark):
    """Many users in few shards, one of them null and one 0, over several batches: as few keys of state as shards, and every user's events and sessions apart."""
    rng = random.Random(3)
    users = [None, *range(30)]
    rows = [(i, at(i / 10), rng.choice(users), "click", 1.0, "{}", i // 100) for i in range(300)]
    df = spark.createDataFrame(rows, f"{E.SCHEMA}, b int")
    with rocks_db(spark):
        ordered = E.run(E.in_order(E.replayed(df, F.col("b"), 3, "1 hour"), shards=3), "shards-order").collect()
        found = E.run(E.idle_sessions(E.replayed(df, F.col("b"), 3, "1 hour"), "2 hours", shards=3), "shards-idle").collect()
    places, sessions = set(), set()
    for user in users:
        own = [r for r in rows if r[2] == user]
        places |= {(user, r[0], n) for n, r in enumerate(own, 1) if r[1] < at(28.9)}
        begins = [k for k in range(len(own)) if k == 0 or own[k][1] - own[k - 1][1] >= dt.timedelta(hours=2)] + [len(own)]
        sessions |= {(user, own[a][1], b - a) for a, b in zip(begins, begins[1:], strict=False) if own[b - 1][1] + dt.timedelta(hours=2) <= at(28.9)}
    assert {(r.user_id, r.event_id, r.place) for r in ordered} == places
    assert {(r.user_id, r.start, r.n) for r in found} == sessions


def test_upserts(spark, tmp_path):
    """A batch that comes again changes nothing, an attempt that was cut short is written over, and two versions are kept."""
    batch = lambda *rows: spark.createDataFrame(rows, "k int, t int, v string")
    target = E.Upserts(f"file://{tmp_path}/t", ["k"], [F.desc("t"), F.desc("v")])
    rows = lambda: sorted(map(tuple, target.table(spark).collect()))
    target(batch((1, 5, "a"), (2, 5, "b"), (1, 4, "old")), 0)
    target(batch((2, 6, "c"), (None, 1, "n")), 1)
    now = sorted([(1, 5, "a"), (2, 6, "c")]) + [(None, 1, "n")]
    assert sorted(map(tuple, target.table(spark).collect()), key=repr) == sorted(now, key=repr)
    target(batch((2, 9, "again")), 1)
    target(batch((1, 9, "again")), 0)
    assert sorted(map(tuple, target.table(spark).collect()), key=repr) == sorted(now, key=repr)
    (tmp_path / "t" / "version-2").mkdir()
    (tmp_path / "t" / "version-2" / "part-broken.parquet").write_text("cut short")
    assert target.versions(spark) == [0, 1]
    target(batch((1, 1, "late")), 2)
    target(batch(), 3)
    target(batch((3, 1, "z")), 4)
    assert target.versions(spark) == [3, 4] and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version-3", "version-4"]
    assert sorted(map(tuple, target.table(spark).collect()), key=repr) == sorted([*now, (3, 1, "z")], key=repr)


def test_state_expires(spark, tmp_path):
    """A user is new again after the time to live, and not before."""
    schema, seen = E.SCHEMA, []
    for n, pause in enumerate((0, 0, 4)):
        time.sleep(pause)
        spark.createDataFrame([(n, at(n), 1, "click", 1.0, "{}"), (10 + n, at(n), 2 + n, "click", 1.0, "{}")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/events-{n}.parquet")
        keep = 3_600_000 if n < 2 else 1000
        with rocks_db(spark):
            stream = E.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/events-*.parquet"), keep if n < 2 else keep)
            place = "long" if n < 2 else "short"
            stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{place}").option("checkpointLocation", f"{tmp_path}/c-{place}").trigger(once=True).start().awaitTermination()
        seen.append({(r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/{place}").collect()})
    assert seen[0] == {(1, 0), (2, 10)} and seen[1] == seen[0] | {(3, 11)}
    # With a time to live of a second: all are new once, and again after a pause.
    time.sleep(3)
    spark.createDataFrame([(3, at(3), 1, "click", 1.0, "{}")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/events-3.parquet")
    with rocks_db(spark):
        E.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/events-*.parquet"), 1000).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/short").option("checkpointLocation", f"{tmp_path}/c-short").trigger(once=True).start().awaitTermination()
    again = {(r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/short").collect()}
    assert seen[2] == {(1, 0), (2, 10), (3, 11), (4, 12)} and again == seen[2] | {(1, 3)}


def test_joins_prune_partitions(spark, sf):
    out = queries()["partition_pruned_by_join"](spark, sf)
    assert out.count() == 5 and "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString().lower()


@pytest.fixture
def row_groups(spark, tmp_path):
    rows = [(i, f"s{i % 7}" if i % 11 else None, float(i), at(i)) for i in range(1000)]
    t = pa.table({"i": [r[0] for r in rows], "s": [r[1] for r in rows], "x": [r[2] for r in rows], "t": pa.array([r[3] for r in rows], pa.timestamp("us"))})
    for n in range(2):
        pq.write_table(t.slice(500 * n, 500), tmp_path / f"part-{n}.parquet", row_group_size=100)
    spark.dataSource.register(RowGroups)
    push_filters(spark)
    return rows, spark.read.format("row_groups").option("path", str(tmp_path)).load()


def test_row_groups(spark, row_groups, tmp_path):
    rows, df = row_groups
    assert dict(df.dtypes) == {"i": "bigint", "s": "string", "x": "double", "t": "timestamp_ntz"} and df.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == rows
    for condition, keep, parts in (
        ("i >= 250 and i < 310", lambda r: 250 <= r[0] < 310, 2), ("s = 's3' and x > 600", lambda r: r[1] == "s3" and r[2] > 600, 4), ("s is null", lambda r: r[1] is None, 10), ("i in (5, 905)", lambda r: r[0] in (5, 905), 2), ("not (i < 990)", lambda r: r[0] >= 990, 1),
        ("s like 's1%'", lambda r: r[1] == "s1", 10), ("length(s) = 2 and i % 2 = 1", lambda r: r[1] and r[0] % 2, 10), ("t > timestamp_ntz'2024-02-01'", lambda r: r[3] > dt.datetime(2024, 2, 1), 10), ("x > 5000", lambda r: False, 0),
    ):
        some = df.where(condition)
        assert sorted(map(tuple, some.collect()), key=lambda r: r[0]) == [r for r in rows if keep(r)], condition
        assert some.rdd.getNumPartitions() == parts or parts == 0, condition
    few = spark.read.format("row_groups").options(path=str(tmp_path), columns="x, i").load()
    assert few.columns == ["x", "i"] and few.agg(F.sum("x")).first()[0] == sum(range(1000))


def test_filters_reach_the_source(row_groups, tmp_path):
    reader = RowGroups({"path": str(tmp_path), "columns": "i"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("s",), "s3"), GreaterThan(("i",), 5), EqualTo(("a", "b"), 1), Not(EqualTo(("t",), dt.datetime(2024, 1, 1)))]))
    assert len(left) == 2 and "s3" in str(reader.condition) and "i > 5" in str(reader.condition)


def test_row_groups_as_a_stream(spark, row_groups, tmp_path):
    rows, _ = row_groups
    stream = spark.readStream.format("row_groups").options(path=str(tmp_path), columns="i", groups="3").load()
    run = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}-out").option("checkpointLocation", f"{tmp_path}-c").start()
    for _ in range(2):  # the second run goes on where the first ended
        q = run()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}-out").collect()) == list(range(1000))


def test_sketch_bounds_of_nulls_and_any_number_of_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["A", "B", None]), rng.randint(0, 400), rng.choice([None, *range(50)]), i // 3, rng.choice([None, 7.0, 50000.0, 1e5 * rng.random()])) for i in range(3000)]
    out = sketches_checked(spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long, l_orderkey long, l_extendedprice double"))
    assert {tuple(r) for r in out.collect()} == {(flag, *[True] * 6) for flag in ("A", "B", None)}
    # No aggregate has a copy of each row for each kind of key, with sketches for all their combinations.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "percentile(" not in plan
