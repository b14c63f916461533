import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import access, parse, rules, storing
from pulsegrid.operators.ordered_groups import ordered_groups, together
from pulsegrid.schemas import DomainSpec, Field
from pulsegrid.sources import tables

T0 = datetime(2024, 1, 1)
ROW = (
    "time timestamp, user_id string, device_id string, sequence_id bigint, temperature double, "
    "battery int, extra_data string, partition int, offset bigint"
)


def reading(i, offset, temperature=1.0, partition=0):
    return (T0 + timedelta(hours=i), "u", "d", i, temperature, 5, "{}", partition, offset)


def stored(spark, path):
    rows = tables.read_telemetry(spark, path).collect()
    return sorted((r.sequence_id, r.temperature) for r in rows)


def test_first_copy_wins_also_in_a_group_of_copies(spark):
    rows = [reading(1, offset, float(offset)) for offset in range(500, 0, -1)]
    rows.append(reading(2, 7))
    got = storing.dedupe_first_wins(spark.createDataFrame(rows, ROW)).collect()
    assert sorted((r.sequence_id, r.temperature) for r in got) == [(1, 1.0), (2, 1.0)]


def test_storing_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = spark.createDataFrame([reading(i, i) for i in range(60)], ROW)
    tables.write_telemetry(first, path)
    before = stored(spark, path)
    assert len(before) == 60
    tables.write_telemetry(first, path)
    tables.write_telemetry(first.withColumn("temperature", F.lit(9.0)), path)
    assert stored(spark, path) == before
    later = spark.createDataFrame([reading(i, i, 2.0) for i in range(50, 70)], ROW)
    tables.write_telemetry(later, path)
    assert stored(spark, path) == before + [(i, 2.0) for i in range(60, 70)]
    tables.write_telemetry(first.where("false"), path)
    assert len(stored(spark, path)) == 70


def test_many_dates_are_found_by_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LISTED_DATES", 2)
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([reading(i * 24, i) for i in range(10)], ROW)
    tables.write_telemetry(rows, path)
    tables.write_telemetry(rows, path)
    assert len(stored(spark, path)) == 10


def test_only_touched_dates_are_read(spark, tmp_path):
    path = str(tmp_path / "raw")
    tables.write_telemetry(spark.createDataFrame([reading(i * 24, i) for i in range(10)], ROW), path)
    one = storing.touched(tables.read_telemetry(spark, path), None, [T0.date()])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan or "PartitionFilters: [(dt" in plan
    assert len(one.inputFiles()) == 1 or one.count() == 1


def test_write_stats(spark):
    offered = spark.createDataFrame(
        [reading(1, 1) + (1,), reading(1, 2) + (1,), reading(2, 3) + (1,), reading(2, 4) + (2,), reading(3, 5) + (2,)],
        ROW + ", batch_id bigint",
    )
    already = spark.createDataFrame([reading(3, 0)], ROW)
    got = {r.batch_id: (r.offered, r.written, r.duplicates) for r in storing.write_stats(offered, already).collect()}
    assert got == {1: (3, 2, 1), 2: (2, 0, 2)}


def test_quarantine(spark):
    rows = spark.createDataFrame(
        [(T0, "u", "d", 1, None), (None, "u", "d", 1, None), (T0, "u", "d", 1, "Invalid JSON: x")],
        "time timestamp, user_id string, device_id string, sequence_id bigint, error string",
    )
    good, bad = storing.quarantine_split(rows)
    assert good.count() == 1
    assert {r.error for r in bad.collect()} == {"Unstorable: NULL key", "Invalid JSON: x"}


def test_snapshots(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v int").schema
    path = str(tmp_path / "snap")
    table = tables.Snapshots(spark, path, schema, ["k"])
    assert table.before("q", 5) is None and table.latest().count() == 0
    every = list(range(table.buckets))
    table.write(spark.createDataFrame([("a", 1)], schema), None, every, "q", 0)
    table.write(spark.createDataFrame([], schema), table.before("q", 3), every, "q", 3)
    again = tables.Snapshots(spark, path, schema, ["k"])
    assert again.read(again.before("q", 3)).collect()[0].v == 1
    assert again.latest().count() == 0 and again.read(again.before("q", 9)).count() == 0
    again.write(spark.createDataFrame([("b", 2)], schema), again.before("q", 3), every, "q", 3)
    assert [r.k for r in again.latest().collect()] == ["b"]


def test_running_values_in_slices_equal_plain_windows(spark):
    """One group with most rows, some at the very same time or at none; NULL values in between."""
    rng = random.Random(1)
    rows = [
        (rng.choice(["hot"] * 8 + ["a", "b", "c"]), rng.choice([None, 0, 1, rng.randint(-20, 50)]), i,
         rng.choice([None, float(i)]))
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "k string, s int, n int, v double").repartition(5)
    df = df.withColumn("t", F.timestamp_seconds("s"))
    before = Window.partitionBy("k").orderBy("t", "n").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("p", F.last("v", ignorenulls=True).over(before))
    want = want.withColumn("q", F.last("p", ignorenulls=True).over(before))
    cut = ordered_groups(df, ["k"], ["t", "n"], slice_seconds=7)
    assert cut.df.where("k = 'hot'").select("_slice").distinct().count() > 8
    twice = cut.last_before(p=F.col("v")).last_before(q=F.col("p")).rows()
    key = lambda r: r.n
    assert sorted(twice.collect(), key=key) == sorted(want.collect(), key=key)


def test_rows_stay_together(spark):
    """Columns that nobody asks for are still shuffled, so that two readers share one shuffle."""
    df = spark.range(50).selectExpr("id", "id % 3 AS k", "map(id, id) AS m", "parse_json('1') AS v", "if(id > 3, id, NULL) AS n")
    kept = together(df.repartition(4, "k"))
    assert kept.count() == 50 and kept.columns == df.columns
    both = kept.select("k", "id").join(kept.groupBy("k").count(), "k")
    assert both.count() == 50
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_access(spark):
    listed = spark.createDataFrame(
        [
            ("$all", "publish", "users/%u/devices/%c/telemetry"),
            ("$all", "subscribe", "users/%u/config"),
            ("bridge", "subscribe", "users/+/devices/+/telemetry"),
            ("backend", "all", "#"),
        ],
        "username string, permission string, topic string",
    )
    log = [
        ("a", "c1", "publish", "users/a/devices/c1/telemetry", True),
        ("a", "c1", "publish", "users/a/devices/c2/telemetry", False),
        ("a", "c1", "publish", "users/b/devices/c1/telemetry", False),
        ("a", "c1", "subscribe", "users/a/config", True),
        ("a", "c1", "publish", "users/a/config", False),
        ("bridge", "x", "subscribe", "users/q/devices/z/telemetry", True),
        ("bridge", "x", "publish", "users/q/devices/z/telemetry", False),
        ("backend", "x", "publish", "anything", True),
        ("%u", "x", "subscribe", "users/%u/config", True),
        ("nobody", "x", "publish", "anything", False),
    ]
    schema = "username string, clientid string, action string, topic string, want boolean"
    got = access.acl_audit(spark.createDataFrame(log * 2, schema), listed).collect()
    assert len(got) == 2 * len(log)
    for r in got:
        assert r.allowed == r.want, r


def test_packed_places_order_like_their_columns(spark):
    rnd = random.Random(4)
    far = [-(2**63), 2**63 - 1, -1, 0, 1]
    rows = [(rnd.choice([-(2**31), 2**31 - 1, -1, 0, 3]), rnd.choice(far + [rnd.getrandbits(62)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, o bigint")
    got = df.select("p", "o", storing.packed(df, ["p", "o"]).alias("n")).collect()
    assert [(r.p, r.o) for r in sorted(got, key=lambda r: r.n)] == sorted((r.p, r.o) for r in got)
    assert len({r.n for r in got}) == len(set(rows))
    times = spark.createDataFrame([(datetime(y, 1, 1), y) for y in (1, 1969, 1970, 2024, 9999)], "t timestamp, y bigint")
    numbers = [r.n for r in times.select(storing.packed(times, ["t", "y"]).alias("n"), "y").orderBy("y").collect()]
    assert numbers == sorted(numbers)
    assert storing.packed(times, ["t", "y", "y"]) is None
    assert storing.packed(spark.range(1).selectExpr("'a' AS s"), ["s"]) is None


def test_firsts_of_hot_copies_and_of_keys_with_equal_places(spark):
    rnd = random.Random(5)
    rows = [("hot", 1, i % 4, 1000 - i, i) for i in range(900)]
    rows += [(rnd.choice(["a", "b", None]), rnd.randint(0, 20), 0, i % 40, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, partition int, offset bigint, v int").dropDuplicates(["k", "t", "partition", "offset"])
    first, last = {}, {}
    for r in df.collect():
        place = (r.partition, r.offset)
        first[r.k, r.t] = min(first.get((r.k, r.t), (place, r.v)), (place, r.v))
        last[r.k, r.t] = max(last.get((r.k, r.t), (place, r.v)), (place, r.v))
    found = storing.dedupe_first_wins(df, ["k", "t"])
    assert found.columns == df.columns
    assert {(r.k, r.t): ((r.partition, r.offset), r.v) for r in found.collect()} == first and found.count() == len(first)
    newest = storing.latest_by_key(df, ["k", "t"], ["partition", "offset"])
    assert {(r.k, r.t): ((r.partition, r.offset), r.v) for r in newest.collect()} == last and newest.count() == len(last)
    for plan in (found, newest):
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
    # whole copies, and rows of one key at one place
    twice = df.unionByName(df).unionByName(df.withColumn("v", -F.col("v")))
    assert storing.dedupe_first_wins(twice, ["k", "t"]).count() == len(first)
    # an order that fits no number goes the other way
    named = df.withColumn("offset", F.format_string("%012d", "offset"))
    again = storing.dedupe_first_wins(named, ["k", "t"])
    assert {(r.k, r.t): r.v for r in again.collect()} == {key: v for key, (_, v) in first.items()}


def test_the_newest_update_replaces_what_is_stored(spark):
    kind = "user_id string, rules array<struct<key:string,operator:string,threshold:double,message:string>>"
    one, two, three = ([("t", ">", x, "m")] for x in (1.0, 2.0, 3.0))
    stored = spark.createDataFrame([("a", one), ("b", one)], kind)
    updates = spark.createDataFrame([("a", two, 5), ("a", three, 4), ("c", one, 1)], kind + ", at bigint")
    got = {r.user_id: r.rules[0].threshold for r in rules.upsert_config(stored, updates, ["at"]).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 1.0}
    plan = rules.upsert_config(stored, updates, ["at"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_another_domain_is_stored_once(spark, tmp_path):
    spec = DomainSpec(
        fields=(Field("at", "timestamp", required=True), Field("box", "string", required=True), Field("grams", "long")),
        key=("at", "box"),
        time="at",
        topic_filter="boxes/+",
    )
    assert spec.stored == ["at", "box", "grams", "extra_data"]
    kind = "at timestamp, box string, grams bigint, extra_data string, partition int, offset bigint"
    path = str(tmp_path / "boxes")
    rows = [(T0 + timedelta(days=i % 3), f"b{i % 5}", i, "{}", 0, i) for i in range(40)]
    frame = spark.createDataFrame(rows, kind)
    assert tables.read_readings(spark, path, spec).count() == 0
    assert tables.write_readings(frame, path, spec) == {"offered": 40, "written": 15}
    assert tables.write_readings(frame, path, spec)["written"] == 0
    got = {(r.at, r.box): r.grams for r in tables.read_readings(spark, path, spec).collect()}
    assert got == {(r[0], r[1]): r[2] for r in reversed(rows)}
    with pytest.raises(ValueError, match="key"):
        tables.write_readings(frame, path, replace(spec, key=("box",)))


def test_messages_of_a_domain(spark):
    spec = DomainSpec(fields=(Field("box", "string", required=True),), key=("box",), time="box", topic_filter="users/+/boxes/#")
    rows = [("users/u/boxes", '{"box":"a","x":1}', None), ("users/u/boxes/7", "{}", None), ("users/u/bags", '{"box":"b"}', None), ("users/u/boxes", None, "not_an_envelope")]
    got = parse.parse_domain(spark.createDataFrame(rows, "topic string, payload string, skip_reason string"), spec).collect()
    assert sorted((r.box or "", r.user_id, r.extra_data, r.error) for r in got) == [
        ("", "u", "{}", "Invalid JSON: missing field `box`"),
        ("a", "u", '{"x":1}', None),
    ]
