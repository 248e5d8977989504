from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import moments, points, timeline, topology
from tidegauge.schemas import MEASURED, METRIC_POINTS, Params
from tidegauge.session import fresh_path
from tidegauge.sources import readers, writers

T = dt.datetime(2024, 1, 1)


def raw(spark, rows):
    return spark.createDataFrame([("j", T, c, t, n, num, kv) for c, t, n, num, kv in rows], METRIC_POINTS)


def test_filters_and_fold(spark):
    df = raw(spark, [
        ("a", 1, "execute", None, {"s": "2,3.0,5.0"}), ("a", 1, "duration", 1000.0, None),
        ("a", 1, "junk", 1.0, None), ("a", 1, "emit", None, {}), ("__acker", 2, "execute", None, {"s": "1,1.0,1.0"}),
        ("b", 3, "emit", None, {}), ("a", 1, "__receive", None, {"capacity": "10"}),
    ])
    rows = points.measured_points(df, points.approved_names(spark, Params().approved_names)).collect()
    assert len(rows) == 1
    assert set(rows[0].data) == {"execute", "duration", "recv-queue"}
    assert rows[0].data["duration"].num == 1000.0


def test_duplicate_alias_is_an_error(spark):
    df = raw(spark, [("a", 1, "duration", 1.0, None), ("a", 1, "duration", 2.0, None)])
    with pytest.raises(Exception, match="two points of the same name"):
        points.pivot_points(df).collect()


def test_approved_names_last_line_wins(spark):
    got = {r.name: r.alias for r in points.approved_names(spark, ["a", "  a  b ", "", "c\td e", " f "]).collect()}
    assert got == {"a": "b", "c": "d", "f": "f"}


def test_user_filters_replace_the_rules(spark):
    df = raw(spark, [("__sys", 1, "x", 1.0, None), ("a", 1, "x", None, None)])
    assert points.drop_system_components(df, keep=F.lit(True)).count() == 2
    assert points.drop_empty_points(df, keep=F.lit(True)).count() == 2
    assert points.drop_system_components(df).count() == points.drop_empty_points(df).count() == 1


def measured(spark, data, component="a", task=1):
    return spark.createDataFrame([("j", T, component, task, data)], MEASURED)


def test_queue_missing_field_counts_as_zero(spark):
    df = measured(spark, {"recv-queue": (None, {"capacity": "10", "population": "2"})})
    row = points.queue_fields(df).first()
    assert (row.recv_rate, row.recv_capacity, row.recv_population, row.recv_sojourn) == (0.0, 10.0, 2.0, 0.0)
    assert row.send_rate is None
    agg = moments.queue_aggregate(points.queue_fields(df), ["job"]).first()
    assert (agg.recv_rate_cnt, agg.recv_rate_s, agg.send_rate_cnt) == (1, 0.0, 0)


def test_cmv_parsing_drops_empty_streams(spark):
    df = measured(spark, {"execute": (None, {"s": "2,3.0,5.0", "t": "0,0.0,0.0", "u": "bad"})})
    rows = points.parse_cmv(df.withColumn("kind", F.lit("service"))).collect()
    assert [(r.stream, r.cnt, r.s, r.ss) for r in rows] == [("s", 2, 3.0, 5.0)]
    total = points.report_totals(df.withColumn("kind", F.lit("service"))).first()
    assert (total.cnt, total.s, total.ss) == (2, 3.0, 5.0)


def test_log_round_trip_and_rejects(spark):
    data = {"execute": (None, {'s"x': "2,3.0,5.0"}), "duration": (60000.0, None),
            "recv-queue": (None, {"arrival_rate_secs": "1.5"})}
    lines = writers.report_lines(measured(spark, data, component="a.b->c", task=7))
    extra = spark.createDataFrame(
        [("j", 'other.info->{"x": "a->b"}'), ("j", "no arrow here"), ("j", "task.a.1->not json"), ("j", 'task.a.1->{"x"')],
        "job string, value string",
    )
    path = fresh_path(spark, "log-test")
    writers.sink_metric_log(lines.unionByName(extra), path)
    got, others, rejects = readers.scan_metric_log(spark, path)
    # the component holds an arrow, so its line splits too early and is a record of another kind
    assert {r.name for r in others.collect()} == {"other.info", "task.a.b"}
    assert {r.value for r in rejects.collect()} == {"no arrow here", "task.a.1->not json", 'task.a.1->{"x"'}
    assert got.count() == 0

    path = fresh_path(spark, "log-test")
    writers.sink_metric_log(writers.report_lines(measured(spark, data, component="a.b", task=7)), path)
    row = readers.scan_metric_log(spark, path)[0].first()
    assert (row.job, row.component, row.task, row.ts) == ("j", "a.b", 7, T)
    assert row.data["execute"].kv == {'s"x': "2,3.0,5.0"}
    assert row.data["duration"].num == 60000.0
    assert float(row.data["recv-queue"].kv["arrival_rate_secs"]) == 1.5


def test_log_sink_can_be_switched_off(spark, tmp_path):
    path = str(tmp_path / "none")
    writers.sink_metric_log(writers.report_lines(measured(spark, {"duration": (1.0, None)})), path, enabled=False)
    assert not (tmp_path / "none").exists()


def test_histogram_edges(spark):
    df = spark.createDataFrame([("k", v) for v in (1.0, 10.0, 10.5, 25.0, 99.0, None)], "key string, v double")
    row = moments.latency_histogram(df, ["key"], "v", (10.0, 25.0)).first()
    assert (row.bin0, row.bin1, row.bin2) == (2, 2, 1)


def test_histogram_text_without_completions(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 5.0, False), ("b", 1.0, True)], "key string, v double, bad boolean")
    got = {r.key: (r.histogram, r.fails) for r in
           moments.latency_histogram_text(df, ["key"], "v", (2.0,), F.col("bad")).collect()}
    assert got == {"a": (None, 1), "b": ("0,1|1", 1)}


def test_qos_is_strict(spark):
    df = spark.createDataFrame([("k", 5.0), ("k", 5.1)], "key string, v double")
    assert moments.qos_miss(df, ["key"], "v", F.lit(5.0)).first().cnt == 1


def test_moments_merge_like_the_whole(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 11).alias("part"), F.col("id").cast("double").alias("v"))
    parts = moments.cmv_merge(moments.cmv_aggregate(df, ["k", "part"], "v"), ["k"])
    whole = moments.cmv_aggregate(df, ["k"], "v")
    assert sorted(parts.collect()) == sorted(whole.collect())


def test_stats_without_samples(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (2, 0.0, 0.0)], "cnt bigint, s double, ss double")
    rows = moments.with_cmv_stats(df).collect()
    assert tuple(rows[0])[3:] == (0.0, 0.0, 0.0, 0.0)
    assert rows[1].scv is None


def test_epochs_restart_history_and_warmup(spark):
    alloc = spark.createDataFrame(
        [("j", t, "a", "service", 2 if t < 4 else 3) for t in range(1, 8)],
        "job string, tick int, component string, kind string, executors int",
    )
    got = {r.tick: (r.changed, r.epoch, r.tick_in_epoch) for r in timeline.allocation_epochs(alloc).collect()}
    assert got[3] == (False, 0, 3) and got[4] == (True, 1, 0) and got[5] == (False, 1, 1)
    ready = timeline.warmup_gate(timeline.allocation_epochs(alloc).filter("not changed"), Params(history_size=3))
    assert sorted(r.tick for r in ready.collect()) == [3, 7]


def test_empty_ticks_take_a_place(spark):
    rows = spark.createDataFrame([("j", "a", 1, 5), ("j", "a", 4, 7)], "job string, component string, tick int, cnt bigint")
    got = {r.tick: r.cnt for r in timeline.history_rollup(rows, 3).collect()}
    assert got == {1: 5, 4: 7}


def test_first_tick_covers_two_intervals(spark):
    df = spark.createDataFrame([(i,) for i in (0, 59, 60, 119, 120, 180)], "s int").select(
        "s", timeline.optimise_tick(F.timestamp_seconds("s"), F.timestamp_seconds(F.lit(0)), 60).alias("tick"))
    assert [r.tick for r in df.orderBy("s").collect()] == [1, 1, 1, 1, 2, 3]


def test_adjust_gate(spark):
    ticks = spark.range(1, 10).select(F.col("id").cast("int").alias("tick"))
    late = timeline.adjust_gate(ticks, Params(interval_seconds=60, adjust_min_seconds=360))
    assert min(r.tick for r in late.collect()) == 5
    assert timeline.adjust_gate(ticks, Params(interval_seconds=60)).count() == 9


def test_system_components_and_maps(spark):
    execs = spark.createDataFrame(
        [("j", "a", "service", 1, 2, "h1", 67), ("j", "a", "service", 3, 3, "h2", 68), ("j", "__acker", "service", 9, 9, "h1", 67)],
        "job string, component string, kind string, task_start int, task_end int, host string, port int",
    )
    assert {r.component: r.tasks for r in topology.component_tasks(execs).collect()} == {"a": [1, 2, 3]}
    assert topology.component_tasks(execs, with_system=True).count() == 2
    maps = {r.component: r.assignment for r in topology.assignment_map(execs).collect()}
    assert maps["a"] == {"[1, 2]": "h1:67", "[3, 3]": "h2:68"}


def test_allocation_changed_sees_missing_components(spark):
    schema = "job string, component string, executors int"
    old = spark.createDataFrame([("j", "a", 1), ("k", "a", 1), ("l", "a", 1)], schema)
    new = spark.createDataFrame([("j", "a", 1), ("k", "a", 2), ("l", "a", 1), ("l", "b", 1)], schema)
    got = {r.job: r.changed for r in topology.allocation_changed(old, new).collect()}
    assert got == {"j": False, "k": True, "l": True}
