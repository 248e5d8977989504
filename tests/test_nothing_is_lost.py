"""Rows that are easy to drop by accident: odd names, gaps, strangers, leading zeros."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidegauge.operators import capacity, moments, points, timeline, topology
from tidegauge.plans import dataflows
from tidegauge.plans import optimise as plan
from tidegauge.schemas import MEASURED, METRIC_POINTS, Params
from tidegauge.sources import readers, writers
from tidegauge.streaming import live

T = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def test_any_approved_metric_reaches_its_report(spark):
    rows = [("j", T, "a", 1, "gc-time", 7.0, None), ("j", T, "b", 2, "execute", None, {"s": "1,1.0,1.0"}), ("j", T, "a", 1, "other", 1.0, None)]
    got = points.measured_points(
        spark.createDataFrame(rows, METRIC_POINTS), points.approved_names(spark, ["gc-time", "execute", "heap used"])
    ).collect()
    assert {r.component: {k: v.num for k, v in r.data.items()} for r in got} == {"a": {"gc-time": 7.0}, "b": {"execute": None}}


def test_job_names_keep_their_zeros(spark, tmp_path):
    lines = [(job, f'task.a.{task}->{{"duration":1.0}}') for job in ("007", "7", "x") for task in (1, 2)]
    writers.sink_metric_log(spark.createDataFrame(lines, "job string, value string"), str(tmp_path / "log"))
    measured, _, _ = readers.scan_metric_log(spark, str(tmp_path / "log"))
    assert sorted((r.job, r.task) for r in measured.collect()) == [(j, t) for j in ("007", "7", "x") for t in (1, 2)]


def test_bad_lines_are_rejects_and_end_nothing(spark):
    lines = ["task.a.99999999999->{}", 'task.a.1->{"timestamp":99999999999999999}', 'task.a.1->{"timestamp":"x","duration":2.0}', "task.a.2->{"]
    measured, others, rejects = readers.parse_metric_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    # an unreadable time counts as none, so the report counts as read now
    assert [r.data["duration"].num for r in measured.collect()] == [2.0]
    assert others.count() == 0 and {r.value for r in rejects.collect()} >= set(lines[:2])


def test_unknown_tasks_are_handed_back(spark):
    reports = [("j", T, "a", task, {"execute": (None, {"s": "1,2.0,4.0"})}) for task in (1, 2, 99)]
    execs = spark.createDataFrame([("j", "a", "service", 1, 2, "h", 1)], "job string, component string, kind string, task_start int, task_end int, host string, port int")
    totals, unknown = plan.totals_of_reports(spark.createDataFrame(reports, MEASURED), execs, Params())
    assert totals.first().cnt == 2 and [r.task for r in unknown.collect()] == [99]


def test_ticks_without_a_snapshot_keep_the_last_allocation(spark):
    snapshots = spark.createDataFrame(
        [("j", "a", "service", t, e) for t, e in ((2, 1), (3, 1), (6, 5), (50, 9))], "job string, component string, kind string, tick int, executors int")
    ends = spark.createDataFrame([("j", 40)], "job string, _last int")
    held = timeline.allocation_as_of(snapshots, ends)
    assert {r.tick: r.executors for r in held.collect()} == {t: 1 if t < 6 else 5 for t in range(2, 41)}
    epochs = {r.tick: (r.epoch, r.changed, r.tick_in_epoch) for r in timeline.allocation_epochs(held).collect()}
    assert epochs[5] == (0, False, 4) and epochs[6] == (1, True, 0) and epochs[40] == (1, False, 34)


def test_silent_executors_have_a_row_at_every_tick(spark):
    execs = spark.createDataFrame([("j", "a", "service", 1, 2), ("j", "a", "service", 3, 4)], "job string, component string, kind string, task_start int, task_end int")
    reports = spark.createDataFrame([("j", 1, "a", 1, "s", 1, 2.0, 4.0), ("j", 2, "a", 3, "s", 1, 3.0, 9.0)],
                                    "job string, tick int, component string, task int, stream string, cnt long, s double, ss double")
    got = {(r.executor, r.tick): (r.stream, r.cnt) for r in moments.executor_rollup(reports, execs).collect()}
    assert got == {(1, 1): ("s", 1), (1, 2): (None, 0), (3, 1): (None, 0), (3, 2): ("s", 1)}


def test_broken_rates_have_no_curve_and_are_named(spark):
    nodes = spark.createDataFrame([("a", 8.0, 1e-9, 1.0, 1.0), ("b", 8.0, 10.0, 1.0, 1.0)], "component string, lam double, mu double, ca2 double, cs2 double")
    low = F.expr("cast(least(floor(lam / mu) + 1, 2147483647) as int)")
    curve = capacity.capacity_curve(nodes, low, low.cast("bigint") + 8)
    assert {r.component for r in curve.collect()} == {"b"} and curve.count() == 9
    assert [r.component for r in capacity.without_curve(nodes, low, low.cast("bigint") + 8).collect()] == ["a"]
    # a healthy node with room for a million executors has none either, and is named too
    assert capacity.without_curve(nodes, low, low.cast("bigint") + 10**6).count() == 2


def test_totals_without_an_allocation_are_named(spark):
    totals = spark.createDataFrame([("j", t, c, 1) for t in range(1, 6) for c in "ab"] + [("k", 1, "a", 1)], "job string, tick int, component string, cnt int")
    snaps = spark.createDataFrame([("j", 2, "a", "service", 1), ("j", 2, "b", "service", 1), ("j", 4, "a", "service", 1)],
                                  "job string, tick int, component string, kind string, executors int")
    got = {(r.job, r.tick, r.component) for r in timeline.unallocated_totals(totals, snaps).collect()}
    assert got == {("j", 1, "a"), ("j", 1, "b"), ("j", 4, "b"), ("j", 5, "b"), ("k", 1, "a")}


def test_each_path_has_its_own_service(spark):
    records = spark.createDataFrame([(f"s{i}", "w") for i in range(200)], "sid string, sentence string")
    got = dataflows.dataflow_two_path(records, 0.5, lambda w: F.concat(w, F.lit("+")), lambda w: F.concat(w, F.lit("-")))
    assert {(r.path, r.word) for r in got.collect()} == {("A-P", "w+!!"), ("A-NotP", "w-!!")}
    assert topology.pick_source(spark.createDataFrame([("j", "b"), ("j", "a")], "job string, component string")).first().component == "a"


def test_points_can_be_read_as_a_stream(spark, tmp_path):
    rows = [("j", T, "a", 1, "duration", 7.0, None), ("j", T, "__acker", 1, "duration", 1.0, None), ("j", T, "a", 1, "x", 1.0, None)]
    spark.createDataFrame(rows, METRIC_POINTS).write.parquet(str(tmp_path / "points"))
    stream = readers.read_metric_points(spark, str(tmp_path / "points"), streaming=True)
    kept = points.approved_metrics(points.drop_system_components(stream), points.approved_names(spark, Params().approved_names))
    assert [(r.component, r.num) for r in live.drained(spark, kept, "t-points").collect()] == [("a", 7.0)]


def test_the_policy_none_changes_nothing(spark):
    result = spark.createDataFrame([("j", 9, "a", "current", 3, 2, "FEASIBLE", 1.0, 1.0, 1.0, 0.0, True)], plan.RESULT_SCHEMA)
    assert plan.decide(result, Params()).count() == 1
    nothing = plan.decide(result, Params(policy="none"))
    assert nothing.count() == 0 and plan.rebalance_plan(nothing, Params(policy="none")).count() == 0
