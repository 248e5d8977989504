"""Live results over several micro-batches equal the batch results."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import datasets as d
from tidegauge.catalog import queries as Q
from tidegauge.operators import moments, ordering, topology
from tidegauge.plans import optimise as plan
from tidegauge.session import fresh_path
from tidegauge.sources import queue, readers
from tidegauge.streaming import counters, live, reports


@pytest.fixture(scope="module")
def days(spark, data):
    """The events as one file per six days, oldest first."""
    events = d.table(spark, data, "events")
    folder = fresh_path(spark, "events-by-day")
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(d.start())) / (6 * d.DAY * 1000000))
    for i in range(5):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    return folder, events.schema


def stream(spark, days):
    folder, schema = days
    return d.shape_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))


def closed(spark, data):
    last = d.tuple_events(spark, data).agg(F.max("ts")).first()[0]
    return F.lit(last) - F.expr("INTERVAL 1 HOUR")


def same(a, b):
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_stream_cmv_over_batches(spark, data, days):
    keys = ["job", "component", "stream"]
    got = live.drained(spark, live.stream_cmv(stream(spark, days), keys, "elapsed_ms", d.DAY), "t-cmv")
    whole = d.tuple_events(spark, data).withColumn("bucket", F.window("ts", "1 day")["start"])
    want = moments.cmv_aggregate(whole, ["bucket", *keys], "elapsed_ms").filter(
        F.col("bucket") + F.expr("INTERVAL 1 DAY") <= closed(spark, data))
    pick = ["bucket", *keys, "cnt", F.round("s", 6).alias("s"), F.round("ss", 6).alias("ss")]
    same(got.select(*pick), want.select(*pick))


def test_counter_carries_over_batches(spark, data, days):
    folder = fresh_path(spark, "t-counter")
    rows = stream(spark, days).select("job", "task", "ts", "event_id")
    live.stream_stateful_counter(rows, ["job", "task"], ["ts", "event_id"], folder, 0.3).awaitTermination()
    got = spark.read.parquet(f"{folder}/rows")
    assert got.select("batch").distinct().count() == 5
    want = ordering.with_position(
        d.tuple_events(spark, data).select("job", "task", "ts", "event_id"), ["job", "task"], ["ts", "event_id"])
    same(got.select("job", "task", "event_id", "position"), want.select("job", "task", "event_id", "position"))
    assert got.filter("sampled <> (position % 3 = 0)").count() == 0


def test_stream_optimise_over_batches(spark, data, days):
    folder = fresh_path(spark, "t-optimise")
    execs = d.written(d.executors(spark, data), "t-executors")
    x = d.measured_ms()
    rows = (
        stream(spark, days).withColumn("_x", x).withWatermark("ts", "1 hour")
        .groupBy(F.window("ts", "1 day"), "job", "component", "kind", "task", "stream")
        .agg(F.count(F.lit(1)).alias("arrivals"), F.sum("elapsed_ms").alias("total_ms"), F.count("_x").alias("cnt"),
             F.coalesce(F.sum("_x"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0)).alias("ss"))
        .withColumn("day", F.col("window.start")).drop("window")
    )
    live.stream_optimise(
        rows, lambda batch: moments.component_totals(d.reports_of_days(batch, execs)),
        topology.allocation_counts(execs), Q.PARAMS, folder,
    ).awaitTermination()
    got = live.stream_results(spark, folder)
    totals = d.totals(spark, data).filter(F.col("tick") <= 28)
    # the two newest tables of totals, each no longer than the history
    kept = spark.read.parquet(f"{folder}/ticks")
    assert kept.select("batch").distinct().count() <= 2
    assert kept.groupBy("batch", "job").agg(F.countDistinct("tick").alias("n")).filter(F.col("n") > Q.PARAMS.history_size).count() == 0
    want = plan.optimise(totals, topology.allocation_counts(execs), Q.PARAMS)
    pick = ["job", "tick", "component", "objective", "executors", "current", "status", "stable",
            F.round("real_ms", 6).alias("real_ms")]
    same(got.select(*pick), want.select(*pick))


def test_reports_and_snapshots_over_batches(spark, data):
    """Five micro-batches of reports and of snapshots; a report comes again in the next file, a task is unknown, and a job grows."""
    base = fresh_path(spark, "t-reports")
    execs = d.written(d.executors(spark, data), "t-executors")
    measured = d.written(Q._measured(spark, data), "t-measured")
    snapshots = d.written(d.allocation_snapshots(spark, data).select(
        (d.start() + F.make_dt_interval("tick")).alias("ts"), "job", F.col("tick").cast("int").alias("tick"), "component", "kind", "executors"
    ), "t-snapshots")
    day = (F.unix_micros("ts") - F.unix_micros(d.start())) / (d.DAY * 1000000)
    for i in range(5):
        own = measured.filter(F.floor(day / 6) == i)
        again = measured.filter((F.floor(day) == 6 * i - 1) & (F.col("job") == "job1"))
        strange = own.filter("job = 'job2'").withColumn("task", F.col("task") + 1000)
        own.unionByName(again).unionByName(strange).coalesce(1).write.mode("append").parquet(f"{base}/in/reports")
        snapshots.filter(F.floor(day / 6) == i).coalesce(1).write.mode("append").parquet(f"{base}/in/snapshots")

    def read(what, schema):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/{what}")
        return live.closable(rows, f"{base}/end/{what}")

    def run():
        totals = reports.closed_totals(read("reports", measured.schema), execs, Q.PARAMS, "2 days")
        reports.stream_tick(totals, read("snapshots", snapshots.schema), Q.PARAMS, base, "2 days").awaitTermination()

    run()
    totals = d.totals(spark, data)
    want = plan.optimise(totals, d.written(d.allocation_snapshots(spark, data), "t-whole"), Q.PARAMS)
    # each job's table of spans and the waiting snapshots are bounded, however many snapshots came
    assert spark.read.parquet(f"{base}/spans").groupBy("batch", "job", "component").count().agg(F.max("count")).first()[0] <= 2
    pick = ["job", "tick", "component", "objective", "executors", "current", "status", "stable", F.round("real_ms", 6).alias("real_ms")]
    got = live.stream_results(spark, base).select(*pick)
    last = got.agg(F.max("tick")).first()[0]
    assert last >= 24 and spark.read.parquet(f"{base}/results").select("batch").distinct().count() >= 3
    same(got, want.filter(F.col("tick") <= last).select(*pick))
    seen = {(r.job, r.tick) for r in live.stream_records(spark, base).collect()}
    assert seen == {(r.job, r.tick) for r in got.select("job", "tick").distinct().collect()}


def test_text_queue_reads_each_record_once(spark):
    folder = fresh_path(spark, "t-queue")
    base = fresh_path(spark, "t-queue-out")

    def run():
        live.to_files(readers.scan_text_queue(spark, folder), f"{base}/rows", f"{base}/checkpoint").awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{base}/rows").collect())

    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(folder)
    assert run() == ["a", "b"]
    spark.createDataFrame([("c",)], "value string").coalesce(1).write.mode("append").text(folder)
    assert run() == ["a", "b", "c"]


def test_a_consumed_queue_holds_only_what_is_unread(spark):
    base = fresh_path(spark, "t-consumed")

    def put(*texts):
        for t in texts:
            spark.createDataFrame([(t,)], "value string").coalesce(1).write.mode("append").text(f"{base}/in")

    def take():
        rows = queue.take_all(spark, f"{base}/in", f"{base}/rows", f"{base}/checkpoint", "archive", f"{base}/read", 1)
        return sorted(r.text for r in rows.collect())

    def held(folder):
        return sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(f"{base}/{folder}").collect())

    put("a", "b", "a")
    assert take() == ["a", "a", "b"] == held("read") and held("in") == []
    put("c")
    assert held("in") == ["c"]
    # a run with the same checkpoint reads none again
    assert take() == ["a", "a", "b", "c"] == held("read") and held("in") == []
    assert take() == ["a", "a", "b", "c"]
    assert queue.prune_archive(spark, f"{base}/read", 3600) == 0
    assert queue.prune_archive(spark, f"{base}/read", -3600) >= 4 and held("read") == []
    assert queue.prune_archive(spark, f"{base}/nothing", 0) == 0
    with pytest.raises(ValueError):
        readers.scan_text_queue(spark, f"{base}/in", consume="archive")


def _counted(spark, folder, day, files):
    """Run the counter over the files so far; each ``(job, task)`` of a file is one row."""
    for i, rows in files:
        made = spark.createDataFrame([(k, i, j) for j, k in enumerate(rows)], "k string, i int, j int")
        made.coalesce(1).write.mode("append").parquet(day)
    rows = spark.readStream.schema("k string, i int, j int").option("maxFilesPerTrigger", 1).parquet(day)
    live.stream_stateful_counter(rows, ["k"], ["i", "j"], folder, 0.5).awaitTermination()


def _placed(spark, folder):
    return sorted((r.k or "", r.i, r.j, r.position) for r in spark.read.parquet(f"{folder}/rows").collect())


def test_a_batch_writes_the_counters_it_touched(spark, monkeypatch):
    monkeypatch.setattr(counters, "FAN", 3)
    folder, day = fresh_path(spark, "t-log"), fresh_path(spark, "t-log-in")
    many = [f"k{j}" for j in range(3000)]
    files = [(0, many), *[(i, ["k1", None, "k1", f"new{i}"]) for i in range(1, 8)]]
    written_rows = {}
    write = counters.CounterLog._write

    def watched(self, rows, run):
        write(self, rows, run)
        written_rows[run] = self._read([run]).count()

    monkeypatch.setattr(counters.CounterLog, "_write", watched)
    for f in files:
        _counted(spark, folder, day, [f])
    assert [written_rows[counters.Run(0, i, i)] for i in range(8)] == [3000] + [3] * 7
    merged = {r: n for r, n in written_rows.items() if r.level}
    # a counter is written again once per level, and the first table by one merge in eight batches
    assert sorted(merged) == [(1, 0, 2), (1, 3, 5)] and merged[counters.Run(1, 3, 5)] == 5
    log = counters.CounterLog(spark, f"{folder}/counters", spark.read.parquet(day).select("k").schema)
    assert [tuple(r) for r in log.runs(8)] == [(0, 6, 6), (0, 7, 7), (1, 0, 2), (1, 3, 5)]
    seen = {r["_key"]["k"]: r["_seen"] for r in log.before(8, spark.createDataFrame([("k1",), (None,)], "k string")).collect()}
    assert seen["k1"] == 15 and seen[None] == 7
    # only the buckets of the two keys are read
    assert len(seen) < 3000 / 4
    expect, at = [], {}
    for i, rows in files:
        for j, k in enumerate(rows):
            expect.append((k or "", i, j, at.get(k, 0)))
            at[k] = at.get(k, 0) + 1
    assert _placed(spark, folder) == sorted(expect)


def test_a_repeated_batch_counts_once(spark, monkeypatch):
    monkeypatch.setattr(counters, "FAN", 2)
    folder, day = fresh_path(spark, "t-again"), fresh_path(spark, "t-again-in")
    _counted(spark, folder, day, [(i, ["a", "a", "b"]) for i in range(5)])
    before = _placed(spark, folder)
    assert [p for k, _, _, p in before if k == "a"] == list(range(10))
    # as if the driver had gone after the work of the last batch and before its commit
    for name in ("4", ".4.crc"):
        os.remove(f"{folder}/checkpoint/commits/{name}")
    _counted(spark, folder, day, [])
    assert _placed(spark, folder) == before
    _counted(spark, folder, day, [(5, ["b"])])
    assert [p for k, _, _, p in _placed(spark, folder) if k == "b"] == list(range(6))


def test_a_broken_merge_is_made_again(spark, monkeypatch):
    monkeypatch.setattr(counters, "FAN", 2)
    folder = fresh_path(spark, "t-broken")
    log = counters.CounterLog(spark, folder, spark.createDataFrame([], "k string").schema)
    for i in range(2):
        log.add(spark.createDataFrame([("a", i + 1), (f"b{i}", 1)], "k string, _seen long"), i)
    # a merged table that was not finished does not count, one that was finished replaces what is not yet deleted
    os.makedirs(f"{folder}/run=1-0-1")
    assert [r.level for r in log.runs(2)] == [0, 0]
    log._write(log._read(log.runs(2)).groupBy("k", "_bucket").agg(F.max("_seen").alias("_seen")), counters.Run(1, 0, 1))
    assert [tuple(r) for r in log.runs(2)] == [(1, 0, 1)]
    log.compact(2)
    assert sorted(os.listdir(folder)) == ["run=1-0-1"]
    keys = spark.createDataFrame([("a",), ("b0",), ("b1",)], "k string")
    assert {r["_key"]["k"]: r["_seen"] for r in log.before(2, keys).collect()} == {"a": 2, "b0": 1, "b1": 1}


def test_text_queue_binary(spark):
    folder = fresh_path(spark, "t-queue-bin")
    spark.createDataFrame([("a",)], "value string").coalesce(1).write.text(folder)
    rows = live.drained(spark, readers.scan_text_queue(spark, folder, binary=True), "t-bin").collect()
    assert [bytes(r.text) for r in rows] == [b"a"]
