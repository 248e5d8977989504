"""Plans stay on the JVM side, read few columns and move little."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import datasets, queries
from tidegauge.catalog.queries import QUERIES
from tidegauge.operators import dataflow

BATCH = [n for n in QUERIES if not n.startswith("stream_") and n not in ("scan_text_queue", "consume_text_queue")]
CHEAP = ["cmv_aggregate", "latency_histogram", "latency_histogram_text", "tumbling_bucket", "qos_miss", "check_optimized",
         "optimise", "cmv_merge", "loop_back", "dataflow_two_path", "sample_one_in_n", "service_nodes"]


def text(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_and_no_pairs(spark, data, name):
    plan = text(QUERIES[name](spark, data))
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"):
        assert node not in plan, node


def test_only_needed_columns_are_read(spark, data):
    plan = text(QUERIES["cmv_aggregate"](spark, data))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>" in plan
    plan = text(QUERIES["latency_histogram"](spark, data))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in plan


def test_filters_reach_the_scan(spark, data):
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text(QUERIES["cmv_aggregate"](spark, data))).group(1)
    assert "IsNotNull(l_quantity)" in pushed


def test_aggregation_combines_before_its_shuffle(spark, data):
    physical = QUERIES["cmv_aggregate"](spark, data)._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in physical


def test_dataflows_do_not_shuffle(spark, data):
    for name in ("split_stream", "loop_back", "dataflow_chain", "dataflow_two_path", "dataflow_loop"):
        assert "Exchange" not in text(QUERIES[name](spark, data)), name


def test_ranked_grid_moves_once(spark, data):
    from pyspark.sql import functions as F

    from tidegauge.operators import allocate

    schema = "job string, tick int, component string, lam double, mu double, ca2 double, cs2 double, ratio double"
    nodes = spark.createDataFrame([("j", 1, "a", 8.0, 10.0, 1.0, 1.0, 1.0)], schema)
    plan = allocate.allocate_greedy(nodes, F.lit(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["component_rollup", "executor_rollup", "executor_results", "queue_aggregate", "duration_sum",
                                  "first_task_only", "history_rollup", "optimise", "scan_metric_points"])
def test_raw_events_are_scanned_once(spark, data, name, tmp_path, monkeypatch):
    """Also by what runs while the query is made: every table that is written counts."""
    plans = []
    write = datasets.written
    monkeypatch.setattr(datasets, "written", lambda df, tag: (plans.append(text(df)), write(df, tag))[1])
    monkeypatch.setattr(queries, "written", datasets.written)
    plans.append(text(QUERIES[name](spark, data)))
    scans = sum(len(re.findall(r"FileScan parquet .*?Location: [^,]*events\.parquet", p)) for p in plans)
    assert scans == 1


def test_several_outputs_take_one_scan(spark, data, tmp_path):
    spark.createDataFrame([("a", "xx"), ("b", "xxx"), ("c", None), ("d", "y")], "sid string, word string").write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    emitted = dataflow.emit(records, {"p": (F.col("word").startswith("x"), F.col("word")), "q": (F.length("word") == 2, F.col("word"))})
    out = dataflow.consume(emitted, {"p": F.upper, "q": lambda w: F.concat(w, F.lit("!"))})
    assert sorted(map(tuple, out.collect())) == [("a", "p", "XX"), ("a", "q", "xx!"), ("b", "p", "XXX")]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_loop_touches_only_what_is_inside(spark, monkeypatch):
    touched = []
    real = dataflow.written

    def counted(df, tag):
        table = real(df, tag)
        touched.append(table.count())
        return table

    monkeypatch.setattr(dataflow, "written", counted)
    records = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("sid"), F.lit("w").alias("word"))
    got = dataflow.loop_through(records, lambda rows, j: rows.withColumn("word", F.concat("word", F.lit(str(j)))), 0.5)
    rows = got.collect()
    assert len(rows) == 2000 and all(r.word == "w" + "".join(map(str, range(1, r.passes + 1))) for r in rows)
    assert sum(touched) == sum(r.passes for r in rows) and touched == sorted(touched, reverse=True)
    closed_form = {r.sid: r.passes for r in dataflow.loop_back(records, 0.5).collect()}
    assert {r.sid: r.passes for r in rows} == closed_form
    nobody = spark.createDataFrame([(None, "w")], "sid string, word string")
    assert [tuple(r) for r in dataflow.loop_through(nobody, lambda rows, j: rows, 0.5).collect()] == [(None, "w", 1)]
    assert dataflow.loop_through(records.limit(0), lambda rows, j: rows, 0.5).count() == 0
