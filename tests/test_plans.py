"""Physical-plan checks: the extraction adds no shuffle, prunes columns, keeps codegen."""

from pyspark.sql import functions as F

from rateflow.plans import pipeline
from rateflow.plans.queries import QUERIES
from rateflow.sources import synth

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_has_no_exchange_when_input_is_split(spark):
    n = spark.sparkContext.defaultParallelism * 2
    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(n, "o_orderkey")
    emails = synth.html_messages(orders)
    before = _plan(emails).count("Exchange")
    plan = _plan(pipeline.extract_rates(emails))
    assert plan.count("Exchange") == before == 1  # only the one we asked for above
    assert "MapInArrow" in plan
    rows = pipeline.extract_rates(emails)
    rows.collect()  # adaptive plan is final after execution: codegen stages are visible
    final = _plan(rows)
    assert "isFinalPlan=true" in final and "*(" in final


def test_small_input_is_spread_once_before_rendering(spark):
    plan = _plan(QUERIES["extract_rates"](spark, SF))
    # round-robin (not by key), so copies of one message cannot pile up in one task
    assert plan.count("Exchange RoundRobinPartitioning") == 1
    assert plan.count("Exchange") == 1
    rendered = plan.index("MapInArrow")
    assert plan.index("Exchange RoundRobinPartitioning") > rendered  # below the python pass


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["extract_rates"](spark, SF))
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][0]
    assert "o_totalprice" not in scan and "o_orderkey" in scan


def test_no_filter_evaluates_the_array_expression_twice(spark):
    plan = _plan(QUERIES["all_or_nothing"](spark, SF))
    filters = [line for line in plan.split("\n") if "Filter" in line]
    assert not any("lambdafunction" in line for line in filters)


def test_unseen_scans_the_ledger_with_broadcast_batch_keys(spark):
    plan = _plan(QUERIES["unseen_messages"](spark, SF))
    assert "LeftAnti" in plan and "LeftSemi" in plan  # distinct keys on both sides of the ledger scan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_unseen_falls_back_to_a_plain_anti_join_over_the_limit(spark):
    from rateflow.sources import messages

    msgs = spark.range(100).withColumnRenamed("id", "message_id")
    ledger = spark.range(0, 100, 2).withColumnRenamed("id", "message_id")
    out = messages.unseen(msgs, ledger, broadcast_bytes=10)
    assert "LeftSemi" not in _plan(out)
    assert sorted(r[0] for r in out.collect()) == list(range(1, 100, 2))


def test_filter_on_the_f2_flag_does_not_repeat_detection(spark):
    plan = _plan(QUERIES["rate_table_count"](spark, SF))
    assert not any("Filter" in line and "lambdafunction" in line for line in plan.split("\n"))
    assert "Generate inline" in plan


def test_all_or_nothing_on_exploded_rows_aggregates_keys_before_the_shuffle(spark):
    from rateflow.operators import rates

    df = spark.createDataFrame(
        [(1, "Фрахт", "1", None)] * 50 + [(2, "Фрахт", "1", "2")], "message_id BIGINT, name_raw STRING, rate_raw STRING, entry_raw STRING"
    )
    out = rates.all_or_nothing_rows(df)
    plan = _plan(out)
    assert "Window" not in plan
    assert "LeftAnti" in plan and "HashAggregate" in plan
    assert [r.message_id for r in out.collect()] == [2]


def test_building_an_extraction_starts_no_job(spark):
    from rateflow.sources import messages

    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(3)
    html = synth.html_messages(orders.groupBy("o_orderkey", "o_custkey", "o_orderdate").count().drop("count"))
    raw = synth.mime_messages(orders)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    spark.sparkContext.setJobGroup("build-only", "no job may start here")
    try:
        pipeline.extract_rates(html)
        pipeline.extract_rates(messages.emails_from_raw(raw, want_text=False))
        pipeline.detect_rate_tables(html)
        assert list(tracker.getJobIdsForGroup("build-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(tracker.getJobIdsForGroup()) == before


def test_messages_without_tables_never_reach_python(spark):
    emails = spark.createDataFrame([(1, "<p>x</p>"), (2, "<TABLE></TABLE>")], "message_id BIGINT, html STRING")
    plan = _plan(pipeline.extract_rates(emails))
    assert "RLIKE" in plan.upper() and plan.upper().rindex("RLIKE") > plan.index("MapInArrow")


def test_keyword_chain_is_evaluated_once_per_row(spark):
    plan = _plan(QUERIES["normalised_rates"](spark, SF))
    assert plan.count("автоперевозка") <= 1


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    from rateflow import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    monkeypatch.setattr(session, "_context", lambda s: Context())
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            session.scratch_dir(spark, "x")
