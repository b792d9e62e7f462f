"""Plan shapes that must hold at scale."""

import re

import pytest

from conftest import SF_DIR
from hostweave.operators import logs
from hostweave.plans.bindings import Bindings
from hostweave.plans.queries import registered


@pytest.fixture
def plan(spark):
    def text(name):
        df = registered()[name](spark, SF_DIR)
        return df._jdf.queryExecution().executedPlan().toString()

    return text


def test_latest_of_numbers_hash_aggregates(plan):
    text = plan("fs_latest")
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_summary_aggregates_before_the_shuffle(plan):
    assert plan("fs_summary_by_node").count("partial_sum") >= 1


def test_keep_last_n_cuts_before_the_shuffle(plan):
    text = plan("log_keep_last_n")
    below_first_shuffle = text[text.rindex("Exchange hashpartitioning"):]
    assert re.search(r"WindowGroupLimit .* Partial", below_first_shuffle)


@pytest.mark.parametrize("name", ["log_tail_one", "log_tail_all", "path_page", "path_page_after", "top_cpu"])
def test_limits_are_top_k(plan, name):
    assert "TakeOrderedAndProject" in plan(name)


def test_planning_runs_no_job(spark):
    """Queries that write files or streams first are left out."""
    tracker = spark.sparkContext.statusTracker()
    for name, build in registered().items():
        if name.startswith("stream_") or name in ("inventory_scan", "log_read_files", "fs_read_landed", "compacted_table"):
            continue
        spark.sparkContext.setJobGroup(name, name)
        build(spark, SF_DIR)
        found = tracker.getJobIdsForGroup(name)
        started = [i for i in found if tracker.getJobInfo(i) and len(tracker.getJobInfo(i).stageIds) > 1]
        assert not started, name  # reading a table's schema is a job of one stage, without a shuffle


def test_no_query_joins_without_a_key(spark):
    for name, build in registered().items():
        if name.startswith("stream_") or name in ("inventory_scan", "log_read_files"):
            continue  # run before they are planned; their parts are covered by others
        text = build(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_only_what_is_needed(plan):
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>", plan("fs_latest"))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan("directory_sizes")
    assert "html" not in plan("path_under_roots")


def test_filters_reach_the_scan(plan, spark, tmp_path):
    assert "EqualTo(source,src5)" in plan("log_by_name")
    Bindings(spark, SF_DIR).log_lines().write.partitionBy("log_name").parquet(f"{tmp_path}/t")
    tail = logs.tail_log(spark.read.parquet(f"{tmp_path}/t"), "src3")
    text = tail._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*log_name[^\]]*src3", text)


def test_parsers_are_narrow_and_split_once(plan):
    text = plan("transfer_parse")
    assert "Exchange" not in text and text.count("split(") == 1


def test_runs_are_matched_without_an_aggregate(plan):
    """A task would hold all its runs in one; and schedules are read once each, not once per job."""
    text = plan("cron_missed_runs")
    assert not re.search(r"Aggregate\([^\n]*job_id", text)
    assert "regexp_extract" not in text[text.rindex("Aggregate(") :]
