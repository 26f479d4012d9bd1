"""Tables larger than the small folder: results where scores pass their bounds, and tasks that stay small as the input grows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from tidemark.plans import catalogue, tables


def written(path, sql):
    duckdb.connect().execute(f"copy ({sql}) to '{path}/events.parquet' (format parquet)")
    return str(path)


def test_fusion_full_is_not_held_to_100(spark, tmp_path):
    """Each event of a user four times: the parts of one of the sessions add up to more than 100."""
    folder = written(tmp_path, "select e.* replace (event_id + r * 100000 as event_id) from '/root/testdata/sf0.1/events.parquet' e, range(4) t(r) where user_id in (1155, 794, 983)")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    found = catalogue.queries()["fusion_full"](spark, folder).toPandas()
    assert found.final_risk_score.max() > 100
    same_rows(found, con.execute(catalogue.oracle_sql()["fusion_full"]).df())


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100, raising=False)


def most_in_a_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_enrichment_is_dealt_by_size(spark, monkeypatch):
    """Ten times the events: no partition holds much more than its share of rows."""
    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)
    assert most_in_a_partition(tables.enriched(spark, "/root/testdata/sf0.01")) < 1_500


@pytest.mark.parametrize("name", ["upsert_latest", "alert_filter_lenient", "alert_search", "risky_of_both", "live_session_summary", "session_risk_summary"])
def test_same_rows_where_events_are_dealt(spark, duck, small_tasks, name):
    assert tables.task_count(spark, SMALL) > 4
    same_rows(catalogue.queries()[name](spark, SMALL).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["alert_list_hydrated", "alert_list_critical", "alert_list_live", "alert_details", "alert_dedup_richness", "alert_by_ids", "alert_merge_critical", "alert_hydrate_left", "alert_new_rows"])
def test_joins_by_event_are_dealt_by_size(spark, duck, small_tasks, name):
    """All joins and ranks by event, or by session, work in as many partitions as the events make."""
    tasks = tables.task_count(spark, SMALL)
    found = catalogue.queries()[name](spark, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks})" in plan and not re.findall(rf"hashpartitioning\((?!.*, {tasks}\))[^\n]*", plan)
    same_rows(found.toPandas(), duck.execute(catalogue.oracle_sql()[name]).df())
