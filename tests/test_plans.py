"""What the physical plans must and must not contain."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from airloom.operators import positions  # noqa: E402
from airloom.session import written  # noqa: E402
from driver_queries.spark_side import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
WRITING = {name for name in QUERIES if name.startswith(("stream_", "closed_"))} | {"upsert_table"}


def plan_of(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_query_pairs_everything_with_everything_or_leaves_the_jvm(spark, name):
    plan = plan_of(spark, name)
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert banned not in plan


def test_scans_are_narrow_and_filtered(spark):
    plan = plan_of(spark, "trend_day")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "events" in line)
    assert "props" not in scan and "event_id" not in scan
    assert "GreaterThanOrEqual(ts" in scan


def test_rankings_are_cut_before_the_shuffle(spark):
    for name in ("ranking", "context_anomalies", "latest_insights", "nearest", "first_sensor", "batch_deduplicated"):
        assert "WindowGroupLimit" in plan_of(spark, name)


def test_cells_around_cities_are_dealt_out_before_a_join_is_chosen(spark):
    plan = plan_of(spark, "nearest")
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\w+)#\d+L?, \d+\), REPARTITION_BY_COL", plan)
    assert ("band", "cell") in dealt and ("city_id", "band") in dealt


def test_documents_are_dealt_out_before_they_are_parsed(spark):
    assert re.search(r"hashpartitioning\(event_id#\d+L, \d+\), REPARTITION_BY_COL", plan_of(spark, "weather_readings"))


def test_comparison_reads_the_readings_once(spark, monkeypatch):
    sorted_once = []
    monkeypatch.setattr(positions, "written", lambda rows, name: sorted_once.append(rows) or written(rows, name))
    plan = plan_of(spark, "compare")
    before = sorted_once[0]._jdf.queryExecution().executedPlan().toString()
    assert before.count("events.parquet") == 1 and "events.parquet" not in plan
    assert "rank(" not in before and "rank(" not in plan  # ranks come from places
