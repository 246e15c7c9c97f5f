"""What must stay true of the physical plans at any scale."""

import re

import pytest

from monofila.checks.registry import Bench
from monofila.operators import consolidate as C
from monofila.operators import profiles as P
from monofila.operators.bitmaps import person_bitmaps
from monofila.plans import reports as R

FOLDER = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_consolidation_shuffles_filings_and_history_once(spark, no_broadcast):
    b = Bench(spark, FOLDER)
    text = plan(b.computed)
    assert len(re.findall(r"Exchange hashpartitioning\(tenant#\d+, ", text)) == 2
    above_union = text[: text.index("Union")]
    assert above_union.count("SortMergeJoin") == 1
    assert above_union.count("Exchange hashpartitioning") == 1, "survivors move once, before the join"
    assert "Window" not in text and "Expand" not in text


def test_survivors_combine_before_the_shuffle(spark):
    text = plan(C.survivors(Bench(spark, FOLDER).universe))
    exchange = text.index("Exchange hashpartitioning")
    assert "partial_min" in text[exchange:] and "partial_count" in text[exchange:]


def test_catalogue_is_broadcast_by_size_not_by_hint(spark):
    u = Bench(spark, FOLDER).universe
    assert plan(u).count("BroadcastHashJoin") == 4
    assert "ResolvedHint" not in u._jdf.queryExecution().analyzed().toString()


def test_scans_are_pruned(spark):
    b = Bench(spark, FOLDER)
    text = plan(R.by_classification(b.consolidated))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(s == "classification:string" for s in schemas)
    counted = re.findall(r"ReadSchema: struct<([^>]*)>", plan(R.source_contribution(b.universe, b.consolidated)))
    assert all("o_orderdate" not in s for s in counted)


def test_no_report_uses_a_cross_join_or_a_global_window_on_groups(spark):
    b = Bench(spark, FOLDER)
    for df in (
        R.headline(b.consolidated, b.universe, b.notices), R.by_territory(b.consolidated), R.labour_reasons(b.notices),
        R.findings(b.people, b.consolidated), R.funnel(b.universe, b.consolidated),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Window" not in text


def test_pareto_window_sees_only_the_top(spark):
    text = plan(R.advisor_pareto(Bench(spark, FOLDER).consolidated))
    window = text.index("Window [")
    assert "TakeOrderedAndProject" in text[window:]


def test_tenant_reports_read_one_partition(spark):
    b = Bench(spark, FOLDER)
    text = plan(R.headline(b.consolidated, b.received, b.notices, tenant=1))
    assert re.search(r"PartitionFilters: \[[^\]]*tenant", text)


def test_raw_counts_need_no_lookup(spark):
    b = Bench(spark, FOLDER)
    for df in (R.funnel(b.received, b.consolidated), R.headline(b.consolidated, b.received, b.notices)):
        # The derived official filings themselves join the catalogue once; the report adds none.
        assert len(re.findall(r"\w+Join ", plan(df))) <= 1


def test_staging_filters_reach_the_scan(spark):
    text = plan(Bench(spark, FOLDER).desk)
    assert "EqualTo(o_orderpriority,5-LOW)" in text


def test_reports_on_persons_read_the_written_counters(spark):
    b = Bench(spark, FOLDER)
    for df in (
        R.quality_by_source(b.people, tenant=1), R.channel_combinations(b.people), R.quality_status(b.people, tenant=1),
        R.findings(b.people, b.consolidated, tenant=1), P.duplicity_of_people(b.people),
    ):
        text = plan(df)
        assert "person_key" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", text))
        assert "o_orderkey" not in text, "no report goes back to the filings"


def test_panels_come_from_one_scan(spark):
    b = Bench(spark, FOLDER)
    text = plan(R.panels(b.consolidated, tenant=0))
    assert text.count("FileScan") == 1
    assert text.index("Generate") < text.rindex("Exchange hashpartitioning"), "rows are spread after the first aggregation"


def test_bitmaps_move_filings_once(spark):
    text = plan(person_bitmaps(Bench(spark, FOLDER).universe, "tenant", "channel"))
    assert len(re.findall(r"Exchange hashpartitioning\(person_key", text)) == 1
    assert "partial_bitmap_construct_agg" in text and "partial_collect_set" in text
