"""What the plans do: pushed filters, early cuts, nothing computed that is not asked for."""

import re

import pytest
from compare import DATA
from pyspark.sql import functions as F

from fieldlens.operators import crossplot, filters, series, summary, totals, wellmap
from fieldlens.plans.catalogue import QUERIES
from fieldlens.plans.derived import DerivedTables


@pytest.fixture(scope="module")
def t(spark):
    return DerivedTables(spark, str(DATA / "sf0.01"))


@pytest.fixture
def plan_of(capsys):
    def text(frame, mode="simple"):
        capsys.readouterr()
        frame.explain(mode)
        return capsys.readouterr().out

    return text


def test_top_of_one_case_is_a_limit(t, plan_of):
    assert "TakeOrderedAndProject(limit=10" in plan_of(totals.top_wells(t.productiondata, t.completiondata, case="ASIA"))


def test_top_of_all_cases_is_cut_before_the_shuffle(t, plan_of):
    plan = plan_of(totals.top_wells(t.productiondata, t.completiondata))
    assert "row_number(), 10, Partial" in plan and "row_number(), 10, Final" in plan


def test_field_series_needs_no_completion(t, plan_of):
    plan = plan_of(series.actual_series(t.productiondata, t.completiondata, "oil"))
    assert "Generate" not in plan and "SortMergeJoin" not in plan


def test_series_without_well_count_has_no_distinct(t, plan_of):
    actual = series.actual_series(t.productiondata, t.completiondata, "oil", ["Reservoir"], ordered=False)
    assert "distinct" in plan_of(actual)
    plan = plan_of(series.series_groups(actual, ["Reservoir"], "oil"))
    assert "distinct" not in plan and "BHP" not in plan


def test_counts_share_one_pass_without_expand(t, plan_of):
    plan = plan_of(summary.well_activity(t.productiondata))
    counts = plan_of(summary.count_producers(t.productiondata))
    assert plan.count("lineitem.parquet") == counts.count("lineitem.parquet") == 1
    assert "Expand" not in counts


def test_totals_are_summed_before_the_join(t, plan_of):
    lines = plan_of(totals.top_layers(t.productiondata, t.completiondata)).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line and "completion" in line)
    scan = next(i for i, line in enumerate(lines) if "lineitem.parquet" in line)
    assert any("partial_sum(oil" in line for line in lines[join:scan])


def test_scans_read_only_what_is_used(t, plan_of):
    plan = plan_of(series.production_by_month(t.productiondata), "formatted")
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "l_" in line]
    assert len(read) == 1 and "l_orderkey" not in read[0]


def exchanges(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final, len(re.findall(r"^[ :+*-]*Exchange hashpartitioning", final, re.MULTILINE))


def test_crossplot_sums_both_sides_in_one_exchange(t):
    """One for the sums per completion, one for those per key; the small completions may be dealt as well."""
    plan, shuffles = exchanges(crossplot.crossplot(t, "oil", ["Reservoir", "FaultBlock"]))
    derived = exchanges(t.producer_timestep)[1]
    of_rates = [line for line in plan.splitlines() if re.search("partial_sum.*rate", line)]
    assert len(of_rates) == 2 and shuffles - derived <= 3 and "SortMergeJoin" not in plan


def test_marking_runs_the_points_once(spark, t):
    points = crossplot.crossplot(t, "oil", ["Reservoir"])
    keys = crossplot.crossplot_keys(["Reservoir"])
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    marked = crossplot.mark_selected(points, keys, filters.picks(wells=["W1"], layers=["RES_1"]))
    assert len(jobs.getJobIdsForGroup()) == before
    plan, _ = exchanges(marked)
    assert "ReusedExchange" in plan and plan.count("lineitem.parquet") == exchanges(points)[0].count("lineitem.parquet")


def test_paths_are_lazy(spark, t):
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    paths = wellmap.well_paths(wellmap.well_points(t.completiondata))
    assert len(jobs.getJobIdsForGroup()) == before and paths.count() == t.completiondata.count()


def test_many_chosen_values_stay_out_of_the_plan(spark, t, plan_of):
    cases = t.fit_info.select("casename")
    chosen = spark.range(100_000).select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("value"), F.lit("producers").alias("list")).join(cases)
    frame = series.actual_series(t.productiondata, t.completiondata, "oil", ["Reservoir"], chosen=chosen)
    plan = plan_of(frame)
    assert len(plan) < 20_000 and "W99999" not in plan
    assert frame.count() > 0


@pytest.mark.parametrize("name", ["case_summary", "crossplot_oil", "fit_series_oil"])
def test_no_hinted_broadcast(spark, name, plan_of):
    """Without a checked size nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(QUERIES[name](spark, str(DATA / "sf0.01")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Cartesian" not in plan
