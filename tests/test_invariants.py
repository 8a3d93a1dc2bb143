"""Relations that hold between results, on the derived tables."""

import pytest
from compare import DATA
from frames import rows
from pyspark.sql import functions as F

from fieldlens.functions.measures import month_date
from fieldlens.operators import joins, modelled, options, series
from fieldlens.operators.filters import injecting, producing
from fieldlens.plans.derived import DerivedTables
from fieldlens.sources.tables import check_tables


@pytest.fixture(scope="module")
def t(spark):
    return DerivedTables(spark, str(DATA / "sf0.01"))


def test_dimension_keys_are_unique(t):
    check_tables(t)


def test_completion_join_keeps_rows(t):
    joined = joins.with_completion(joins.production_rows(t.productiondata), t.completiondata, ["Reservoir"])
    unmatched = joined.filter(F.col("Reservoir").isNull()).count()
    assert joined.count() == t.productiondata.count() == 60000
    assert unmatched == 1707


def test_series_by_status_add_up_to_all_production(t):
    months = series.production_by_month(t.productiondata, ordered=False).groupBy("casename").agg(F.sum("inj").alias("v"))
    injected = series.actual_series(t.productiondata, t.completiondata, "injectant", ordered=False)
    assert rows(months) == rows(injected.groupBy("casename").agg(F.sum("injectant").alias("v")))


@pytest.mark.parametrize("dims", [["Reservoir"], ["Compartment", "Type"], ["WellAPI"]])
def test_groups_add_up_to_the_field(t, dims):
    def total(dims):
        actual = series.actual_series(t.productiondata, t.completiondata, "gross", dims, ordered=False)
        return rows(actual.groupBy("casename", "date").agg(F.sum("gross").alias("v")))

    assert total(dims) == total([])


def test_training_and_validation_are_everything(t):
    fit = modelled.fit_series(t.producer_timestep, t.completiondata, t.fit_info, "gas", ordered=False)
    by_case = fit.groupBy("casename").agg(F.sum("gas_rate_p50").alias("v"))
    assert rows(by_case) == rows(t.producer_timestep.groupBy("casename").agg(F.sum("GasRateP50").alias("v")))
    kinds = rows(fit.select("casename", "type_of_fit").distinct())
    assert [case for case, kind in kinds if kind == "validation"] == ["AFRICA", "ASIA", "MIDDLE EAST"]


def test_one_scan_equals_the_literal_union(t):
    joined = t.productiondata.alias("p").join(
        t.completiondata.select("casename", "WellAPI", "WellName"), ["casename", "WellAPI"], "left"
    )
    columns = ["casename", "WellName", "WellAPI", "Status"]
    union = joined.filter(producing()).select(*columns).union(joined.filter(injecting()).select(*columns)).distinct()
    assert rows(union) == rows(options.well_options(t.productiondata, t.completiondata))


def test_one_case_equals_its_part_of_all(t):
    everything = series.actual_series(t.productiondata, t.completiondata, "water", ["Reservoir"])
    one = series.actual_series(t.productiondata, t.completiondata, "water", ["Reservoir"], case="EUROPE")
    assert rows(everything.filter("casename = 'EUROPE'")) == rows(one)


def test_month_dates_are_first_days(t):
    dates = t.productiondata.select(month_date("Year", "Month").alias("d")).distinct()
    assert dates.filter(F.dayofmonth("d") != 1).count() == 0
