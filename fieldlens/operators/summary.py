"""Counts and fit information, one row per case."""

from pyspark.sql import functions as F

from fieldlens.functions.labels import NOT_APPLICABLE, date_text, run_type
from fieldlens.operators.filters import injecting, one_case, producing
from fieldlens.operators.grouping import per_case


def well_activity(production):
    """One row per well: did it produce, did it inject, did its status change.

    The four counts below come from these rows, so they share one scan and one
    shuffle, and no row is multiplied for a distinct count.
    """
    return production.groupBy("casename", "WellAPI").agg(
        F.max(producing()).alias("produces"),
        F.max(injecting()).alias("injects"),
        (F.min("Status") != F.max("Status")).alias("converted"),
    )


def _wells_where(condition=None):
    return F.count(F.col("WellAPI") if condition is None else F.when(condition, F.col("WellAPI")))


def _counts():
    return {
        "total_wells": _wells_where(),
        "producer_wells": _wells_where(F.col("produces")),
        "injector_wells": _wells_where(F.col("injects")),
        "conversion_wells": _wells_where(F.col("converted")),
    }


def _count(production, case, *names):
    wanted = [_counts()[name].alias(name) for name in names]
    return per_case(well_activity(one_case(production, case)), case, *wanted)


def count_wells(production, case=None):
    return _count(production, case, "total_wells")


def count_producers(production, case=None):
    return _count(production, case, "producer_wells")


def count_injectors(production, case=None):
    return _count(production, case, "injector_wells")


def count_conversions(production, case=None):
    """Wells that had more than one status."""
    return _count(production, case, "conversion_wells")


def count_dims(completion, case=None):
    """Distinct layers, fault blocks and compartments; NULL is none of them."""
    return per_case(
        completion,
        case,
        F.countDistinct("Reservoir").alias("total_layers"),
        F.countDistinct("FaultBlock").alias("total_faultblocks"),
        F.countDistinct("Compartment").alias("total_compartments"),
    )


def case_summary(production, completion, case=None):
    """All counts of a case in one row; a case missing on one side counts zero there."""
    wells = _count(production, case, *_counts())
    parts = wells.unionByName(count_dims(completion, case), allowMissingColumns=True)
    names = [name for name in parts.columns if name != "casename"]
    return parts.groupBy("casename").agg(
        *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in names]
    )


def first_per_case(fit_info):
    """One row per case."""
    return fit_info.dropDuplicates(["casename"])


def fit_summary(fit_info, case=None):
    """Dates as text and the kind of run; only a backtest has a backtest end."""
    backtest = F.col("IsBacktest")
    return first_per_case(one_case(fit_info, case)).select(
        "casename",
        date_text("FitStartDate").alias("fit_startdate"),
        date_text("FitEndDate").alias("fit_enddate"),
        run_type(backtest).alias("fit_type"),
        F.when(backtest, date_text("BacktestEndDate"))
        .otherwise(F.lit(NOT_APPLICABLE))
        .alias("backtest_enddate"),
        F.col("Dt").alias("dt"),
    )
