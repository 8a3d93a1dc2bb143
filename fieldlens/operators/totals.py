"""Cumulative volumes and rankings, on calendar months."""

from pyspark.sql import functions as F

from fieldlens.functions.labels import date_range_text, round_for_display
from fieldlens.functions.measures import (
    TO_MILLIONS, TO_THOUSANDS, actual_rate, calendar_volume, month_date,
)
from fieldlens.operators.filters import one_case
from fieldlens.operators.grouping import per_case, top_per_case
from fieldlens.operators.joins import ON_COMPLETION, production_rows, with_completion

CUMULATIVE_PHASES = ("oil", "water", "gas", "injectant")


def cumulative(production, case=None):
    """First and last month and the volume of four phases, in millions."""
    date = month_date("Year", "Month")
    rows = one_case(production, case).select(
        "casename",
        date.alias("date"),
        *[calendar_volume(actual_rate(phase), date).alias(phase) for phase in CUMULATIVE_PHASES],
    )
    return per_case(
        rows,
        case,
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        *[(F.sum(phase) * TO_MILLIONS).alias(f"{phase}_cum") for phase in CUMULATIVE_PHASES],
    )


def cumulative_display(totals):
    """The totals rounded to two decimals, with their dates as one text."""
    volumes = [f"{phase}_cum" for phase in CUMULATIVE_PHASES]
    return round_for_display(totals, volumes).select(
        "casename", *volumes, date_range_text("min_date", "max_date").alias("date_range")
    )


def oil_volume_by(production, completion, dim, case=None):
    """Oil volume, in thousands, per value of a completion column; NULL is a value.

    Rows are summed per completion before the completions are joined.
    """
    volume = calendar_volume(actual_rate("oil"), month_date("Year", "Month"))
    sums = (
        production_rows(production, volume.alias("oil"), case=case)
        .groupBy(*ON_COMPLETION)
        .agg(F.sum("oil").alias("oil"))
    )
    joined = with_completion(sums, completion, [dim], case=case)
    return joined.groupBy("casename", dim).agg((F.sum("oil") * TO_THOUSANDS).alias("oil_cum"))


def top_wells(production, completion, n=10, case=None):
    """The n well names with the largest oil volume, per case."""
    volumes = oil_volume_by(production, completion, "WellName", case)
    return top_per_case(volumes, n, "oil_cum", "WellName", case)


def top_layers(production, completion, n=10, case=None):
    """The n layers with the largest oil volume, per case."""
    volumes = oil_volume_by(production, completion, "Reservoir", case)
    return top_per_case(volumes, n, "oil_cum", "Reservoir", case)
