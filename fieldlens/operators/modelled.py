"""Modelled rates by date: the median and a percentile band."""

from pyspark.sql import functions as F

from fieldlens.functions.labels import fit_type, known_or_na
from fieldlens.functions.measures import check_phase, fit_rate, percentiles
from fieldlens.operators.filters import has_choice
from fieldlens.operators.grouping import check_dims, group_columns, in_order, with_field
from fieldlens.operators.joins import step_rows, with_completion


def rate_columns(phase, band):
    """Result names of the median, lower and upper rate."""
    lower, upper = percentiles(band)
    return [f"{phase}_rate_p{p}" for p in ("50", lower, upper)]


def fit_series(
    steps, completion, fit_info, phase, band="25-75", dims=(), case=None, chosen=None, ordered=True
):
    """Summed modelled rates per date and dimensions, labelled training or validation.

    The label depends on case and date only, so it is added to the summed rows and
    not to every modelled one.
    """
    dims = check_dims(dims)
    check_phase(phase)
    names = rate_columns(phase, band)
    rates = [fit_rate(phase, name.rsplit("_p", 1)[1]).alias(name) for name in names]
    rows = step_rows(steps, F.col("Date").alias("date"), *rates, case=case)
    if dims or has_choice(chosen):
        rows = with_completion(rows, completion, dims, chosen, numbered=True, case=case)
    sums = rows.groupBy("casename", "date", *dims).agg(*[F.sum(name).alias(name) for name in names])
    bounds = fit_info.select("casename", "IsBacktest", "BacktestEndDate")
    label = fit_type(F.col("IsBacktest"), F.col("BacktestEndDate"), F.col("date"))
    groups = group_columns(dims)
    series = (
        with_field(sums, dims)
        .join(bounds, "casename", "left")
        .select("casename", "date", *groups, label.alias("type_of_fit"), *names)
    )
    return in_order(series, ["casename", *groups, "date"]) if ordered else series


def fit_band(series, phase, band="25-75", dims=()):
    """The band of each group as one closed outline.

    Dates run forwards along the lower rate and back along the upper one. A series
    has one row per group and date, so an outline is as long as its calendar.
    """
    _, lower, upper = rate_columns(phase, band)
    groups = group_columns(dims)
    filled = series.withColumns({name: known_or_na(F.col(name)) for name in groups})
    point = F.struct("date", F.col(lower).alias("lower"), F.col(upper).alias("upper"))
    outlines = filled.groupBy("casename", *groups, "type_of_fit").agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )
    dates, lows, highs = (F.col(f"points.{part}") for part in ("date", "lower", "upper"))
    return outlines.select(
        "casename", *groups, "type_of_fit",
        F.concat(dates, F.reverse(dates)).alias("x"),
        F.concat(lows, F.reverse(highs)).alias("y"),
    )


def actual_with_band(actual, fit, dims, phase):
    """Measured and modelled rates of the same group and date side by side.

    A date or group that only one of them has stays, as the months after the last measured one do.
    """
    groups = group_columns(dims)
    left, right = actual.alias("a"), fit.alias("f")
    same = [F.col(f"a.{key}").eqNullSafe(F.col(f"f.{key}")) for key in ["casename", "date", *groups]]
    rates = [name for name in fit.columns if name.startswith(f"{phase}_rate_p")]
    keys = ["casename", "date", *groups]
    return left.join(right, same, "full").select(
        *[F.coalesce(f"a.{name}", f"f.{name}").alias(name) if name in keys else f"a.{name}" for name in actual.columns],
        "f.type_of_fit",
        *[f"f.{name}" for name in rates],
    )
