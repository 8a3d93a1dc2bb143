"""Measured against modelled volume after the backtest boundary."""

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.labels import group_label, hover_text, text_of
from fieldlens.functions.measures import (
    actual_rate, check_phase, fit_rate, fit_table, mean_month_volume, month_date,
)
from fieldlens.operators.filters import flag_chosen, with_keys
from fieldlens.operators.grouping import check_dims
from fieldlens.operators.joins import (
    ON_COMPLETION, production_rows, step_rows, with_bounds, with_either_completion,
)

# Fixed values.
DEFAULT_KEYS = ("WellAPI", "WellName", "Reservoir")
WELL_KEYS = ("WellAPI", "WellName")
DEFAULT_HUE = ("WellAPI", "Reservoir")
AXIS_MARGIN = 1.2
FLAG_ORDER = ("WellAPI", "Reservoir", "FaultBlock", "Compartment")


def crossplot_keys(dims=(), include_wells=True):
    """Grouping columns of a crossplot, in a fixed order."""
    dims = check_dims(dims)
    if not dims:
        return list(DEFAULT_KEYS)
    return list(dict.fromkeys([*dims, *(WELL_KEYS if include_wells else ())]))


def _volumes(rows, completion, phase, keys, case=None, chosen=None):
    """Measured and modelled volume and mean net pay per key, of rows that `is_fit` tells apart.

    Rows are summed per completion before the completions are joined. Net pay is the mean over
    production rows, so each completion weighs as many rows as it had.
    """
    sums = rows.groupBy(*ON_COMPLETION, "is_fit").agg(F.sum("rate").alias("rate"), F.count(F.lit(1)).alias("weight"))
    joined = with_either_completion(sums, completion, [*keys, F.col("Netpay").alias("pay")], chosen, case)
    actual, fit = F.when(~F.col("is_fit"), F.col("rate")), F.when(F.col("is_fit"), F.col("rate"))
    weight = F.when(~F.col("is_fit") & F.col("pay").isNotNull(), F.col("weight"))
    return joined.groupBy("casename", *keys).agg(
        mean_month_volume(F.sum(actual)).alias(f"actual_{phase}"),
        mean_month_volume(F.sum(fit)).alias(f"fit_{phase}"),
        (F.sum(F.col("pay") * weight) / F.sum(weight)).alias("netpay"),
        F.min("is_fit").alias("only_fit"),
        F.max("is_fit").alias("has_fit"),
    )


def _measured(production, phase, case):
    rate = actual_rate(phase).alias("rate")
    rows = production_rows(production, month_date("Year", "Month").alias("date"), rate, case=case)
    return rows.withColumn("is_fit", F.lit(False))


def _modelled(steps, phase, case):
    rows = step_rows(steps, F.col("Date").alias("date"), fit_rate(phase, "50").alias("rate"), case=case)
    return rows.withColumns({"completion": F.col("completion").cast("string"), "is_fit": F.lit(True)})


def actual_cum(production, completion, fit_info, phase, keys, case=None, chosen=None):
    """Measured volume and mean net pay per key, of known completions."""
    rows = with_bounds(_measured(production, phase, case), fit_info, "date")
    return _volumes(rows, completion, phase, keys, case, chosen).select("casename", *keys, f"actual_{phase}", "netpay")


def fit_cum(steps, completion, fit_info, phase, keys, case=None, chosen=None):
    """Modelled median volume per key, on the same dates."""
    rows = with_bounds(_modelled(steps, phase, case), fit_info, "date")
    return _volumes(rows, completion, phase, keys, case, chosen).select("casename", *keys, f"fit_{phase}")


def crossplot(tables, phase, dims=(), include_wells=True, case=None, chosen=None, hide_unselected=False):
    """One row per key with measured and modelled volume.

    Chosen values filter only with `hide_unselected`; see `mark_selected` for the
    other use of them.
    """
    check_phase(phase)
    keys = crossplot_keys(dims, include_wells)
    both = _measured(tables.productiondata, phase, case).unionByName(_modelled(fit_table(tables, phase), phase, case))
    rows = with_bounds(both, tables.fit_info, "date")
    points = _volumes(rows, tables.completiondata, phase, keys, case, chosen if hide_unselected else None)
    # A group that one side lacks, or with an unknown key, has no partner.
    return with_keys(points.filter("has_fit and not only_fit"), keys).select(
        "casename", *keys, f"actual_{phase}", f"fit_{phase}", "netpay"
    )


def selected_flags(points, keys, chosen):
    """One flag per filter dimension: false unless it is a key and the value is chosen."""
    dimensions = [dimension for dimension in FLAG_ORDER if dimension in keys]
    if isinstance(chosen, DataFrame):
        flagged = flag_chosen(points, chosen, dimensions)
    else:
        listed = {d: F.coalesce(F.col(d).isin((chosen or {}).get(d, [])), F.lit(False)) for d in dimensions}
        flagged = points.withColumns({f"{d}_selected": flag for d, flag in listed.items()})
    unused = [F.lit(False).alias(f"{d}_selected") for d in FLAG_ORDER if d not in dimensions]
    order = [f"{d}_selected" for d in FLAG_ORDER]
    return flagged.select("*", *unused).select(*points.columns, *order)


def mark_selected(points, keys, chosen):
    """Adds the flags and `is_selected`: true where every flag in use is true.

    A flag that no row of a case has is not in use there; without any in use nothing is selected. Flags are the bits of
    a number, and the bits in use are one number per case. Both sides of that join read the same
    columns of the points, so the points' last exchange runs once and serves both.
    """
    flagged = selected_flags(points, keys, chosen)
    bits = [F.col(f"{d}_selected").cast("int") * (1 << i) for i, d in enumerate(FLAG_ORDER)]
    masked = flagged.withColumn("mask", reduce(add, bits))
    in_use = masked.groupBy("casename").agg(
        F.bit_or("mask").alias("in_use"), F.max(F.xxhash64(*points.columns)).alias("every_column")
    )
    needed = in_use.filter("every_column is not null").drop("every_column")
    selected = (F.col("in_use") != 0) & (F.col("mask").bitwiseAND(F.col("in_use")) == F.col("in_use"))
    return masked.join(needed, "casename").select(*flagged.columns, selected.alias("is_selected"))


def crossplot_ranges(points, phase):
    """Per case: axis ends, and the 1:1 line from nothing to the largest measured volume."""
    actual, fit = F.max(f"actual_{phase}"), F.max(f"fit_{phase}")
    return points.groupBy("casename").agg(
        F.lit(0.0).alias("line_from"),
        actual.alias("line_to"),
        (actual * AXIS_MARGIN).alias("actual_axis_to"),
        (fit * AXIS_MARGIN).alias("fit_axis_to"),
    )


def crossplot_groups(points, keys, dims=(), hue=DEFAULT_HUE):
    """Points with the label of their group and their hover text.

    Only hues among the chosen dimensions group; points with an unknown one are
    left out.
    """
    groups = [name for name in dict.fromkeys(hue) if name in dims] + ["is_selected"]
    known = with_keys(points, groups)
    texts = known.withColumn("netpay", text_of(F.col("netpay")))
    return known.withColumns(
        {"group_label": group_label(known, groups), "hover_text": hover_text(texts, [*keys, "netpay"])}
    )
