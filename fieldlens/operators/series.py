"""Measured rates by month."""

from pyspark.sql import functions as F

from fieldlens.functions.labels import group_label, known_or_na
from fieldlens.functions.measures import actual_rate, month_date
from fieldlens.operators.filters import has_choice, of_phase
from fieldlens.operators.grouping import check_dims, group_columns, in_order, with_field
from fieldlens.operators.joins import completions_per_well, production_rows, with_completion

SECONDARY = ("wellcount", "bhp")


def actual_series(production, completion, phase, dims=(), case=None, chosen=None, ordered=True):
    """Summed rate, well count and mean pressure per month and dimensions.

    Without dimensions or chosen values no completion is needed: each row has at
    most one, so the join would change nothing and is left out.
    """
    dims = check_dims(dims)
    rows = production_rows(
        of_phase(production, phase),
        month_date("Year", "Month").alias("date"),
        actual_rate(phase).alias("rate"),
        "BHP",
        case=case,
    )
    if dims or has_choice(chosen):
        rows = with_completion(rows, completion, dims, chosen, case=case)
    sums = rows.groupBy("casename", "date", *dims).agg(
        F.sum("rate").alias(phase),
        F.countDistinct("well").alias("wellcount"),
        F.avg("BHP").alias("bhp"),
    )
    groups = group_columns(dims)
    series = with_field(sums, dims).select("casename", "date", *groups, phase, *SECONDARY)
    return in_order(series, ["casename", *groups, "date"]) if ordered else series


def production_by_month(production, completion=None, case=None, fanout=False, ordered=True):
    """All four rates per month, whatever the status."""
    return _production_by(production, completion, None, None, case, fanout, ordered)


def production_by_reservoir(production, completion, case=None, fanout=False, ordered=True):
    return _production_by(production, completion, "Reservoir", "reservoir", case, fanout, ordered)


def production_by_faultblock(production, completion, case=None, fanout=False, ordered=True):
    return _production_by(production, completion, "FaultBlock", "faultblock", case, fanout, ordered)


def _production_by(production, completion, dim, name, case, fanout, ordered):
    """Rates by month and one dimension.

    `fanout` counts a row once for every completion of its well, as a join without
    the completion id does. Rows are summed per well first and then multiplied by
    the number of completions, so none is repeated.
    """
    dims = [] if dim is None else [dim]
    rates = {"oil": "Qo", "water": "Qw", "gas": "Qg", "inj": "Qs"}
    rows = production_rows(
        production,
        month_date("Year", "Month").alias("date"),
        *[F.col(column).alias(rate) for rate, column in rates.items()],
        case=case,
    )
    if completion is None and (fanout or dims):
        raise ValueError("fanout needs the completions")
    if fanout:
        # A row without completion id matches no completion and is counted once.
        has_id = F.col("completion").isNotNull().alias("has_id")
        rows = rows.groupBy("casename", "well", "date", has_id).agg(
            *[F.sum(rate).alias(rate) for rate in rates]
        )
        sizes = completions_per_well(completion, dims).withColumn("has_id", F.lit(True))
        rows = rows.join(sizes, ["casename", "well", "has_id"], "left").withColumns(
            {rate: F.col(rate) * F.coalesce("completions", F.lit(1)) for rate in rates}
        )
    elif dims:
        rows = with_completion(rows, completion, dims, case=case)
    keys = ["casename", "date", *[F.col(dim).alias(name) for dim in dims]]
    series = rows.groupBy(*keys).agg(*[F.sum(rate).alias(rate) for rate in rates])
    names = [name] if dims else []
    return in_order(series, ["casename", *names, "date"]) if ordered else series


def series_groups(series, dims, phase):
    """Series rows with the label of their group; an unknown dimension reads 'NA'."""
    groups = group_columns(dims)
    filled = series.withColumns({name: known_or_na(F.col(name)) for name in groups})
    return filled.withColumn("group_label", group_label(filled, groups)).select(
        "casename", "group_label", "date", phase
    )


def with_props(series, dims, phase, props=("wellcount",)):
    """Secondary series next to the rate: rows of (group, name, date, value)."""
    unknown = [prop for prop in props if prop not in SECONDARY]
    if unknown:
        raise ValueError(f"unknown secondary series {unknown}, expected some of {SECONDARY}")
    groups = group_columns(dims)
    filled = series.withColumns({name: known_or_na(F.col(name)) for name in groups})
    label = group_label(filled, groups)
    names = [phase, *props]
    pairs = ", ".join(f"'{name}', cast({name} as double)" for name in names)
    return filled.select(
        "casename", label.alias("group_label"), "date",
        F.expr(f"stack({len(names)}, {pairs}) AS (series, value)"),
    )
