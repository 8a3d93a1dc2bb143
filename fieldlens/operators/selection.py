"""Chosen wells and values: flags, and what a selection of points adds to them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.measures import INJECTOR_STATUS, PRODUCER_STATUS
from fieldlens.operators.options import OPTION_COLUMNS

# The list that a kind of option belongs to.
LIST_NAMES = {"layer": "layers", "faultblock": "faultblocks", "compartment": "compartments"}
PRODUCERS, INJECTORS = "producers", "injectors"


def flag_wells(points, wells=()):
    """Adds `is_selected`: the well is chosen.

    Wells are a list, or for long or per-case selections a DataFrame of
    (casename, WellAPI).
    """
    if isinstance(wells, DataFrame):
        chosen = wells.select("casename", "WellAPI").distinct().withColumn("chosen", F.lit(True))
        joined = points.join(chosen, ["casename", "WellAPI"], "left")
        return joined.select(*points.columns, F.col("chosen").isNotNull().alias("is_selected"))
    listed = F.col("WellAPI").isin(list(wells)) if len(wells) > 0 else F.lit(False)
    return points.withColumn("is_selected", F.coalesce(listed, F.lit(False)))


def hide_unselected_wells(flagged, wells=()):
    """Only chosen wells; where a case has none chosen, all of them."""
    if isinstance(wells, DataFrame):
        cases = wells.filter(F.col("WellAPI").isNotNull()).select("casename").distinct()
        joined = flagged.join(cases.withColumn("has_chosen", F.lit(True)), "casename", "left")
        kept = joined.filter(F.col("is_selected") | F.col("has_chosen").isNull())
        return kept.select(*flagged.columns)
    return flagged.filter("is_selected") if len(wells) > 0 else flagged


def resolve_wells(points, well_options):
    """The list of each selected well: producers if it is an option there, else injectors."""
    kinds = (
        well_options.filter(F.col("Status").isin(PRODUCER_STATUS, INJECTOR_STATUS))
        .groupBy("casename", "WellAPI")
        .agg(F.max(F.col("Status") == PRODUCER_STATUS).alias("is_producer"))
    )
    wells = points.select("casename", "WellAPI").distinct().join(kinds, ["casename", "WellAPI"])
    name = F.when(F.col("is_producer"), F.lit(PRODUCERS)).otherwise(F.lit(INJECTORS))
    return wells.select("casename", name.alias("list"), F.col("WellAPI").alias("value"))


def resolve_dims(points, dim_options):
    """Layers, fault blocks and compartments of selected points that are options."""
    columns = {kind: name for kind, name in OPTION_COLUMNS.items() if name in points.columns}
    pairs = ", ".join(f"{name}, '{kind}'" for kind, name in columns.items())
    values = points.select(
        "casename", F.expr(f"stack({len(columns)}, {pairs}) AS (name, type)")
    ).distinct()
    name = F.create_map(*[F.lit(text) for pair in LIST_NAMES.items() for text in pair])[F.col("type")]
    return values.join(dim_options, ["casename", "type", "name"], "left_semi").select(
        "casename", name.alias("list"), F.col("name").alias("value")
    )


def resolve_selection(points, well_options, dim_options=None):
    """Values that selected points add, as rows of (case, list, value).

    Points carry any of WellAPI, Reservoir, FaultBlock and Compartment.
    """
    parts = []
    if "WellAPI" in points.columns:
        parts.append(resolve_wells(points, well_options))
    if dim_options is not None and any(name in points.columns for name in OPTION_COLUMNS.values()):
        parts.append(resolve_dims(points, dim_options))
    if not parts:
        raise ValueError("points carry no column that can be selected")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def merge_selection(new, current, ordered=True):
    """New values and current ones, each once and sorted."""
    columns = ["casename", "list", "value"]
    merged = new.select(*columns).union(current.select(*columns)).distinct()
    return merged.orderBy(*columns) if ordered else merged
