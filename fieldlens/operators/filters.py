"""Row filters."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.measures import phase_status
from fieldlens.sources.schema import FILTER_DIMENSIONS


# The dimension that a list of chosen values belongs to.
LIST_DIMENSIONS = {
    "producers": "WellAPI", "injectors": "WellAPI", "layers": "Reservoir",
    "compartments": "Compartment", "faultblocks": "FaultBlock",
}


def one_case(df, case=None):
    """Rows of one case, or of all cases."""
    return df if case is None else df.filter(F.col("casename") == case)


def producing():
    """True where oil, water and gas add up to more than nothing; unknown if one is."""
    return F.col("Qo") + F.col("Qw") + F.col("Qg") > 0


def injecting():
    return F.col("Qs") > 0


def of_phase(production, phase):
    """Measured rows of wells in the status that carries the phase."""
    return production.filter(F.col("Status") == phase_status(phase))


def picks(wells=(), layers=(), compartments=(), faultblocks=()):
    """Chosen values by dimension; an empty list chooses nothing and filters nothing."""
    chosen = dict(zip(FILTER_DIMENSIONS, (wells, layers, compartments, faultblocks)))
    return {dimension: list(values) for dimension, values in chosen.items() if len(values) > 0}


def in_picks(chosen):
    """Predicate of all chosen dimensions, or None if nothing is chosen."""
    tests = [F.col(dimension).isin(values) for dimension, values in (chosen or {}).items()]
    return reduce(and_, tests) if tests else None


def has_choice(chosen):
    """Whether anything may be chosen; what a table of chosen values holds is known at run time only."""
    return isinstance(chosen, DataFrame) or bool(chosen)


def without_dimension(chosen, dimension):
    """The chosen values of the other dimensions."""
    if isinstance(chosen, DataFrame):
        kept = [name for name, of in LIST_DIMENSIONS.items() if of != dimension]
        return chosen.filter(F.col("list").isin(kept))
    return {name: values for name, values in (chosen or {}).items() if name != dimension}


def keep_picks(df, chosen):
    """Rows that meet the chosen values: lists by dimension, or a table of them."""
    if isinstance(chosen, DataFrame):
        return _keep_selected(df, chosen)
    predicate = in_picks(chosen)
    return df if predicate is None else df.filter(predicate)


# Chosen values as a table: rows of (casename, list, value), as `merge_selection` leaves them.
# There may be any number of them per case, and they never pass the driver.


def chosen_values(selection):
    """Each chosen value once, as (casename, dimension, value); NULL and unknown lists choose nothing."""
    names = F.create_map(*[F.lit(text) for pair in LIST_DIMENSIONS.items() for text in pair])
    values = selection.select("casename", F.try_element_at(names, F.col("list")).alias("dimension"), "value")
    return values.dropna().distinct()


def dimensions_in_use(selection):
    """One row per case that has chosen anything: `{dimension}_used` tells by which dimensions it filters."""
    used = [F.max(F.col("dimension") == name).alias(f"{name}_used") for name in FILTER_DIMENSIONS]
    return chosen_values(selection).groupBy("casename").agg(*used)


def flag_chosen(df, selection, dimensions):
    """Adds `{dimension}_selected`: the row's case has chosen the row's value."""
    values, columns = chosen_values(selection), df.columns
    for name in dimensions:
        flag = f"{name}_selected"
        side = values.filter(F.col("dimension") == name).select("casename", F.col("value").alias(name), F.lit(True).alias(flag))
        df = df.join(side, ["casename", name], "left")
    flags = [F.coalesce(f"{name}_selected", F.lit(False)).alias(f"{name}_selected") for name in dimensions]
    return df.select(*columns, *flags)


def _keep_selected(df, selection):
    """Rows with a chosen value in every dimension their case filters by; a list that a case lacks filters nothing."""
    flagged = flag_chosen(df, selection, FILTER_DIMENSIONS)
    met = [F.col(f"{name}_selected") | ~F.coalesce(f"{name}_used", F.lit(False)) for name in FILTER_DIMENSIONS]
    return flagged.join(dimensions_in_use(selection), "casename", "left").filter(reduce(and_, met)).select(*df.columns)


def with_keys(df, columns):
    """Rows in which every column is known, as grouping by them needs."""
    return df.dropna(subset=list(columns))
