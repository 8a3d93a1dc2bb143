"""Values a user can choose from, per case."""

from pyspark.sql import functions as F

from fieldlens.operators.filters import injecting, one_case, producing

# Kinds of dimension options and their columns.
OPTION_COLUMNS = {"layer": "Reservoir", "faultblock": "FaultBlock", "compartment": "Compartment"}


def well_options(production, completion, case=None):
    """Distinct wells by status, of rows that produce or inject.

    One scan serves both kinds. Rows become distinct before the names are joined,
    so a well's rows meet its completions only once.
    """
    active = (
        one_case(production, case)
        .filter(producing() | injecting())
        .select("casename", "WellAPI", "Status")
        .distinct()
    )
    names = one_case(completion, case).select("casename", "WellAPI", "WellName").distinct()
    return active.join(names, ["casename", "WellAPI"], "left").select(
        "casename", "WellName", "WellAPI", "Status"
    )


def options_of_status(options, status):
    """Label and value of the wells in one status."""
    return options.filter(F.col("Status") == status).select(
        "casename", F.col("WellName").alias("label"), F.col("WellAPI").alias("value")
    )


def dim_options(completion, case=None, named_only=True):
    """Distinct layers, fault blocks and compartments as (name, type)."""
    pairs = ", ".join(f"{column}, '{kind}'" for kind, column in OPTION_COLUMNS.items())
    options = (
        one_case(completion, case)
        .select("casename", F.expr(f"stack({len(OPTION_COLUMNS)}, {pairs}) AS (name, type)"))
        .distinct()
    )
    return options.filter(F.col("name").isNotNull()) if named_only else options
