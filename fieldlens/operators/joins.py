"""Joins of the fact tables to the hierarchy and to case information.

No side is broadcast by hint. Spark broadcasts a side whose size it has checked
(spark.sql.autoBroadcastJoinThreshold, again at run time under AQE) and otherwise
merges sorted sides, splitting hot keys.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.filters import dimensions_in_use, keep_picks, one_case

ON_COMPLETION = ["casename", "well", "completion"]


def production_rows(production, *columns, case=None):
    """Measured rows with the keys of the completion join."""
    return one_case(production, case).select(
        "casename",
        F.col("WellAPI").alias("well"),
        F.col("CompSubId").alias("completion"),
        *columns,
    )


def step_rows(steps, *columns, case=None):
    """Modelled rows with the keys of the completion join; ids join as integers."""
    return one_case(steps, case).select(
        "casename",
        F.col("WellId").alias("well"),
        F.expr("try_cast(CompletionId AS INT)").alias("completion"),
        *columns,
    )


def with_completion(rows, completion, columns, chosen=None, numbered=False, case=None):
    """Rows with columns of their completion.

    Rows without a completion stay, with NULL columns, unless values are chosen: a
    chosen value can only be met by a completion, so these are picked first and
    the join keeps matches only. A table of chosen values does so in the cases that have
    any. `numbered` joins by the id's number.
    """
    number = F.expr("try_cast(CompSubId AS INT)") if numbered else F.col("CompSubId")
    side = keep_picks(one_case(completion, case), chosen).select(
        "casename",
        F.col("WellAPI").alias("well"),
        number.alias("completion"),
        *columns,
    )
    if not isinstance(chosen, DataFrame):
        return rows.join(side, ON_COMPLETION, "inner" if chosen else "left")
    filtering = dimensions_in_use(chosen).select("casename", F.lit(True).alias("filtered"))
    joined = rows.join(side.withColumn("met", F.lit(True)), ON_COMPLETION, "left").join(filtering, "casename", "left")
    return joined.filter("met or filtered is null").drop("met", "filtered")


def with_either_completion(rows, completion, columns, chosen=None, case=None):
    """Measured (`is_fit` false) and modelled rows with columns of their completion; others drop out.

    One join serves both: a completion offers its id as text to the one and as number to the other.
    """
    number = F.expr("string(try_cast(CompSubId AS INT))")
    ids = F.array(
        F.struct(F.lit(False).alias("is_fit"), F.col("CompSubId").alias("completion")),
        F.struct(F.lit(True).alias("is_fit"), number.alias("completion")),
    )
    side = keep_picks(one_case(completion, case), chosen).select(
        "casename", F.col("WellAPI").alias("well"), *columns, F.inline(ids)
    )
    return rows.join(side, [*ON_COMPLETION, "is_fit"])


def with_bounds(rows, fit_info, date):
    """Rows after the backtest boundary of their case; cases without one drop out."""
    bounds = fit_info.filter(F.col("BacktestEndDate").isNotNull()).select(
        "casename", F.col("BacktestEndDate").alias("boundary")
    )
    return rows.join(bounds, "casename").filter(F.col("boundary") < F.col(date)).drop("boundary")


def completions_per_well(completion, columns=()):
    """How many completions a well has, per value of the columns."""
    return completion.groupBy(
        "casename", F.col("WellAPI").alias("well"), *columns
    ).agg(F.count(F.lit(1)).alias("completions"))
