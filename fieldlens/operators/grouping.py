"""Grouping by case and dimension, ordering, and numbering rows within a group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlens.functions.labels import FIELD
from fieldlens.operators.filters import one_case
from fieldlens.sources.schema import DIMENSIONS

BINS = 1024


def check_dims(dims):
    """Dimensions without repeats, in the given order."""
    unknown = [dim for dim in dims if dim not in DIMENSIONS]
    if unknown:
        raise ValueError(f"unknown dimensions {unknown}, expected some of {DIMENSIONS}")
    return list(dict.fromkeys(dims))


def group_columns(dims):
    """The dimensions, or the constant column that stands for the whole field."""
    return check_dims(dims) or [FIELD]


def with_field(df, dims):
    """Adds the constant column where there is no dimension."""
    return df if dims else df.withColumn(FIELD, F.lit(FIELD))


def per_case(df, case, *aggregates):
    """One row per case; for a named case always one, even without data."""
    if case is None:
        return df.groupBy("casename").agg(*aggregates)
    row = one_case(df, case).agg(*aggregates)
    return row.select(F.lit(case).alias("casename"), *row.columns)


def in_order(df, columns):
    return df.orderBy(*[F.col(name).asc_nulls_last() for name in columns])


def top_per_case(df, n, value, tie_breaker, case=None):
    """The n rows with the largest value; an unknown value counts as largest.

    For one case this is a limit. For all cases each task cuts its rows to n per
    case before the shuffle, so a case that holds most rows costs no more.
    """
    order = [F.col(value).desc_nulls_first(), F.col(tie_breaker).asc_nulls_last()]
    if case is not None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy("casename").orderBy(*order)))
    return ranked.filter(F.col("position") <= n).drop("position")


def depth_bin(measure):
    """A whole number that never falls as the measure rises: BINS of them between a value and its double.

    The same for all data, so that no bounds have to be sampled. NaN and then NULL come last, as in the order.
    """
    size = F.least(F.log2(F.abs(measure) + 1), F.lit(1100.0)) * BINS
    return F.when(measure.isNull(), 3000 * BINS).when(F.isnan(measure), 2000 * BINS).otherwise(
        (F.signum(measure) * F.floor(size)).cast("int")
    )


def number_along(df, keys, measure, tie, name):
    """Position of each row within its key, from 1, by a number and, where it is equal, by a further column.

    A key may hold any share of the rows, so no key is brought into one task: a histogram counts its
    rows by bins of the number, rows are numbered inside their bin, and moved up by what the histogram
    has below. Bins don't depend on the data; nothing runs or is written before the result is asked for.
    """
    value = F.col(measure).cast("double")
    binned = df.withColumn("bin", depth_bin(value))
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    histogram = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "bin", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("earlier")
    )
    inside = Window.partitionBy(*keys, "bin").orderBy(F.col(measure).asc_nulls_last(), F.col(tie).asc_nulls_last())
    numbered = binned.withColumn("inside", F.row_number().over(inside))
    return numbered.join(histogram, [*keys, "bin"]).select(*df.columns, (F.col("earlier") + F.col("inside")).alias(name))
