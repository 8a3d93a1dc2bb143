"""Well counts as bitmaps that can be merged: exact counts at any coarser level without the wells.

A distinct count shuffles a row per group and well, and can't be added up. Here wells get dense numbers per case, and a
group has one bitmap per 32,768 of them; bitmaps of finer groups merge into those of coarser ones.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlens.functions.measures import month_date
from fieldlens.operators.filters import of_phase
from fieldlens.operators.grouping import check_dims, group_columns, with_field
from fieldlens.operators.joins import production_rows, with_completion

SLICES = 64


def well_numbers(production):
    """(casename, well, number): the wells of a case numbered from 0 without gaps.

    Numbers run within slices by hash and are moved up by what earlier slices hold, so no case is sorted as a whole.
    """
    wells = production.filter(F.col("WellAPI").isNotNull()).select(
        "casename", F.col("WellAPI").alias("well"), F.pmod(F.xxhash64("WellAPI"), F.lit(SLICES)).alias("slice")
    ).distinct()
    inside = Window.partitionBy("casename", "slice").orderBy("well")
    earlier = Window.partitionBy("casename").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = wells.groupBy("casename", "slice").count().select(
        "casename", "slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    numbered = wells.withColumn("inside", F.row_number().over(inside)).join(sizes, ["casename", "slice"])
    return numbered.select("casename", "well", (F.col("before") + F.col("inside") - 1).alias("number"))


def well_bitmaps(production, completion, phase, dims=(), numbers=None, case=None, chosen=None):
    """The wells of each month and group as bitmaps: rows of (casename, date, dims, part, wells).

    `numbers` is the result of `well_numbers`, kept where bitmaps of several runs are to be merged.
    """
    dims = check_dims(dims)
    rows = production_rows(of_phase(production, phase), month_date("Year", "Month").alias("date"), case=case)
    if dims or chosen is not None:
        rows = with_completion(rows, completion, dims, chosen, case=case)
    numbered = rows.join(well_numbers(production) if numbers is None else numbers, ["casename", "well"], "left")
    bit = F.col("number") + 1
    return numbered.groupBy("casename", "date", *dims, F.bitmap_bucket_number(bit).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("wells")
    )


def merged_bitmaps(bitmaps, dims=()):
    """Bitmaps of finer groups merged into groups by fewer dimensions."""
    return bitmaps.groupBy("casename", "date", *check_dims(dims), "part").agg(F.bitmap_or_agg("wells").alias("wells"))


def well_counts(bitmaps, dims=()):
    """Wells per month and group, from bitmaps of these or of more dimensions."""
    counts = merged_bitmaps(bitmaps, dims).groupBy("casename", "date", *check_dims(dims)).agg(
        F.sum(F.when(F.col("part").isNotNull(), F.bitmap_count("wells")).otherwise(0)).alias("wellcount")
    )
    return with_field(counts, dims).select("casename", "date", *group_columns(dims), "wellcount")
