"""Loading the input tables, with the checks the operators rely on."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.measures import is_month
from fieldlens.sources.schema import SCHEMAS


@dataclass(frozen=True)
class Tables:
    productiondata: DataFrame
    completiondata: DataFrame
    fit_info: DataFrame
    producer_timestep: DataFrame
    injector_timestep: DataFrame
    rejected: DataFrame = None


def load(spark, folder, fmt="parquet", check=True, schemas=SCHEMAS):
    """The five tables below `folder`, each with its fixed schema.

    Tables may be partitioned by casename; a filter on one case then reads only
    its files. Production rows whose year or month is no calendar month go to
    `rejected`. With `check` the keys of the two dimension tables must be unique.
    Pass other `schemas` where ids are stored differently, e.g. as text.
    """
    frames = {
        name: spark.read.schema(schema).format(fmt).load(f"{folder}/{name}")
        for name, schema in schemas.items()
    }
    tables = Tables(**frames, rejected=rejects_of(frames["productiondata"]))
    if check:
        check_tables(tables)
    return tables


def rejects_of(production):
    """Production rows whose year or month is no calendar month."""
    return production.filter(~is_month("Year", "Month"))


def check_tables(tables):
    """Raise if a completion or a case occurs twice: joins would multiply sums.

    Measured rows join by id text and modelled rows by id number, so ids that are
    one number written in two ways count as the same. An unknown id joins nothing.
    """
    number = F.expr("coalesce(cast(try_cast(CompSubId AS INT) AS string), CompSubId)")
    completions = tables.completiondata.select("casename", "WellAPI", number.alias("CompSubId"))
    require_unique(completions, ["casename", "WellAPI", "CompSubId"], "completiondata")
    require_unique(tables.fit_info, ["casename"], "fit_info")


def require_unique(df, keys, name):
    """Raise ValueError with one example if a known key occurs more than once."""
    twice = df.dropna(subset=keys).groupBy(*keys).count().filter(F.col("count") > 1).take(1)
    if twice:
        raise ValueError(f"{name} is not unique by {keys}: {twice[0].asDict()}")


def list_cases(fit_info, n=None):
    """Case names in order: all, or the first n."""
    cases = fit_info.select("casename").distinct().orderBy("casename")
    return cases if n is None else cases.limit(n)
