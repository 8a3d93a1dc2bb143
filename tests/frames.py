"""Small hand-made tables."""

import datetime

from fieldlens.sources import schema
from fieldlens.sources.tables import Tables

PRODUCTION_DEFAULTS = dict(
    casename="A", WellAPI="w1", CompSubId="1", Year=2020, Month=1, Status=1,
    Qo=1.0, Qw=2.0, Qg=3.0, Qs=0.0, BHP=100.0,
)
COMPLETION_DEFAULTS = dict(
    casename="A", WellAPI="w1", WellName="Well 1", CompSubId="1", Reservoir="R1", FaultBlock="F1",
    Compartment="C1", Type="producer", Latitude=1.0, Longitude=2.0, X=10.0, Y=20.0, TD=100.0, Netpay=5.0,
)
FIT_DEFAULTS = dict(
    casename="A", FitStartDate=datetime.date(2019, 1, 1), FitEndDate=datetime.date(2021, 1, 1),
    IsBacktest=True, BacktestEndDate=datetime.date(2020, 1, 1), Dt=1.0,
)
STEP_DEFAULTS = dict(casename="A", WellId="w1", CompletionId=1, Date=datetime.date(2020, 2, 1))


def _frame(spark, struct, defaults, rows):
    full = [{**defaults, **row} for row in rows]
    return spark.createDataFrame([tuple(row.get(name) for name in struct.names) for row in full], struct)


def production(spark, *rows):
    return _frame(spark, schema.PRODUCTION, PRODUCTION_DEFAULTS, rows)


def completion(spark, *rows):
    return _frame(spark, schema.COMPLETION, COMPLETION_DEFAULTS, rows)


def fit_info(spark, *rows):
    return _frame(spark, schema.FIT_INFO, FIT_DEFAULTS, rows)


def producer_steps(spark, *rows):
    return _frame(spark, schema.PRODUCER_TIMESTEP, STEP_DEFAULTS, rows)


def injector_steps(spark, *rows):
    return _frame(spark, schema.INJECTOR_TIMESTEP, STEP_DEFAULTS, rows)


def tables(spark, production_rows, completion_rows, fit_rows, producer_rows=(), injector_rows=()):
    return Tables(
        production(spark, *production_rows), completion(spark, *completion_rows),
        fit_info(spark, *fit_rows), producer_steps(spark, *producer_rows),
        injector_steps(spark, *injector_rows),
    )


def rows(df, *columns):
    """Rows as tuples, sorted where the caller does not depend on the order."""
    return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)
