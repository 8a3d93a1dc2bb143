"""Fixed schemas of the five input tables."""

from pyspark.sql import types as T

_STRING, _INT, _DOUBLE = T.StringType(), T.IntegerType(), T.DoubleType()
_DATE, _BOOL = T.DateType(), T.BooleanType()

PERCENTILES = ("10", "25", "50", "75", "90")


def _struct(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


def _percentile_columns(*phases):
    return {f"{phase}RateP{p}": _DOUBLE for phase in phases for p in PERCENTILES}


# Measured monthly rates: one row per (case, well, completion, month).
PRODUCTION = _struct(
    casename=_STRING, WellAPI=_STRING, CompSubId=_STRING, Year=_INT, Month=_INT, Status=_INT,
    Qo=_DOUBLE, Qw=_DOUBLE, Qg=_DOUBLE, Qs=_DOUBLE, BHP=_DOUBLE,
)

# The hierarchy: one row per (case, well, completion).
COMPLETION = _struct(
    casename=_STRING, WellAPI=_STRING, WellName=_STRING, CompSubId=_STRING,
    Reservoir=_STRING, FaultBlock=_STRING, Compartment=_STRING, Type=_STRING,
    Latitude=_DOUBLE, Longitude=_DOUBLE, X=_DOUBLE, Y=_DOUBLE, TD=_DOUBLE, Netpay=_DOUBLE,
)

# One row per case.
FIT_INFO = _struct(
    casename=_STRING, FitStartDate=_DATE, FitEndDate=_DATE, IsBacktest=_BOOL,
    BacktestEndDate=_DATE, Dt=_DOUBLE,
)

# Modelled rates: one row per (case, well, completion, date).
_STEP_KEYS = {"casename": _STRING, "WellId": _STRING, "CompletionId": _INT, "Date": _DATE}
PRODUCER_TIMESTEP = _struct(**_STEP_KEYS, **_percentile_columns("Oil", "Gross", "Gas"))
INJECTOR_TIMESTEP = _struct(**_STEP_KEYS, **_percentile_columns("Injectant"))

SCHEMAS = {
    "productiondata": PRODUCTION,
    "completiondata": COMPLETION,
    "fit_info": FIT_INFO,
    "producer_timestep": PRODUCER_TIMESTEP,
    "injector_timestep": INJECTOR_TIMESTEP,
}

# Columns by which results may be grouped, and those by which they may be filtered.
DIMENSIONS = ("WellAPI", "Compartment", "Reservoir", "FaultBlock", "Type")
FILTER_DIMENSIONS = ("WellAPI", "Reservoir", "Compartment", "FaultBlock")
