"""Rates, volumes and months as column expressions."""

from pyspark.sql import functions as F

PHASES = ("oil", "gross", "water", "injectant", "gas")

# Fixed values.
MEAN_MONTH_DAYS = 30.42  # days, for volumes on a constant month
TO_THOUSANDS = 1e-3
TO_MILLIONS = 1e-6
BANDS = ("10-90", "25-75")
PRODUCER_STATUS = 1
INJECTOR_STATUS = 2


def check_phase(phase):
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}, expected one of {PHASES}")
    return phase


def is_month(year, month):
    """True for a calendar month, false for an impossible one, NULL for an unknown one."""
    return F.col(month).between(1, 12) & F.col(year).between(1, 9999)


def month_date(year, month):
    """First day of the month; NULL for an impossible or unknown one."""
    return F.when(is_month(year, month), F.make_date(F.col(year), F.col(month), F.lit(1)))


def days_in_month(date):
    return F.dayofmonth(F.last_day(date))


def actual_rate(phase):
    """Measured rate of a phase; gross is oil plus water, so NULL if either is."""
    return {
        "oil": F.col("Qo"),
        "water": F.col("Qw"),
        "gas": F.col("Qg"),
        "injectant": F.col("Qs"),
        "gross": F.col("Qo") + F.col("Qw"),
    }[check_phase(phase)]


def fit_rate(phase, percentile):
    """Modelled rate of a phase at a stored percentile.

    Water is the difference of the gross and oil percentiles, not a percentile of
    the difference; its lower bound may therefore lie above its upper one.
    """
    if check_phase(phase) == "water":
        return F.col(f"GrossRateP{percentile}") - F.col(f"OilRateP{percentile}")
    return F.col(f"{phase.capitalize()}RateP{percentile}")


def percentiles(band):
    """'25-75' to ('25', '75')."""
    if band not in BANDS:
        raise ValueError(f"unknown percentile band {band!r}, expected one of {BANDS}")
    lower, upper = band.split("-")
    return lower, upper


def phase_status(phase):
    """Well status whose rows carry the phase."""
    return INJECTOR_STATUS if check_phase(phase) == "injectant" else PRODUCER_STATUS


def fit_table(tables, phase):
    """The modelled table that holds the phase."""
    return tables.injector_timestep if check_phase(phase) == "injectant" else tables.producer_timestep


def mean_month_volume(summed_rate):
    """Volume, in thousands, of a summed rate on months of constant length."""
    return summed_rate * MEAN_MONTH_DAYS * TO_THOUSANDS


def calendar_volume(rate, date):
    """Volume of one month from its calendar length; scale after summing."""
    return rate * days_in_month(date)
