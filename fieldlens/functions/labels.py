"""Labels and texts as column expressions."""

from pyspark.sql import functions as F

NO_VALUE = "NA"
NOT_APPLICABLE = "N/A"
FIELD = "field"


def fit_type(is_backtest, boundary, date):
    """Training up to the backtest boundary, validation after it.

    A backtest without a boundary is validation throughout; a case that is not a
    backtest, or does not say, is training.
    """
    inside = F.when(boundary >= date, F.lit("training")).otherwise(F.lit("validation"))
    return F.when(is_backtest, inside).otherwise(F.lit("training"))


def run_type(is_backtest):
    return F.when(is_backtest, F.lit("BT")).otherwise(F.lit("FF"))


def date_text(date):
    return F.date_format(date, "yyyy-MM-dd")


def parse_date(text):
    """Date of a text that may carry a time after its first ten characters."""
    return F.to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def date_range_text(start, end):
    return F.concat_ws(" to ", date_text(start), date_text(end))


def text_of(column, data_type=None):
    """Text of a value as a label shows it: booleans capitalised."""
    text = column.cast("string")
    return F.initcap(text) if data_type == "boolean" else text


def known_or_na(column):
    """A dimension with NULL shown as 'NA'."""
    return F.coalesce(column, F.lit(NO_VALUE))


def _typed(df, columns):
    kinds = dict(df.dtypes)
    return [text_of(F.col(name), kinds[name]) for name in columns]


def group_label(df, columns):
    """Values of the columns joined by '-'."""
    return F.concat_ws("-", *_typed(df, columns))


def hover_text(df, columns, separator="<br>"):
    """'column: value' pairs, one per column; NULL reads 'None'."""
    pairs = [
        F.concat(F.lit(f"{name}: "), F.coalesce(text, F.lit("None")))
        for name, text in zip(columns, _typed(df, columns))
    ]
    return F.concat_ws(separator, *pairs)


def round_for_display(df, columns, digits=2):
    """Columns rounded half to even."""
    return df.withColumns({name: F.bround(F.col(name), digits) for name in columns})
