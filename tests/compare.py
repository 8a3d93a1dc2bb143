"""Running a registered query and its SQL, and comparing the rows."""

import datetime
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def duck(folder):
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    """A value in a form that is equal for both engines and can be sorted."""
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    """Rows with columns in order of name, sorted; types take part in the comparison."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    names = [columns[i] for i in order]
    return names, sorted(shaped, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    return rows_of([column[0] for column in result.description], result.fetchall())
