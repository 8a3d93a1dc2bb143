"""Well coordinates, paths and map groups."""

from pyspark.sql import functions as F

from fieldlens.functions.labels import group_label, hover_text
from fieldlens.operators.filters import keep_picks, one_case, with_keys, without_dimension
from fieldlens.operators.grouping import group_columns, number_along, with_field
from fieldlens.operators.selection import flag_wells, hide_unselected_wells

# Fixed values.
COORDINATES = {"Latitude": "Latitude", "Longitude": "Longitude", "Easting": "X", "Northing": "Y"}
PATH_KEYS = ("casename", "WellAPI", "is_selected")


def _marked(points, wells, hide_unselected):
    flagged = flag_wells(points, wells)
    return hide_unselected_wells(flagged, wells) if hide_unselected else flagged


def _rows(completion, dims, case, chosen):
    """The map marks chosen wells and filters by the other dimensions."""
    return with_field(keep_picks(one_case(completion, case), without_dimension(chosen, "WellAPI")), dims)


def _named(dims):
    """Dimensions, then well columns, each once."""
    return list(dict.fromkeys([*group_columns(dims), "WellName", "WellAPI"]))


def well_centroids(completion, dims=("Type",), case=None, chosen=None, wells=(), hide_unselected=False):
    """Mean coordinates of a well within the dimensions."""
    rows = _rows(completion, dims, case, chosen)
    means = [F.avg(column).alias(name) for name, column in COORDINATES.items()]
    points = rows.groupBy("casename", *_named(dims)).agg(*means)
    return _marked(points, wells, hide_unselected)


def well_points(completion, dims=("Type",), case=None, chosen=None, wells=(), hide_unselected=False):
    """Coordinates of every completion, with what orders them along the well."""
    rows = _rows(completion, dims, case, chosen)
    names = list(dict.fromkeys([*_named(dims), "Type"]))
    coordinates = [F.col(column).alias(name) for name, column in COORDINATES.items()]
    points = rows.select("casename", *names, *coordinates, "TD", "CompSubId")
    return _marked(points, wells, hide_unselected)


def well_paths(points):
    """Points numbered along their well by total depth; equal depths go by completion."""
    known = with_keys(points, PATH_KEYS).select(
        *PATH_KEYS, "WellName", *COORDINATES, "TD", "CompSubId"
    )
    return number_along(known, list(PATH_KEYS), "TD", "CompSubId", "point_no")


def well_lines(paths, points_per_line):
    """Numbered points as lines, one row each.

    A path longer than `points_per_line` goes on in further lines, each beginning with the
    last point of the one before, so no segment is lost and a row never grows beyond that.
    """
    if points_per_line < 2:
        raise ValueError("a line needs two points at least")
    step = points_per_line - 1
    at = F.floor((F.col("point_no") - 1) / step).cast("int")
    ends_one = (F.col("point_no") > 1) & ((F.col("point_no") - 1) % step == 0)
    placed = paths.withColumn(
        "line_no", F.explode(F.when(ends_one, F.array(at - 1, at)).otherwise(F.array(at)))
    )
    point = F.struct("point_no", "Longitude", "Latitude")
    lines = placed.groupBy(*PATH_KEYS, "line_no").agg(F.array_sort(F.collect_list(point)).alias("points"))
    # The last point of a path may also begin a line that has nothing else.
    lines = lines.filter((F.col("line_no") == 0) | (F.size("points") > 1))
    return lines.select(
        *PATH_KEYS, "line_no",
        F.col("points.Longitude").alias("longitudes"),
        F.col("points.Latitude").alias("latitudes"),
    )


def map_groups(points, dims=("Type",), path=False):
    """Points with the label of their group and their hover text; unknown groups are left out.

    With `path` a group is a well and not a value of the dimensions; mean
    coordinates have no path.
    """
    columns = ["WellAPI"] if path else group_columns(dims)
    groups = [*columns, "is_selected"]
    known = with_keys(points, groups)
    return known.withColumns(
        {
            "group_label": group_label(known, groups),
            "hover_text": hover_text(known, list(dict.fromkeys(["WellName", *columns]))),
        }
    )
