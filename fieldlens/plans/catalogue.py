"""Registered queries: every operator over all cases of the derived tables.

Each query takes (spark, folder of parquet files) and returns a DataFrame. Scaled
volumes are rounded to six decimals, as the SQL they are compared with does.
"""

import uuid

from pyspark.sql import functions as F

from fieldlens.functions.labels import parse_date
from fieldlens.functions.measures import (
    INJECTOR_STATUS, PHASES, PRODUCER_STATUS, actual_rate, days_in_month, fit_rate, fit_table, month_date,
)
from fieldlens.operators import crossplot as xplot
from fieldlens.operators import joins, modelled, options, selection, series, summary, totals, wellcounts, wellmap
from fieldlens.operators.filters import picks
from fieldlens.plans.derived import DerivedTables
from fieldlens.sources import artefacts
from fieldlens.sources.files import tasks
from fieldlens.sources.layout import buckets_for, read_layout, work_folder, write_layout
from fieldlens.sources.records import records_and_rejects, write_records, write_texts_as_lists
from fieldlens.sources.schema import FIT_INFO, SCHEMAS
from fieldlens.sources.tables import list_cases, load

# Choices a user might have made; the SQL repeats them.
CASE = "ASIA"
LAYERS = ["RES_1", "RES_3"]
COMPARTMENTS = ["CMP_1"]
FAULTBLOCKS = ["FB_0", "FB_2"]
WELLS = [f"W{number}" for number in range(1, 60) if number not in (7, 10)]
DIMS = ("Reservoir", "FaultBlock")
RANGE = 64 << 10  # bytes of a list of records that a task scans

QUERIES = {}


def query(name):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(DerivedTables(spark, folder))
        return build

    return register


def rounded(df, *columns):
    return df.withColumns({name: F.round(F.col(name), 6) for name in columns})


# Counts and case information


@query("list_cases")
def _(t):
    return list_cases(t.fit_runs, 5)


@query("list_all_cases")
def _(t):
    return list_cases(t.fit_runs)


@query("case_summary")
def _(t):
    return summary.case_summary(t.productiondata, t.completiondata)


@query("case_summary_one_case")
def _(t):
    return summary.case_summary(t.productiondata, t.completiondata, CASE)


@query("count_wells")
def _(t):
    return summary.count_wells(t.productiondata)


@query("count_producers")
def _(t):
    return summary.count_producers(t.productiondata)


@query("count_injectors")
def _(t):
    return summary.count_injectors(t.productiondata)


@query("count_conversions")
def _(t):
    return summary.count_conversions(t.productiondata)


@query("count_dims")
def _(t):
    return summary.count_dims(t.completiondata)


@query("fit_summary")
def _(t):
    return summary.fit_summary(t.fit_runs)


# Rows and column expressions


@query("month_lengths")
def _(t):
    date = month_date("Year", "Month")
    return t.productiondata.select(date.alias("date"), days_in_month(date).alias("days")).distinct()


@query("parsed_dates")
def _(t):
    return t.dated_texts.select("key", parse_date("text").alias("date"))


@query("measured_rates")
def _(t):
    rates = [actual_rate(phase).alias(phase) for phase in PHASES]
    rows = joins.production_rows(t.productiondata, "Year", "Month", *rates)
    return joins.with_completion(rows, t.completiondata, DIMS)


@query("modelled_rates")
def _(t):
    rates = [fit_rate(phase, "50").alias(phase) for phase in PHASES if phase != "injectant"]
    rows = joins.step_rows(t.producer_timestep, F.col("Date").alias("date"), *rates)
    return joins.with_completion(rows, t.completiondata, DIMS, numbered=True)


# Measured series


@query("production_by_month")
def _(t):
    return series.production_by_month(t.productiondata)


@query("production_by_reservoir")
def _(t):
    return series.production_by_reservoir(t.productiondata, t.completiondata)


@query("production_by_faultblock")
def _(t):
    return series.production_by_faultblock(t.productiondata, t.completiondata)


@query("production_by_month_fanout")
def _(t):
    return series.production_by_month(t.productiondata, t.completiondata, fanout=True)


@query("production_by_reservoir_fanout")
def _(t):
    return series.production_by_reservoir(t.productiondata, t.completiondata, fanout=True)


@query("production_by_faultblock_fanout")
def _(t):
    return series.production_by_faultblock(t.productiondata, t.completiondata, fanout=True)


def _actual(t, phase, **more):
    return series.actual_series(t.productiondata, t.completiondata, phase, **more)


@query("actual_series_by_dims")
def _(t):
    return _actual(t, "oil", dims=DIMS)


@query("actual_series_by_well")
def _(t):
    return _actual(t, "gross", dims=("WellAPI", "Type"))


@query("actual_series_filtered")
def _(t):
    chosen = picks(WELLS, LAYERS, COMPARTMENTS, FAULTBLOCKS)
    return _actual(t, "water", dims=("Compartment",), chosen=chosen)


@query("actual_series_one_case")
def _(t):
    return _actual(t, "oil", dims=("Reservoir",), case=CASE, chosen=picks(layers=LAYERS))


@query("series_groups")
def _(t):
    dims = ("Compartment", "Reservoir")
    return series.series_groups(_actual(t, "gas", dims=dims, ordered=False), dims, "gas")


@query("series_with_props")
def _(t):
    dims = ("Compartment",)
    actual = _actual(t, "oil", dims=dims, ordered=False)
    return series.with_props(actual, dims, "oil", ("wellcount", "bhp"))


@query("well_counts_by_reservoir")
def _(t):
    return wellcounts.well_counts(wellcounts.well_bitmaps(t.productiondata, t.completiondata, "oil", ("Reservoir",)), ("Reservoir",))


@query("well_counts_merged")
def _(t):
    """Counts of the field from the bitmaps of its layers and blocks."""
    fine = wellcounts.well_bitmaps(t.productiondata, t.completiondata, "oil", DIMS)
    return wellcounts.well_counts(fine)


# Modelled series


def _fit(t, phase, **more):
    return modelled.fit_series(fit_table(t, phase), t.completiondata, t.fit_info, phase, **more)


@query("fit_series_wide_band")
def _(t):
    return _fit(t, "water", band="10-90", dims=DIMS)


@query("fit_series_filtered")
def _(t):
    return _fit(t, "oil", dims=("Reservoir",), chosen=picks(WELLS, LAYERS))


@query("fit_series_one_case")
def _(t):
    return _fit(t, "gross", case=CASE)


@query("fit_band")
def _(t):
    fit = _fit(t, "oil", dims=("Compartment",), ordered=False)
    band = modelled.fit_band(fit, "oil", dims=("Compartment",))
    return band.withColumn("x", F.col("x").cast("array<string>"))


@query("actual_with_band")
def _(t):
    dims = ("Reservoir",)
    actual, fit = _actual(t, "oil", dims=dims, ordered=False), _fit(t, "oil", dims=dims, ordered=False)
    return modelled.actual_with_band(actual, fit, dims, "oil")


# Totals and rankings

VOLUMES = [f"{phase}_cum" for phase in totals.CUMULATIVE_PHASES]


@query("cumulative")
def _(t):
    return rounded(totals.cumulative(t.productiondata), *VOLUMES)


@query("cumulative_display")
def _(t):
    return totals.cumulative_display(totals.cumulative(t.productiondata))


@query("top_wells")
def _(t):
    return rounded(totals.top_wells(t.productiondata, t.completiondata), "oil_cum")


@query("top_layers")
def _(t):
    return rounded(totals.top_layers(t.productiondata, t.completiondata), "oil_cum")


@query("top_wells_one_case")
def _(t):
    return rounded(totals.top_wells(t.productiondata, t.completiondata, case=CASE), "oil_cum")


# By a table of chosen values


def _selection(t):
    """Wells chosen on a map in all cases, merged with other lists that some cases have."""
    return selection.merge_selection(_from_map(t), t.picked_values, ordered=False)


@query("actual_series_by_selection")
def _(t):
    return _actual(t, "oil", dims=("Reservoir",), chosen=_selection(t))


@query("field_series_by_selection")
def _(t):
    return _actual(t, "gross", chosen=t.picked_values)


@query("fit_series_by_selection")
def _(t):
    return _fit(t, "water", band="10-90", dims=("FaultBlock",), chosen=_selection(t))


@query("fit_band_by_selection")
def _(t):
    fit = _fit(t, "oil", dims=("Reservoir",), chosen=_selection(t), ordered=False)
    band = modelled.fit_band(fit, "oil", dims=("Reservoir",))
    return band.withColumn("x", F.col("x").cast("array<string>"))


@query("crossplot_by_selection")
def _(t):
    return _crossplot(t, "oil", DIMS, chosen=_selection(t), hide_unselected=True)


@query("crossplot_marked_by_selection")
def _(t):
    return xplot.mark_selected(_crossplot(t, "oil", DIMS), xplot.crossplot_keys(DIMS), _selection(t))


@query("well_points_by_selection")
def _(t):
    return wellmap.well_points(t.completiondata, ("Reservoir",), chosen=_selection(t), wells=t.selected_points)


# Crossplot


def _crossplot(t, phase, dims=(), **more):
    return rounded(xplot.crossplot(t, phase, dims, **more), f"actual_{phase}", f"fit_{phase}")


@query("crossplot_default_keys")
def _(t):
    return _crossplot(t, "oil")


@query("crossplot_without_wells")
def _(t):
    return _crossplot(t, "gross", ("Compartment",), include_wells=False)


@query("crossplot_hide_unselected")
def _(t):
    chosen = picks(WELLS, LAYERS, COMPARTMENTS, FAULTBLOCKS)
    return _crossplot(t, "oil", ("Type",), chosen=chosen, hide_unselected=True)


@query("crossplot_selected")
def _(t):
    keys = xplot.crossplot_keys(DIMS)
    chosen = picks(WELLS, LAYERS, COMPARTMENTS, ["no such block"])
    return xplot.mark_selected(_crossplot(t, "oil", DIMS), keys, chosen)


@query("crossplot_ranges")
def _(t):
    ranges = xplot.crossplot_ranges(xplot.crossplot(t, "injectant", DIMS), "injectant")
    return rounded(ranges, "line_to", "actual_axis_to", "fit_axis_to")


@query("crossplot_groups")
def _(t):
    keys = xplot.crossplot_keys(DIMS)
    points = xplot.mark_selected(_crossplot(t, "oil", DIMS), keys, picks(layers=LAYERS))
    groups = xplot.crossplot_groups(points, keys, DIMS, ("WellAPI", "Reservoir", "FaultBlock"))
    return groups.select("casename", "group_label", "hover_text", "actual_oil", "fit_oil")


# Map


@query("well_centroids")
def _(t):
    return wellmap.well_centroids(t.completiondata, DIMS, wells=WELLS)


@query("well_points")
def _(t):
    return wellmap.well_points(t.completiondata, wells=t.selected_points)


@query("well_points_hide_unselected")
def _(t):
    return wellmap.well_points(
        t.completiondata, ("Reservoir",), chosen=picks(layers=LAYERS),
        wells=t.selected_points, hide_unselected=True,
    )


@query("well_paths")
def _(t):
    return wellmap.well_paths(wellmap.well_points(t.completiondata, wells=WELLS))


@query("map_groups_of_centroids")
def _(t):
    centroids = wellmap.well_centroids(t.completiondata, DIMS, wells=WELLS)
    return wellmap.map_groups(centroids, DIMS).drop("hover_text")


@query("map_groups_by_path")
def _(t):
    points = wellmap.well_points(t.completiondata, wells=t.selected_points)
    return wellmap.map_groups(points, path=True).select("casename", "group_label", "hover_text", "TD")


@query("well_lines")
def _(t):
    paths = wellmap.well_paths(wellmap.well_points(t.completiondata, wells=t.selected_points))
    return wellmap.well_lines(paths, 1000)


@query("well_lines_short")
def _(t):
    paths = wellmap.well_paths(wellmap.well_points(t.completiondata, wells=t.selected_points))
    return wellmap.well_lines(paths, 3)


@query("map_groups")
def _(t):
    dims = ("Compartment", "Type")
    return wellmap.map_groups(wellmap.well_points(t.completiondata, dims, wells=WELLS), dims)


# Options and selection


@query("well_options")
def _(t):
    return options.well_options(t.productiondata, t.completiondata)


@query("producer_options")
def _(t):
    return options.options_of_status(
        options.well_options(t.productiondata, t.completiondata), PRODUCER_STATUS
    )


@query("injector_options")
def _(t):
    return options.options_of_status(
        options.well_options(t.productiondata, t.completiondata), INJECTOR_STATUS
    )


@query("dim_options")
def _(t):
    return options.dim_options(t.completiondata)


def _from_map(t):
    wells = options.well_options(t.productiondata, t.completiondata)
    return selection.resolve_selection(t.selected_points, wells)


@query("resolve_selection")
def _(t):
    return _from_map(t)


@query("resolve_selection_from_crossplot")
def _(t):
    wells = options.well_options(t.productiondata, t.completiondata)
    points = xplot.crossplot(t, "oil", ("Compartment", "FaultBlock"))
    return selection.resolve_selection(points, wells, options.dim_options(t.completiondata))


@query("merge_selection")
def _(t):
    injecting = options.options_of_status(
        options.well_options(t.productiondata, t.completiondata), INJECTOR_STATUS
    )
    current = injecting.select("casename", F.lit(selection.INJECTORS).alias("list"), "value")
    return selection.merge_selection(_from_map(t), current)


# Artefacts


@query("latest_prediction")
def _(t):
    return artefacts.latest_prediction(t.predictions)


@query("artefact_paths")
def _(t):
    return artefacts.artefact_paths(t.predictions, ["fit", "name"])


@query("artefact_path")
def _(t):
    return t.predictions.select(
        "name",
        artefacts.artefact_path("manifest", *artefacts.FIT_OUTPUT).alias("fit_output"),
        artefacts.artefact_path("manifest", *artefacts.SENSITIVITY_MATRIX).alias("sensitivity"),
    )


FIT_OUTPUT_SCHEMA = "loss double, wells array<struct<name:string,r2:double>>"


def _contents(t, file):
    """The last prediction of every customer with what its manifest names."""
    root = work_folder(t.spark)
    artefacts.write_contents(t.artefacts, root).write.format("noop").mode("overwrite").save()
    last = artefacts.latest_prediction(t.customer_predictions).withColumnRenamed("latest", "name")
    named = t.customer_predictions.join(last, ["fit", "name"], "left_semi")
    return artefacts.read_contents(named.select("fit", "name", artefacts.artefact_path("manifest", *file).alias("path")), root=root)


@query("artefact_documents")
def _(t):
    documents = artefacts.json_documents(_contents(t, artefacts.FIT_OUTPUT), FIT_OUTPUT_SCHEMA)
    return documents.select("fit", "name", "path", "status", "document.loss", F.explode_outer("document.wells").alias("w")).select(
        "fit", "name", "path", "status", "loss", F.col("w.name").alias("well"), "w.r2"
    )


@query("artefact_cells")
def _(t):
    return artefacts.csv_cells(_contents(t, artefacts.SENSITIVITY_MATRIX)).drop("path")


# Tables written and read again


def _laid_out(t):
    prefix = f"layout_{uuid.uuid4().hex}"
    # Modelled rows are sums of measured ones, so no table has more rows than the measured one.
    write_layout(t, work_folder(t.spark), prefix, buckets_for(t.productiondata, t.completiondata))
    return read_layout(t.spark, prefix)


@query("actual_series_from_layout")
def _(t):
    laid = _laid_out(t)
    return series.actual_series(laid.productiondata, laid.completiondata, "oil", ("Compartment", "Type"))


@query("crossplot_from_layout")
def _(t):
    return _crossplot(_laid_out(t), "gas", DIMS)


@query("loaded_counts")
def _(t):
    """Counts of tables as `load` reads them, with impossible months among their rows."""
    folder = work_folder(t.spark)
    for name in SCHEMAS:
        write_records(getattr(t, name), f"{folder}/{name}", "parquet", partition_by=["casename"])
    loaded = load(t.spark, folder)
    rejected = loaded.rejected.groupBy("casename").agg(F.count(F.lit(1)).alias("rejected_rows"))
    counts = summary.case_summary(loaded.productiondata, loaded.completiondata)
    return counts.join(rejected, "casename", "left")


def _fit_run_lists(t):
    """Case information as lists of records, of which some don't fit the schema."""
    key = F.substring("casename", 4, 20).cast("bigint")
    folder = work_folder(t.spark)
    whole, broken = F.to_json(F.struct(*t.fit_runs.columns)), F.to_json(F.struct("casename", F.lit('no "number"}, [\\').alias("Dt")))
    # A file of orders may be one row group, which is one task's to read; the lists are made and written by as many as are asked for.
    runs = t.fit_runs.repartition(tasks(t.spark), "casename")
    write_texts_as_lists(runs.select(F.when(key % 17 == 0, broken).otherwise(whole).alias("text")), folder)
    return records_and_rejects(t.spark, folder, FIT_INFO, lines=False, chunk=RANGE)


@query("list_records")
def _(t):
    return _fit_run_lists(t)[0]


@query("list_rejects")
def _(t):
    return _fit_run_lists(t)[1].select(F.get_json_object("text", "$.casename").alias("casename"))


def _per_phase(phase):
    query(f"actual_series_{phase}")(lambda t: _actual(t, phase))
    query(f"fit_series_{phase}")(lambda t: _fit(t, phase))
    query(f"crossplot_{phase}")(lambda t: _crossplot(t, phase, DIMS))


for _phase in PHASES:
    _per_phase(_phase)
