"""Edge cases on hand-made rows: NULLs, boundaries, empty choices, ties."""

import datetime

import frames
import pytest
from frames import completion, fit_info, producer_steps, production, rows
from pyspark.sql import functions as F

from fieldlens.functions import labels, measures
from fieldlens.operators import crossplot, grouping, modelled, options, selection, series, summary, totals, wellcounts, wellmap
from fieldlens.operators.filters import picks
from fieldlens.sources.tables import list_cases

day = datetime.date


# Counts


def test_unknown_rate_does_not_make_a_producer(spark):
    prod = production(spark, {"WellAPI": "w1", "Qg": None}, {"WellAPI": "w2"}, {"WellAPI": "w3", "Qo": 0.0, "Qw": 0.0, "Qg": 0.0})
    assert rows(summary.count_producers(prod)) == [("A", 1)]
    assert rows(summary.count_wells(prod)) == [("A", 3)]


def test_case_without_such_wells_counts_none(spark):
    prod = production(spark, {"casename": "A"}, {"casename": "B", "Qs": 2.0})
    assert rows(summary.count_injectors(prod)) == [("A", 0), ("B", 1)]
    assert rows(summary.count_wells(prod, case="absent")) == [("absent", 0)]


def test_conversions_ignore_unknown_status(spark):
    prod = production(
        spark, {"WellAPI": "w1"}, {"WellAPI": "w1", "Status": 2}, {"WellAPI": "w2"}, {"WellAPI": "w2", "Status": None},
        {"WellAPI": None, "Status": 1}, {"WellAPI": None, "Status": 2},
    )
    assert rows(summary.count_conversions(prod)) == [("A", 1)]


def test_dim_counts_leave_null_out(spark):
    comp = completion(spark, {"Compartment": None}, {"CompSubId": "2", "Reservoir": "R2", "Compartment": "C1"})
    assert rows(summary.count_dims(comp)) == [("A", 2, 1, 1)]


def test_summary_of_a_case_on_one_side_only(spark):
    result = summary.case_summary(production(spark, {"casename": "A"}), completion(spark, {"casename": "B"}))
    assert rows(result) == [("A", 1, 1, 0, 0, 0, 0, 0), ("B", 0, 0, 0, 0, 1, 1, 1)]


def test_fit_summary(spark):
    fit = fit_info(spark, {}, {"casename": "B", "IsBacktest": False}, {"casename": "C", "IsBacktest": None})
    assert rows(summary.fit_summary(fit), "casename", "fit_startdate", "fit_type", "backtest_enddate") == [
        ("A", "2019-01-01", "BT", "2020-01-01"), ("B", "2019-01-01", "FF", "N/A"), ("C", "2019-01-01", "FF", "N/A"),
    ]


def test_list_cases_is_ordered_and_distinct(spark):
    fit = fit_info(spark, *[{"casename": name} for name in "gfedcba"], {"casename": "a"})
    assert [row[0] for row in list_cases(fit, 5).collect()] == list("abcde")


# Expressions


def test_days_in_month(spark):
    dates = spark.createDataFrame([(day(2020, 2, 1),), (day(2021, 2, 1),), (day(2021, 12, 1),)], "d date")
    assert [row[0] for row in dates.select(measures.days_in_month(F.col("d"))).collect()] == [29, 28, 31]


def test_fit_type(spark):
    cases = spark.createDataFrame(
        [
            (1, True, day(2020, 1, 1), day(2020, 1, 1)), (2, True, day(2020, 1, 1), day(2020, 2, 1)),
            (3, True, None, day(2020, 2, 1)), (4, False, day(2020, 1, 1), day(2020, 2, 1)),
            (5, None, day(2020, 1, 1), day(2020, 2, 1)),
        ],
        "id int, b boolean, e date, d date",
    )
    result = cases.select("id", labels.fit_type(F.col("b"), F.col("e"), F.col("d")))
    assert rows(result) == [(1, "training"), (2, "validation"), (3, "validation"), (4, "training"), (5, "training")]


def test_labels(spark):
    frame = spark.createDataFrame([("R1", True, 12.5, None)], "r string, s boolean, n double, w string")
    assert frame.select(labels.group_label(frame, ["r", "s"])).first()[0] == "R1-True"
    assert frame.select(labels.hover_text(frame, ["r", "n", "w"])).first()[0] == "r: R1<br>n: 12.5<br>w: None"


def test_date_texts(spark):
    frame = spark.createDataFrame([("2020-03-01T00:00:00Z",), ("2020-04-01",)], "t string")
    assert [row[0] for row in frame.select(labels.parse_date("t")).collect()] == [day(2020, 3, 1), day(2020, 4, 1)]


def test_display_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "v double")
    assert [row[0] for row in labels.round_for_display(frame, ["v"]).collect()] == [0.12, 0.38, 2.5]
    assert [row[0] for row in labels.round_for_display(frame, ["v"], 0).collect()] == [0.0, 0.0, 2.0]


@pytest.mark.parametrize("call", [
    lambda: measures.percentiles("5-95"),
    lambda: measures.check_phase("steam"),
    lambda: grouping.check_dims(["Operator"]),
])
def test_unknown_names_are_refused(call):
    with pytest.raises(ValueError):
        call()


# Series


def test_series_keeps_rows_without_completion(spark):
    prod = production(spark, {}, {"WellAPI": "w9", "Qo": 4.0})
    result = series.actual_series(prod, completion(spark, {}), "oil", ["Reservoir"])
    assert rows(result, "Reservoir", "oil", "wellcount") == [("R1", 1.0, 1), (None, 4.0, 1)]


def test_chosen_values_drop_rows_without_completion(spark):
    prod = production(spark, {}, {"WellAPI": "w9", "Qo": 4.0}, {"CompSubId": "2", "Qo": 8.0})
    comp = completion(spark, {}, {"CompSubId": "2", "Reservoir": "R2"})
    assert rows(series.actual_series(prod, comp, "oil", chosen=picks(layers=["R1"])), "field", "oil") == [("field", 1.0)]
    assert rows(series.actual_series(prod, comp, "oil", chosen=picks()), "oil") == [(13.0,)]


def test_series_by_status_and_gross(spark):
    prod = production(spark, {}, {"Qw": None, "Qo": 7.0}, {"Status": 2, "Qs": 9.0, "Qo": 100.0})
    comp = completion(spark, {})
    assert rows(series.actual_series(prod, comp, "gross"), "gross") == [(3.0,)]
    assert rows(series.actual_series(prod, comp, "injectant"), "injectant") == [(9.0,)]


def test_series_order_puts_unknown_dimension_last(spark):
    prod = production(spark, {"WellAPI": "w9"}, {"Month": 2}, {})
    result = series.actual_series(prod, completion(spark, {}), "oil", ["Reservoir"]).collect()
    assert [(row.Reservoir, row.date.month) for row in result] == [("R1", 1), ("R1", 2), (None, 1)]


def test_mean_pressure_and_well_count(spark):
    prod = production(spark, {"BHP": 10.0}, {"BHP": None}, {"WellAPI": "w2", "BHP": 40.0}, {"WellAPI": None, "BHP": 40.0})
    assert rows(series.actual_series(prod, completion(spark, {}), "oil"), "wellcount", "bhp") == [(2, 30.0)]


def test_fanout_multiplies_by_completions(spark):
    prod = production(spark, {}, {"CompSubId": None, "Qo": 10.0}, {"WellAPI": "w9", "Qo": 100.0})
    comp = completion(spark, {}, {"CompSubId": "2", "Reservoir": "R2"}, {"CompSubId": "3", "Reservoir": "R2"})
    assert rows(series.production_by_month(prod, comp, fanout=True), "oil") == [(3.0 + 10.0 + 100.0,)]
    by_layer = series.production_by_reservoir(prod, comp, fanout=True)
    assert rows(by_layer, "reservoir", "oil") == [("R1", 1.0), ("R2", 2.0), (None, 110.0)]
    assert rows(series.production_by_reservoir(prod, comp), "reservoir", "oil") == [("R1", 1.0), (None, 110.0)]


def test_unknown_dimension_reads_na(spark):
    prod = production(spark, {"WellAPI": "w9"})
    actual = series.actual_series(prod, completion(spark, {}), "oil", ["Reservoir", "Type"])
    assert rows(series.series_groups(actual, ["Reservoir", "Type"], "oil"), "group_label") == [("NA-NA",)]


# Modelled series


def _step(**more):
    return {"OilRateP50": 2.0, "OilRateP25": 1.0, "OilRateP75": 3.0, **more}


def test_fit_series_labels_by_case_and_date(spark):
    steps = producer_steps(
        spark, _step(Date=day(2020, 1, 1)), _step(), _step(casename="B"), _step(casename="none"),
    )
    fit = fit_info(spark, {}, {"casename": "B", "IsBacktest": False})
    result = modelled.fit_series(steps, completion(spark, {}), fit, "oil")
    assert rows(result, "casename", "date", "type_of_fit") == [
        ("A", day(2020, 1, 1), "training"), ("A", day(2020, 2, 1), "validation"),
        ("B", day(2020, 2, 1), "training"), ("none", day(2020, 2, 1), "training"),
    ]


def test_completion_ids_join_as_integers(spark):
    steps = producer_steps(spark, _step(CompletionId=7))
    comp = completion(spark, {"CompSubId": "07"}, {"CompSubId": "seven", "Reservoir": "R2"})
    result = modelled.fit_series(steps, comp, fit_info(spark, {}), "oil", dims=["Reservoir"])
    assert rows(result, "Reservoir", "oil_rate_p50") == [("R1", 2.0)]


def test_water_is_a_difference_of_percentiles(spark):
    rates = {"GrossRateP10": 5.0, "OilRateP10": 1.0, "GrossRateP50": 6.0, "OilRateP50": 2.0, "GrossRateP90": 7.0, "OilRateP90": 6.0}
    result = modelled.fit_series(producer_steps(spark, rates), completion(spark, {}), fit_info(spark, {}), "water", "10-90")
    assert rows(result, "water_rate_p50", "water_rate_p10", "water_rate_p90") == [(4.0, 4.0, 1.0)]


def test_band_runs_forwards_and_back(spark):
    steps = producer_steps(
        spark, _step(Date=day(2020, 3, 1), OilRateP25=10.0, OilRateP75=30.0), _step(Date=day(2020, 2, 1)),
    )
    fit = modelled.fit_series(steps, completion(spark, {}), fit_info(spark, {}), "oil", ordered=False)
    band = modelled.fit_band(fit, "oil").first()
    assert [d.month for d in band.x] == [2, 3, 3, 2]
    assert band.y == [1.0, 10.0, 30.0, 3.0]


# Totals


def test_cumulative_of_a_leap_month(spark):
    prod = production(spark, {"Month": 2, "Qo": 1e6}, {"Year": 2021, "Month": 2, "Qo": 1e6, "Qg": None})
    result = totals.cumulative(prod).first()
    assert result.oil_cum == pytest.approx(29 + 28)
    assert result.gas_cum == pytest.approx(29 * 3e-6)
    shown = totals.cumulative_display(totals.cumulative(prod)).first()
    assert (shown.oil_cum, shown.date_range) == (57.0, "2020-02-01 to 2021-02-01")


def test_rankings_count_unknown_names_and_break_ties(spark):
    prod = production(spark, *[{"WellAPI": f"w{i}", "Qo": rate} for i, rate in enumerate([5.0, 5.0, 1.0, 9.0])], {"WellAPI": "w4", "Qo": None})
    comp = completion(spark, *[{"WellAPI": f"w{i}", "WellName": name} for i, name in [(0, "b"), (1, "a"), (2, "c"), (4, "e")]])
    for case in (None, "A"):
        top = totals.top_wells(prod, comp, 3, case).select("WellName").collect()
        assert [row[0] for row in top] == ["e", None, "a"]


def test_rankings_are_per_case(spark):
    prod = production(spark, *[{"casename": case, "CompSubId": str(i), "Qo": float(i)} for case in "AB" for i in range(1, 4)])
    comp = completion(spark, *[{"casename": case, "CompSubId": str(i), "Reservoir": f"R{i}"} for case in "AB" for i in range(1, 4)])
    assert rows(totals.top_layers(prod, comp, 2), "casename", "Reservoir") == [("A", "R2"), ("A", "R3"), ("B", "R2"), ("B", "R3")]


# Crossplot


def _crossplot_tables(spark):
    return frames.tables(
        spark,
        [
            {"Month": 1, "Qo": 1000.0},  # on the boundary: not counted
            {"Month": 2, "Qo": 2.0}, {"Month": 3, "Qo": 3.0},
            {"Month": 3, "CompSubId": "2", "Qo": 4.0},
            {"Month": 3, "CompSubId": "3", "Qo": 5.0},
            {"Month": 3, "WellAPI": "w9", "Qo": 9.0},
            {"casename": "B", "Month": 3},
        ],
        [
            {}, {"CompSubId": "2", "Netpay": 8.0},
            {"CompSubId": "3", "Reservoir": None, "Netpay": 1.0},
            {"casename": "B"},
        ],
        [{}, {"casename": "B", "IsBacktest": False, "BacktestEndDate": None}],
        [_step(), _step(CompletionId=3), _step(WellId="w9"), _step(casename="B"), _step(Date=day(2020, 1, 1))],
    )


def test_crossplot_joins_known_groups_after_the_boundary(spark):
    result = crossplot.crossplot(_crossplot_tables(spark), "oil", ["Reservoir"], include_wells=False)
    (only,) = result.collect()
    assert (only.casename, only.Reservoir) == ("A", "R1")
    assert only.actual_oil == pytest.approx(9 * 30.42 * 1e-3)
    assert only.fit_oil == pytest.approx(2 * 30.42 * 1e-3)
    assert only.netpay == pytest.approx((5 + 5 + 8) / 3)


def test_crossplot_keys():
    assert crossplot.crossplot_keys() == ["WellAPI", "WellName", "Reservoir"]
    assert crossplot.crossplot_keys(["WellAPI", "Type"]) == ["WellAPI", "Type", "WellName"]
    assert crossplot.crossplot_keys(["Type"], include_wells=False) == ["Type"]


def test_chosen_values_filter_only_when_hiding(spark):
    tables, chosen = _crossplot_tables(spark), picks(wells=["other"])
    assert crossplot.crossplot(tables, "oil", ["Reservoir"], chosen=chosen).count() == 1
    assert crossplot.crossplot(tables, "oil", ["Reservoir"], chosen=chosen, hide_unselected=True).count() == 0


def _marked(spark, chosen):
    points = spark.createDataFrame(
        [("A", "w1", "R1"), ("A", "w1", "R2"), ("A", "w2", "R1"), ("B", "w3", "R1")],
        "casename string, WellAPI string, Reservoir string",
    )
    return rows(crossplot.mark_selected(points, ["WellAPI", "Reservoir"], chosen), "casename", "WellAPI", "Reservoir", "is_selected")


def test_nothing_chosen_selects_nothing(spark):
    assert not any(row[3] for row in _marked(spark, picks()))
    assert not any(row[3] for row in _marked(spark, picks(faultblocks=["F1"])))
    assert not any(row[3] for row in _marked(spark, picks(wells=["nobody"])))
    assert not any(row[3] for row in _marked(spark, picks(wells=["nobody"], layers=["none"])))


def test_a_flag_nobody_has_is_not_in_use_in_that_case(spark):
    selected = [row[:3] for row in _marked(spark, picks(wells=["w1"], layers=["R1"])) if row[3]]
    assert selected == [("A", "w1", "R1"), ("B", "w3", "R1")]
    selected = [row[:3] for row in _marked(spark, picks(wells=["w1"])) if row[3]]
    assert selected == [("A", "w1", "R1"), ("A", "w1", "R2")]


def test_crossplot_groups_leave_unknown_hue_out(spark):
    points = spark.createDataFrame(
        [("A", "R1", 1.5, True), ("A", None, 2.0, False)],
        "casename string, Reservoir string, netpay double, is_selected boolean",
    )
    grouped = crossplot.crossplot_groups(points, ["Reservoir"], ["Reservoir"])
    assert rows(grouped, "group_label", "hover_text") == [("R1-True", "Reservoir: R1<br>netpay: 1.5")]
    assert crossplot.crossplot_groups(points, ["Reservoir"], []).count() == 2


# Map


def test_centroids_and_field_column(spark):
    comp = completion(spark, {}, {"CompSubId": "2", "Latitude": 3.0, "Type": "injector"})
    assert rows(wellmap.well_centroids(comp, []), "field", "WellAPI", "Latitude") == [("field", "w1", 2.0)]
    assert rows(wellmap.well_centroids(comp), "Type", "Latitude") == [("injector", 3.0), ("producer", 1.0)]
    assert wellmap.well_centroids(comp, ["WellAPI"]).columns.count("WellAPI") == 1


def test_map_marks_wells_and_filters_by_the_rest(spark):
    comp = completion(spark, {}, {"WellAPI": "w2"}, {"WellAPI": "w3", "Reservoir": "R2"})
    chosen = picks(wells=["w1"], layers=["R1"])
    points = wellmap.well_points(comp, chosen=chosen, wells=["w1"])
    assert rows(points, "WellAPI", "is_selected") == [("w1", True), ("w2", False)]
    hidden = wellmap.well_points(comp, chosen=chosen, wells=["w1"], hide_unselected=True)
    assert rows(hidden, "WellAPI") == [("w1",)]
    assert wellmap.well_points(comp, hide_unselected=True).count() == 3


def test_selection_by_frame_is_per_case(spark):
    comp = completion(spark, {}, {"WellAPI": "w2"}, {"casename": "B"}, {"casename": "B", "WellAPI": "w2"})
    wells = spark.createDataFrame([("A", "w1"), ("A", "w1")], "casename string, WellAPI string")
    marked = rows(wellmap.well_points(comp, wells=wells), "casename", "WellAPI", "is_selected")
    assert marked == [("A", "w1", True), ("A", "w2", False), ("B", "w1", False), ("B", "w2", False)]
    hidden = rows(wellmap.well_points(comp, wells=wells, hide_unselected=True), "casename", "WellAPI")
    assert hidden == [("A", "w1"), ("B", "w1"), ("B", "w2")]


def test_paths_run_by_depth_and_lines_stay_bounded(spark):
    comp = completion(spark, *[{"CompSubId": f"{i:03}", "TD": float(-(i // 2)), "Longitude": float(i)} for i in range(50)])
    paths = wellmap.well_paths(wellmap.well_points(comp))
    ordered = sorted(range(50), key=lambda i: (-(i // 2), i))
    assert [row[0] for row in paths.orderBy("point_no").select("Longitude").collect()] == ordered
    lines = wellmap.well_lines(paths, points_per_line=7).orderBy("line_no").collect()
    assert max(len(line.longitudes) for line in lines) == 7
    assert [value for line in lines for value in line.longitudes[line.line_no > 0 :]] == ordered
    assert all(a.longitudes[-1] == b.longitudes[0] for a, b in zip(lines, lines[1:], strict=False))
    pairs = wellmap.well_lines(paths, points_per_line=2).orderBy("line_no").collect()
    assert [tuple(line.longitudes) for line in pairs] == list(zip(ordered, ordered[1:], strict=False))


def test_map_groups_leave_unknown_groups_out(spark):
    comp = completion(spark, {}, {"CompSubId": "2", "Compartment": None})
    points = wellmap.well_points(comp, ["Compartment"], wells=["w1"])
    assert rows(wellmap.map_groups(points, ["Compartment"]), "group_label") == [("C1-True",)]
    assert rows(wellmap.map_groups(points, path=True), "group_label") == [("w1-True",), ("w1-True",)]


# Options and selection


def test_well_options_are_the_union(spark):
    prod = production(
        spark, {}, {}, {"Status": 2, "Qs": 1.0}, {"WellAPI": "w2", "Qg": None}, {"WellAPI": "w3", "Qg": None, "Qs": 1.0},
        {"WellAPI": "w4", "Status": None},
    )
    comp = completion(spark, {}, {"CompSubId": "2"}, {"CompSubId": "3", "WellName": "other name"})
    result = options.well_options(prod, comp)
    assert rows(result, "WellName", "WellAPI", "Status") == [
        ("Well 1", "w1", 1), ("Well 1", "w1", 2), ("other name", "w1", 1), ("other name", "w1", 2),
        (None, "w3", 1), (None, "w4", None),
    ]
    assert rows(options.options_of_status(result, 2), "label", "value") == [("Well 1", "w1"), ("other name", "w1")]


def test_dim_options(spark):
    comp = completion(spark, {}, {"CompSubId": "2", "Compartment": None})
    named = [("C1", "compartment"), ("F1", "faultblock"), ("R1", "layer")]
    assert rows(options.dim_options(comp), "name", "type") == named
    assert rows(options.dim_options(comp, named_only=False), "name", "type") == [*named, (None, "compartment")]


def _well_options(spark):
    return spark.createDataFrame(
        [("A", "x", "both", 1), ("A", "x", "both", 2), ("A", "x", "inj", 2), ("A", "x", "none", None)],
        "casename string, WellName string, WellAPI string, Status int",
    )


def test_selected_wells_go_to_producers_first(spark):
    points = spark.createDataFrame([("A", w) for w in ("both", "inj", "none", "gone", "inj")], "casename string, WellAPI string")
    assert rows(selection.resolve_selection(points, _well_options(spark))) == [
        ("A", "injectors", "inj"), ("A", "producers", "both"),
    ]


def test_selected_values_must_be_options(spark):
    points = spark.createDataFrame([("A", "R1", "gone"), ("A", None, "C1")], "casename string, Reservoir string, Compartment string")
    dims = spark.createDataFrame([("A", "R1", "layer"), ("A", "C1", "compartment"), ("A", "gone", "layer")], "casename string, name string, type string")
    assert rows(selection.resolve_selection(points, _well_options(spark), dims)) == [
        ("A", "compartments", "C1"), ("A", "layers", "R1"),
    ]
    with pytest.raises(ValueError):
        selection.resolve_selection(points.select("casename"), _well_options(spark), dims)


def test_merged_selection_is_sorted_and_distinct(spark):
    kind = "casename string, list string, value string"
    new = spark.createDataFrame([("A", "producers", "b"), ("A", "producers", "a")], kind)
    current = spark.createDataFrame([("A", "producers", "b"), ("A", "layers", "z")], kind)
    merged = [tuple(row) for row in selection.merge_selection(new, current).collect()]
    assert merged == [("A", "layers", "z"), ("A", "producers", "a"), ("A", "producers", "b")]


def test_fanout_needs_completions(spark):
    with pytest.raises(ValueError, match="completions"):
        series.production_by_month(production(spark, {}), fanout=True)


def test_the_forecast_stays_next_to_the_measured_rows(spark):
    actual = spark.createDataFrame([("A", datetime.date(2020, 1, 1), "f", 1.0)], "casename string, date date, field string, oil double")
    fit = spark.createDataFrame(
        [("A", datetime.date(2020, 2, 1), "f", "validation", 2.0, 1.0, 3.0)],
        "casename string, date date, field string, type_of_fit string, oil_rate_p50 double, oil_rate_p25 double, oil_rate_p75 double",
    )
    both = modelled.actual_with_band(actual, fit, (), "oil").orderBy("date").collect()
    assert [(str(r.date), r.field, r.oil, r.oil_rate_p50) for r in both] == [("2020-01-01", "f", 1.0, None), ("2020-02-01", "f", None, 2.0)]


# Bitmaps of wells


def test_bitmaps_count_each_well_once_at_any_level(spark):
    wells = [f"w{i}" for i in range(40)]
    prod = production(
        spark, *[{"WellAPI": w, "CompSubId": c} for w in wells for c in ("1", "2")], {"WellAPI": None}, {"WellAPI": "w0", "Month": 13},
        {"casename": "B", "WellAPI": None, "Month": 2},
    )
    comp = completion(spark, *[{"WellAPI": w, "CompSubId": c, "Reservoir": f"R{c}"} for w in wells for c in ("1", "2")])
    numbers = wellcounts.well_numbers(prod)
    assert sorted(row.number for row in numbers.collect()) == list(range(40))
    fine = wellcounts.well_bitmaps(prod, comp, "oil", ["Reservoir"], numbers)
    first, later = datetime.date(2020, 1, 1), datetime.date(2020, 2, 1)
    by_layer = rows(wellcounts.well_counts(fine, ["Reservoir"]), "casename", "date", "Reservoir", "wellcount")
    assert by_layer == sorted([("A", first, "R1", 40), ("A", first, "R2", 40), ("A", first, None, 0), ("A", None, "R1", 1), ("B", later, None, 0)], key=repr)
    whole = rows(wellcounts.well_counts(fine), "casename", "date", "wellcount")
    assert whole == sorted([("A", first, 40), ("A", None, 1), ("B", later, 0)], key=repr)
    assert fine.filter("part is not null").count() < prod.select("Month", "CompSubId", "WellAPI").distinct().count() / 20


# Chosen values as a table


def _chosen(spark, *values):
    return spark.createDataFrame(list(values), "casename string, list string, value string")


def _two_cases(spark):
    prod = production(
        spark, {}, {"CompSubId": "2", "Qo": 4.0}, {"WellAPI": "w9", "Qo": 16.0},
        {"casename": "B"}, {"casename": "B", "WellAPI": "w9", "Qo": 16.0}, {"casename": "C", "Qo": 64.0},
    )
    comp = completion(
        spark, {}, {"CompSubId": "2", "Reservoir": "R2", "Compartment": None}, {"casename": "B"}, {"casename": "C", "Reservoir": "R2"},
    )
    return prod, comp


def test_a_list_that_a_case_lacks_filters_nothing(spark):
    prod, comp = _two_cases(spark)

    def oil(*values):
        return rows(series.actual_series(prod, comp, "oil", chosen=_chosen(spark, *values)), "casename", "oil")

    assert oil() == [("A", 21.0), ("B", 17.0), ("C", 64.0)]
    assert oil(("A", "layers", "R1"), ("A", "layers", "R1")) == [("A", 1.0), ("B", 17.0), ("C", 64.0)]
    assert oil(("A", "layers", "R1"), ("B", "producers", "w1"), ("C", "layers", "R1")) == [("A", 1.0), ("B", 1.0)]
    assert oil(("A", "producers", "w1"), ("A", "injectors", "w9"), ("A", "compartments", "C1")) == [("A", 1.0), ("B", 17.0), ("C", 64.0)]
    assert oil(("A", "layers", None), ("A", "colours", "red"), (None, "layers", "R1")) == [("A", 21.0), ("B", 17.0), ("C", 64.0)]


def test_lists_and_tables_of_chosen_values_agree(spark):
    prod, comp = _two_cases(spark)
    listed = picks(wells=["w1"], layers=["R1", "R2"], compartments=["C1"])
    table = _chosen(spark, *[(c, n, v) for c in "ABC" for n, v in [("producers", "w1"), ("layers", "R1"), ("layers", "R2"), ("compartments", "C1")]])
    for dims in ([], ["Reservoir"]):
        one, other = (rows(series.actual_series(prod, comp, "gross", dims, chosen=c)) for c in (listed, table))
        assert one == other
    points = spark.createDataFrame(
        [("A", "w1", "R1"), ("A", "w1", "R3"), ("A", "w2", "R1"), ("B", "w3", "R1"), ("C", "w1", "R3")],
        "casename string, WellAPI string, Reservoir string",
    )
    keys = ["WellAPI", "Reservoir"]
    assert rows(crossplot.mark_selected(points, keys, listed)) == rows(crossplot.mark_selected(points, keys, table))
    assert rows(wellmap.well_points(comp, chosen=listed)) == rows(wellmap.well_points(comp, chosen=table))


def test_crossplot_is_the_join_of_its_sides(spark):
    tables = _crossplot_tables(spark)
    for keys in (["Reservoir"], ["WellAPI", "WellName"], ["Type", "Compartment"]):
        args = (tables.completiondata, tables.fit_info, "oil", keys)
        actual, fit = crossplot.actual_cum(tables.productiondata, *args), crossplot.fit_cum(tables.producer_timestep, *args)
        both = crossplot.crossplot(tables, "oil", [k for k in keys if k != "WellName"], include_wells="WellName" in keys)
        joined = actual.join(fit, ["casename", *keys]).select(both.columns)
        assert rows(both) == rows(joined)
