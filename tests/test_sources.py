"""Loading tables, JSON records and artefact files."""

import datetime
import json
import os
import random

import frames
import numpy as np
import pytest
from frames import completion, fit_info, production, rows
from pyspark.sql import functions as F

from fieldlens.functions import measures
from fieldlens.operators import joins, options, series, summary
from fieldlens.plans import catalogue
from fieldlens.plans.derived import DerivedTables
from fieldlens.sources import artefacts, layout, records, schema, tables


@pytest.fixture
def folder(spark, tmp_path):
    parts = frames.tables(
        spark,
        [{}, {"casename": "B", "Month": 13}, {"casename": "B", "Month": None}, {"casename": "B", "Year": 0}],
        [{}, {"casename": "B"}],
        [{}, {"casename": "B"}],
    )
    for name in schema.SCHEMAS:
        getattr(parts, name).write.partitionBy("casename").parquet(str(tmp_path / name))
    return str(tmp_path)


def test_load_checks_months_and_keeps_rejects(spark, folder):
    loaded = tables.load(spark, folder)
    assert rows(loaded.productiondata, "casename", "Month") == [("A", 1), ("B", 1), ("B", 13), ("B", None)]
    assert rows(loaded.rejected, "casename", "Year", "Month") == [("B", 0, 1), ("B", 2020, 13)]
    by_month = series.production_by_month(loaded.productiondata)
    assert rows(by_month, "casename", "date", "oil") == [("A", datetime.date(2020, 1, 1), 1.0), ("B", None, 3.0)]


def test_a_well_of_impossible_months_only_is_counted(spark):
    prod = production(spark, {}, {"WellAPI": "w2", "Month": 13, "Qs": 1.0}, {"WellAPI": "w3", "Month": 0, "Year": None})
    assert rows(summary.count_wells(prod)) == [("A", 3)]
    assert rows(options.well_options(prod, completion(spark, {})), "WellAPI") == [("w1",), ("w2",), ("w3",)]
    assert rows(prod.filter(~measures.is_month("Year", "Month")), "WellAPI") == [("w2",), ("w3",)]


def test_one_case_reads_only_its_files(spark, folder, capsys):
    loaded = tables.load(spark, folder)
    series.actual_series(loaded.productiondata, loaded.completiondata, "oil", ["Reservoir"], case="A").explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters: [isnotnull(casename") == 2
    assert "EqualTo(Status,1)" in plan
    assert "Latitude" not in plan and "Qs" not in plan


@pytest.mark.parametrize("twice", [{"CompSubId": "1"}, {"CompSubId": "01"}])
def test_repeated_completion_is_refused(spark, twice):
    parts = frames.tables(spark, [{}], [{}, twice], [{}])
    with pytest.raises(ValueError, match="completiondata"):
        tables.check_tables(parts)


def test_repeated_case_is_refused(spark):
    parts = frames.tables(spark, [{}], [{}], [{}, {}])
    with pytest.raises(ValueError, match="fit_info"):
        tables.check_tables(parts)


def test_ids_that_are_no_numbers_do_not_count_as_repeated(spark):
    tables.check_tables(frames.tables(spark, [{}], [{"CompSubId": "x"}, {"CompSubId": "y"}], [{}]))


def test_json_records(spark, tmp_path):
    file = tmp_path / "fit.json"
    file.write_text(json.dumps([{"casename": "A", "IsBacktest": True, "BacktestEndDate": "2020-01-01"}, {"casename": "B"}]))
    read = records.read_records(spark, str(file), schema.FIT_INFO, lines=False)
    assert [(row.casename, row.IsBacktest, str(row.BacktestEndDate)) for row in read.collect()] == [
        ("A", True, "2020-01-01"), ("B", None, "None"),
    ]


def test_records_written_and_read_back(spark, tmp_path):
    frame = fit_info(spark, *[{"casename": f"C{i}"} for i in range(10)]).coalesce(1)
    out = str(tmp_path / "out")
    assert records.write_records(frame, out) == schema.FIT_INFO.names
    assert rows(records.read_records(spark, out, schema.FIT_INFO)) == rows(frame)


def test_latest_prediction_follows_the_order_column(spark):
    frame = spark.createDataFrame([("f", "new", 2), ("f", "old", 1), ("g", "only", 5)], "fit string, name string, seq int")
    assert rows(artefacts.latest_prediction(frame)) == [("f", "new"), ("g", "only")]


def test_manifest_paths(spark):
    manifest = {"files": {"final": {"a.csv": "p/a", "b.csv": "p/b"}, "intermediateOutput": {"fit_output.json": "q"}}}
    frame = spark.createDataFrame([("k", json.dumps(manifest)), ("empty", "{}"), ("broken", "{")], "key string, manifest string")
    assert rows(artefacts.artefact_paths(frame, ["key"])) == [
        ("broken", None, None, None), ("empty", None, None, None), ("k", "final", "a.csv", "p/a"), ("k", "final", "b.csv", "p/b"), ("k", "intermediateOutput", "fit_output.json", "q"),
    ]
    paths = frame.select("key", artefacts.artefact_path("manifest", *artefacts.FIT_OUTPUT))
    assert rows(paths) == [("broken", None), ("empty", None), ("k", "q")]


def test_from_manifest_to_files(spark, tmp_path):
    (tmp_path / "out.json").write_text(json.dumps({"wells": [{"name": "w1", "r2": 0.9}], "loss": 1.5}, indent=1))
    (tmp_path / "matrix.csv").write_text("Well,w1,w2\nw1,0.5,1\nw2,0.25,2\n")
    manifest = {"files": {
        "final": {"SensitivityMatrixCumWWell.csv": str(tmp_path / "matrix.csv")},
        "intermediateOutput": {"fit_output.json": str(tmp_path / "out.json")},
    }}
    frame = spark.createDataFrame([(json.dumps(manifest),)], "manifest string")
    output, matrix = frame.select(
        artefacts.artefact_path("manifest", *artefacts.FIT_OUTPUT),
        artefacts.artefact_path("manifest", *artefacts.SENSITIVITY_MATRIX),
    ).first()
    document = artefacts.read_json_artefact(spark, output)
    assert rows(document, "loss", "wells.name") == [(1.5, ["w1"])]
    table = artefacts.read_csv_artefact(spark, [matrix])
    assert table.dtypes[:3] == [("Well", "string"), ("w1", "double"), ("w2", "int")]
    assert rows(table, "Well", "w1") == [("w1", 0.5), ("w2", 0.25)]
    assert all(row.source_file.endswith("matrix.csv") for row in table.collect())
    typed = artefacts.read_csv_artefact(spark, matrix, "Well string, w1 double, w2 double")
    assert typed.dtypes[2] == ("w2", "double")


ODD = [
    {"a": 1, "t": 'brace } and "quote" \\'}, {"a": 2, "t": "[1, {2}, \\\\"}, {"a": None, "t": "é" * 50}, {"a": 4, "t": "\n\t,"},
    {"a": "no number", "t": "x"}, {"a": 6, "t": "x", "more": [[1, 2], {"b": "]"}]}, 7, "text, with a comma", [1, 2], None,
]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_lists_are_read_by_ranges_of_any_size(spark, tmp_path, chunk, indent):
    rng = random.Random(chunk)
    for k in range(3):
        some = [rng.choice(ODD) for _ in range(30 if chunk > 1 else 8)]
        (tmp_path / f"{k}.json").write_text(json.dumps(some, indent=indent, ensure_ascii=k == 1))
    (tmp_path / "empty.json").write_text(" [ ] \n")
    (tmp_path / "single.json").write_text('{"a": 50, "t": "[{"}')
    found = records.list_elements(spark, str(tmp_path), chunk).collect()
    for k in range(3):
        whole = json.loads((tmp_path / f"{k}.json").read_text())
        own = sorted((row.start, row.text) for row in found if row.path.endswith(f"/{k}.json"))
        assert [json.loads(text) for _, text in own] == whole
    assert not [row for row in found if "empty" in row.path] and [row.start for row in found if "single" in row.path] == [0]


def test_broken_records_go_to_the_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": "x"}, , {"a": 2, "t": "y"}, {"a": nonsense}, 5]')
    (tmp_path / "b.json").write_text('[{"a": 3}, {"a": 4, "t": "open]')
    kept, rejects = records.records_and_rejects(spark, str(tmp_path), "a int, t string", lines=False, chunk=16)
    assert rows(kept) == [(1, None), (2, "y"), (3, None)]
    assert sorted(row.text for row in rejects.collect()) == sorted(["", '{"a": "x"}', '{"a": nonsense}', "5", '{"a": 4, "t": "open]'])
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "c.json").write_text('{"a": 1}\n\n{"a": "x"}\n{"a": 2\n{"a": 9, "t": "z"}\n')
    kept, rejects = records.records_and_rejects(spark, str(lines), "a int, t string")
    assert rows(kept) == [(1, None), (9, "z")]
    assert rows(rejects, "text") == [('{"a": "x"}',), ('{"a": 2',)]


def test_a_list_is_read_by_several_tasks_and_equals_one(spark, tmp_path):
    frame = fit_info(spark, *[{"casename": f'C "{i}" ]}}'} for i in range(500)]).coalesce(1)
    out = str(tmp_path / "lists")
    records.write_record_lists(frame, out)
    elements = records.list_elements(spark, out, 1 << 12)
    by_task = [n for n in elements.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(by_task) > 3
    kept, rejects = records.records_and_rejects(spark, out, schema.FIT_INFO, lines=False, chunk=1 << 12)
    assert rows(kept) == rows(frame) == rows(records.read_records(spark, f"{out}/part-*", schema.FIT_INFO, lines=False))
    assert rejects.count() == 0


def test_lists_are_written_by_as_many_tasks_as_asked_for(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 200).selectExpr("id as o_orderkey", "id as o_custkey", "'1-URGENT' as o_orderpriority", "'F' as o_orderstatus", "timestamp_ntz'1995-01-01 00:00:00' as o_orderdate")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(catalogue, "work_folder", lambda _: str(tmp_path / "lists"))
    kept, rejects = catalogue._fit_run_lists(DerivedTables(spark, str(tmp_path)))
    assert len(list((tmp_path / "lists").glob("part-*"))) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert kept.count() == 188 and rejects.count() == 11


def test_a_null_text_is_written_as_null(spark, tmp_path):
    records.write_texts_as_lists(spark.createDataFrame([("1",), (None,), ("2",)], "text string").coalesce(1), str(tmp_path / "lists"))
    (file,) = (tmp_path / "lists").glob("part-*")
    assert json.loads(file.read_text()) == [1, None, 2]


class Counted:
    """A file in memory that counts the bytes read of it."""

    def __init__(self, data):
        self.data, self.bytes = data, 0

    def read_at(self, size, at):
        part = self.data[at : at + size]
        self.bytes += len(part)
        return part


@pytest.mark.parametrize("text", [b'{"a": "x, \\"]"}', b'{"a": "' + b"y" * 20_000 + b'"}'])
def test_a_range_reads_little_behind_its_end(text):
    file = Counted(b"[" + b",".join([text] * (1_000_000 // len(text))) + b"]")
    chunk, found = 1 << 16, []
    for number in range(3):
        end = (number + 1) * chunk
        earlier = np.frombuffer(file.data[: number * chunk], np.uint8)
        odd = np.cumsum(records._quotes(earlier, 0)[0]) % 2 == 1 if number else np.zeros(0, bool)
        before = file.bytes
        found += records._elements(file, len(file.data), number * chunk, end, int(odd[-1]) if number else 0, int(records.STEP[earlier[~odd]].sum()))
        assert file.bytes - before <= chunk + 4 * len(text) + 3 * records.BEHIND
    assert [start for start, _ in found] == list(range(1, 3 * chunk + 1, len(text) + 1)) and {t for _, t in found} == {text}


def test_contents_of_a_column_of_paths(spark, tmp_path):
    documents = {"a.json": '{"loss": 1.5, "wells": []}', "b.json": '{"loss": ', "c/d.json": "", "m.csv": 'W,"x\ny"\n1,"2"\n\n,3,4\n'}
    frame = spark.createDataFrame([(k, v.encode()) for k, v in documents.items()], "path string, content binary")
    assert rows(artefacts.write_contents(frame, str(tmp_path))) == rows(artefacts.write_contents(frame, str(tmp_path)))
    (tmp_path / "folder").mkdir()
    paths = [*documents, "missing", None, "folder", f"file:{tmp_path}/a.json", f"file://{tmp_path}/a.json", "nosuch://x/y"]
    wanted = spark.createDataFrame(list(enumerate(paths)), "k long, path string").repartition(3)
    read = artefacts.read_contents(wanted, root=str(tmp_path))
    status = dict(rows(read, "k", "status"))
    assert [status[k] for k in range(10)] == ["read"] * 4 + ["missing", "no path", "unreadable", "read", "read", "unreadable"]
    parsed = artefacts.json_documents(read.filter("k <> 3"), "loss double, wells array<string>")
    assert rows(parsed, "k", "status", "document.loss")[:3] == [(0, "read", 1.5), (1, "broken", None), (2, "broken", None)]
    cells = artefacts.csv_cells(read.filter("k in (3, 4)"))
    assert rows(cells.filter("k = 3"), "line", "position", "header", "value") == [
        (1, 0, "W", "1"), (1, 1, "x\ny", "2"), (2, 0, "W", None), (2, 1, "x\ny", "3"), (2, 2, None, "4"),
    ]
    assert rows(cells.filter("k = 4"), "status", "line", "value") == [("missing", None, None)]
    assert rows(artefacts.read_contents(wanted, root=str(tmp_path), largest=5).filter("k = 0"), "status") == [("too large",)]


def test_files_are_written_by_several_tasks_and_leave_nothing_beside(spark, tmp_path):
    few = spark.range(400).selectExpr("concat('blob/', id, '.json') AS path", "cast('{}' AS binary) AS content").coalesce(1)
    deep = spark.range(3).selectExpr(f"concat('file:{tmp_path}/own/', id, '/a') AS path", "cast(null AS binary) AS content")
    written = artefacts.write_contents(few.union(deep).coalesce(1), f"file://{tmp_path}").withColumn("task", F.spark_partition_id())
    found = written.collect()
    assert len({row.task for row in found}) > 3 and sum(row["size"] for row in found) == 800
    assert sorted(os.listdir(tmp_path)) == ["blob", "own"]
    assert sorted(os.listdir(tmp_path / "blob")) == sorted(f"{k}.json" for k in range(400))
    assert [os.listdir(tmp_path / "own" / str(k)) for k in range(3)] == [["a"]] * 3


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    parts = frames.tables(
        spark, [{"WellAPI": f"w{i}", "CompSubId": str(i % 3)} for i in range(400)], [{"WellAPI": "w1"}], [{}], [{"WellId": "w1", "CompletionId": 1, "OilRateP50": 1.0}],
    )
    monkeypatch.setattr(layout, "ROWS", 20)
    layout.write_layout(parts, str(tmp_path / "laid"), "by_rows")
    for name in layout.BUCKET_COLUMNS:
        described = dict(rows(spark.sql(f"DESCRIBE EXTENDED by_rows_{name}").filter("col_name = 'Num Buckets'"), "col_name", "data_type"))
        assert described == {"Num Buckets": "20"}
    assert rows(layout.read_layout(spark, "by_rows").productiondata.select(*parts.productiondata.columns)) == rows(parts.productiondata)
    assert layout.buckets_for(parts.completiondata) == layout.FEWEST


def test_bucketed_tables_join_without_moving_the_fact(spark, tmp_path):
    parts = frames.tables(
        spark, [{"WellAPI": f"w{i % 7}", "CompSubId": str(i % 3), "Month": i % 13 + 1} for i in range(200)],
        [{"WellAPI": f"w{i}", "CompSubId": str(c), "Reservoir": f"R{c}"} for i in range(7) for c in range(3)], [{}],
        [{"WellId": f"w{i % 7}", "CompletionId": i % 3, "OilRateP50": 1.0, "Date": datetime.date(2020, 2 + i % 9, 1)} for i in range(63)],
    )
    layout.write_layout(parts, str(tmp_path / "laid"), "bucketed", buckets=8)
    laid = layout.read_layout(spark, "bucketed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        joined = joins.with_completion(joins.production_rows(laid.productiondata, "Qo"), laid.completiondata, ["Reservoir"])
        sums = joined.groupBy("casename", "well", "completion").agg(F.sum("Qo").alias("Qo"))
        assert "Exchange" not in plan_text(sums)
        modelled = joins.with_completion(joins.step_rows(laid.producer_timestep, "OilRateP50"), laid.completiondata, ["Reservoir"], numbered=True)
        plan = plan_text(modelled)
        assert plan.count("Exchange") == 1 and "producer_timestep" not in plan[plan.index("Exchange"):].split("Exchange")[1]
        one = joins.with_completion(joins.production_rows(laid.productiondata, "Qo", case="A"), laid.completiondata, ["Reservoir"], case="A")
        assert "PartitionFilters: [isnotnull(casename" in plan_text(one)
        for dims in (["Reservoir"], ["WellAPI"]):
            assert rows(series.actual_series(laid.productiondata, laid.completiondata, "oil", dims)) == rows(
                series.actual_series(parts.productiondata, parts.completiondata, "oil", dims)
            )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_quotes_behind_escapes_are_no_marks():
    rng = random.Random(3)
    for _ in range(500):
        data, before = bytes(rng.choices(b'"\\\\a', k=rng.randint(1, 12))), rng.randint(0, 3)
        marks, run = [], before
        for byte in data:
            marks.append(byte == records.QUOTE and run % 2 == 0)
            run = run + 1 if byte == records.ESCAPE else 0
        found, rest = records._quotes(np.frombuffer(data, np.uint8), before)
        assert (found.tolist(), rest) == (marks, run)


def plan_text(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
