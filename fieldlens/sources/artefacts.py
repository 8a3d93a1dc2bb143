"""Files that belong to a case: from its manifest to the data behind it."""

import csv
import io
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.sources.files import below, opened, tasks

# Stages of a manifest and the two files read from them.
FIT_OUTPUT = ("intermediateOutput", "fit_output.json")
SENSITIVITY_MATRIX = ("final", "SensitivityMatrixCumWWell.csv")

# What became of a path.
READ, MISSING, UNREADABLE, TOO_LARGE, BROKEN, NO_PATH = "read", "missing", "unreadable", "too large", "broken", "no path"
#: Bytes of contents that a task gathers, and cells.
GATHERED, CELLS = 8 << 20, 50_000
#: Folders that a task remembers to be there.
FOLDERS = 10_000

_TEXT = T.StringType()
MANIFEST = T.StructType(
    [T.StructField("files", T.MapType(_TEXT, T.MapType(_TEXT, _TEXT)), True)]
)


def latest_prediction(predictions, fit="fit", name="name", order="seq"):
    """Name of the last prediction of every fit."""
    return predictions.groupBy(fit).agg(F.max_by(name, order).alias("latest"))


def artefact_paths(manifests, keys, manifest="manifest"):
    """Every (stage, file, path) of a JSON manifest, one row each.

    A broken or empty manifest stays as a row with NULL for what it lacks.
    """
    parsed = manifests.select(*keys, F.from_json(manifest, MANIFEST).alias("m"))
    stages = parsed.select(*keys, F.explode_outer("m.files").alias("stage", "entries"))
    return stages.select(*keys, "stage", F.explode_outer("entries").alias("file", "path"))


def artefact_path(manifest, stage, file):
    """Path of one file of a JSON manifest; NULL if the manifest has none."""
    files = F.from_json(manifest, MANIFEST)["files"]
    return F.try_element_at(F.try_element_at(files, F.lit(stage)), F.lit(file))


def read_json_artefact(spark, paths, schema=None, lines=False):
    """JSON documents, one or many, with the file they came from; `lines` if each line is one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths, multiLine=not lines).withColumn("source_file", F.input_file_name())


def read_csv_artefact(spark, paths, schema=None):
    """CSV files with a header, with the file they came from.

    Without a schema the types are inferred, which reads the files twice; give one
    for large sets.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    frame = reader.csv(paths, header=True, inferSchema=schema is None)
    return frame.withColumn("source_file", F.input_file_name())


def read_contents(paths, column="path", root=None, largest=256 << 20):
    """Rows with the `content` behind a column of paths, and the `status` of each.

    Files are opened inside tasks, so neither paths nor contents pass the driver, and a bad one stops nothing. A
    path without a scheme or leading slash is taken below `root`. What is larger than `largest` bytes fits no row; the readers above take it.
    """
    schema = T.StructType([*paths.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("status", _TEXT)])

    def run(batches):
        for batch in batches:
            first, contents, states, size = 0, [], [], 0
            for i, path in enumerate(batch.column(column).to_pylist()):
                content, status = _content(path, root, largest)
                contents.append(content), states.append(status)
                size += len(content or b"")
                if size >= GATHERED:
                    yield _with(batch.slice(first, i + 1 - first), contents, states)
                    first, contents, states, size = i + 1, [], [], 0
            yield _with(batch.slice(first), contents, states)

    return paths.repartition(tasks(paths.sparkSession), column).mapInArrow(run, schema)


def _with(batch, contents, states):
    arrays = [*batch.columns, pa.array(contents, pa.binary()), pa.array(states, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "content", "status"])


def _content(path, root, largest):
    if path is None:
        return None, NO_PATH
    try:
        system, name = opened(below(root, path))
        with system.open_input_file(name) as file:
            return (None, TOO_LARGE) if file.size() > largest else (file.read(), READ)
    except FileNotFoundError:
        return None, MISSING
    except (OSError, ValueError):
        return None, UNREADABLE


def write_contents(contents, root, column="path", content="content"):
    """One file per row, written inside tasks below `root`; returns rows of (path, size) once all are there.

    A file appears whole or not at all, and writing it again replaces it, as a task that is run again does. Rows are dealt to tasks
    by path, however few bytes they have. Below `root`, which is one file system, a file is written into a folder of its task and then
    moved, so tasks that fill the same folder wait for each other only while they move a file.
    """

    def run(batches):
        made, parts = set(), None
        try:
            for batch in batches:
                sizes = []
                for path, data in zip(batch.column(column).to_pylist(), batch.column(content).to_pylist(), strict=True):
                    whole = below(root, path)
                    system, name = opened(whole)
                    folder = name.rsplit("/", 1)[0]
                    if folder not in made:
                        if len(made) >= FOLDERS:
                            made.clear()
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    if whole == path:
                        part = f"{name}.part-{uuid.uuid4().hex}"
                    else:
                        if parts is None:
                            parts = opened(below(root, f".parts-{uuid.uuid4().hex}"))
                            parts[0].create_dir(parts[1], recursive=True)
                        part = f"{parts[1]}/part"
                    with system.open_output_stream(part) as out:
                        out.write(data or b"")
                    system.move(part, name)
                    sizes.append(len(data or b""))
                yield pa.RecordBatch.from_arrays([batch.column(column), pa.array(sizes, pa.int64())], ["path", "size"])
        finally:
            if parts is not None:
                parts[0].delete_dir(parts[1])

    return contents.select(column, content).repartition(tasks(contents.sparkSession), column).mapInArrow(run, "path string, size long")


def json_documents(contents, schema):
    """Contents parsed as JSON of a schema into `document`; what does not parse is broken."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*struct.fields, T.StructField("_broken", _TEXT)])
    parsed = contents.withColumn("parsed", F.from_json(F.decode("content", "UTF-8"), wide, {"columnNameOfCorruptRecord": "_broken"}))
    fits = F.col("parsed").isNotNull() & F.col("parsed._broken").isNull()
    document = F.when(fits, F.struct(*[F.col("parsed").getField(name).alias(name) for name in struct.names]))
    status = F.when((F.col("status") == READ) & ~fits, F.lit(BROKEN)).otherwise(F.col("status"))
    rest = [name for name in contents.columns if name not in ("content", "status")]
    return parsed.select(*rest, status.alias("status"), document.alias("document"))


def csv_cells(contents):
    """Contents read as CSV with a header: a row per cell with line, position, header and value; empty cells are NULL.

    Files may have different columns, so cells are rows. A file that was not read stays as one row without a cell.
    """
    kept = [f for f in contents.schema.fields if f.name != "content"]
    cell = [("line", T.LongType()), ("position", T.IntegerType()), ("header", _TEXT), ("value", _TEXT)]
    clash = {name for name, _ in cell} & {f.name for f in kept}
    if clash:
        raise ValueError(f"cells have columns of the same name: {sorted(clash)}")
    schema = T.StructType([*kept, *[T.StructField(n, kind) for n, kind in cell]])
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]

    def batch_of(batch, owners, cells):
        columns = list(zip(*cells, strict=True)) or [()] * 4
        taken = [batch.column(f.name).take(pa.array(owners, pa.int64())) for f in kept]
        return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    def cells_of(content):
        reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8", "replace", newline=""))
        header = next(reader, [])
        for line, values in enumerate((row for row in reader if row), 1):
            for position, value in enumerate(values):
                yield line, position, header[position] if position < len(header) else None, value or None

    def run(batches):
        for batch in batches:
            owners, cells = [], []
            for i, content in enumerate(batch.column("content")):
                for one in cells_of(content.as_py()) if content.is_valid else [(None,) * 4]:
                    owners.append(i), cells.append(one)
                    if len(cells) >= CELLS:
                        yield batch_of(batch, owners, cells)
                        owners, cells = [], []
            yield batch_of(batch, owners, cells)

    return contents.mapInArrow(run, schema)
