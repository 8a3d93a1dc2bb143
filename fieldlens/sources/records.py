"""JSON records in, records out."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.sources.files import opened, tasks

#: Bytes of a list that a task scans, bytes held at a time, and bytes of the longest record.
CHUNK, HELD, LONGEST = 64 << 20, 4 << 20, 64 << 20
#: Bytes read at first behind a range, for the rest of its last record.
BEHIND = 4 << 10
BROKEN = "_broken"
QUOTE, ESCAPE, COMMA, OPEN_LIST, CLOSE_LIST = b'"\\,[]'
#: By how much a byte outside of a string changes the depth.
STEP = np.zeros(256, np.int64)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1


def read_records(spark, path, schema, lines=True):
    """JSON records: one per line, as `write_records` leaves them, or with `lines=False` a list per file.

    Files of lines can be split between tasks; for large lists, or to keep what is broken apart, see
    `records_and_rejects`. A record that is no JSON of the schema stops the read.
    """
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def records_and_rejects(spark, path, schema, lines=True, chunk=CHUNK):
    """(records, rejects): JSON records that fit the schema, and the text of those that don't with their place.

    Both kinds of file are read by several tasks. A list is cut into ranges of `chunk` bytes. Whether a range begins inside a string, and how
    deep, is not known, so each range is scanned for both cases, the ranges of a file are put together in order, and then each
    range gives the records that begin in it. A record whose quotes or braces don't match hides what follows
    it in its file, which is then one reject. A file that is no list is one record.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    wide = T.StructType([*struct.fields, T.StructField(BROKEN, T.StringType(), True)])
    if lines:
        texts = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("path"), F.lit(None).cast("long").alias("start"), F.col("value").alias("text")
        ).filter("trim(text) <> ''")
    else:
        texts = list_elements(spark, path, chunk)
    parsed = texts.select("path", "start", "text", F.from_json("text", wide, {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    fits = F.col("r").isNotNull() & F.col(f"r.{BROKEN}").isNull()
    return (
        parsed.filter(fits).select(*[F.col("r").getField(name).alias(name) for name in struct.names]),
        parsed.filter(~fits).select("path", "start", "text"),
    )


def list_elements(spark, path, chunk=CHUNK):
    """The elements of JSON lists as text: (path, start, text), with the byte at which each begins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    ranges = files.filter("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / chunk).cast("long"))).alias("number")
    ).repartition(tasks(spark), "path", "number")
    scanned = ranges.mapInArrow(_scan(chunk), "path string, length long, number long, flips int, outside long, inside long, is_list boolean")
    earlier = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begun = scanned.withColumn("in_string", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1)
    deltas = begun.withColumn("delta", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    placed = deltas.select(
        "path", "length", "number", "in_string",
        F.coalesce(F.sum("delta").over(earlier), F.lit(0)).alias("depth"),
        F.coalesce(F.first("is_list", ignorenulls=True).over(whole), F.lit(False)).alias("is_list"),
    )
    # A range of a file that is no list has no record of its own but for the first.
    return placed.filter("is_list or number = 0").repartition(tasks(spark), "path", "number").mapInArrow(_cut(chunk), "path string, start long, text string")


def _quotes(data, escapes):
    """Where strings begin and end, and how many escapes run up to the end of `data`."""
    marks, at = data == QUOTE, np.flatnonzero(data == ESCAPE)
    if escapes % 2 and not (len(at) and at[0] == 0):
        marks[0] = False
    if not len(at):
        return marks, 0
    breaks = np.flatnonzero(np.diff(at) != 1)
    first, after = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1
    run = after - first + np.where(first == 0, escapes, 0)
    behind = after[run % 2 == 1]
    marks[behind[behind < len(data)]] = False
    return marks, int(run[-1]) if after[-1] == len(data) else 0


def _escapes_before(file, at):
    """How many escapes run up to a place in a file."""
    n = 0
    while at > n:
        size = min(4096, at - n)
        part = file.read_at(size, at - n - size)
        bare = part.rstrip(b"\\")
        n += len(part) - len(bare)
        if bare:
            break
    return n


def _parts(file, at, end, escapes, own=None):
    """(place, bytes, quotes) of a file from `at` on, a few megabytes at a time; behind `own` little at first, then twice as much each time."""
    own, behind = end if own is None else min(own, end), BEHIND
    while at < end:
        if at < own:
            size = min(HELD, own - at)
        else:
            size, behind = min(behind, end - at), min(2 * behind, HELD)
        data = np.frombuffer(file.read_at(size, at), np.uint8)
        if not len(data):
            return
        marks, escapes = _quotes(data, escapes)
        yield at, data, marks
        at += len(data)


def _scan(chunk):
    """Per range: the parity of its quotes, and the change of depth if it begins outside or inside a string."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, length, number in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "number")), strict=True):
                system, name = opened(path)
                flips, outside, inside, is_list = 0, 0, 0, None
                with system.open_input_file(name) as file:
                    at = number * chunk
                    for _, data, marks in _parts(file, at, min(at + chunk, length), _escapes_before(file, at)):
                        odd = (np.cumsum(marks) + flips) % 2 == 1
                        steps = STEP[data]
                        inside += int(steps[odd].sum())
                        outside += int(steps[~odd].sum())
                        flips = (flips + int(marks.sum())) % 2
                        text = data.tobytes().lstrip() if is_list is None else b""
                        is_list = text[:1] == b"[" if text else is_list
                rows.append((path, length, number, flips, outside, inside, is_list))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["path", "length", "number", "flips", "outside", "inside", "is_list"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

    return run


def _elements(file, length, begin, end, in_string, depth):
    """(start, bytes) of the elements that follow a mark in [begin, end).

    Marks are the opening of a list and the commas in it. The last element is read on beyond the end. One that is longer
    than LONGEST comes cut, and is no JSON then.
    """
    start, held, size, opening = None, [], 0, False
    for at, data, marks in _parts(file, begin, length, _escapes_before(file, begin), end):
        odd = (np.cumsum(marks) + in_string) % 2 == 1
        after = depth + np.cumsum(np.where(odd, 0, STEP[data]))
        opens = ~odd & (data == OPEN_LIST) & (after == 1)
        commas = ~odd & (data == COMMA) & (after == 1)
        closes = ~odd & (data == CLOSE_LIST) & (after == 0)
        last, raw = 0, data.tobytes()
        for spot in np.flatnonzero(opens | commas | closes).tolist():
            mark = raw[spot]
            if start is not None:
                own = raw[last:spot] if size < LONGEST else b""
                whole = b"".join([*held, own]) if held else own
                if whole.strip() or not (opening and mark == CLOSE_LIST):
                    yield start, whole
            if mark == CLOSE_LIST or at + spot >= end:
                start = None
                if at + spot >= end:
                    return
            else:
                start, opening = at + spot + 1, mark == OPEN_LIST
            held, size, last = [], 0, spot + 1
        if start is not None:
            if size < LONGEST:
                held.append(raw[last:])
            size += len(data) - last
        elif at + len(data) >= end:
            return
        in_string, depth = int(odd[-1]), int(after[-1])
    if start is not None and b"".join(held).strip():
        yield start, b"".join(held)


def _cut(chunk):
    """The elements that begin in each range, a few megabytes of text at a time."""

    def run(batches):
        for batch in batches:
            columns = ("path", "length", "number", "in_string", "depth", "is_list")
            for path, length, number, in_string, depth, is_list in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    if is_list:
                        found = _elements(file, length, number * chunk, min((number + 1) * chunk, length), int(in_string), depth)
                    else:
                        text = file.read_at(min(length, LONGEST), 0)
                        found = [(0, text)] if text.strip() else []
                    yield from gathered(path, found)

    def gathered(path, found):
        starts, texts, size = [], [], 0
        for start, text in found:
            starts.append(start), texts.append(text.decode("utf-8", "replace").strip())
            size += len(text)
            if size >= HELD:
                yield batch_of(path, starts, texts)
                starts, texts, size = [], [], 0
        yield batch_of(path, starts, texts)

    def batch_of(path, starts, texts):
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), len(starts)), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], ["path", "start", "text"])

    return run


def write_records(df, path, fmt="json", mode="errorifexists", partition_by=()):
    """Rows written as records, one file per partition and value of `partition_by`; returns the column names."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)
    return df.columns


def write_record_lists(df, path, mode="errorifexists"):
    """Rows written as JSON lists, one file per partition; returns the column names."""
    write_texts_as_lists(df.select(F.to_json(F.struct(*df.columns)).alias("text")), path, mode)
    return df.columns


def write_texts_as_lists(texts, path, mode="errorifexists"):
    """JSON texts, the column `text`, written as lists, one file per partition; a null text is a JSON null."""

    def run(batches):
        opening = "["
        for batch in batches:
            texts = batch.column("text")
            if len(texts):
                marks = pa.array([opening, *[","] * (len(texts) - 1)], texts.type)
                joined = pc.binary_join_element_wise(marks, texts, pa.scalar("", texts.type), null_handling="replace", null_replacement="null")
                yield pa.RecordBatch.from_arrays([joined], ["value"])
                opening = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if opening == "[" else "]"])], ["value"])

    texts.select("text").mapInArrow(run, "value string").write.mode(mode).text(path)
