"""Running numbers, XORs and sums along each key in order, with no key in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _running(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step, undo) -> np.ndarray:
    """The scan of ``step`` within runs that begin at ``starts``."""
    total = step.accumulate(values)
    before = np.where(starts > 0, total[starts - 1], 0)
    return undo(total, np.repeat(before, lengths))


def scanned(df: DataFrame, key: str, order: list[str], xors: list[str], sums: list[str]) -> DataFrame:
    """``df`` stored with ``at`` (1, 2, ... along each key in order), and ``xors`` and ``sums`` running along it, the row's own included.

    Rows are dealt by ranges of (key, order), so a key of any size is spread over slices; nulls come first. A slice scans
    its own rows as they stream by. What a key has in earlier slices is added afterwards: only the first and the last key of a
    slice can be in another one, so these carries are at most two rows per slice, and are broadcast.
    ``key``, ``xors`` and ``sums`` are longs without null.
    """
    laid = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", at long, slice int"

    def run(batches):
        number = TaskContext.get().partitionId()
        last, carry = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lengths = np.diff(np.r_[starts, len(keys)])
            goes_on = keys[0] == last
            out = {name: batch.column(name) for name in batch.schema.names}
            for name, values, step, undo in (
                [("at", np.ones(len(keys), np.int64), np.add, np.subtract)]
                + [(x, batch.column(x).to_numpy(), np.bitwise_xor, np.bitwise_xor) for x in xors]
                + [(s, batch.column(s).to_numpy(), np.add, np.subtract) for s in sums]
            ):
                running = _running(values, starts, lengths, step, undo)
                if goes_on:
                    running[: lengths[0]] = step(running[: lengths[0]], carry[name])
                carry[name] = running[-1]
                out[name] = pa.array(running, pa.int64())
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*out.values(), pa.array(np.full(len(keys), number, np.int32))], [*out, "slice"])

    local = stored(laid.mapInArrow(run, schema))
    edges = local.groupBy("slice").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("keys")).select("slice", F.explode("keys").alias(key))
    lanes = ["at", *xors, *sums]
    totals = local.join(F.broadcast(edges), ["slice", key]).groupBy(key, "slice").agg(F.max_by(F.struct(*lanes), "at").alias("t"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = totals.select(key, "slice", *((F.bit_xor if x in xors else F.sum)(f"t.{x}").over(earlier).alias(f"_{x}") for x in lanes)).where("_at > 0")
    joined = local.join(F.broadcast(held), ["slice", key], "left")
    moved = {x: F.coalesce(F.col(x).bitwiseXOR(F.col(f"_{x}")) if x in xors else F.col(x) + F.col(f"_{x}"), F.col(x)) for x in lanes}
    return joined.select(*(moved.get(c, F.col(c)).alias(c) for c in [*df.columns, "at"]))


def joined_text(df: DataFrame, key: list[str], value: str, chunk: int = 4096) -> DataFrame:
    """``key``, ``first`` and ``text``: the values of each key in rising order, comma-joined, in chunks that lie apart in any order.

    Chunks of a key don't overlap, so sorted by ``first`` they give its whole list.
    """
    laid = df.select(*key, value).repartitionByRange(*key, value).sortWithinPartitions(*key, value)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                keys = np.stack([part.column(k).to_numpy() for k in key], axis=1)
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
                values = part.column(value)
                grouped = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(keys)].astype(np.int32)), pc.cast(values, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(starts)) for k in key), values.take(pa.array(starts)), pc.binary_join(grouped, ",")], [*key, "first", "text"])

    return laid.mapInArrow(run, ", ".join(f"{k} long" for k in key) + ", first long, text string")
