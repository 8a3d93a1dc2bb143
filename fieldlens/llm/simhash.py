"""SimHash near-duplicates: covering locality-sensitive hashing finds every pair of fingerprints within the radius.

A fingerprint has 64 bits. Bit i is one if it is one in over half of the XXH64 hashes (seed 42) of the document's runs
of ``width`` words, repeats included. Documents link if their fingerprints differ in at most ``radius`` bits.

1. Each bit position is dealt a non-zero vector of radius + 1 bits, and each non-zero vector v of that length makes a table, whose
   mask keeps the positions with an odd inner product with v. The vectors of ``radius`` differing positions leave some v orthogonal to all
   of them; its mask drops these positions, so the pair has the same masked fingerprint in that table. No pair is lost, whatever the data.
2. Equal fingerprints are one class, so copies are never paired. A bucket (table, masked fingerprint) of at most ``BUCKET`` classes is compared
   within itself; it yields at most one row per class, which names the smallest class that it hangs together with there.
3. In a larger bucket every class sends itself with each dropped position flipped, in turn, and unflipped. Two fingerprints within a
   radius of 2 meet at such a value, and what meets there is within a radius of 2. A value has at most as many senders as positions plus one, so
   output is linear in the bucket and no task holds it. A radius of 1 is checked pair by pair there (the senders are few); a radius over 2 has
   larger buckets compared in blocks.
4. Links make components.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; a document of fewer words than
``width`` has one run; a null doc_id links like any other but names no component, so its component_id is null where no other row has an id; rows
that repeat a doc_id stand each for themselves; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, stored, table
from .components import components

BITS = 64
SEED = 42
#: Classes of a bucket that are compared with one another in a task.
BUCKET = 256
#: Bytes of a text split at a time, and hashes whose bits are counted at a time.
PIECE = 1 << 20
COUNTED = 1 << 15
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int) -> list[int]:
    """The masks of the tables: any ``radius`` positions are dropped by at least one of them."""
    vectors = (1 << (radius + 1)) - 1
    dealt = [1 + i % vectors for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _pieces(text: bytes):
    """Lists of words, cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            blank = BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        yield text[at:end].split()
        at = end


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(BITS, np.int64)
    words = np.array(hashes, np.uint64)
    for at in range(0, len(words), COUNTED):
        bits = np.unpackbits(words[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a whole text, in pieces, so that only its bytes and a piece are held."""
    ones, n, kept = np.zeros(BITS, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in _pieces(text.lower()):
        words = kept + words
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:-1] + 1).tolist()]
            hashes = [hashed(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]
            ones += _ones(hashes)
            n += len(hashes)
            words = words[len(words) - width + 1 :]
        kept = words
    if not n and kept:
        ones, n = _ones([hashed(b" ".join(kept), SEED)]), 1
    return int(((2 * ones > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum()) if n else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a long, for every row."""

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            found = np.array([fingerprint(data[a:b].tobytes(), width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long")


def _hung(x: np.ndarray, radius: int) -> np.ndarray:
    """For each of a few fingerprints the position of the first that it hangs together with."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        least = np.where(near, label[None, :], len(x)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _within(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside small buckets, at most one per class of a bucket."""
    laid = buckets.repartition("table", "bucket").sortWithinPartitions("table", "bucket", "print")

    def run(batches):
        kept = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in ("table", "bucket", "print")], axis=1)
            now = now if kept is None else np.concatenate([kept, now])
            edge = np.flatnonzero((now[1:, :2] != now[:-1, :2]).any(axis=1)) + 1
            whole = edge[-1] if len(edge) else 0
            # The last bucket may go on in the next batch.
            kept = now[whole:]
            yield linked(now[:whole], edge[:-1])
        if kept is not None:
            yield linked(kept, np.zeros(0, np.int64))

    def linked(rows, edge):
        starts, ends = np.r_[0, edge].astype(int), np.r_[edge, len(rows)].astype(int)
        two = starts[ends - starts == 2]
        x = rows[:, 2].astype(np.int64).view(np.uint64)
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
        a, b = [two], [two + 1]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            first = _hung(x[s:e], radius)
            hung = np.flatnonzero(first != np.arange(e - s))
            a.append(first[hung] + s), b.append(hung + s)
        names = x.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[np.concatenate(a)]), pa.array(names[np.concatenate(b)])], ["a", "b"])

    return laid.mapInArrow(run, "a long, b long")


def _across(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside large buckets, by the values that two fingerprints reach with one flip each."""
    opened = [[i for i in range(BITS) if not mask >> i & 1] for mask in masks(radius)]
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in free)) for free in opened))
    sent = buckets.select("print", F.explode(F.element_at(flips, F.col("table") + 1)).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("met")).distinct()
    if radius == 2:
        least = sent.groupBy("met").agg(F.min("print").alias("a"))
        return sent.join(least, "met").where("print <> a").select("a", F.col("print").alias("b"))
    other = sent.select("met", F.col("print").alias("a"))
    return other.join(sent, "met").where("a < print").where(F.bit_count(F.col("a").bitwiseXOR(F.col("print"))) <= radius).select("a", F.col("print").alias("b"))


def _blocked(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside large buckets, block against block; for a radius that single flips don't cover."""
    count = buckets.groupBy("table", "bucket").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"))
    spot = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    mine = buckets.join(count, ["table", "bucket"]).withColumn("block", spot)
    dealt = mine.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "table", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print"
    )

    def compare(group: pa.Table) -> pa.Table:
        x = group.column("print").to_numpy().view(np.uint64)
        first = _hung(x, radius)
        names = x.view(np.int64)
        hung = np.flatnonzero(first != np.arange(len(x)))
        return pa.table({"a": names[first[hung]], "b": names[hung]})

    return dealt.groupBy("table", "bucket", "i", "j").applyInArrow(compare, "a long, b long")


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) between distinct fingerprints ``print`` that connect whatever lies within the radius."""
    kept = masks(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*(F.struct(F.lit(t).alias("table"), F.lit(signed(m)).cast("long").alias("mask")) for t, m in enumerate(kept)))
    every = classes.select("print", F.explode(tables).alias("t")).select(F.col("t.table"), F.col("t.mask").bitwiseAND(F.col("print")).alias("bucket"), "print")
    sizes = stored(every.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stored(every.join(sizes, ["table", "bucket"]))
    small, large = shared.where(F.col("n") <= BUCKET).drop("n"), shared.where(F.col("n") > BUCKET).drop("n")
    rest = _across(large, radius) if radius in (1, 2) else _blocked(large, radius)
    return _within(small, radius).unionByName(rest).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    prints = stored(fingerprints(docs, width))
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    hung = components(links(classes, radius))
    part = classes.join(hung.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    names = part.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(part.join(names, "component").select("print", "component_id"))
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
