"""Near-duplicate documents: MinHash bands find pairs, odd sketches sift them, full sets confirm them.

A document's set holds its distinct runs of ``width`` words (64-bit hashes); with fewer words
the whole sequence is one run. Two documents are linked if 100 * intersection >= percent * union. Classes of
equal sets stand for all their documents, so copies are never paired with one another.

1. Every class has ``bands * 5`` MinHash values. Classes that share a band of five values meet in a bucket, and each is
   compared with the smallest of the bucket only (a star).
2. An odd sketch folds further MinHash samples (the least hash in each of ``BINS`` parts of one permutation) into ``BITS`` bits by
   parity. The ones in the XOR of two sketches estimate how many samples differ; pairs that are ``SIGMAS`` standard deviations of
   samples and sketch below the similarity are left out, the others are confirmed on their full sets.
3. Links make components. Buckets that hold more than one component are looked at again: those that share classes are put together, their
   classes are dealt into blocks, and a task holds the sets of two blocks. It sifts pairs of different components by their sketches, confirms them on the sets at once,
   and sends no more than one link per class. So pairs are never rows, and a set travels once per block, not per pair.

No pair that shares a band is lost, and pairs within one component are never looked at. A pair just at the
similarity shares no band with a probability of at most ``MISS``; the sketch loses less than that.

Defined cases: a document without words or text has an empty set, size 0, and is linked with nothing; a null doc_id is
linked with nothing and not kept; rows that repeat a doc_id are one document with several sets; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_view, lean, mixed, odd_numbers, slices, small_enough, stored, table
from .components import components
from .words import shingle_sets

#: MinHash values of a band, and the largest probability that a pair at the similarity shares none.
ROWS = 5
MISS = 1e-7
#: Samples and bits of an odd sketch, and how far below the similarity a pair is still confirmed.
BINS = 1024
BITS = 1024
SIGMAS = 6
#: Classes, and members of their sets, of a block.
BLOCK = 512
HELD = 1 << 18
#: Classes of buckets put together that are compared as one group; beyond that each bucket is a group.
TOGETHER = 1 << 16
#: Members of sets laid out as columns at a time.
COLUMNS = 1 << 13
#: Documents confirmed against one document by a task in one go.
CHUNK = 256
#: Bytes of text hashed at a time.
SLICE = 1 << 20


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _ones(differing: np.ndarray) -> np.ndarray:
    """Expected ones in the XOR of two sketches whose samples differ so much."""
    return BITS / 2 * (1 - np.exp(-2 * differing / BITS))


def near_enough(ones: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches of ``a`` and ``b`` samples with so many ones in their XOR allow the similarity.

    At the similarity p, at least p of the larger number of samples are equal, give or take the deviation of as many draws; the
    ones of so many differing samples deviate once more.
    """
    p, most = percent / 100, np.maximum(a, b)
    equal = np.maximum(0, p * most - SIGMAS * np.sqrt(most * p * (1 - p)))
    expected = _ones(np.maximum(0, a + b - 2 * equal))
    return ones <= expected + SIGMAS * np.sqrt(expected * (1 - expected / BITS)) + 1


def _minima(sets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The MinHash values of a set: the least of each hash function over its members."""
    out = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        part = sets[at : at + 2048]
        grid = part[None, :] * keys[:, None]
        grid ^= grid >> np.uint64(32)
        np.minimum(out, grid.min(axis=1), out=out)
    return out


def _sketch(one: np.ndarray) -> tuple[int, bytes]:
    """The number of samples of a set, and their odd sketch."""
    laid = np.sort(mixed(one ^ np.uint64(0x5851F42D4C957F2D)))
    part = laid >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(len(part), bool)
    first[1:] = part[1:] != part[:-1]
    samples = laid[first]
    spots = (mixed(samples * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return len(samples), np.packbits((np.bincount(spots, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _prints(percent: int, width: int):
    bands = band_count(percent)
    keys = mixed(odd_numbers(37, bands * ROWS)) | np.uint64(1)
    inside = odd_numbers(41, ROWS)
    order = odd_numbers(43, bands)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    names = ["doc_id", "n_shingles", "digest", "bands", "samples", "sketch"]

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                rows = []
                for one in shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width):
                    if not len(one):
                        rows.append((0, None, None, None, None))
                        continue
                    least = _minima(one, keys)
                    named = mixed((least.reshape(bands, ROWS) * inside).sum(axis=1, dtype=np.uint64) + order).view(np.int64)
                    rows.append((len(one), hashlib.blake2b(one.tobytes(), digest_size=16).digest(), named, *_sketch(one)))
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names)

    return run


PRINTS = "doc_id long, n_shingles long, digest binary, bands array<long>, samples int, sketch binary"


def _sketch_words(column) -> np.ndarray:
    data, _ = byte_view(column)
    return data.reshape(-1, BITS // 8).view(np.uint64)


def _sizes_fit(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _sift(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of which sizes and sketches allow the similarity."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("samples").alias(f"k_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_sizes_fit(percent))

    def run(batches):
        for batch in batches:
            ones = np.bitwise_count(_sketch_words(batch.column("s_a")) ^ _sketch_words(batch.column("s_b"))).sum(axis=-1, dtype=np.int64)
            near = near_enough(ones, batch.column("k_a").to_numpy(), batch.column("k_b").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "k_a", "k_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity.

    Each a goes out once to every chunk of its partners, ahead of them; a task holds the set of one a
    and reads partners one after another.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    wanted = dealt.select("a", "chunk", F.lit(1).alias("kind"), F.col("b").alias("id")).unionAll(
        dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("kind"), F.col("a").alias("id"))
    )
    wanted = stored(wanted)
    # Texts that are not wanted stay where they are.
    rows = wanted.join(docs.select(F.col("doc_id").alias("id"), "text").join(small_enough(wanted.select("id")), "id", "left_semi"), "id")
    laid = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "kind")

    def run(batches):
        key, heads = None, []
        for batch in batches:
            a, chunk, kind, ids = (batch.column(x).to_numpy() for x in ("a", "chunk", "kind", "id"))
            data, offsets = byte_view(batch.column("text"))
            left, right = [], []
            for first, last in slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                for i, one in enumerate(sets, first):
                    if key != (a[i], chunk[i]):
                        key, heads = (a[i], chunk[i]), []
                    if not kind[i]:
                        heads.append(one)
                        continue
                    for head in heads:
                        common = len(np.intersect1d(head, one, assume_unique=True))
                        if common and 100 * common >= percent * (len(head) + len(one) - common):
                            left.append(a[i]), right.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return laid.mapInArrow(lean(run), "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (rep and what goes with it) with the full set of the document, its samples and sketch."""
    rows = wanted.join(docs.select(F.col("doc_id").alias("rep"), "text").join(small_enough(wanted.select("rep")), "rep", "left_semi"), "rep")
    others = [c for c in wanted.columns]
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                sets = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                sketches = [_sketch(one) if len(one) else (0, bytes(BITS // 8)) for one in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, last - first) for c in others),
                        pa.array([len(one) for one in sets], pa.int64()), pa.array([k for k, _ in sketches], pa.int32()),
                        pa.array([x for _, x in sketches], pa.binary()), pa.array([one.tobytes() for one in sets], pa.binary()),
                    ],
                    [*others, "n", "samples", "sketch", "items"],
                )

    return rows.mapInArrow(lean(run), f"{kinds}, n long, samples int, sketch binary, items binary").where("n > 0")


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the sets ``a`` with the sets ``b``, as a grid."""
    used = np.unique(np.concatenate([a, b]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    values, at, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    # What a single set holds is common to none.
    shared = count > 1
    column = np.cumsum(shared) - 1
    real = shared[at]
    owner, at = owner[real], column[at[real]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        grid = np.zeros((len(used), COLUMNS), np.float32)
        grid[owner[part], at[part] - lo] = 1
        out += grid[place[a]] @ grid[place[b]].T
    return out


def _linked(percent: int):
    """Of the classes of two blocks, links between different components that make them hang together."""

    def run(group: pa.Table) -> pa.Table:
        rep, part, size, samples, block = (group.column(x).to_numpy() for x in ("rep", "component", "n", "samples", "block"))
        left, right = np.flatnonzero(block == group.column("i")[0].as_py()), np.flatnonzero(block == group.column("j")[0].as_py())
        out_a, out_b = [], []
        if len(left) and len(right) and part.min() != part.max():
            sketch = _sketch_words(group.column("sketch"))
            near = np.zeros((len(left), len(right)), bool)
            for r, i in enumerate(left):
                ones = np.bitwise_count(sketch[right] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                near[r] = (part[right] != part[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
                near[r] &= near_enough(ones, samples[right], samples[i], percent)
            rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if len(rows):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("items")]
                common = _common(sets, left[rows], right[columns])
                union = size[left[rows]][:, None] + size[right[columns]][None, :] - common
                fits = near[np.ix_(rows, columns)] & (100 * common >= percent * union)
                top = {}

                def root(x):
                    while top.get(x, x) != x:
                        x = top[x]
                    return x

                for r, c in zip(*np.nonzero(fits), strict=True):
                    i, j = left[rows[r]], right[columns[c]]
                    x, y = root(part[i]), root(part[j])
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        out_a.append(min(rep[i], rep[j])), out_b.append(max(rep[i], rep[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _rest(buckets: DataFrame, found: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links of different components that share a bucket and were not in its star."""
    members = buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    torn = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = stored(members.join(torn, "bucket"))
    joined = components(open_.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
    near = open_.join(joined.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    nodes = near.select("cluster", "rep", "component").distinct()
    wide = nodes.groupBy("cluster").agg(F.count("*").alias("classes")).where(F.col("classes") > TOGETHER).select("cluster")
    apart = near.join(wide, "cluster", "left_semi").select(F.lit(True).alias("apart"), F.col("bucket").alias("key"), "rep")
    whole = nodes.join(wide, "cluster", "left_anti").select(F.lit(False).alias("apart"), F.col("cluster").alias("key"), "rep")
    sets = stored(_sets(docs, open_.select("rep", "component").distinct(), width))
    groups = stored(apart.unionByName(whole).join(sets.select("rep", "n"), "rep"))
    blocks = groups.groupBy("apart", "key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / HELD)).cast("int").alias("blocks"))
    spot = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = groups.drop("n").distinct().join(blocks, ["apart", "key"]).withColumn("block", spot).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = placed.select("apart", "key", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "rep")
    return dealt.groupBy("apart", "key", "i", "j").applyInArrow(_linked(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    prints = stored(docs.mapInArrow(lean(_prints(percent, width)), PRINTS))
    real = prints.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.first("sketch").alias("sketch"))
    )
    every = classes.select("rep", F.explode("bands").alias("bucket"))
    heads = every.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Most buckets hold one class; the others are few and read several times.
    buckets = stored(every.join(heads, "bucket"))
    stars = buckets.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    # A doc_id that has several sets ties their classes together.
    member = real.join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    ties = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    tied = member.join(ties, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = stored(_confirmed(_sift(stars, classes, percent).distinct(), docs, percent, width).unionAll(tied).distinct())
    found = components(links)
    more = stored(_rest(buckets, found, docs, percent, width).distinct())
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    named = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        prints.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns of ``docs``; rows without doc_id stay.

    Rows that repeat a doc_id with another text are parts of one document and stay together; of rows with equal doc_id and
    text one stays, the first in the order of their other columns.
    """
    judged = near_duplicates(docs)
    gone = small_enough(judged.where("not kept and doc_id is not null").select("doc_id"))
    again = small_enough(judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    rows = left.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"))
    same = Window.partitionBy("_id", "_text").orderBy(F.to_json("_row"))
    twice = rows.join(again, F.col("_id") == again["doc_id"], "left_semi").withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(twice.select("_row.*"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=3, percent=85)
