"""Language of a text by Bayesian fusion of evidence.

For each language l the log posterior is the sum of

- the text's log likelihood under hashed byte trigrams of its letters, learnt from a sample of labelled rows and tempered,
  since neighbouring trigrams tell the same thing;
- log P(declared language | l), from counts of declared and text-only languages over all rows;
- log P(address suffix | l), likewise;
- log P(l | host): the host's counts, smoothed towards its domain, which is smoothed towards all rows.

Counts come from grouped aggregation over all rows; only the classifier of text sees a sample, of at most
``SAMPLE`` rows, the first ``SAMPLE_BYTES`` characters of each, for each of at most ``LANGUAGES`` languages (the most frequent).

Defined cases: a text without letters (signs and digits are none), or null, has language 'und' and is not kept, whatever is declared; null declared
language, suffix or host is no evidence; repeated rows count each; of languages with equal evidence the first by name wins; in a table without any label all rows are 'und'; extra columns
are carried by ``kept_documents`` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, lean, slices, stored, table

LANGUAGES = 200
SAMPLE = 500
#: Characters of a sample row that are learnt from; only learning cuts a text.
SAMPLE_BYTES = 20_000
BUCKETS = 1 << 14
TEMPER = 0.25
#: Weight of the parent's rate in rows: of the domain for a host, of all rows for a domain.
HOST_WEIGHT = 20.0
#: Rows added to each count of declared languages and suffixes.
SMOOTH = 1.0
#: The least posterior of the best language in a row that is kept.
LEAST = 0.5
SLICE = 1 << 21

LETTER = np.zeros(256, np.uint32)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)
#: Signs that are no letters (fixed values): UTF-8 lead byte, second byte from and to, bytes. Latin-1 signs but for three letters among them,
#: times and divide, general punctuation to currency, arrows to dingbats, CJK punctuation, full-width punctuation.
SIGNS = (
    (0xC2, 0xA0, 0xA9, 2), (0xC2, 0xAB, 0xB4, 2), (0xC2, 0xB6, 0xB9, 2), (0xC2, 0xBB, 0xBF, 2), (0xC3, 0x97, 0x97, 2), (0xC3, 0xB7, 0xB7, 2),
    (0xE2, 0x80, 0x83, 3), (0xE2, 0x86, 0x9E, 3), (0xE3, 0x80, 0x80, 3), (0xEF, 0xBC, 0xBC, 3),
)


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased, and zero for whatever is no letter."""
    x = LETTER[data]
    if len(data) > 1 and (data > 127).any():
        first, second = data[:-1], data[1:]
        for lead, low, high, size in SIGNS:
            at = np.flatnonzero((first == lead) & (second >= low) & (second <= high))
            for k in range(size if len(at) else 0):
                x[np.minimum(at + k, len(x) - 1)] = 0
    return x


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram that begins at each byte, and whether it has a letter in its middle."""
    x = _letters(data)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32), x[1:-1] > 0


def _counts(data: np.ndarray) -> np.ndarray:
    """How often each bucket occurs in one text."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), SLICE):
        piece = data[max(0, at - 2) : at + SLICE]
        if len(piece) > 2:
            code, real = _trigrams(piece)
            out += np.bincount(code[real], minlength=BUCKETS)
    return out


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """id, text, declared, suffix, host of web pages: the html's lang attribute, the top domain and the host."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(
        F.col("page_id").alias("id"),
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ").alias("text"),
        blank(declared).alias("declared"),
        blank(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
        blank(host).alias("host"),
    )


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """id, text, declared, suffix, host of documents: their lang and source; a source without a dot has no suffix."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"),
        _suffix(), F.col("source").alias("host"),
    )


def _suffix() -> Column:
    return F.expr("nullif(regexp_extract(source, '[.]([a-z]+)$', 1), '')").alias("suffix")


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods by bucket, from the sample of labelled rows."""
    top = rows.where("declared is not null").groupBy("declared").count().orderBy(F.desc("count"), "declared").limit(LANGUAGES).collect()
    labels = sorted(r["declared"] for r in top)
    if not labels:
        return [], np.zeros((0, BUCKETS), np.float32)
    # Each language's rows are thinned by a hash to a little over the bound, then cut to it.
    share = {r["declared"]: min(1.0, 2 * SAMPLE / r["count"]) for r in top}
    rate = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    spot = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000))
    some = (
        rows.where(F.col("declared").isin(labels))
        .withColumn("spot", spot)
        .where(F.col("spot") < rate[F.col("declared")] * 1_000_000)
        .select("declared", F.substring("text", 1, SAMPLE_BYTES).alias("text"), "spot")
        .withColumn("nth", F.row_number().over(Window.partitionBy("declared").orderBy("spot", "text")))
        .where(F.col("nth") <= SAMPLE)
        .select("declared", "text")
    )

    def count(batches):
        total = {}
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for i, label in enumerate(batch.column("declared").to_pylist()):
                c = _counts(data[offsets[i] : offsets[i + 1]])
                total[label] = total.get(label, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["declared", "counts"])

    sums = {x: np.zeros(BUCKETS) for x in labels}
    for r in some.mapInArrow(count, "declared string, counts binary").toLocalIterator():
        sums[r["declared"]] += np.frombuffer(r["counts"], np.int64)
    grid = np.array([sums[x] for x in labels]) + 0.5
    return labels, np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)


def _scored(rows: DataFrame, labels: list[str], table_: np.ndarray) -> DataFrame:
    """The rows with ``scores`` (tempered log likelihood by language, null without letters), without their text."""
    shared = rows.sparkSession.sparkContext.broadcast(table_)
    others = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("scores", T.ArrayType(T.FloatType()))])

    def run(batches):
        weights = shared.value.T
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            scores = []
            for first, last in slices(offsets, SLICE):
                for i in range(first, last):
                    counts = _counts(data[offsets[i] : offsets[i + 1]])
                    scores.append((TEMPER * (counts.astype(np.float32) @ weights)).tolist() if counts.any() else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(scores, pa.list_(pa.float32()))], [*others, "scores"])

    placed = rows.select(*others, "text").mapInArrow(lean(run), schema)
    return placed.withColumn("text_at", F.expr("nullif(array_position(scores, array_max(scores)), 0) - 1").cast("int")).withColumn(
        "domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    )


KEYS = ("declared", "suffix", "domain", "host")


class Evidence:
    """What all scored rows say about languages: how many rows each has, in all and by each key.

    The counts by key are tables of their own, stored, so that the planner knows their size.
    """

    def __init__(self, scored: DataFrame, labels: list[str]):
        self.labels, n = labels, len(labels)
        real = scored.where("text_at is not null")
        count = [F.count_if(F.col("text_at") == i).cast("double").alias(f"c{i}") for i in range(n)]
        self.whole = [float(c) for c in real.agg(*count).first()]
        self.by = {k: stored(real.where(F.col(k).isNotNull()).groupBy(k).agg(F.array(*count).alias(f"by_{k}"))) for k in KEYS}
        self.kinds = {k: max(1, self.by[k].count()) for k in ("declared", "suffix")}

    def posterior(self, scored: DataFrame) -> DataFrame:
        """``scored`` with the best language's place ``best`` and its ``posterior``; scores and counts go."""
        total = sum(self.whole) + len(self.labels)
        sum_of = lambda a: f"aggregate({a}, 0D, (x, y) -> x + y)"
        out = scored
        for key in KEYS:
            out = out.join(self.by[key], key, "left")
        smooth = lambda own, parent: f"transform({own}, (x, i) -> (x + {HOST_WEIGHT} * {parent}[i]) / ({sum_of(own)} + {HOST_WEIGHT}))"
        ratio = "".join(f" + coalesce(ln((by_{k}[i] + {SMOOTH}) / (_langs[i] + {SMOOTH} * {self.kinds[k]})), 0D)" for k in ("declared", "suffix"))
        out = (
            out.withColumns({"_all": F.array(*[F.lit((c + 1) / total) for c in self.whole]), "_langs": F.array(*[F.lit(c) for c in self.whole])})
            .withColumn("_domain", F.expr(f"case when by_domain is null or domain = '' then _all else {smooth('by_domain', '_all')} end"))
            .withColumn("_host", F.expr(f"case when by_host is null then _domain else {smooth('by_host', '_domain')} end"))
            .withColumn("_log", F.expr(f"transform(scores, (s, i) -> s + ln(_host[i]){ratio})"))
        )
        return out.withColumn("best", F.expr("nullif(array_position(_log, array_max(_log)), 0) - 1").cast("int")).withColumn(
            "posterior", F.coalesce(F.expr("1 / aggregate(transform(_log, x -> exp(x - array_max(_log))), 0D, (x, y) -> x + y)"), F.lit(0.0))
        ).drop("scores", "_all", "_langs", "_domain", "_host", "_log", *(f"by_{k}" for k in KEYS))


def _kept() -> Column:
    return F.col("best").isNotNull() & (F.col("posterior") >= LEAST)


def fused(rows: DataFrame) -> DataFrame:
    """id, language, posterior, kept, and what the text alone says (text_language), for evidence rows.

    The rows' scores are stored without their texts: some numbers a row.
    """
    labels, weights = learn(rows)
    if not labels:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"), F.lit("und").alias("text_language"))
    scored = stored(_scored(rows, labels, weights))
    names = F.array(*[F.lit(x) for x in labels])
    named = lambda at: F.coalesce(F.get(names, F.col(at)), F.lit("und"))
    return Evidence(scored, labels).posterior(scored).select("id", named("best").alias("language"), "posterior", _kept().alias("kept"), named("text_at").alias("text_language"))


def language_of_documents(docs: DataFrame) -> DataFrame:
    return fused(evidence_of_documents(docs))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with the columns of ``docs``; each row is judged by itself, whatever its doc_id.

    Texts are scored twice, for the counts and for themselves, as scoring costs less than moving or storing them. The row's number keeps
    the filter on the verdict above what makes it.
    """
    rows = evidence_of_documents(docs)
    labels, weights = learn(rows)
    if not labels:
        return docs.limit(0)
    evidence = Evidence(stored(_scored(rows, labels, weights).drop("id", "scores")), labels)
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text", F.col("lang").alias("declared"), _suffix(), F.col("source").alias("host"))
    judged = evidence.posterior(_scored(own, labels, weights)).withColumns({"kept": _kept(), "_number": F.monotonically_increasing_id()})
    return judged.where("kept and _number >= 0").select("_row.*")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_of_documents(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
