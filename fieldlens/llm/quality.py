"""Quality rules with a verdict on each host, in DataFrame functions only.

Each document fails some rules; failures are counted by host, each host's rate is shrunk
towards the rate of all hosts by a beta prior fitted to the hosts (method of moments), and
a host whose shrunk rate passes the limit fails with all its documents.

Defined cases: a null or blank text has no words and fails the base rule; documents without a
host form one group, which gets no verdict; repeated rows count as often as they
stand; columns other than the named ones are carried along, unless they bear the name of a
measure, which then replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, stored, table

#: Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules that count against a host: documents of mostly symbols, or of mostly equal lines.
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
#: A host fails if this share of its documents is expected to fail one rule.
HOST_LIMIT = 0.5

RULES = ("base", "symbols", "lines")


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text, computed within the row.

    A run of three words is known by its 64-bit hash. Sorting the (hash, position) pairs of a text brings equal
    runs together; the positions of runs with an equal neighbour, sorted again, tell the words covered.
    """
    own = _text(text)
    words = F.regexp_extract_all(own, F.lit(WORD), F.lit(0))
    step = (
        docs.withColumn("_words", words)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.translate(own, SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(own) - F.char_length(F.translate(own, SYMBOLS, ""))).cast("long"))
        .withColumn("_lines", F.filter(F.split(own, "\n"), lambda x: x.rlike(WORD)))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
        .withColumn(
            "_runs",
            F.expr(
                "case when n_words >= 3 then sort_array(transform(sequence(1, cast(n_words as int) - 2), i ->"
                " struct(xxhash64(_words[i - 1], _words[i], _words[i + 1]) as h, i as at))) end"
            ),
        )
        .drop("_words")
        .withColumn(
            "_at",
            F.expr(
                "sort_array(transform(filter(_runs, (r, i) -> (i > 0 and _runs[i - 1].h = r.h)"
                " or (i + 1 < size(_runs) and _runs[i + 1].h = r.h)), r -> r.at))"
            ),
        )
        .drop("_runs")
        .withColumn(
            "n_repeat_words",
            F.expr(
                "coalesce(aggregate(transform(_at, (p, i) -> case when i + 1 < size(_at) then least(3, _at[i + 1] - p) else 3 end),"
                " 0L, (a, x) -> a + x), 0L)"
            ),
        )
        .drop("_at")
    )
    return step.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def failures() -> dict[str, Column]:
    """Each host-level rule as a condition on the measures."""
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: its documents, its shrunk rate by rule, and whether it fails.

    The prior of a rule has the mean m of all documents and the strength s = m(1 - m)/v - 1, v
    being the variance of the hosts' rates less what chance adds to it, m(1 - m) times the mean of 1/n; without spread
    beyond chance the strength is the number of documents of a mean host.
    """
    fails = failures()
    hosts = stored(
        measured.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("n"), *[F.count_if(fails[r]).alias(f"n_{r}") for r in RULES])
    )
    prior = hosts.agg(
        F.avg("n").alias("n"),
        F.avg(1 / F.col("n")).alias("chance"),
        *[(F.sum(f"n_{r}") / F.sum("n")).alias(f"m_{r}") for r in RULES],
        *[F.var_pop(F.col(f"n_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES],
    ).first()
    for r in RULES:
        m = prior[f"m_{r}"] or 0.0
        v = (prior[f"v_{r}"] or 0.0) - m * (1 - m) * (prior["chance"] or 0.0)
        strength = max(1.0, m * (1 - m) / v - 1 if v > 0 else prior["n"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"n_{r}") + m * strength) / (F.col("n") + strength))
    failed = F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit
    return hosts.select(host, "n", *[f"rate_{r}" for r in RULES], failed.alias("host_failed"))


def judged(measured: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with ``kept``: the base rule holds and the host does not fail."""
    back = verdicts.where("host_failed").select(F.col(host).alias("_host"), F.lit(True).alias("_failed"))
    return (
        measured.join(back, F.col(host) == F.col("_host"), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_failed").isNull())
        .drop("_host", "_failed")
    )


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures and the verdict of each document, without its text.

    The measures of a document are some numbers, settled once; verdicts read them twice.
    """
    measured = settled(measures(docs.select("doc_id", host, "text")).drop("text"))
    return judged(measured, host_verdicts(measured, host), host).select(*COLUMNS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``, whatever their names.

    Texts are measured twice, for the hosts and for themselves, and neither shuffled nor stored. The row's number keeps the filter on the
    verdict above the measures; pushed into them, it would compute them anew for each place that names them.
    """
    verdicts = host_verdicts(measures(docs.select("source", "text")).drop("text"))
    rows = measures(docs.select(F.struct(*docs.columns).alias("_row"), "source", "text")).drop("text")
    return judged(rows.withColumn("_number", F.monotonically_increasing_id()), verdicts).where("kept and _number >= 0").select("_row.*")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
r AS (
  SELECT doc_id, source, len(ws) AS n_words,
    CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    ws, row_number() OVER () AS k
  FROM w),
g AS (SELECT k, ws, unnest(range(1, n_words - 1)) AS i FROM r WHERE n_words >= 3),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
p AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM h WHERE c >= 2),
q AS (SELECT k, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words FROM p GROUP BY k),
m AS (
  SELECT doc_id, source, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed
  FROM r LEFT JOIN q USING (k)),
f AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS a,
    count(*) FILTER (100 * n_symbols > 10 * word_chars) AS b,
    count(*) FILTER (100 * n_dup_lines > 30 * n_lines) AS c
  FROM m WHERE source IS NOT NULL GROUP BY source),
e AS (
  SELECT avg(n) AS mn, avg(1 / n) AS chance, sum(a) / sum(n) AS ma, sum(b) / sum(n) AS mb, sum(c) / sum(n) AS mc,
    var_pop(a / n) AS wa, var_pop(b / n) AS wb, var_pop(c / n) AS wc FROM f),
o AS (
  SELECT *, wa - ma * (1 - ma) * chance AS va, wb - mb * (1 - mb) * chance AS vb, wc - mc * (1 - mc) * chance AS vc FROM e),
s AS (
  SELECT source, n, a, b, c, ma, mb, mc,
    greatest(1.0, CASE WHEN va > 0 THEN ma * (1 - ma) / va - 1 ELSE mn END) AS sa,
    greatest(1.0, CASE WHEN vb > 0 THEN mb * (1 - mb) / vb - 1 ELSE mn END) AS sb,
    greatest(1.0, CASE WHEN vc > 0 THEN mc * (1 - mc) / vc - 1 ELSE mn END) AS sc
  FROM f, o),
v AS (
  SELECT source FROM s
  WHERE greatest((a + ma * sa) / (n + sa), (b + mb * sb) / (n + sb), (c + mc * sc) / (n + sc)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND v.source IS NULL AS kept
FROM m LEFT JOIN v ON m.source = v.source
"""
