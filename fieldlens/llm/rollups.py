"""Token totals maintained by deltas: signed rows added batch by batch.

A ledger keeps, per committed batch, what it changed: for each document the signed change of its count, and for each (source, language,
tokenizer) the signed change of documents and tokens. Totals are the sum of the latter over batches; nothing old is
rewritten. A commit writes partitions of its own, named by batch and attempt, and then a marker that names the attempt. Readers see
marked attempts only, so what a lost commit has left is never read, whatever was committed since; once a batch is marked, sending it again does
nothing. Should two attempts of a batch be marked at once, the first by name counts.

A change row is (doc_id, op, source, lang, n_tokens): 'insert' and 'revise' set the document's count, 'delete' removes it.
What a batch writes is new minus old, old being the sum of the document's earlier signed rows.

Defined cases: null source or language is a group of its own; a null doc_id or op is rejected as an error; a document named twice in a batch takes
the row with the largest n_tokens of the last op in the order insert, revise, delete; deleting an unknown document changes nothing; inserting
one again revises it; an empty batch is committed and changes nothing; further columns of a change are ignored. The query names a document
without doc_id by the hash of its source, language and text.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Known, MergeList, encoded, public_path, read_tokenizer
from .common import shared_folder, stored, table

DOCS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, batch string, attempt string"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, batch string, attempt string"
KEYS = ("source", "lang", "tokenizer")


class Ledger:
    """Token counts below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return found

    def committed(self) -> DataFrame:
        """The attempt of each batch that counts."""
        return self._read("marks", "batch string, attempt string").groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def _marked(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.committed(), ["batch", "attempt"], "left_semi")

    def documents(self, tokenizer: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """The count of each document that is there now, or of those in ``of`` (doc_id) only."""
        rows = self._marked("documents", DOCS)
        if tokenizer is not None:
            rows = rows.where(F.col("tokenizer") == tokenizer)
        if of is not None:
            rows = rows.join(of, "doc_id", "left_semi")
        return rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer."""
        return (
            self._marked("totals", TOTALS).groupBy(*KEYS)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.countDistinct("batch").alias("n_batches"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )

    def commit(self, batch: str, tokenizer: str, changes: DataFrame) -> bool:
        """Adds one batch; False if it was there already."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        order = F.when(F.col("op") == "insert", 1).when(F.col("op") == "revise", 2).when(F.col("op") == "delete", 3)
        checked = changes.select(
            "doc_id", "source", "lang",
            F.when(F.col("doc_id").isNotNull() & order.isNotNull(), order).otherwise(F.raise_error(F.lit("a change needs a doc_id and an op"))).alias("turn"),
            F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"),
        )
        last = checked.groupBy("doc_id").agg(F.max(F.struct("turn", "n", "source", "lang")).alias("x")).select("doc_id", "x.*")
        old = self.documents(tokenizer, last.select("doc_id"))
        new = last.where("turn < 3").select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col("n").alias("tokens"))
        minus = old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        signed = stored(
            new.unionByName(minus).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        )
        attempt = uuid.uuid4().hex
        self._put("documents", signed, batch, attempt)
        self._put("totals", signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), batch, attempt)
        self._put("marks", self.spark.range(1).select(F.lit(1).alias("one")), batch, attempt)
        return True

    def _put(self, name: str, rows: DataFrame, batch: str, attempt: str) -> None:
        named = rows.withColumns({"batch": F.lit(batch), "attempt": F.lit(attempt)})
        named.write.mode("append").partitionBy("batch", "attempt").parquet(f"{self.folder}/{name}")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, lang, n_tokens of each row by the tokenizer at ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        merges, known = MergeList(shared.value), (Known(), Known())
        for batch in batches:
            n = [sum(len(ids) for ids in encoded(merges, x.as_py() or "", known)) // 4 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(np.array(n, np.int64))], ["doc_id", "source", "lang", "n_tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The life of the table as four batches, one sent twice: every document comes in with an estimate from its length,
    then with its count, one of every seven is withdrawn, and comes in again."""
    docs = table(spark, folder, "documents")
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("source", "lang", "text")).alias("doc_id"), "source", "lang", "text")
    name = "byte_bpe_50k"
    ledger = Ledger(spark, f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}")
    op = lambda rows, what: rows.withColumn("op", F.lit(what))
    guess = docs.select("doc_id", "source", "lang", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("n_tokens"))
    counted = stored(token_counts(docs, public_path(f"{name}.json")))
    some = counted.where(F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 0)
    ledger.commit("1", name, op(guess, "insert"))
    ledger.commit("2", name, op(counted, "revise"))
    ledger.commit("2", name, op(counted, "revise"))
    ledger.commit("3", name, op(some, "delete"))
    ledger.commit("4", name, op(some, "insert"))
    return ledger.totals()
