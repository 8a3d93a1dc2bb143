"""Trie of conversation prefixes: block digests group conversations, turn boundaries are refined where blocks diverge.

1. A turn is reduced to the first 128 bits of the SHA-256 of role and text; texts travel no further. The turns of a conversation, in order, are
   cut into blocks of ``BLOCK``. Each turn's digest and position give two 64-bit words; a prefix is the XOR of its turns' words. The words of a block
   are its digest, and those of all blocks so far name the prefix that ends with it, so one scan replaces a round per block.
2. Conversations with the same blocks so far are one row with a count and the least conv_id. Copies of any number end here.
3. A prefix that goes on with a single block has no branch inside it: the block's turns are nodes as they are. Where several
   blocks follow, siblings diverge, and their turns are grouped one by one (per distinct block, not per conversation).
4. Sums over subtrees need no walk: the least member of a node owns it, a conversation owns the end of its path, and what it saves is the
   bytes u before that. A node of depth d saves the sum of u over its other members, less the path above d for each; its leaves are those that
   its members own.

Conversations are numbered and scanned over ranges of (conversation, order), so one of any length is spread over tasks.

Defined cases: null role and text are empty; rows with a null conv_id belong to no conversation and are left out; a null turn comes first; rows of the same turn
are ordered by the SHA-256 of role and text; a conversation may have no turns left, and is a member of the root only; an empty table has no
member and gives no rows, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .scans import joined_text, scanned

#: Turns of a block.
BLOCK = 4
#: The rule of the rebuilt conversations (fixed values): FAMILY of them share the first of their least, up to HEAD - 1 turns.
FAMILY, HEAD = 5, 9
NODE = ["depth", "pa", "pb"]


def turn_digest(role: Column, text: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the role's length in bytes, a colon, role and text."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (position from 1), digest and bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    return scanned(rows, "conv_id", ["turn", "digest"], [], []).drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their ids, and their turns (conv_id, at, digest, bytes).

    The first h turns come from the conversation conv_id - conv_id % FAMILY; what lies behind the first h turns stays.
    """
    ids = own.where("at = 1").select(
        "conv_id", F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h")
    )
    heads = own.where(f"at < {HEAD} and conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "base")
    first = heads.join(ids, "base").where("at <= h").select("conv_id", "at", "digest", "bytes")
    had = heads.groupBy("base").agg(F.count("*").alias("n"))
    # Where the base has fewer than h turns, what follows moves up.
    short = ids.join(had, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    rest = own.join(short, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "bytes")
    return ids.select("conv_id"), first.unionByName(rest)


def blocks(path: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: conv_id, k, its turns, the prefix before it (qa, qb), the one that ends with it (pa, pb), path bytes."""
    word = lambda i: F.xxhash64(F.lit(i), "at", "digest")
    cut = path.select("conv_id", F.expr(f"(at - 1) div {size}").alias("k"), "at", word(1).alias("a"), word(2).alias("b"), "bytes")
    formed = cut.groupBy("conv_id", "k").agg(
        F.array_sort(F.collect_list(F.struct("at", "a", "b", "bytes"))).alias("turns"),
        F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("bytes").alias("size"),
    )
    along = scanned(formed.withColumns({"pa": F.col("xa"), "pb": F.col("xb"), "path": F.col("size")}), "conv_id", ["k"], ["pa", "pb"], ["path"])
    return stored(
        along.select(
            "conv_id", "k", "turns", F.col("pa").bitwiseXOR(F.col("xa")).alias("qa"), F.col("pb").bitwiseXOR(F.col("xb")).alias("qb"),
            "pa", "pb", "path", (F.col("path") - F.col("size")).alias("above"),
        )
    )


def _inner(distinct: DataFrame) -> DataFrame:
    """A row per turn of each block: the node, the node above it, its bytes and the bytes of the path above."""
    upto = lambda i, x: F.aggregate(F.slice("turns", 1, i), F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(t[x]))
    summed = lambda i: F.aggregate(F.slice("turns", 1, i), F.lit(0).cast("long"), lambda acc, t: acc + t["bytes"])
    each = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: F.struct(
            F.element_at("turns", i)["at"].alias("depth"),
            F.col("qa").bitwiseXOR(upto(i, "a")).alias("pa"), F.col("qb").bitwiseXOR(upto(i, "b")).alias("pb"),
            F.col("qa").bitwiseXOR(upto(i - 1, "a")).alias("up_a"), F.col("qb").bitwiseXOR(upto(i - 1, "b")).alias("up_b"),
            F.element_at("turns", i)["bytes"].alias("bytes"), (F.col("above") + summed(i - 1)).alias("above"),
        ),
    )
    kept = [c for c in ("n", "least", "u", "leaves") if c in distinct.columns]
    return distinct.select("torn", *kept, F.explode(each).alias("x")).select("torn", *kept, "x.*")


def nodes(records: DataFrame) -> DataFrame:
    """One row per node below the root, from block records with ``u`` and ``leaf`` of their conversation.

    depth, pa, pb, up_a, up_b, bytes, above, n (members), least (the owner and its u), u and leaves (sums over members).
    """
    members = [F.count("*").alias("n"), F.min(F.struct("conv_id", "u")).alias("least"), F.sum("u").alias("u"), F.sum("leaf").alias("leaves")]
    distinct = records.groupBy("k", "qa", "qb", "pa", "pb", F.size("turns").alias("length")).agg(*members, F.first("turns").alias("turns"), F.first("above").alias("above"))
    wide = distinct.groupBy("k", "qa", "qb").agg(F.count("*").alias("follow")).where("follow > 1 and k > 0")
    # The root nearly always branches, and all first blocks hang on it: they are refined without asking.
    torn = distinct.join(wide, ["k", "qa", "qb"], "left").withColumn("torn", (F.col("k") == 0) | F.col("follow").isNotNull())
    inner = _inner(torn)
    same = [F.first(c).alias(c) for c in ("up_a", "up_b", "bytes", "above")]
    refined = inner.where("torn").groupBy(*NODE).agg(*same, F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("u").alias("u"), F.sum("leaves").alias("leaves"))
    return refined.unionByName(inner.where("not torn").drop("torn"))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the comma-joined ids that end at each node; chunks of ids stream by, one after another."""
    chunks = joined_text(ends, NODE, "conv_id")
    laid = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            keys = zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)
            for key, text in zip(keys, batch.column("text"), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            yield rows(done)
        if now is not None:
            yield rows([(*now, state.hexdigest())])

    def rows(done):
        cols = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], [*NODE, "ends_sha256"])

    return laid.mapInArrow(run, "depth long, pa long, pb long, ends_sha256 string")


def trie(ids: DataFrame, path: DataFrame, size: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations ``ids`` with the turns ``path`` (conv_id, at, digest, bytes); see ``op11``."""
    records = blocks(path, size)
    plain = stored(nodes(records.withColumns({"u": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})).select(*NODE, "up_a", "up_b", "above", F.col("least.conv_id").alias("owner")))
    children = plain.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("pa"), F.col("up_b").alias("pb")).agg(F.count("*").alias("n_children"))
    owned = plain.join(children, NODE, "left").groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("above").alias("first_above"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf")
    )
    last = records.groupBy("conv_id").agg(F.max_by(F.struct(F.expr("element_at(turns, -1).at").alias("depth"), "pa", "pb", "path"), "k").alias("end"))
    zero = F.lit(0).cast("long")
    members = stored(
        ids.join(last, "conv_id", "left").join(owned, "conv_id", "left").select(
            "conv_id", *(F.coalesce(f"end.{c}", zero).alias(c) for c in NODE),
            F.coalesce("first_above", "end.path", zero).alias("u"), F.coalesce("leaf", zero).alias("leaf"),
        )
    )
    below = nodes(records.join(members.select("conv_id", "u", "leaf"), "conv_id"))
    root = (
        members.agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "u")).alias("least"), F.sum("u").alias("u"), F.sum("leaf").alias("leaves"))
        .where("n > 0")
        .select(*(zero.alias(c) for c in NODE), F.lit(None).cast("long").alias("up_a"), F.lit(None).cast("long").alias("up_b"), zero.alias("bytes"), zero.alias("above"), "n", "least", "u", "leaves")
    )
    every = below.unionByName(root)
    parents = plain.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("owner").alias("parent"))
    top = root.select(F.lit(1).cast("long").alias("depth"), zero.alias("up_a"), zero.alias("up_b"), F.col("least.conv_id").alias("parent"))
    return (
        every.join(children, NODE, "left")
        .join(parents.unionByName(top), ["depth", "up_a", "up_b"], "left")
        .join(_end_hashes(members.select(*NODE, "conv_id")), NODE, "left")
        .select(
            F.col("least.conv_id").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("n_children", zero).alias("n_children"),
            # A root without children is the only leaf.
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            (F.col("u") - F.col("least.u") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    ids, path = rebuilt(turns(table(spark, folder, "conversations")))
    return trie(ids, path)


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS spot
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
p AS (
  SELECT i.conv_id, 0 AS part, t.spot, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.base WHERE t.spot <= i.h
  UNION ALL SELECT i.conv_id, 1, t.spot, t.role, t.text FROM ids i JOIN t ON t.conv_id = i.conv_id WHERE t.spot > i.h),
w AS (
  SELECT i.conv_id, coalesce(l, []) AS l FROM ids i
  LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, spot) AS l FROM p GROUP BY conv_id) USING (conv_id)),
pre AS (SELECT conv_id, d, list_slice(l, 1, d) AS seq, d = len(l) AS ends FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM w)),
n AS (
  SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ending
  FROM pre GROUP BY d, seq),
c AS (SELECT d - 1 AS d, list_slice(seq, 1, d - 1) AS seq, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * strlen(n.seq[n.d].text) ELSE 0 END AS saved
  FROM n LEFT JOIN c ON c.d = n.d AND c.seq = n.seq),
s AS (
  SELECT g, list_slice(seq, 1, g) AS seq, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS g FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ending, '')) AS ends_sha256
FROM f JOIN s ON s.g = f.d AND s.seq = f.seq LEFT JOIN n p ON p.d = f.d - 1 AND p.seq = list_slice(f.seq, 1, f.d - 1)
"""
