"""Repeated passages by prefix-free parsing: bytes that an earlier document already holds.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller doc_id.

Triggers: in every ``LENGTH``-byte string, the ``KEY``-byte string of least rolling hash (the leftmost of equals) is its
trigger, so equal strings have equal triggers at equal places and no string is without one. Triggers cut a text
into phrases; a phrase here is a trigger with ``LENGTH - KEY`` bytes before and ``LENGTH`` bytes from it on, which
holds every string that has this trigger. The dictionary is the set of distinct phrases with the smallest
document of each; the parse of a text is the list of its phrases.

1. Documents are dealt into batches. A batch parses its texts and sorts its phrases by trigger; a trigger with a single phrase in the
   batch is sent with the phrase's hash and its smallest document, one with several only with their number.
2. Dictionary: per share of the triggers, the batches' sorted lists are merged. A phrase that a smaller document of
   another batch holds answers for all of its strings at once. A trigger with one phrase in all batches
   needs no more. For the others, the batches send each distinct phrase once, as bytes.
3. The suffixes of the dictionary's phrases are ranked by prefix doubling, 8, 16, 32 and ``LENGTH`` bytes long, which is the suffix array as
   far as it matters; suffixes of one rank are equal byte by byte. The smallest document of each rank tells, per phrase and string,
   whether an earlier document than the batch's own first holds it: a mask of a bit per string.
4. The parse takes this back to the corpus: an occurrence of a phrase goes where the mask says so, and as a whole if its document is not the
   phrase's first in the batch. Each batch marks the bytes and cuts.

Two phrases count as equal without their bytes only if the 64-bit hashes of trigger and of phrase both agree.

Lists travel as packed sorted arrays, at most one entry for a phrase and batch, so a hot one has an entry per batch and not
per row. A trigger with more than ``HOT`` phrases sends their strings instead, dealt by the strings' own hashes. Texts are shuffled once.

Defined cases: null text is empty; a null doc_id takes no part, nothing of it goes; rows with equal doc_id are no smaller than one
another; a text shorter than ``LENGTH`` stays whole; columns to be carried are named, others are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, given_back, mixed, table, text_bytes

#: Bytes of a repeated string (the contract's), and of a trigger.
LENGTH = 50
KEY = 20
#: Bytes of text of a batch, and of the texts whose triggers make one share.
BATCH = 8 << 20
SHARE = 8 << 20
#: Bytes looked at together; positions within must fit the low bits below.
PIECE = 1 << 20
LOW = np.uint64(PIECE - 1)
#: Phrases of a trigger that are ranked together, and bytes of phrases ranked in one go.
HOT = 1 << 14
RANKED = 1 << 20
#: Strings of a phrase at most.
STRINGS = LENGTH - KEY + 1
#: Odd base of the rolling hash (a fixed value).
BASE = 0x9E3779B97F4A7C15

NONE = np.iinfo(np.int64).max


#: More than the bytes hashed in one go.
REACH = PIECE + 4 * LENGTH


@functools.cache
def _powers() -> np.ndarray:
    out = np.full(REACH + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any ranges of one piece of bytes, from hashes of its prefixes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers()[: len(data)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A range's powers begin with its place; it is raised to the same power as all others."""
        return (self.sums[last] - self.sums[first]) * _powers()[REACH - first]

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * _powers()[REACH - n + 1 :][::-1]


class Parse:
    """The triggers of a batch of texts: row, first and last string they stand for, where the phrase begins and ends, key and phrase hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        parts = []
        # Rows are parsed together as far as they fit one piece.
        row, n = 0, len(offsets) - 1
        while row < n:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
            parts += self._run(row, last)
            row = last
        join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        self.row, self.first, self.last = join(0, np.int64), join(1, np.int64), join(2, np.int64)
        self.left, self.right = join(3, np.int64), join(4, np.int64)
        self.key, self.phrase = join(5, np.uint64), join(6, np.uint64)

    def _run(self, row: int, last: int) -> list:
        """Strings are named by their place in the batch's bytes."""
        begin, end = int(self.offsets[row]), int(self.offsets[last])
        if end - begin <= PIECE:
            return self._block(row, last, begin, end)
        out = []
        at = begin
        while end - at >= LENGTH:
            stop = min(end, at + PIECE)
            out += self._block(row, last, at, stop)
            at = stop - LENGTH + 1
        return out

    def _block(self, row: int, last: int, begin: int, end: int) -> list:
        # The bytes around take part in phrases, as a text may be cut into blocks.
        lo = max(int(self.offsets[row]), begin - LENGTH)
        hi = min(int(self.offsets[last]), end + LENGTH)
        if end - begin < LENGTH:
            return []
        roll = Rolling(self.data[lo:hi])
        keys = mixed(roll.all(KEY)[begin - lo : end - lo - KEY + 1])
        value = (keys & ~LOW) | np.arange(len(keys), dtype=np.uint64)
        width, span = LENGTH - KEY + 1, 1
        while span * 2 <= width:
            value = np.minimum(value[:-span], value[span:])
            span *= 2
        if width > span:
            value = np.minimum(value[: len(value) - (width - span)], value[width - span :])
        spot = (value & LOW).astype(np.int64)
        # Which row each string starts in, and whether it ends there as well.
        bounds = np.clip(self.offsets[row : last + 1] - begin, 0, len(spot) + LENGTH)
        inside = np.zeros(len(spot) + 1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= LENGTH:
                inside[a] += 1
                inside[b - LENGTH + 1 if b - LENGTH + 1 <= len(spot) else len(spot)] -= 1
        valid = np.cumsum(inside[:-1]) > 0
        where = np.flatnonzero(valid)
        if not len(where):
            return []
        new = np.ones(len(where), bool)
        new[1:] = (spot[where][1:] != spot[where][:-1]) | (np.diff(where) != 1)
        head = np.flatnonzero(new)
        first, final = where[head], where[np.append(head[1:], len(where)) - 1]
        trigger = spot[first]
        rows = np.searchsorted(self.offsets[row : last + 1], first + begin, "right") - 1 + row
        left = np.maximum(trigger + begin - (LENGTH - KEY), self.offsets[rows])
        right = np.minimum(trigger + begin + LENGTH, self.offsets[rows + 1])
        phrase = roll(left - lo, right - lo)
        phrase = mixed(phrase + (trigger + begin - left).astype(np.uint64) * np.uint64(BASE) + (right - left).astype(np.uint64))
        return [(rows, first + begin, final + begin, left, right, keys[trigger], phrase)]


def _first_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by the last of ``keys`` first, and where runs of equal (all but the first) begin in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys[1:]:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def by_share(shares: np.ndarray):
    """(share, positions) of each share, positions in rising order."""
    order = np.argsort(shares, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(shares[order]) != 0]) if len(order) else []
    for a, b in zip(starts, np.append(starts[1:], len(order)).astype(int) if len(order) else [], strict=True):
        yield int(shares[order[a]]), order[a:b]


class Batch:
    """One batch: what it sends at each step depends on its texts alone, so it is computed anew where needed."""

    def __init__(self, group: pa.Table, shares: int):
        self.ids = group.column("doc_id").to_numpy()
        self.parse = Parse(*byte_view(group.column("text")))
        self.shares = np.uint64(shares)
        p = self.parse
        self.doc = self.ids[p.row] if len(p.row) else np.zeros(0, np.int64)
        # By trigger, then phrase, then document. A head is the first of a phrase, an entry the first of a trigger.
        order, heads = _first_of([self.doc, p.phrase, p.key])
        self.sample = order[heads]
        self.head_of = np.empty(len(order), np.int64)
        self.head_of[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        self.head_least = self.doc[self.sample]
        key = p.key[self.sample]
        new = np.ones(len(heads), bool)
        new[1:] = key[1:] != key[:-1]
        entry = np.flatnonzero(new)
        self.count = np.diff(np.append(entry, len(heads)))
        self.entry_of = np.repeat(np.arange(len(entry)), self.count)
        self.key = key[entry]
        single = self.count == 1
        self.phrase = np.where(single, p.phrase[self.sample[entry]], np.uint64(0))
        self.least = np.where(single, self.head_least[entry], NONE)

    def sent(self):
        for s, which in by_share((self.key % self.shares).astype(np.int64)):
            yield s, pack(self.key[which], self.phrase[which], self.least[which], self.count[which])

    def answered(self, answers: dict[int, bytes]) -> None:
        """Takes the dictionary's answers: which phrases go wholly, and which are sent as bytes."""
        gone, more, hot = np.zeros(len(self.key), bool), self.count > 1, np.zeros(len(self.key), bool)
        for s, which in by_share((self.key % self.shares).astype(np.int64)):
            if s in answers:
                held, listed, many = unpack(answers[s])
                gone[which] = held
                more[which] |= listed
                hot[which] = many
        self.gone = gone[self.entry_of]
        p = self.parse
        plain = np.flatnonzero((more & ~gone & ~hot)[self.entry_of])
        at = self.sample[plain]
        self.r_head, self.r_shift = plain, np.zeros(len(plain), np.int64)
        self.r_left, self.r_size, self.r_key = p.left[at], p.right[at] - p.left[at], p.key[at]
        spread = np.flatnonzero((more & ~gone & hot)[self.entry_of])
        if len(spread):
            at = self.sample[spread]
            n = p.right[at] - p.left[at] - LENGTH + 1
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            left = np.repeat(p.left[at], n) + shift
            self.r_head, self.r_shift = np.append(self.r_head, np.repeat(spread, n)), np.append(self.r_shift, shift)
            self.r_left, self.r_size = np.append(self.r_left, left), np.append(self.r_size, np.full(len(left), LENGTH))
            self.r_key = np.append(self.r_key, self._hashes(left))

    def _hashes(self, left: np.ndarray) -> np.ndarray:
        """Hashes of the strings that begin at ``left``."""
        out = np.empty(len(left), np.uint64)
        order = np.argsort(left, kind="stable")
        at = 0
        while at < len(order):
            upto = int(np.searchsorted(left[order], left[order[at]] + PIECE, "left"))
            some = left[order[at:upto]]
            lo = int(some[0])
            roll = Rolling(self.parse.data[lo : int(some[-1]) + LENGTH])
            out[order[at:upto]] = mixed(roll(some - lo, some - lo + LENGTH))
            at = upto
        return out

    def phrases_sent(self):
        """By share the phrases as bytes, with the smallest document of each."""
        data = self.parse.data
        for s, which in by_share((self.r_key % self.shares).astype(np.int64)):
            size = self.r_size[which]
            place = np.repeat(self.r_left[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            yield s, pack(self.r_key[which], self.head_least[self.r_head[which]], size), data[place].tobytes()

    def marks(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each byte of the batch whether it goes."""
        p = self.parse
        mask = np.zeros(len(self.sample), np.uint64)
        for s, which in by_share((self.r_key % self.shares).astype(np.int64)):
            if s in answers:
                (bits,) = unpack(answers[s])
                np.bitwise_or.at(mask, self.r_head[which], bits << self.r_shift[which].astype(np.uint64))
        edge = np.zeros(len(p.data) + 1, np.int32)
        whole = self.gone[self.head_of] | (self.doc > self.head_least[self.head_of])
        np.add.at(edge, p.first[whole], 1)
        np.add.at(edge, p.last[whole] + LENGTH, -1)
        rest = np.flatnonzero(~whole & (mask[self.head_of] > 0))
        bits, left, first, last = mask[self.head_of[rest]], p.left[rest], p.first[rest], p.last[rest]
        for b in range(STRINGS):
            place = left + b
            place = place[(bits >> np.uint64(b) & np.uint64(1) > 0) & (place >= first) & (place <= last)]
            np.add.at(edge, place, 1)
            np.add.at(edge, place + LENGTH, -1)
        return np.cumsum(edge[:-1]) > 0


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of each suffix by its first ``LENGTH`` bytes; what lies beyond the end counts as zero bytes.

    Words of 8 bytes are ranked, then pairs of ranks, so equal ranks mean equal bytes.
    """
    ranks = np.concatenate([data, np.zeros(LENGTH, np.uint8)]).astype(np.uint64)
    for span in (1, 2, 4):
        ranks = (ranks[: len(ranks) - span] << np.uint64(8 * span)) | ranks[span:]
    span = 8
    _, ranks = np.unique(ranks, return_inverse=True)
    while True:
        step = min(span, LENGTH - span)
        pairs = (ranks[: len(ranks) - step].astype(np.uint64) << np.uint64(32)) | ranks[step:].astype(np.uint64)
        _, ranks = np.unique(pairs, return_inverse=True)
        span += step
        if span == LENGTH:
            return ranks[: len(data)]


def string_masks(data: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each phrase a mask of its strings: those that a document smaller than the phrase's own holds."""
    starts = np.cumsum(sizes) - sizes
    # Equal phrases are ranked once.
    rows = np.zeros((len(sizes), 2 * LENGTH), np.uint8)
    at = np.repeat(np.arange(len(sizes)), sizes)
    rows[at, np.arange(len(data)) - starts[at]] = data
    rows[:, -1] = sizes
    _, sample, which = np.unique(rows.view(f"S{2 * LENGTH}").ravel(), return_index=True, return_inverse=True)
    low = np.full(len(sample), NONE)
    np.minimum.at(low, which, least)
    size = sizes[sample]
    place = np.repeat(starts[sample] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ranks = suffix_ranks(data[place])
    begin, out = np.cumsum(size) - size, np.zeros(len(sizes), np.uint64)
    smallest = np.full(int(ranks.max(initial=-1)) + 1, NONE)
    for b in range(STRINGS):
        held = np.flatnonzero(size >= LENGTH + b)
        np.minimum.at(smallest, ranks[begin[held] + b], low[held])
    for b in range(STRINGS):
        held = np.flatnonzero(size >= LENGTH + b)
        own = np.full(len(sample), NONE)
        own[held] = smallest[ranks[begin[held] + b]]
        out |= (own[which] < least).astype(np.uint64) << np.uint64(b)
    return out


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers place by place: in a sorted list the high places hardly change, so they compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(payload: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(payload, np.uint8, size * n, at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), at + size * n


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length: the length, then each column's type and values."""
    out = [np.int64(len(columns[0])).tobytes(), np.int64(len(columns)).tobytes()]
    for c in columns:
        if c.dtype == bool:
            out += [b"?", np.packbits(c).tobytes()]
        elif c.dtype == np.int64:
            # Documents of a batch are few: their places in a sorted list.
            values, at = np.unique(c, return_inverse=True)
            kind = b"H" if len(values) < 1 << 16 else b"I"
            out += [kind, np.int64(len(values)).tobytes(), _planes(values), _planes(at.astype(kind.decode()))]
        else:
            out += [b"Q", _planes(c)]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    at, out = 16, []
    for _ in range(k):
        kind, at = payload[at : at + 1].decode(), at + 1
        if kind == "?":
            out.append(np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        elif kind == "Q":
            column, at = _numbers(payload, "Q", n, at)
            out.append(column)
        else:
            values, at = _numbers(payload, "q", int(np.frombuffer(payload, np.int64, 1, at)[0]), at + 8)
            place, at = _numbers(payload, kind, n, at)
            out.append(values[place])
    return out


def _joined(group: pa.Table, kinds: list) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """The batches' lists one after the other, with the batch of each entry."""
    batches = group.column("batch").to_pylist()
    lists = [unpack(x.as_py()) for x in group.column("payload")]
    origin = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
    return batches, origin, [np.concatenate([x[i] for x in lists]) if lists else np.zeros(0, k) for i, k in enumerate(kinds)]


ANSWERS = "batch int, step int, share int, payload binary"


def _answers(step: int, share: int, batches: list[int], origin: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """To each batch its entries' answers, in its own order; a batch that need not know anything gets none."""
    rows = []
    ends = np.searchsorted(origin, np.arange(len(batches) + 1))
    for i, b in enumerate(batches):
        part = [c[ends[i] : ends[i + 1]] for c in columns]
        if any(c.any() for c in part):
            rows.append((b, step, share, pack(*part)))
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["batch", "step", "share", "payload"])


def _dictionary(group: pa.Table, hot: int) -> pa.Table:
    """Merges the batches' triggers of one share."""
    batches, origin, (key, phrase, least, count) = _joined(group, [np.uint64, np.uint64, np.int64, np.int64])
    order, heads = _first_of([least, phrase, key])
    run = np.empty(len(order), np.int64)
    run[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    smallest = least[order][heads]
    # Of a trigger: the distinct phrases that came alone, and those of batches with several, which may be equal.
    _, of_key = np.unique(key, return_inverse=True)
    n = of_key.max(initial=-1) + 1
    alone = np.bincount(of_key[order[heads]], weights=count[order[heads]] == 1, minlength=n)
    several = np.bincount(of_key, weights=np.where(count > 1, count, 0), minlength=n)
    held = (count == 1) & (smallest[run] < least)
    many = (alone + several > 1)[of_key] & ~held
    return _answers(1, group.column("share")[0].as_py(), batches, origin, held, many, (alone + several > hot)[of_key] & many)


def _ranked(group: pa.Table) -> pa.Table:
    """Ranks the suffixes of one share's phrases, some triggers at a time."""
    batches, origin, (key, least, size) = _joined(group, [np.uint64, np.int64, np.int64])
    blob = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("blob")])
    begin = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    upto = np.cumsum(size[order])
    masks, a = np.zeros(len(key), np.uint64), 0
    ends = np.append(new[1:], len(order))
    while a < len(order):
        # Whole triggers up to the limit, at least one.
        reach = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + RANKED, "right"))
        b = int(ends[max(np.searchsorted(ends, reach, "right") - 1, np.searchsorted(ends, a, "right"))])
        some = order[a:b]
        n = size[some]
        place = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        masks[some] = string_masks(blob[place], n, least[some])
        a = b
    return _answers(2, group.column("share")[0].as_py(), batches, origin, masks)


SENT = "share int, batch int, payload binary, blob binary"
SENT_ARROW = pa.schema([("share", pa.int32()), ("batch", pa.int32()), ("payload", pa.binary()), ("blob", pa.binary())])


def _rows(batch: int, sent) -> pa.Table:
    rows = [(s, batch, payload, blob[0] if blob else None) for s, payload, *blob in sent]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, SENT_ARROW.types, strict=True)], schema=SENT_ARROW)


def _by_step(answers: pa.Table, step: int) -> dict[int, bytes]:
    return {s: p for t, s, p in zip(*(answers.column(x).to_pylist() for x in ("step", "share", "payload")), strict=True) if t == step}


def repeated_passages(docs: DataFrame, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """doc_id, the columns ``carry``, n_bytes, spans (begin, end of what goes), kept (the bytes left)."""
    taken = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    size = text_bytes(taken)
    batches, shares = math.ceil(size / BATCH) or 1, math.ceil(size / SHARE) or 1
    known = taken.where("doc_id is not null").withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    dealt = known.repartition(batches, "batch")

    def send(group: pa.Table) -> pa.Table:
        return _rows(group.column("batch")[0].as_py(), Batch(group, shares).sent())

    def list_phrases(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return SENT_ARROW.empty_table()
        one = Batch(group, shares)
        one.answered(_by_step(answers, 1))
        return _rows(group.column("batch")[0].as_py(), one.phrases_sent())

    carried = [docs.schema[c] for c in carry]
    out = "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    schema = T.StructType([*T.StructType.fromDDL(out), *carried])
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = byte_view(group.column("text"))
        one = Batch(group, shares)
        one.answered(_by_step(answers, 1))
        return _cut(group, data, offsets, one.marks(_by_step(answers, 2)))

    def _cut(group: pa.Table, data, offsets, goes) -> pa.Table:
        spans, kept = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            row = goes[a:b]
            turn = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
            spans.append([{"begin": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
            kept.append(data[a:b][~row].tobytes() if len(turn) else data[a:b].tobytes())
        return pa.table(
            [group.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, span_type), pa.array(kept, pa.binary()), *[group.column(c) for c in carry]],
            names=["doc_id", "n_bytes", "spans", "kept", *carry],
        )

    first = dealt.groupBy("batch").applyInArrow(lambda g: given_back(send(g)), SENT).groupBy("share").applyInArrow(lambda g: given_back(_dictionary(g, hot)), ANSWERS)
    second = (
        dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(lambda g, a: given_back(list_phrases(g, a)), SENT).groupBy("share").applyInArrow(lambda g: given_back(_ranked(g)), ANSWERS)
    )
    done = dealt.groupBy("batch").cogroup(first.unionAll(second).groupBy("batch")).applyInArrow(lambda g, a: given_back(cut(g, a)) if g.num_rows else _cut(g, *byte_view(g.column("text")), np.zeros(0, bool)), schema)
    unnamed = taken.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<begin: long, end: long>>").alias("spans"), F.col("text").cast("binary").alias("kept"), *carry,
    )
    return done.unionByName(unnamed)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with the columns of ``docs``; a character cut in two goes as a whole.

    A document of which nothing is left stays as an empty text.
    """
    # The row travels as one column, so its names clash with none of the operator's.
    others = [c for c in docs.columns if c != "text"]
    cut = repeated_passages(docs.select("doc_id", "text", F.struct(*others).alias("_row")), ("_row",))
    left = F.col("kept").cast("string")
    whole = F.coalesce(F.try_validate_utf8(left), F.replace(F.make_valid_utf8(left), F.lit("�"), F.lit("")))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return cut.select(whole.alias("_text"), "_row").select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeated_passages(table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
