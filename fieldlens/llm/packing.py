"""Packing by lexical retrieval: windows filled with the neighbours of a seed document.

Documents are dealt into shards by a hash, of about ``SHARD`` tokens each. A shard is an inverted index with BM25 weights; the
number of documents that hold a term is counted over all documents, and terms are tokens, so that count has at most as
many rows as the vocabulary. In a shard, the first unused document seeds a window, the index
returns unused neighbours by score (ties: in order of the shard), and they fill the window one after another. The one that no
longer fits is cut; its rest seeds the next window. A term in more than half of all documents weighs nothing.

Whole windows of a long document stand alone; its rest is packed. What is left of a shard goes into sequences whose lengths
are powers of two, so nothing is padded.

Defined cases: null text is empty and has the end token only; a null doc_id is a document like others; repeated rows are
packed each; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import public_path, read_tokenizer
from .common import byte_view, given_back, lean, slices, stored, table

WINDOW = 4096
#: Tokens of a shard.
SHARD = 1 << 21
#: Shards dealt to a partition, about.
TOGETHER = 4
#: Bytes of text tokenized together.
SLICE = 1 << 22
#: ASCII white space as blanks.
BLANKED = np.arange(256, dtype=np.uint8)
BLANKED[9:14] = 32
#: The end token of a document (the contract's).
END = 2
K1, B = 1.2, 0.75
#: Pieces of text between white space that are kept with their ids.
KEPT = 1 << 18


#: The pre-tokenizer's pattern (a fixed value of the vocabulary file) under which letters, digits and signs never join.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Small letters that are one word wherever they stand together, whatever the Unicode version: Latin ones.
LETTERS = re.compile("[a-zÀ-ÖØ-öø-įı-ſ]+")
#: Kinds of bytes: ASCII letters and digits, ASCII signs without the apostrophe, others.
KIND = np.zeros(256, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[[x for x in range(33, 127) if not KIND[x] and x != 39]] = 2
#: Words given to the tokenizer as one text.
JOINED = 256


class Chunks:
    """Ids of texts by a tokenizer that never joins what white space parts.

    Texts are cut at ASCII white space as whole Arrow columns, each distinct chunk of a column is looked up once, and ids are gathered
    by place. Two generations of bounded size are kept; new chunks go to the tokenizer together.

    If the vocabulary file says that texts are lower-cased and cut by the pattern ``WORDS``, chunks are smaller and fewer: ASCII letters are
    lower-cased, and signs are parted from letters and digits. New chunks of letters are then joined to texts, as the marks of a word's end tell
    their ids apart. Where a text may hold a special token nothing is changed.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new, self.old = {"": b""}, {}
        spec = json.loads(tokenizer_json)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if steps == known and cuts[0].get("pattern") == {"Regex": WORDS} and suffix and not any(x["normalized"] for x in spec["added_tokens"]):
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            # Words of LETTERS are composed and no sign parts them: lower-cased, the same model needs neither normalizer nor pattern for them.
            parted = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
            plain = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"] | {"pretokenizers": [parted, *cuts[1:]]}}
            self.plain = Tokenizer.from_str(json.dumps(plain))
            self.plain.no_truncation()
            self.plain.no_padding()
        self.special = sorted({x["content"][:2].encode() for x in spec["added_tokens"]})

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        own, alone = {}, chunks
        if self.ends is not None:
            words = [c for c in chunks if LETTERS.fullmatch(c)]
            alone = [c for c in chunks if not LETTERS.fullmatch(c)]
            groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
            for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                last = np.flatnonzero(self.ends[ids]) + 1
                if len(last) == len(group) and last[-1] == len(ids):
                    raw, cut = ids.tobytes(), (4 * np.r_[0, last]).tolist()
                    own.update((c, raw[a:b]) for c, a, b in zip(group, cut[:-1], cut[1:], strict=True))
                else:
                    alone += group
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        own.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(alone, found, strict=True))
        return own

    def _looked_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.new.get, chunks))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        if lacking:
            own = self._encoded([chunks[i] for i in lacking if chunks[i] not in self.old])
            before = self.old
            if len(self.new) > KEPT:
                self.old, self.new = self.new, {"": b""}
            for i in lacking:
                c = chunks[i]
                found[i] = self.new[c] = own[c] if c in own else before[c]
        return found

    def _parted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ASCII lower-cased, with a blank between signs and letters or digits of a text."""
        kind = KIND[data]
        cut = np.flatnonzero((kind[1:] | kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        # A cut where a text begins falls to the text before, as a blank at its end.
        return np.insert(data, cut, np.uint8(32)), offsets + np.searchsorted(cut, offsets, "right")

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as bytes and offsets, one after the other, and how many each text has."""
        data = BLANKED[data]
        raw = data.tobytes() if self.ends is not None else b""
        if self.ends is not None and not any(x in raw for x in self.special):
            data, offsets = self._parted(data, offsets)
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(lists.values)
        held = self._looked_up(coded.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in held], np.int64)
        every = np.frombuffer(b"".join(held), "<u4")
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        starts = np.cumsum(sizes) - sizes
        # Half as wide where places fit.
        wide = np.int32 if max(len(every), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        ids = every[np.repeat((starts[at] - (ends - n)).astype(wide), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=wide)]
        return ids, np.diff(np.r_[0, ends][lists.offsets.to_numpy()])


@functools.lru_cache(maxsize=1)
def chunks_of(tokenizer_json: str) -> Chunks:
    """The tokenizer of a file with the chunks known so far, kept by a worker from task to task."""
    return Chunks(tokenizer_json)


def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id of the tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(read_tokenizer(path)).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end: int = END, kind: str = "<u4") -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned integers of type ``kind``, the end token last)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = chunks_of(shared.value)
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                ids, counts = chunks(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end, kind)
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                bounds = (np.r_[0, ends] * out.itemsize).astype(np.int32)
                packed_ids = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(counts + 1), packed_ids], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids binary")


def document_counts(tokens: DataFrame, kind: str = "<u4") -> tuple[int, np.ndarray]:
    """The number of documents, and for each token how many hold it."""

    def run(batches):
        counts, n = np.zeros(1, np.int64), 0
        for batch in batches:
            for ids in batch.column("ids"):
                own = np.unique(np.frombuffer(ids.as_buffer(), kind))
                if own[-1] >= len(counts):
                    counts = np.pad(counts, (0, int(own[-1]) + 1 - len(counts)))
                counts[own] += 1
                n += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], ["token", "n"])

    rows = tokens.select("ids").mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = rows.column("token").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    out[token[token >= 0]] = n[token >= 0]
    return int(n[token < 0].sum()), out


class Index:
    """BM25 weights of a shard's documents by term, and of terms by document."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray):
        sizes = np.array([len(d) for d in docs])
        ids = np.concatenate(docs).astype(np.int64)
        own = np.repeat(np.arange(len(docs)), sizes)
        real = idf[ids] > 0
        pair, tf = np.unique(ids[real] * len(docs) + own[real], return_counts=True)
        self.term, self.doc = pair // len(docs), (pair % len(docs)).astype(np.int32)
        size = sizes / max(1.0, sizes.mean())
        self.weight = (idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc]))).astype(np.float32)
        terms, first = np.unique(self.term, return_index=True)
        self.first = np.append(first, len(pair))
        at = np.searchsorted(terms, self.term)
        order = np.argsort(self.doc, kind="stable")
        self.terms_of = at[order]
        self.doc_first = np.searchsorted(self.doc[order], np.arange(len(docs) + 1))
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms_of[self.doc_first[seed] : self.doc_first[seed + 1]]
        lo, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        if not len(terms):
            return np.zeros(self.n, np.float32)
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, first token, tokens). Every token is in one piece."""
    out: list[list[tuple[int, int, int]]] = []
    at = np.zeros(len(docs), np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    for i, d in enumerate(docs):
        while size[i] - at[i] >= window:
            out.append([(i, int(at[i]), window)])
            at[i] += window
        docs[i] = d[at[i] :]
    start = at.copy()
    left = size - at
    open_ = np.flatnonzero(left > 0)
    if not len(open_):
        return out
    index = Index(docs, idf)
    unused = left > 0
    seed, cursor, now, room = -1, 0, [], window
    while True:
        if seed < 0:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            seed = cursor
        unused[seed] = False
        now, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        rest = -1
        if room and unused.any():
            score = index.scores(seed)
            free = np.flatnonzero(unused)
            # The best few first; all of them only if the best few don't fill the window.
            some = min(len(free), 64)
            while room:
                best = free if some == len(free) else free[np.argpartition(-score[free], some - 1)[:some]]
                best = best[np.lexsort((best, -score[best]))]
                for i in best:
                    if not unused[i]:
                        continue
                    unused[i] = False
                    n = min(room, int(left[i]))
                    now.append((int(i), int(start[i]), n))
                    room -= n
                    if n < left[i]:
                        start[i] += n
                        left[i] -= n
                        rest = int(i)
                    if not room:
                        break
                if some == len(free):
                    break
                some = min(len(free), some * 16)
        seed = rest
        if not room:
            out.append(now)
            now = []
        elif rest < 0 and not unused.any():
            break
    # The last, unfilled sequence is cut at powers of two.
    total = window - room if now else 0
    bounds = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    for length in bounds:
        part = []
        while length:
            i, first, n = now.pop(0)
            take = min(n, length)
            part.append((i, first, take))
            length -= take
            if take < n:
                now.insert(0, (i, first + take, n - take))
        out.append(part)
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD, end: int = END) -> DataFrame:
    """One row per piece with its ids; a sequence's id is its shard times 2^32 plus its place there."""
    kind = id_type(path)
    tokens = stored(tokenized(docs, path, end, kind))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = math.ceil(total / shard) or 1
    n, counts = document_counts(tokens, kind)
    idf = np.zeros(max(len(counts), 1), np.float32)
    held = counts > 0
    idf[held] = np.maximum(0, np.log((n - counts[held] + 0.5) / (counts[held] + 0.5)))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        raw = [np.frombuffer(x.as_py(), kind) for x in group.column("ids")]
        rows = [(i, first, k, s, o) for s, seq in enumerate(fill(list(raw), shared.value, window)) for (i, first, k), o in zip(seq, np.cumsum([0] + [p[2] for p in seq]).tolist(), strict=False)]
        i, first, k, s, o = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        base = group.column("shard")[0].as_py() << 32
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(i)), "start": first, "length": k,
            "ids": pa.array([raw[a][b : b + c].astype("<u4").tobytes() for a, b, c in zip(i, first, k, strict=True)], pa.binary()),
            "doc_tokens": group.column("n_tokens").take(pa.array(i)), "sequence_id": s + base, "offset": o,
        })

    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)))
    # A task packs some shards one after the other, whatever the session's partitions are.
    return dealt.repartition(math.ceil(shards / TOGETHER), "shard").groupBy("shard").applyInArrow(lambda g: given_back(pack(g)), PIECES)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return digests(packed(table(spark, folder, "documents"), public_path("word_bpe_49k.json")))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
