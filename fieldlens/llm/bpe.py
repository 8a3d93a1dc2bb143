"""Byte-pair encoding as a streaming transducer, and decoding as an incremental state machine.

The merge list fixes how far bytes yet to come can change what is already merged. Let p be a place between
two bytes whose fate differs between two continuations of a text, and m the rule that removes it in one of them, with left part
u and right part v. Rules apply in order, so whatever made the difference came from an earlier rule: either v reaches the
unknown bytes; or v ends where another rule k < m, whose left part is an end of v, takes that end away; or a place inside v
differs itself. So the distance D of rule m obeys

    D[m] = max(|v|, |v| + D[k] for those k, offset in v + D of the rules that built v)

and the largest D is the lookahead: a token whose end lies that far behind the last byte known is stable. The
transducer holds a window of a few lookaheads of the current run of characters, whatever the length of the text.

Words are separated by the tokenizer's own pattern before merging; short pieces between white space repeat, so their ids are kept
in a table of bounded size.

Defined cases: null text is empty; special tokens written out in a text become their ids, as the tokenizer does it; repeated
rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: White space as the tokenizer sees it, and its pattern of words (fixed values).
WS = "\t-\r\x20\x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: The characters that a run may go on with, by kind.
RUNS = {k: regex.compile(v) for k, v in {"letter": r"\p{L}*", "number": r"\p{N}*", "space": f"[{WS}]*", "other": rf"[^{WS}\p{{L}}\p{{N}}]*"}.items()}
#: White space and the characters after it: no word goes on past its end.
UNIT = re.compile(f"[{WS}]*[^{WS}]+")
#: Pieces of text kept with their ids, how long they may be, and how much text is fed at a time.
KEPT, KEPT_CHARS, FED = 1 << 18, 48, 1 << 16
NO_RULE = 1 << 60


class Known:
    """Ids by piece of text: two generations of bounded size, of which the older goes when the younger is full."""

    def __init__(self, size: int = KEPT):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        return self.new.get(key) or self.old.get(key)

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeList:
    """A tokenizer's vocabulary and rules as bytes, with its lookahead."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer and prefix blank is covered")
        letters = _byte_letters()
        plain = lambda token: bytes(letters[c] for c in token)
        self.ids = {plain(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.special = {}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("only plain special tokens are covered")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        rules = [tuple(map(plain, r if isinstance(r, list) else r.split(" "))) for r in model["merges"]]
        self.rank = {r: i for i, r in enumerate(rules)}
        self.lookahead = self._lookahead(rules)
        self._number()
        self.window = 4 * self.lookahead + 1024
        self.find_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @staticmethod
    def _lookahead(rules: list[tuple[bytes, bytes]]) -> int:
        inner = {bytes([b]): 0 for b in range(256)}  # of a token: the largest offset + D of the rules that built it
        by_left: dict[bytes, int] = {}
        most = 1
        for u, v in rules:
            if u not in inner or v not in inner:
                raise ValueError("a rule uses a token that no earlier rule makes")
            d = max(len(v), inner[v], *(len(v) + by_left.get(v[i:], 0) for i in range(len(v))))
            by_left[u] = max(by_left.get(u, 0), d)
            inner[u + v] = max(inner.get(u + v, 0), inner[u], len(u) + d, len(u) + inner[v])
            most = max(most, d)
        return most

    def _number(self) -> None:
        """The rules by ids: of two tokens, of two bytes, and the id that each rule makes."""
        self.first = [self.ids.get(bytes([b]), -1 - b) for b in range(256)]
        self.made = {i: self.ids[u + v] for (u, v), i in self.rank.items()}
        self.pairs = {(self.ids[u], self.ids[v]): i for (u, v), i in self.rank.items()}
        self.rows = [[self.pairs.get((a, b), NO_RULE) for b in self.first] for a in self.first]
        self.packed_of = {i: i.to_bytes(4, "little") for i in self.ids.values()}.__getitem__

    def short(self, data: bytes) -> bytes:
        """The packed ids of one short word; the same as those of `merged`."""
        parts, rows, made, get, none = [self.first[b] for b in data], self.rows, self.made, self.pairs.get, NO_RULE
        ranks = [rows[a][b] for a, b in zip(data, data[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] = new = made[best]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get((new, parts[at + 1]), none)
            if at:
                ranks[at - 1] = get((parts[at - 1], new), none)
        return b"".join(map(self.packed_of, parts))

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of one word: always the earliest rule, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 60:
            return self._merged_long(parts)
        get, none = self.rank.get, NO_RULE
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
        return parts

    def _merged_long(self, parts: list[bytes]) -> list[bytes]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        alive: list = list(parts)
        while heap:
            _, i, (u, v) = heapq.heappop(heap)
            j = after[i]
            if alive[i] != u or j >= n or alive[j] != v:
                continue
            alive[i], alive[j] = u + v, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := (alive[a], alive[b])) in rank:
                    heapq.heappush(heap, (rank[pair], a, pair))
        return [x for x in alive if x is not None]


class Encoder:
    """Ids of a text that comes in pieces; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: MergeList, known: tuple[Known, Known] | None = None):
        self.m = merges
        self.units, self.words = known or (Known(), Known())
        self.packed = merges.packed
        self.text, self.run, self.tail = "", None, bytearray()

    def feed(self, text: str) -> bytes:
        self.text += text
        return self._drain(False)

    def finish(self) -> bytes:
        return self._drain(True)

    def _drain(self, end: bool) -> bytes:
        out: list[bytes] = []
        if self.m.find_special is not None:
            while found := self.m.find_special.search(self.text):
                self._plain(self.text[: found.start()], True, out)
                out.append(self.m.special[found[0]].to_bytes(4, "little"))
                self.text = self.text[found.end() :]
        # A special token may have begun.
        held = 0 if end else max((n for s in self.m.special for n in range(1, len(s)) if self.text.endswith(s[:n])), default=0)
        ready = len(self.text) - held
        self.text = self._plain(self.text[:ready], end, out) + self.text[ready:]
        return b"".join(out)

    def _plain(self, text: str, end: bool, out: list[bytes]) -> str:
        """Encodes what is settled of ``text``, and all if it ends here; returns the rest."""
        at = 0
        if self.run is not None:
            at = RUNS[self.run].match(text).end()
            if self.run == "space" and at and not (end and at == len(text)):
                at -= 1  # the last blank may belong to what follows
            self.tail += text[:at].encode()
            if not end and at + (self.run == "space") >= len(text):
                self._window(out)
                return text[at:]
            self._window(out)
            self._word(bytes(self.tail), out)
            self.run, self.tail = None, bytearray()
        units = UNIT.findall(text, at)
        if not end and units:
            last = units.pop()
            rest = text[at + sum(map(len, units)) :]
            assert rest.startswith(last)
        else:
            rest = text[at + sum(map(len, units)) :]
        self._units(units, out)
        if end:
            if rest:
                self._units([rest], out)
            return ""
        if len(rest) <= self.m.window:
            return rest
        words = WORD.findall(rest)
        if len(words[-1]) <= self.m.window:
            # The last two may still change, as in a contraction.
            for w in words[:-2]:
                self._word(w.encode(), out)
            return "".join(words[-2:])
        for w in words[:-1]:
            self._word(w.encode(), out)
        last = words[-1]
        self.run = next(k for k in ("space", "letter", "number", "other") if RUNS[k].match(last, len(last) - 1).end() == len(last))
        keep = 1 if self.run == "space" else 0
        self.tail += last[: len(last) - keep].encode()
        self._window(out)
        return last[len(last) - keep :]

    def _window(self, out: list[bytes]) -> None:
        """Emits the stable tokens of the run and drops their bytes."""
        while len(self.tail) > self.m.window:
            stable, used = self.m.window - self.m.lookahead, 0
            for token in self.m.merged(bytes(self.tail[: self.m.window])):
                if used + len(token) > stable:
                    break
                out.append(self.packed[token])
                used += len(token)
            del self.tail[:used]

    def _word(self, data: bytes, out: list[bytes]) -> None:
        if len(data) > self.m.window:
            kept, self.tail = self.tail, bytearray(data)
            self._window(out)
            data, self.tail = bytes(self.tail), kept
        out.extend(self.packed[t] for t in self.m.merged(data))

    def _units(self, units: list[str], out: list[bytes]) -> None:
        found = list(map(self.units.new.get, units))
        if None in found:
            older, word = self.units.old.get, self._known_word
            for i in [i for i, ids in enumerate(found) if ids is None]:
                unit = units[i]
                if (ids := older(unit)) is None:
                    # A blank or none and letters are one word.
                    ids = word(unit) if unit.isascii() and (unit.isalpha() or unit[0] == " " and unit[1:].isalpha()) else b"".join(map(word, WORD.findall(unit)))
                if len(unit) <= KEPT_CHARS:
                    self.units.put(unit, ids)
                found[i] = ids
        out.extend(found)

    def _known_word(self, word: str) -> bytes:
        if (ids := self.words.new.get(word)) is not None:
            return ids
        if (ids := self.words.old.get(word)) is None:
            if len(word) > KEPT_CHARS:
                part: list[bytes] = []
                self._word(word.encode(), part)
                return b"".join(part)
            ids = self.m.short(word.encode())
        self.words.put(word, ids)
        return ids


class Decoder:
    """Text of ids that come in pieces; bytes of an unfinished character wait, wrong ones become U+FFFD."""

    def __init__(self, merges: MergeList):
        top = max(merges.bytes_of) + 1
        self.bytes_of = [merges.bytes_of.get(i, b"") for i in range(top)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def encoded(merges: MergeList, text: str, known: tuple[Known, Known] | None = None) -> Iterable[bytes]:
    """The packed ids of a text, in pieces."""
    encoder = Encoder(merges, known)
    for at in range(0, len(text), FED):
        yield encoder.feed(text[at : at + FED])
    yield encoder.finish()


def read_tokenizer(path: str) -> str:
    """A tokenizer's file; a few MB, which every task gets."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def merge_list(text: str) -> tuple[MergeList, tuple[Known, Known]]:
    """The rules of a tokenizer's file with the pieces known so far, kept by a worker from task to task."""
    return MergeList(text), (Known(), Known())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        merges, known = merge_list(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = b"".join(encoded(merges, batch.column("text")[i].as_py() or "", known))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([len(ids) // 4]), pa.array([ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        decoder = Decoder(merge_list(shared.value)[0])
        for batch in batches:
            texts = [decoder.feed(x.as_py() or b"") + decoder.finish() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chars", pa.int64())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text piece by piece, keeping digests only: doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def run(batches):
        merges, known = merge_list(shared.value)
        decoder = Decoder(merges)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids_hash, text_hash, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for ids in encoded(merges, text.as_py() or "", known):
                    ids_hash.update(ids)
                    back = decoder.feed(ids)
                    text_hash.update(back.encode())
                    n, chars = n + len(ids) // 4, chars + len(back)
                back = decoder.finish()
                text_hash.update(back.encode())
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), chars + len(back)))
            n, a, b, c = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], schema=ROUND_TRIP)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), public_path("byte_bpe_50k.json"))
