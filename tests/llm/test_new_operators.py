"""The conversation trie, covering SimHash and whitening against brute force: nulls, ties, hot keys, empty tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from fieldlens.llm import bpe, common, html_text, langid, minhash, neighbours, packing, prefixes, repeats, rollups, scans, simhash, whitening

TURN = "conv_id long, turn long, role string, text string, n_convs string, at int, digest string, k int, slice string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], TURN)


def order_of(turn):
    role, text = turn[1] or "", turn[2] or ""
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
    return (turn[0] is not None, turn[0] or 0, digest)


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, *turn in rows:
        if conv is not None:
            own[conv].append(turn)
    own = {c: [(t[1] or "", t[2] or "") for t in sorted(v, key=order_of)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = set()
    for seq, held in members.items():
        under = [s for s in members if s[: len(seq)] == seq]
        children = [s for s in under if len(s) == len(seq) + 1]
        leaves = [s for s in under if not any(len(x) == len(s) + 1 and x[: len(s)] == s for x in under)]
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in under if s)
        ends = ",".join(str(c) for c in sorted(held) if full[c] == seq)
        parent = min(members[seq[:-1]]) if seq else None
        out.add((min(held), len(seq), parent, len(held), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_conversations(seed, n, longest, texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + [(None, 1, "user", "nobody's"), (7, None, None, None), (7, None, None, None)]


@pytest.mark.parametrize(("seed", "n", "longest", "texts"), [(1, 60, 12, ["a", "é", None, ""]), (2, 300, 7, ["same"]), (3, 40, 30, ["x", "y"])])
def test_trie_equals_brute_force(spark, seed, n, longest, texts):
    rows = some_conversations(seed, n, longest, texts)
    ids, path = prefixes.rebuilt(prefixes.turns(turns_of(spark, rows)))
    got = [tuple(r) for r in prefixes.trie(ids, path, 2 + seed % 3).collect()]
    assert set(got) == trie_by_hand(rows)
    assert len(got) == len(set(got))


def test_trie_of_nothing_and_of_a_hot_conversation(spark):
    assert prefixes.trie(*prefixes.rebuilt(prefixes.turns(turns_of(spark, []).limit(0)))).count() == 0
    rows = [(5, t, "user", "long " * 2000 if t == 3 else f"t{t % 3}") for t in range(2000)] + [(c, t, "user", f"t{t}") for c in range(40, 60) for t in range(3)]
    got = prefixes.trie(*prefixes.rebuilt(prefixes.turns(turns_of(spark, rows)))).collect()
    own = [r for r in got if r.conv_id == 5 and r.depth]
    assert max(r.depth for r in own) == 2000
    small = {tuple(r) for r in got if r.depth < 3}
    assert small == {r for r in trie_by_hand([r for r in rows if r[0] != 5 or r[1] < 12]) if r[1] < 3}


def test_scan_goes_on_over_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, 900]), i, rng.getrandbits(62), rng.randint(0, 9)) for i in range(5000)]
    frame = spark.createDataFrame(rows, "key long, i long, x long, s long")
    got = {(r.key, r.i): (r.at, r.x, r.s) for r in scans.scanned(frame, "key", ["i"], ["x"], ["s"]).collect()}
    state, expected = defaultdict(lambda: (0, 0, 0)), {}
    for key, i, x, s in rows:
        state[key] = (state[key][0] + 1, state[key][1] ^ x, state[key][2] + s)
        expected[key, i] = state[key]
    assert got == expected


def print_by_hand(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts_by_hand(prints, radius):
    """The smallest value each is reachable from."""
    label = {x: x for x in prints}
    changed = True
    while changed:
        changed = False
        for x in prints:
            least = min(label[y] for y in prints if (x ^ y).bit_count() <= radius)
            if least < label[x]:
                label[x], changed = least, True
    return label


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_drop_any_positions_within_the_radius(radius):
    from itertools import combinations

    kept = simhash.masks(radius)
    assert len(kept) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    some = combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), radius) for _ in range(3000))
    for spots in some:
        assert any(all(not m >> s & 1 for s in spots) for m in kept)


@pytest.mark.parametrize(("radius", "bucket"), [(2, 256), (2, 3), (1, 3), (3, 4)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(radius * 100 + bucket)
    prints = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(25):
            x ^= sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(1, 4))))
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = simhash.links(spark.createDataFrame(signed, "print long"), radius).collect()
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in found}
    label = {x: x for x in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        label[max(top(a), top(b))] = min(top(a), top(b))
    assert {x: top(x) for x in prints} == parts_by_hand(sorted(prints), radius)
    assert len(pairs) <= 30 * len(prints)


def test_simhash_equals_brute_force(spark, documents):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b C"), (6, "É é"), (6, "again six"), (None, "One")]
    for i in range(60):
        copy = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy[rng.randrange(400)] = rng.choice(words)
        rows.append((100 + i, ("  " if i % 2 else "\r\n").join(copy)))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(*rows)).collect()))
    prints = [(d, print_by_hand(t)) for d, t in rows]
    label = parts_by_hand(sorted({p for _, p in prints}), 2)
    least = {}
    for d, p in prints:
        if d is not None:
            least[label[p]] = min(d, least.get(label[p], d))
    assert got == sorted((d is None, d or 0, f"{p:016x}", least.get(label[p])) for d, p in prints)
    assert simhash.near_duplicates(documents().limit(0)).count() == 0
    assert [tuple(r) for r in simhash.near_duplicates(documents((None, "alone"))).select("doc_id", "component_id").collect()] == [(None, None)]


def test_long_text_in_pieces_has_the_same_fingerprint(monkeypatch):
    text = "\n".join(f"Word{i * i % 977}  x" for i in range(3000)) + " " + "q" * 5000 + " end of it"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 17)
    assert simhash.fingerprint(text.encode()) == whole == print_by_hand(text)


def vectors_of(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("dims", T.StringType()), T.StructField("n", T.IntegerType())])
    return spark.createDataFrame([(i, v, "x", "y", 3) for i, v in rows], kind)


def whitened_by_hand(rows):
    used = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in used}:
        quant = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in used if len(v) == d]
        fit = sorted({tuple(x) for _, x in quant})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        gaps = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
        cov = np.array([[sum(g[j] * g[k] for g in gaps) / n**3 for k in range(d)] for j in range(d)])
        values, vectors = np.linalg.eigh(cov)
        out[d] = (quant, n, sums, values[::-1], vectors[:, ::-1])
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6] + 40).tolist()) for i in range(300)]
    rows += [(1000, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])] * 40
    rows += [(1, None), (2, [1.0] * 5 + [None]), (3, [float("nan")] + [0.0] * 5), (4, [float("inf")] * 6), (5, []), (6, [1e4, -1e4, 3.0, 0.0, -0.0, 2.0])]
    rows += [(7, [1.0, 2.0]), (8, [1.5, 2.0]), (9, [3.0])]
    got = [r.asDict() for r in whitening.whitened(vectors_of(spark, rows)).collect()]
    hand = whitened_by_hand(rows)
    assert len(got) == sum(len(q) * min(4, d) for d, (q, *_) in hand.items())
    for d, (quant, n, sums, values, vectors) in hand.items():
        ids = {i for i, _ in quant}
        mine = [r for r in got if r["vec_id"] in ids and r["n"] == n]
        for c in range(min(4, d)):
            expected = []
            for i, x in quant:
                exact = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
                z = float(np.dot(np.array(x) - np.array(sums) / n, vectors[:, c]) / np.sqrt(values[c])) if values[c] > 1e-9 else None
                expected.append((i is None, i or 0, str(exact), z))
            seen = [(r["vec_id"] is None, r["vec_id"] or 0, r["deviation_text"], r["whitened"]) for r in mine if r["component"] == c + 1]
            key = lambda r: (r[0], r[1], int(r[2]), abs(r[3] or 0))
            expected.sort(key=key), seen.sort(key=key)
            assert [r[:3] for r in seen] == [r[:3] for r in expected]
            if expected[0][3] is None:
                assert {r[3] for r in seen} == {None}
                continue
            a, b = np.array([r[3] for r in seen]), np.array([r[3] for r in expected])
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
            assert {round(r["explained"] / (values[c] / values.sum()), 6) for r in mine if r["component"] == c + 1} == {1.0}
        errors = {r["identity_error"] for r in mine}
        assert len(errors) == 1 and (d == 1 or errors.pop() < 1e-4)
    assert all(r["deviation"] == int(r["deviation_text"]) for r in got if r["deviation"] is not None)
    assert whitening.whitened(vectors_of(spark, []).limit(0)).count() == 0
    assert whitening.whitened(vectors_of(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("top", [1, 300, 1 << 20, 1 << 40, 1 << 62])
def test_plane_products_are_exact(top):
    rng = random.Random(top)
    rows = [[rng.randint(-top, top) for _ in range(5)] + [7] for _ in range(130)]
    got = whitening.cross_products(np.array(rows, np.int64))
    full = [[*r, 1] for r in rows]
    for j in range(7):
        for k in range(7):
            assert got[j, k] == sum(r[j] * r[k] for r in full)


def test_suffix_ranks_are_those_of_the_bytes():
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 2, 700), np.zeros(300), np.tile(rng.integers(0, 256, 60), 8), rng.integers(0, 256, 49)):
        data = data.astype(np.uint8)
        padded = data.tobytes() + bytes(repeats.LENGTH)
        prefixes = [padded[i : i + repeats.LENGTH] for i in range(len(data))]
        place = {p: r for r, p in enumerate(sorted(set(prefixes)))}
        ranks = repeats.suffix_ranks(data)
        same = defaultdict(set)
        for p, r in zip(prefixes, ranks.tolist(), strict=True):
            same[r].add(p)
        assert all(len(x) == 1 for x in same.values()) and len(same) == len(place)


def removed_by_hand(rows):
    """The bytes left of each row."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"x" * 50
        out.append((d, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 3, 1 << 14])
def test_passages_of_hot_triggers_and_equal_ids(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(repeats, "BATCH", 4000)
    monkeypatch.setattr(repeats, "SHARE", 3000)
    rng = random.Random(hot)
    common = "a passage that many documents hold, with other words on both of its sides "
    rows = [(i % 37, "".join(rng.choice([common, common[:60], "  " * 30, f"{rng.random()} ", "é\n" * 20, "\x00" * 55]) for _ in range(6))) for i in range(80)]
    rows += [(90, rows[3][1]), (90, rows[3][1]), (91, None), (92, ""), (93, common * 200)]
    got = sorted((r.doc_id, bytes(r.kept)) for r in repeats.repeated_passages(documents(*rows), hot=hot).collect())
    assert got == removed_by_hand(rows)


def test_hostile_pages_take_linear_time():
    import time

    pages = {
        "wide": "<div>" + "<p>x</p>" * 20000 + "</div>", "closing": "<div>" * 8000 + "</b>" * 20000 + "end", "quotes": '<a "' * 20000, "items": "<ul>" + "<li>x" * 20000,
        "comments": "<!--" * 20000, "nested": "<div>" * 5000 + "<li>" * 5000 + "deep",
    }
    began = time.perf_counter()
    for page in pages.values():
        root, nodes = html_text.tree(page)
        html_text.features(nodes)
        html_text.rendered(root, set(range(len(nodes))))
    assert time.perf_counter() - began < 20


def test_an_address_that_ends_in_a_slash_does_not_close_its_link():
    root, _ = html_text.tree("<p>a <a href=http://e.org/>text</a> b <br/> c <img src='x'/> d")
    (p,) = root.items
    link = p.items[1]
    assert (link.tag, link.items) == ("a", ["text"]) and [x.tag for x in p.items if x.__class__ is not str] == ["a", "br", "img"]


def test_pages_with_clashing_columns_and_empty_tables(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>" + "Some words, and more of them. " * 20 + "</p></article></body></html>"
    frame = spark.createDataFrame([(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (2, None, None, "x", "y"), (None, "v", "", "x", "y")], "page_id long, url string, html string, text string, h string")
    got = html_text.extract(frame).collect()
    assert sorted((r.page_id or 0, r.text) for r in got)[:2] == [(0, ""), (1, got[0].text if got[0].page_id == 1 else got[1].text)]
    assert [r.text for r in got if r.page_id == 1] == ["Title\n" + ("Some words, and more of them. " * 20).strip()] * 2
    assert html_text.extract(frame.limit(0)).count() == 0


def test_signs_are_no_letters(spark, documents):
    rows = [(i, "the river and the house over the hill " * 9, "en", "a.org") for i in range(30)] + [(i, "der Fluss und das Haus über dem Hügel ist groß " * 9, "de", "b.de") for i in range(30, 60)]
    signs = [(100, "— … “ ” • → ¡ « 123 !"), (101, None), (102, "日本語"), (103, "")]
    got = {r.id: (r.language, r.kept) for r in langid.language_of_documents(documents(*rows, *((i, t, "en", "a.org") for i, t in signs))).collect()}
    assert got[100] == got[101] == got[103] == ("und", False) and got[102][0] != "und"
    assert got[0] == ("en", True) and got[40] == ("de", True)
    kept = langid.kept_documents(documents(*rows, (7, "— …", "en", "a.org"), (8, "the house over the hill", None, None), (8, "", "en", "a.org")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(60), 8])


def test_a_lost_commit_is_never_read(spark, tmp_path, monkeypatch):
    kind = "doc_id long, op string, source string, lang string, n_tokens long, batch string, docs long"
    change = lambda *rows: spark.createDataFrame([(d, o, s, "en", n, "x", 9) for d, o, s, n in rows], kind)
    for lost_at in (1, 2, 3):
        ledger = rollups.Ledger(spark, str(tmp_path / str(lost_at)))
        assert ledger.commit("1", "t", change((1, "insert", "s", 5), (2, "insert", "s", 7), (3, "insert", None, 1)))
        put, calls = rollups.Ledger._put, []

        def fails(self, name, rows, batch, attempt, put=put, calls=calls, lost_at=lost_at):
            calls.append(name)
            if len(calls) == lost_at:
                raise OSError("lost")
            put(self, name, rows, batch, attempt)

        revised = change((1, "revise", "s", 6), (2, "delete", None, 0), (9, "delete", "s", 0))
        monkeypatch.setattr(rollups.Ledger, "_put", fails)
        with pytest.raises(OSError, match="lost"):
            ledger.commit("2", "t", revised)
        monkeypatch.setattr(rollups.Ledger, "_put", put)
        assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("s", 2, 12), (None, 1, 1)}
        # Another batch says the same before the lost one is sent again.
        assert ledger.commit("3", "t", revised) and ledger.commit("2", "t", revised) and not ledger.commit("2", "t", revised)
        assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("s", 1, 6), (None, 1, 1)}
        assert ledger.commit("4", "t", change((2, "insert", "u", 3), (2, "insert", "u", 4), (2, "insert", "u", 4)))
        assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("s", 1, 6), (None, 1, 1), ("u", 1, 4)}


def test_token_counts_are_those_of_the_tokenizer(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.public_path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    rows = [(1, "some words here", "en", "a"), (2, "Über \n\n  Häuser", "de", None), (None, "no id", "en", "a"), (4, None, None, "a"), (5, "more words, twice", "en", "a")]
    documents(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    totals = defaultdict(lambda: [0, 0])
    for _, text, lang, source in rows:
        n = len(known.encode(text or "", add_special_tokens=False).ids)
        totals[source, lang][0] += 1
        totals[source, lang][1] += n
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rollups.op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == totals


def test_one_of_equal_rows_stays_and_unlike_rows_of_a_document_stay(spark, documents):
    rows = [(1, "a b c d e f"), (1, "totally other words than these ones"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, ""), (4, "a b c d e f")]
    kept = minhash.kept_documents(documents(*rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, "a b c d e f"), (1, "totally other words than these ones"), (3, "")]
    assert minhash.kept_documents(documents().limit(0)).count() == 0


def test_blocks_of_sets_find_what_brute_force_finds():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    base = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    sets = []
    for _ in range(120):
        one = base.copy()
        k = rng.integers(0, 60)
        one[rng.choice(200, k, replace=False)] = rng.integers(1, 1 << 62, k).astype(np.uint64)
        sets.append(np.unique(one))
    a, b = np.arange(50), np.arange(50, 120)
    common = minhash._common(sets, a, b)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[50 + j])) for i in range(50) for j in range(70))
    made = [minhash._sketch(x) for x in sets]
    group = pa.table({
        "rep": np.arange(120), "component": np.arange(120), "n": [len(x) for x in sets], "samples": pa.array([k for k, _ in made], pa.int32()),
        "sketch": pa.array([s for _, s in made], pa.binary()), "items": pa.array([x.tobytes() for x in sets], pa.binary()), "block": [0] * 60 + [1] * 60, "i": [0] * 120, "j": [1] * 120,
    })
    got = minhash._linked(80)(group).to_pylist()
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    label = list(range(120))

    def top(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for r in got:
        assert linked(r["a"], r["b"])
        x, y = top(r["a"], label), top(r["b"], label)
        label[max(x, y)] = min(x, y)
    full = list(range(120))
    for i in range(60):
        for j in range(60, 120):
            if linked(i, j):
                x, y = top(i, full), top(j, full)
                full[max(x, y)] = min(x, y)
    assert [top(x, label) for x in range(120)] == [top(x, full) for x in range(120)] and len(got) < 120


def fused_by_hand(rows, labels, weights):
    """rows: (id, text, declared, suffix, host) -> id, best language, posterior."""
    import math

    scores, says = {}, {}
    for k, (_, text, *_) in enumerate(rows):
        counts = langid._counts(np.frombuffer((text or "").encode(), np.uint8))
        scores[k] = langid.TEMPER * (counts.astype(np.float32) @ weights.T) if counts.any() else None
        says[k] = int(np.argmax(scores[k])) if counts.any() else None
    n = len(labels)
    tally = lambda of: {key: [sum(says[k] == i for k in range(len(rows)) if says[k] is not None and of(rows[k]) == key) for i in range(n)] for key in {of(r) for k, r in enumerate(rows) if says[k] is not None and of(r) is not None}}
    domain = lambda r: ".".join(r[4].split(".")[-2:]) if r[4] and "." in r[4] and all(r[4].split(".")[-2:]) else ""
    declared, suffix, domains, hosts = tally(lambda r: r[2]), tally(lambda r: r[3]), tally(domain), tally(lambda r: r[4])
    whole = [sum(s == i for s in says.values()) for i in range(n)]
    overall = [(c + 1) / (sum(whole) + n) for c in whole]
    out = []
    for k, r in enumerate(rows):
        if scores[k] is None:
            out.append((r[0], "und", 0.0))
            continue
        smooth = lambda own, up: [(c + langid.HOST_WEIGHT * u) / (sum(own) + langid.HOST_WEIGHT) for c, u in zip(own, up, strict=True)]
        prior = smooth(domains[domain(r)], overall) if r[4] is not None and domain(r) else overall
        prior = smooth(hosts[r[4]], prior) if r[4] is not None else prior
        log = [float(s) + math.log(p) for s, p in zip(scores[k], prior, strict=True)]
        for table, value in ((declared, r[2]), (suffix, r[3])):
            if value is not None:
                log = [x + math.log((table[value][i] + langid.SMOOTH) / (whole[i] + langid.SMOOTH * len(table))) for i, x in enumerate(log)]
        top = max(log)
        out.append((r[0], labels[log.index(top)], 1 / sum(math.exp(x - top) for x in log)))
    return out


def test_posterior_of_pages_equals_brute_force(spark):
    rng = random.Random(12)
    words = {"en": "the river and house over hill with some light".split(), "de": "der fluss und das haus über dem hügel mit licht".split(), "fr": "la rivière et une maison sous le ciel avec lumière".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        text = " ".join(rng.choices(words[lang] + words[rng.choice(list(words))][:4], k=rng.choice([3, 12, 60])))
        host = rng.choice([f"www.site.{lang}", f"news.site.{lang}", "shared.org", f"{lang}{i % 3}.blog.net"])
        mark = rng.choice([f' lang="{lang}"', "", f" class=x lang='{lang.upper()}-XX'"])
        rows.append((i, f"https://{host}/{i}", f"<html{mark}><head><style>p {{}}</style></head><body><p>{text}</p></body></html>"))
    rows += [(200, "https://shared.org/", "<html lang=en><body>123 —</body></html>"), (201, None, None), (202, "nonsense", "<html><body>the house</body></html>"), (0, rows[0][1], rows[0][2])]
    evidence = langid.evidence_of_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string"))
    plain = [tuple(r) for r in evidence.select("id", "text", "declared", "suffix", "host").collect()]
    assert {r[2] for r in plain} == {"en", "de", "fr", None} and {r[3] for r in plain} >= {"en", "org", "net", None}
    labels, weights = langid.learn(evidence)
    expected = sorted(fused_by_hand(plain, labels, weights))
    got = sorted((r.id, r.language, r.posterior) for r in langid.fused(evidence).collect())
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert np.allclose([r[2] for r in got], [r[2] for r in expected], rtol=1e-4)
    right = sum(p[2] == g[1] for p, g in zip(sorted(plain, key=lambda r: r[0]), got, strict=True) if p[2])
    assert right >= 0.9 * sum(p[2] is not None for p in plain)


def test_chunks_have_the_ids_of_whole_texts():
    import pyarrow as pa
    from fieldlens.llm.common import byte_view
    from tokenizers import Tokenizer

    spec = bpe.read_tokenizer(bpe.public_path("word_bpe_49k.json"))
    known, chunks = Tokenizer.from_str(spec), packing.Chunks(spec)
    assert chunks.ends is not None
    rng = random.Random(4)
    parts = [
        "a", "Be", "E", "é", "É", "İ", "ß", "'", "'s", "'LL", "''", "1", "23", "²", "½", ".", ",", "!?", "...", "-", " ", "  ", "\n", "\t", " ", "　", "é", "́",
        "ﬁ", "ǅ", "日本", "🙂", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "|>", "<", "_", "\x00", "\x1f", " ", "ŉ", "K", "Å", "don't", "I'M", "x'.s", "’s",
    ]
    for size in (40, 3):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            ids, counts = chunks(*byte_view(pa.array(some)))
            got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == [known.encode(x, add_special_tokens=False).ids for x in some]
    byte_level = bpe.read_tokenizer(bpe.public_path("byte_bpe_50k.json"))
    assert packing.Chunks(byte_level).ends is None


def test_scores_are_those_of_bm25():
    import math

    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype("<u2") for _ in range(25)]
    held = np.array([sum(t in d for d in docs) for t in range(40)])
    idf = np.maximum(0, np.log((25 - held + 0.5) / (held + 0.5))).astype(np.float32)
    index = packing.Index(docs, idf)
    mean = sum(map(len, docs)) / 25
    for seed in range(25):
        expected = [
            sum(
                max(0, math.log((25 - held[t] + 0.5) / (held[t] + 0.5))) * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
                for t in set(docs[seed].tolist())
                if (f := int((d == t).sum()))
            )
            for d in docs
        ]
        assert np.allclose(index.scores(seed), expected, rtol=1e-5)


def test_packing_keeps_rows_without_id_and_repeated_rows(spark, documents):
    rows = [(None, "one two three"), (None, "one two three"), (4, "x " * 9000), (4, "x " * 9000), (5, None), (None, None)]
    pieces = packing.packed(documents(*rows), bpe.public_path("word_bpe_49k.json")).collect()
    whole = defaultdict(int)
    for p in pieces:
        whole[p.doc_id] += p.length
    assert whole == {None: 2 * 4 + 1, 4: 2 * 9001, 5: 1}
    held = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == held[p.sequence_id] and len(p.ids) == 4 * p.length
        held[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 for n in held.values()) and max(held.values()) <= 4096


def test_neighbours_and_archives_with_clashing_columns(spark):
    rows = [(i, [float(i % 5), 1.0], "a", 1, True) for i in range(40)] + [(3, [3.0, 1.0], "a", 1, True), (None, [1.0, 1.0], "a", 1, True), (50, [0.0, 0.0], "a", 1, True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int, q boolean")
    got = neighbours.nearest(frame, frame.where("vec_id = 20")).collect()
    exact = sorted(((-(i % 5 * 0 + 1.0), i) for i, _ in enumerate(rows[:40]) if i != 20))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)][:20] == [i for _, i in exact][:4] + [3] + [i for _, i in exact][4:19]


def test_pipeline_of_an_empty_table_and_of_null_rows(spark, documents, tmp_path):
    import corpus_pipeline

    prose = [" ".join(random.Random(i).choices("the river and house over hill with some light under garden".split(), k=80)) + f" number {i}" for i in range(4)]
    empty, some = str(tmp_path / "empty"), str(tmp_path / "some")
    documents().limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    rows = [(1, prose[0]), (1, prose[1]), (1, prose[0]), (2, prose[0]), (None, prose[2]), (None, prose[2], None, None), (None, None, None, None), (3, None), (4, prose[3], None, None)]
    documents(*rows).write.parquet(f"{some}/documents.parquet")
    pieces = corpus_pipeline.run(spark, some).collect()
    # Copies go, rows without id stay as they are, unlike rows of a document both stay.
    assert sorted((p.doc_id is None, p.doc_id or 0) for p in pieces if p.start == 0) == [(False, 1), (False, 1), (False, 4), (True, 0), (True, 0)]


def test_a_worker_gives_back_what_a_task_held():
    def held():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    pins = []

    def run(batches):
        for batch in batches:
            # Small parts of the C heap with one in use behind them, which the heap doesn't shrink below by itself.
            parts = [bytearray(100_000) for _ in range(1500)]
            pins.append(bytearray(100_000))
            yield batch + len(parts)

    before = held()
    assert list(common.lean(run)([1, 2])) == [1501, 1502]
    assert held() < before + 40 and len(pins) == 2
    assert common.given_back("x") == "x"
