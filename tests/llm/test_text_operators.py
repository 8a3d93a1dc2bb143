"""Text operators against brute force, on hand-made rows and on a small table: nulls, ties, long texts, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import DATA, duck, duck_rows, rows_of

import __spark_entry__ as contract
from fieldlens.llm import bpe, html_text, langid, minhash, neighbours, packing, quality, registry, repeats, rollups, warc

SMALL = DATA / "sf0.001"
WORDS = "the of and stone river light over under house garden winter road signal paper green slow".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    frame = contract.queries()[name](spark, str(SMALL))
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == duck_rows(duck(SMALL), contract.oracle_sql()[name])


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.public_path(name))


TEXTS = [None, "", " ", "a", "It's  odd:\n\n 12 'll\t x<|endoftext|>y", "é日本 ￿", "ab" * 4000, " " * 3000, "=" * 5000 + "!", prose(1, 50)]


def test_bpe_equals_the_tokenizer_and_comes_back(spark, documents):
    path, known = bpe.public_path("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    docs = documents(*enumerate(TEXTS), (3, "a"), (None, "null id"))
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.round_trip(docs, path).collect()}
    expected = set()
    for i, text in [*enumerate(TEXTS), (None, "null id")]:
        ids = known.encode(text or "", add_special_tokens=False).ids
        back = known.decode(ids, skip_special_tokens=False)
        expected.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(ids)))
    assert got == expected
    encoded = bpe.encode(docs, path)
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded, path).collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}
    assert bpe.round_trip(documents().limit(0), path).count() == 0


def test_bpe_fed_in_any_pieces():
    merges = bpe.MergeList(bpe.read_tokenizer(bpe.public_path("byte_bpe_50k.json")))
    known = tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    for text in [*TEXTS[4:], "'" * 40 + "ll", "thing" * 1500 + " end", "日本語" * 900]:
        encoder, out, at = bpe.Encoder(merges), b"", 0
        while at < len(text):
            step = rng.choice([5, 60, 700])
            out += encoder.feed(text[at : at + step])
            at += step
            assert len(encoder.tail) <= merges.window
        out += encoder.finish()
        assert np.frombuffer(out, "<u4").tolist() == known.encode(text, add_special_tokens=False).ids


def test_short_words_by_ids_and_rules_kept_by_a_worker():
    text = bpe.read_tokenizer(bpe.public_path("byte_bpe_50k.json"))
    merges, pieces = bpe.merge_list(text)
    assert bpe.merge_list(str(text.encode(), "utf-8")) == (merges, pieces)
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choices("aeinorst theABC019.,'é日\n", k=rng.randint(1, 48))).encode()
        assert merges.short(word) == b"".join(merges.packed[t] for t in merges.merged(word))
    known = tokenizer("byte_bpe_50k.json")
    for line in [" plain", "plain", " two words", "don't stop", " Ü Über", "  two", "\nnext", " ab1 'sab 'll", " x" * 60]:
        for _ in range(2):
            assert np.frombuffer(b"".join(bpe.encoded(merges, line, pieces)), "<u4").tolist() == known.encode(line, add_special_tokens=False).ids


def test_plain_words_need_no_normalizer():
    spec = bpe.read_tokenizer(bpe.public_path("word_bpe_49k.json"))
    chunks, known = packing.chunks_of(spec), tokenizer("word_bpe_49k.json")
    assert packing.chunks_of(str(spec.encode(), "utf-8")) is chunks
    letters = [c for c in map(chr, range(0x180)) if packing.LETTERS.fullmatch(c)]
    rng = random.Random(7)
    words = [*letters, *("".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(3000)), *("".join(rng.choices("aeinrstÉèß", k=rng.randint(2, 9))) for _ in range(3000))]
    assert {w: np.frombuffer(ids, "<u4").tolist() for w, ids in chunks._encoded(words).items()} == {w: known.encode(w, add_special_tokens=False).ids for w in words}


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def linked(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    part = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {i: new if p == old else p for i, p in part.items()}
    return {(i, len(sets[i]), part[i], part[i] == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, documents):
    rng, rows = random.Random(5), [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "  \n"), (5, "one")]
    for family in range(6):
        base = prose(family, 120).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = "w" + str(rng.random())
            rows.append((len(rows), " ".join(words)))
    rows.append((len(rows), prose(99, 60_000)))
    for width, percent in ((3, 85), (5, 80)):
        got = {tuple(r) for r in minhash.near_duplicates(documents(*rows, rows[20]), width, percent).collect()}
        assert got == linked(rows, width, percent)
    null = minhash.near_duplicates(documents((None, "a b c d e f"), (1, "a b c d e f")), 3, 85)
    assert {tuple(r) for r in null.collect()} == {(None, 4, None, False), (1, 4, 1, True)}
    assert minhash.near_duplicates(documents().limit(0)).count() == 0
    kept = minhash.kept_documents(documents((1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c")))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]


def test_quality_rules_on_odd_texts(spark, documents):
    docs = documents((1, None), (2, "a b c a b c a b c"), (3, prose(1, 80)), (4, prose(1, 80) + "\n# x\n# x\n\n"), (None, prose(2, 60), None, None))
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].base_failed) == (0, 0, True)
    assert (got[2].n_repeat_words, got[4].n_dup_lines, got[4].n_symbols) == (9, 1, 2)
    assert got[3].kept and got[None].kept and not got[2].kept
    assert quality.quality_rules(documents().limit(0)).count() == 0


def test_a_bad_host_takes_its_documents_with_it(spark, documents):
    good = [(i, prose(i, 80), "en", f"h{i % 9}") for i in range(90)]
    bad = [(100 + i, "too short", "en", "bad") for i in range(60)] + [(200, prose(7, 80), "en", "bad")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(*good, *bad)).collect()}
    assert all(got[i] for i in range(90)) and not got[200]


def removed(rows):
    seen, out = {}, set()
    for i, text in sorted(rows):
        data = (text or "").encode()
        for s in range(len(data) - 49):
            seen.setdefault(data[s : s + 50], i)
        gone = [False] * len(data)
        for s in range(len(data) - 49):
            if seen[data[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        spans = len(re.findall("1+", "".join("01"[g] for g in gone)))
        out.add((i, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeated_passages_equal_brute_force(spark, documents, monkeypatch, tmp_path):
    passage, rng = prose(50, 30), random.Random(8)
    rows = [(0, None), (1, "x" * 49), (2, "y" * 300), (3, "z" + "y" * 120), (4, passage), (5, prose(51, 20) + passage + "é" * 40), (6, passage[7:90] + "é" * 40)]
    for i in range(7, 40):
        at = rng.randrange(len(passage) - 60)
        rows.append((i, prose(i % 9, 40)[: rng.randint(30, 300)] + passage[at : at + rng.randint(48, 60)] + prose(i, 9)))
    for batch in (300, 8 << 20):
        monkeypatch.setattr(repeats, "BATCH", batch)
        monkeypatch.setattr(repeats, "SHARE", 2 * batch)
        folder = str(tmp_path / str(batch))
        documents(*rows).write.parquet(f"{folder}/documents.parquet")
        assert {tuple(r) for r in repeats.op10_repeated_passages(spark, folder).collect()} == removed(rows)
    null = repeats.repeated_passages(documents((None, passage), (1, passage)))
    assert all(not r.spans for r in null.collect())
    assert repeats.repeated_passages(documents().limit(0)).count() == 0


def test_packing_holds_every_id_once_without_padding(spark, documents):
    path, known = bpe.public_path("word_bpe_49k.json"), tokenizer("word_bpe_49k.json")
    texts = [None, "", "Ünï códe's <|endoftext|> x", prose(1, 9000), *[prose(i, 30 + 37 * i) for i in range(40)], prose(3, 141)]
    pieces = packing.digests(packing.packed(documents(*enumerate(texts)), path, shard=1 << 14)).collect()
    sequences = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for i, text in enumerate(texts):
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in s])
        assert [p.offset for p in s] == [0, *ends[:-1]] and (ends[-1] & (ends[-1] - 1)) == 0 and ends[-1] <= 4096
    assert packing.packed(documents().limit(0), path).count() == 0


def test_packing_puts_like_documents_together():
    a, b = np.arange(10, 40), np.arange(50, 80)
    docs = [np.repeat(x, 20)[:600].astype("<u4") for x in (a, b, a, b)]
    filled = packing.fill(docs, np.ones(100, np.float32), window=1200)
    assert [sorted(p[0] for p in s) for s in filled] == [[0, 2], [1, 3]]


def test_neighbours_leave_out_what_is_no_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [2.0, None]), (7, [-1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0]), (1, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(vectors, vectors.where("vec_id in (0, 2, 9)")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 1.0), (0, 1, 1.0), (0, 8, 1.0), (0, 7, -1.0)]
    assert neighbours.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 3000)
    big = "<p>é\r\n\r\n</p>" * 200
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3\r\nx: y", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}/archives")
    got = {r.page_id: r for r in warc.read(index, f"file://{tmp_path}/archives").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert got[2].payload.decode() == big and got[1].payload_bytes == len(big.encode()) and got[5].payload == b""
    one = warc.read(index.where("page_id = 3"), f"file://{tmp_path}/archives").collect()
    assert [r.payload for r in one] == [b"small"]
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_ledger_counts_a_batch_once(spark, tmp_path):
    ledger = rollups.Ledger(spark, str(tmp_path / "ledger"))
    change = lambda *rows: spark.createDataFrame(rows, "doc_id long, op string, source string, lang string, n_tokens long")
    assert ledger.totals().count() == 0
    assert ledger.commit("1", "v1", change((1, "insert", "a", "en", 10), (2, "insert", None, "en", 5), (3, "insert", "a", "de", 7)))
    assert not ledger.commit("1", "v1", change((9, "insert", "a", "en", 99)))
    ledger.commit("2", "v1", change((1, "revise", "b", "en", 12), (3, "delete", None, None, None), (8, "delete", "a", "en", 4)))
    ledger.commit("3", "v2", change((1, "insert", "b", "en", 3)))
    ledger.commit("4", "v2", change().limit(0))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 12), (None, "en", "v1"): (1, 5), ("b", "en", "v2"): (1, 3)}


def test_language_of_held_out_rows(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    known = rows.where("doc_id % 5 <> 0").selectExpr("doc_id", "text", "lang", "source")
    held = rows.where("doc_id % 5 = 0").selectExpr("doc_id", "text", "cast(null as string) AS lang", "source")
    got = {r.id: r.text_language for r in langid.language_of_documents(known.unionAll(held)).collect()}
    truth = rows.where("doc_id % 5 = 0").select("doc_id", "lang").collect()
    assert sum(got[r.doc_id] == r.lang for r in truth) >= 0.97 * len(truth)


def test_language_without_evidence(spark, documents):
    docs = documents((1, None, "en"), (2, "12 34", "en"), (3, prose(1, 50), "en", None), (None, prose(2, 50), None))
    assert {r.id: (r.language, r.kept) for r in langid.language_of_documents(docs).collect()} == {1: ("und", False), 2: ("und", False), 3: ("en", True), None: ("en", True)}
    assert langid.kept_documents(docs).count() == 2
    assert langid.language_of_documents(documents().limit(0)).count() == 0


LAYOUT = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><div class="cookie-notice">We use cookies.</div>
<header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav></header>
<article><h1>A &amp; B</h1><p>First  line of
the text, which goes on.<p>Second <b>bold</b> line, which has a clause; and ends.</article>
<aside class="sidebar"><ul><li><a href="/x">Other</a></li></ul></aside>
<div class="comments"><p>What a fine article, I liked it very much.</p></div><footer>&copy; 2020</footer></body></html>"""


def test_main_text_of_another_layout(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model = html_text.learn(pages)
    odd = [(1, "u", LAYOUT), (2, "u", None), (3, None, ""), (4, "u", "<<p <a href='"), (5, "u", "<div>" * 3000 + "x"), (1, "u", LAYOUT)]
    got = html_text.extract(spark.createDataFrame(odd, "page_id long, url string, html string"), model).collect()
    texts = [r.text for r in got]
    assert texts[0] == texts[5] == "A & B\nFirst line of the text, which goes on.\nSecond bold line, which has a clause; and ends."
    assert texts[1] == texts[2] == ""


def test_a_character_cut_in_two_goes_as_a_whole(spark, documents):
    docs = documents((1, "é" + "x" * 60), (2, "ũ" + "x" * 60 + "\ufffd"), (3, "own \ufffd text"))
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.kept_documents(docs).collect()}
    assert got == {1: ("é" + "x" * 60, 61), 2: ("", 0), 3: ("own \ufffd text", 10)}


def test_filters_return_the_columns_they_were_given(spark, documents):
    docs = documents(*[(i, prose(i, 80)) for i in range(30)], (30, None), (31, "too short"))
    for stage in (quality.kept_documents, langid.kept_documents, minhash.kept_documents, repeats.kept_documents):
        kept = stage(docs)
        assert kept.columns == docs.columns and {(r.kept, r.n_words) for r in kept.select("kept", "n_words").collect()} == {("x", 1)}
        assert stage(docs.limit(0)).count() == 0
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == set(range(30))


def without_repeats(rows):
    """The texts without the bytes that an earlier document holds, cut characters left out."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        data = text.encode()
        keep = np.ones(len(data), bool)
        for s in range(len(data) - 49):
            if seen.setdefault(data[s : s + 50], i) < i:
                keep[s : s + 50] = False
        out[i] = bytes(np.frombuffer(data, np.uint8)[keep]).decode(errors="ignore")
    return out


def test_pipeline_equals_brute_force(spark):
    """Quality by its SQL, languages by the operator on what is left (tested on held-out rows), the rest by brute force."""
    pieces = contract.queries()["pipeline"](spark, str(SMALL)).collect()
    good = [r[0] for r in duck(SMALL).execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = langid.kept_documents(docs.where(docs.doc_id.isin(good))).collect()
    rows = [(r.doc_id, r.text) for r in known]
    firsts = {i for i, _, _, kept in linked(rows, 5, 80) if kept}
    texts = without_repeats([(i, t) for i, t in rows if i in firsts])
    tokens = tokenizer("word_bpe_49k.json")
    at = collections.Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.array([*tokens.encode(texts[p.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (p.start, p.doc_tokens, p.ids_crc32) == (at[p.doc_id], len(ids), zlib.crc32(ids[p.start : p.start + p.length].tobytes()))
        at[p.doc_id] += p.length
    assert at == {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
