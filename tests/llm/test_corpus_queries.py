"""The corpus operators against brute force, on the smallest tables and on hand-made edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import bpe, embeddings, jaccard, licenses, packing, quality, records, rtree, sharding, toxicity, urls
from tracegrid.llm.common import connected_components, stage_path
from tracegrid.llm.word_encoder import encoder, vocabulary_path

EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "one two three"), (6, "Cc By general PUBLIC license\nall rights reserved"), (7, "a b c a b c a b c"), (8, "x\n\nx\n x"),
    (9, "ÉCOLE straße 日本語 ½ don't I'M <|endoftext|> \x1c end"), (10, "word " * 6000), (11, "%% ** $$ | < >"), (12, "a b c d e f g h i j"), (13, "A B C D E f g h i j"), (None, "no id"), (4, "one two three"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in EDGE], "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def libs(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


# ----------------------------------------------------------------- 1 licenses
def base_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), places


def test_license_base_places(spark, sf, texts):
    for r in licenses.op1_licenses(spark, sf).collect():
        n, places = base_places(texts[r.doc_id])
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_spans_and_edges(edge, empty):
    s = licenses.scanner()
    text = next(t for label, t in licenses.TEMPLATES if label == "isc")
    words = text.split()
    changed = " ".join(["intro"] * 5 + words[:8] + ["very"] + words[8:])
    n, _, spans = s.scan(changed)
    assert n == len(words) + 6 and spans[0][0] == "isc" and spans[0][3] == 1.0 and spans[0][1] == 5
    assert s.scan("the software of the use and " * 500)[2] == []
    assert licenses.scan(empty).count() == 0 and licenses.scan(edge).count() == len(EDGE)
    automaton = licenses.Automaton()
    rng = random.Random(3)
    seqs = [[rng.randrange(3) for _ in range(40)] for _ in range(5)]
    for i, q in enumerate(seqs):
        automaton.add(i, q)
    automaton.finish()
    for _ in range(200):
        q = rng.choice(seqs)
        a = rng.randrange(36)
        part = q[a : a + rng.randrange(1, 5)]
        want = sorted((i, e + len(part)) for i, w in enumerate(seqs) for e in range(40 - len(part) + 1) if w[e : e + len(part)] == part)
        assert automaton.ends[automaton.state_of(part)] == want


# ----------------------------------------------------------------- 2 quality
def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)})


def test_quality_counts(spark, sf, texts, edge, empty):
    for r in quality.op2_quality(spark, sf).collect():
        assert tuple(r)[1:6] == counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    got = Counter(tuple(r) for r in quality.measure(edge).select("doc_id", *quality.COUNTS[:5]).collect())
    assert got == Counter((i, *counts(t)) for i, t in EDGE)
    assert quality.measure(empty).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    df = spark.createDataFrame([(k, n) for n in (0, 1, 30, 200) for k in (0, 1, 2, 3) if k <= n], "k long, n long")
    for r in df.withColumn("t", quality.binomial_tail("k", "n", 0.02)).collect():
        want = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k <= 0.02 * r.n or r.k == 0 else 1.0
        assert r.t == pytest.approx(want, rel=1e-9)


def test_cutoffs_reject_bad_and_keep_good(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(9000):
        bad = i % 5 == 0
        words = [rng.choice("abcdefghij") + str(rng.randrange(999)) + ("%%%" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0 if bad else 1))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = quality.apply_rules(docs, truth).join(truth, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept): r["count"] for r in kept} == {(0, False): 1800, (1, True): 7200}
    none = quality.apply_rules(docs.limit(50), truth.limit(0))
    assert none.where("kept").count() == 50


def test_joint_cutoffs_hold_their_bound(spark):
    """300 strata as independent draws, each at level DELTA: few lose more than ALPHA of their good rows to the chosen cutoffs."""
    draws, rng = 300, np.random.default_rng(5)
    good_symbols, good_shouts, bad = rng.integers(0, 101, (draws, 600)), rng.integers(0, 101, (draws, 600)), rng.integers(30, 200, (draws, 300))
    rows, labels, at = [], [], 0
    for d in range(draws):
        for x, y, g in [*zip(good_symbols[d].tolist(), good_shouts[d].tolist(), [1] * 600, strict=True), *((x, 10, 0) for x in bad[d].tolist())]:
            rows.append((at, str(d), 100, 500, x, 0, 0, y * 5, False))
            labels.append((at, g))
            at += 1
    schema = ", ".join(["doc_id long", "lang string", *(f"{c} long" for c in quality.COUNTS), "base_failed boolean"])
    measured, truth = spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.calibrate(measured, truth, delta=quality.DELTA * draws).collect()
    # Good symbols a word are 0 to 1 in hundredths, and so is the share of capitals: the true loss is known.
    lost = lambda c: 1 - np.prod([(np.floor(min(c.get(r, 9), 1) * 100 + 1e-9) + 1) / 101 for r in ("symbols", "shouting")])
    wrong = sum(lost(r.cutoffs) > quality.ALPHA for r in found)
    assert len(found) > draws / 2 and wrong <= 0.05 * draws + 8
    assert all(r.tail <= quality.DELTA and r.cutoffs for r in found)


# ----------------------------------------------------------------- 3 sharding
def test_shards_are_exact_and_gapless(spark, sf, texts, edge, empty):
    rows = sharding.op3_sharding(spark, sf).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(texts)
    out = sharding.shuffle(edge, shards=4).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(EDGE) and sorted(Counter(r.shard for r in out).values()) == [3, 4, 4, 4]
    assert sharding.shuffle(empty).count() == 0
    assert sharding.shuffle(edge, shards=24).select("shard").distinct().count() == len(EDGE)


def test_shuffle_is_uniform_and_written_whole(spark):
    """Places in the input tell nothing about shards and slots; written shards come back whole and in order."""
    n, shards = 24_000, 8
    out = sharding.shuffle(spark.range(0, n, 1, 6).withColumn("shard", F.lit("old")), shards=shards)
    rows = np.array([(r.id, r.shard, r.slot) for r in out.collect()])
    table = np.zeros((12, shards))
    np.add.at(table, (rows[:, 0] // (n // 12), rows[:, 1]), 1)
    expected = n / 12 / shards
    assert ((table - expected) ** 2 / expected).sum() < 77 + 5 * (2 * 77) ** 0.5
    assert abs(np.corrcoef(rows[:, 0], rows[:, 2])[0, 1]) < 0.04
    path = stage_path(spark, "shards-test")
    sharding.write_shards(out, path)
    back = spark.read.parquet(path)
    assert back.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z")).where("n = 3000 and a = 0 and z = 2999").count() == shards
    assert back.select("id").distinct().count() == n


def test_hypergeometric_draws(spark):
    u = sharding._uniform("1L", "id")
    for total, good, drawn in ((1000, 300, 100), (50, 5, 20), (10**7, 10**6, 10**5)):
        x = spark.range(3000).select(F.expr(sharding.hypergeometric(f"{total}L", f"{good}L", f"{drawn}L", u)).alias("x"))
        mean, var, low, high = x.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
        p = good / total
        want = drawn * p * (1 - p) * (total - drawn) / (total - 1)
        assert abs(mean - drawn * p) < 5 * (want / 3000) ** 0.5 and abs(var / want - 1) < 0.2 and 0 <= low and high <= min(good, drawn)
    parts = [(i, 50 + 7 * i) for i in range(30)]
    m = sharding.communication_matrix(spark.createDataFrame(parts, "id long, n long")).collect()
    assert {r.id: sum(r.counts) for r in m} == dict(parts)
    cols = [sum(c) for c in zip(*(r.counts for r in m), strict=True)]
    assert max(cols) - min(cols) <= 1


# ----------------------------------------------------------------- 4 records
def test_records_round_trip(spark, sf, texts, edge, empty):
    lib, at = libs("word_bpe_49k.json"), 0
    got = {r.doc_id: tuple(r)[1:] for r in records.op4_records(spark, sf).collect()}
    for i in sorted(texts):
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = stage_path(spark, "records-test")
    manifest = records.write_records(edge, path)
    plain, mixed = records.read_records(manifest, path).collect(), records.read_records(manifest, path, shuffle_seed=3).collect()
    assert len(plain) == len(EDGE) and Counter(map(tuple, plain)) == Counter(map(tuple, mixed))
    none = stage_path(spark, "records-test")
    assert records.read_records(records.write_records(empty, none), none).count() == 0


def test_records_find_corruption():
    import io

    data = records.frame(records.serialize(5, np.array([1, 70000], dtype="<u4").tobytes())) + records.frame(records.serialize(None, b""))
    assert [records.parse(p)[0] for _, p in records.read_frames(io.BytesIO(data))] == [5, None]
    assert np.frombuffer(records.parse(next(records.read_frames(io.BytesIO(data)))[1])[1], "<u4").tolist() == [1, 70000]
    for place in (3, 9, 20, len(data) - 2):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.read_frames(io.BytesIO(bytes(broken))))


# ----------------------------------------------------------------- 5 urls
def test_url_rules(spark, sf):
    cases = {
        "http://a.net/x": ("net/", "block"), "http://example.net/en/1": ("example.net/en/", "allow"), "https://WWW.Example.Net/en/1?x": ("example.net/en/", "allow"), "http://example.com/de/": ("example.com/de/", "block"),
        "http://xexample.com/de/": (None, None), "http://b.org/fr/1#x": ("org/fr/", "allow"), "http://net": (None, None), "net/": (None, None), None: (None, None), "": (None, None),
    }
    for url, want in cases.items():
        assert urls.fitting(*urls.parse(url)) == want
    assert urls.parse("HTTP://A.B?x") == ("a.b", "") and urls.parse("x://H/p?q#f") == ("h", "/p") and urls.parse("x://h#f/g") == ("h", "")
    rows = urls.op5_urls(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        rule, verdict = urls.fitting(r.host, r.path)
        assert r.rule == rule and (r.verdict == verdict if rule else r.verdict == ("block" if r.mined else "allow"))


def test_mined_rules_block_what_labels_show(spark):
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.example.org/{'ads' if i % 2 == 0 else 'news'}/{i}") for i in range(600)] + [(9999, None)]
    labels = [(i, 0 if i % 6 == 0 else 1, 0) for i in range(600)]
    out = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.page_id: r.verdict for r in out.collect()}
    assert all(got[i] == ("block" if i % 6 == 0 else "allow") for i in range(600)) and got[9999] == "allow"


# ----------------------------------------------------------------- 6 jaccard
def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s[i]), find(i)) for i in docs}


def test_jaccard_components(spark, sf, texts, edge, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6_jaccard(spark, sf).collect()}
    assert got == brute_components(texts)
    rows = jaccard.components(edge).collect()
    assert len(rows) == len(EDGE)
    found = {r.doc_id: r.component_id for r in rows}
    assert found[5] == 4 and found[13] == 12 and found[1] == 1 and found[None] is None
    assert jaccard.components(empty).count() == 0


def test_jaccard_keys_rows_by_their_text(spark):
    """Rows that share an id but not a text, null ids, equal rows, extra columns with clashing names."""
    b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "bc")
    rows = [(3, b), (3, c), (4, b + " x"), (5, c + " x"), (None, b), (None, "q r s"), (6, "q r s"), (None, "lone words"), (3, b), (9, None), (None, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, component_id int")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.components(df).collect())
    assert got == Counter([(3, 3)] * 3 + [(4, 3), (5, 3), (None, 3), (None, 6), (6, 6), (None, None), (9, 9), (None, None)])
    left = Counter((r.doc_id, r.text) for r in jaccard.without_copies(df.select("doc_id", "text")).collect())
    assert left == Counter([(3, b), (3, c), (6, "q r s"), (None, "lone words"), (9, None), (None, "")])


@pytest.mark.parametrize(("block", "few", "frequent"), [(8, 8, 128), (8, 0, 10**6), (2048, 0, 10), (16, 1, 40)])
def test_jaccard_large_tiles(spark, monkeypatch, block, few, frequent):
    """Passages that make up most of many texts, and a group of copies that link through one text alone."""
    for name, value in (("BLOCK", block), ("FEW", few), ("FREQUENT", frequent), ("ROWS", 64)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(60)]
    docs = {i: " ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 14, 20]))]) for i in range(60)}
    base = [f"t{i}" for i in range(100)]
    for i in range(60, 110):
        copy = list(base)
        for k in rng.sample(range(0, 100, 10), 2 if i > 60 else 0):
            copy[k] = f"v{rng.randrange(10**6)}"
        docs[i] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()} == brute_components(docs)


def test_linked_sets_share_enough_cells():
    """Draws of rare shingles never share fewer cells than a set that links must."""
    rng = np.random.default_rng(6)
    for n, rare in ((5, 5), (40, 40), (120, 100), (300, 300), (300, 90), (2000, 1900)):
        need, p = jaccard.least_shared(n, rare), jaccard.prefix_length(n)
        drawn = rng.hypergeometric(rare - (p - 1), p - 1, p, 20_000).min() if rare >= p else 1
        assert 1 <= need <= drawn
    assert jaccard.least_shared(2000, 2000) > 250 and jaccard.least_shared(300, 10) == 1


def test_frequencies_count_all_texts(spark):
    docs = spark.createDataFrame([(i, f"common words of every text here {i}") for i in range(300)], "doc_id long, text string").repartition(5)
    bits, bins, levels = jaccard.frequent(docs)
    common = jaccard.shingles("common words of every text here") & np.uint64((1 << bits) - 1)
    assert sorted(bins.tolist()) == sorted(common.tolist()) and set(levels.tolist()) == {9}


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (12, 300)).astype(np.uint64) << np.uint64(1)
    sets = [np.unique(np.r_[base[i % 12][: rng.integers(200, 300)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64) << np.uint64(1)]) for i in range(150)]
    points, sizes = np.stack([rtree.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    linked = {(a, b) for a in range(150) for b in range(a + 1, 150) if (o := len(np.intersect1d(sets[a], sets[b]))) * 100 >= 75 * (sizes[a] + sizes[b] - o)}
    tree = np.arange(150) // 70  # three trees in one forest
    forest = rtree.Forest(tree, points, sizes, np.arange(150))
    found = Counter((min(a, b), max(a, b)) for x, y in forest.join(np.array([0, 1, 2, 0, 0, 1]), np.array([0, 1, 2, 1, 2, 2]), 75, 100) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    assert linked and linked <= set(found) and len(found) < 150 * 149 / 4 and set(found.values()) == {1}
    marked = rtree.Forest(tree, points, sizes, np.arange(150) % 12)
    assert all(u % 12 != v % 12 for x, y in marked.join(np.array([0, 0]), np.array([0, 1]), 75, 100) for u, v in zip(x.tolist(), y.tolist(), strict=True))
    wide = rtree.unpack_vectors([rtree.pack_vector(np.full(1024, 300)), rtree.pack_vector(np.full(1024, 3))])
    assert wide.tolist() == [[300] * 1024, [3] * 1024]


# ----------------------------------------------------------------- 7 bpe, and the word encoder
ODD = ["", " ", "  a  b\n\n c \t d", "don't it's we'll I'M they've", "x<|endoftext|>y <|endoftext|><|endoftext|>", "a\x00b 日本語 テスト 1234 ½ ²", "a" * 50, " lead trail ", "\u00a0nbsp\u2003em", "😀😀 a😀b", "hello\x1cworld \x85", "ﬁ é ́x ΣΑΣ ς İ"]


def odd_texts():
    rng = random.Random(4)
    return ODD + ["".join(rng.choice("abcdetinosr '-\n1") for _ in range(200)) for _ in range(100)] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x4E00, 0x4F00), 10, 32, 32])) for _ in range(100)) for _ in range(100)]


def test_trie_encoder_equals_the_library(spark, sf, texts, edge, empty):
    import hashlib

    lib, ours = libs("byte_bpe_50k.json"), bpe.encoder(bpe.vocabulary_path())
    odd = odd_texts()
    for t, got in zip(odd, ours.encode_all(odd), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want and ours.decode(got) == lib.decode(want, skip_special_tokens=False)
    for r in bpe.op7_bpe(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.decode(bpe.encode(empty)).count() == 0 and bpe.decode(bpe.encode(edge)).count() == len(EDGE)


def test_word_encoder_equals_the_library():
    lib, odd = libs("word_bpe_49k.json"), odd_texts()
    for t, got in zip(odd, encoder(vocabulary_path()).encode_all(odd), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


# ----------------------------------------------------------------- 8 packing
def check_packed(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_packing(spark, sf, texts, edge, empty):
    lib, want = libs("word_bpe_49k.json"), {}
    for i, t in texts.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            want[i, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = packing.op8_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    least = -(-sum(r.length for r in rows) // 2048)
    assert check_packed(rows, 2048) <= least + max(1, least // 50)
    assert check_packed(packing.packed_rows(edge).collect(), 2048) >= 1 and packing.packed_rows(empty).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] = fit - x
    return len(gaps)


def test_supersteps_place_like_best_fit_decreasing(spark):
    rng = random.Random(9)
    for _ in range(40):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 200))]
        want = best_fit_decreasing(lengths, 64)
        left, now, opened, steps = dict(Counter(lengths)), {}, 0, 0
        while left:
            runs, rest = packing.sweep(left, now, 64)
            assert sum(r[1] for r in runs) + sum(rest.values()) == sum(left.values()) and runs
            opened += sum(r[3] for r in runs if not r[2])
            now, left, steps = packing.after(runs, now, 64), rest, steps + 1
        assert opened <= want + max(1, want // 50) and steps <= 12
    # Ties, equal rows, other columns, and every row placed once.
    rows = [(i % 7, 1 + (i * i) % 64, 5) for i in range(900)] + [(3, 64, 5)] * 20
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, offset int").repartition(5), 64).collect()
    assert Counter((r.doc_id, r.length) for r in out) == Counter((a, b) for a, b, _ in rows)
    assert check_packed(out, 64) <= best_fit_decreasing([b for _, b, _ in rows], 64) * 1.02 + 1
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), 64)


# ----------------------------------------------------------------- 9 embeddings
def brute_vectors(rows, threshold=0.95):
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows.items() if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)}
    links, root = dict.fromkeys(rows, 0), {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in rows}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = {}
    for i in range(160):
        centre = rng.normal(0, 1, 16) if i % 8 == 0 else centre
        rows[i] = (centre + rng.normal(0, rng.choice([0.0, 0.1, 0.22, 0.35]), 16)).astype(np.float32).tolist()
    rows |= {200: None, 201: [], 202: [0.0] * 16, 203: [1.0, None], 204: [float("nan")] * 16, 205: [float("inf")] + [1.0] * 15, 206: [1.0, 2.0], 207: [2.0, 4.0], 208: [1e30] * 16, 209: [1e-30] * 16}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    for tiles in (1, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tiles=tiles).collect()}
        assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    twice = embeddings.near_duplicates(df.where("vec_id < 3").unionAll(df.where("vec_id < 3"))).collect()
    assert len(twice) == 6 and all(r.n_links >= 1 for r in twice)


def test_embeddings_of_the_table(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.op9_embeddings(spark, sf).collect()} == brute_vectors(rows)


def test_embeddings_link_by_vectors_alone(spark):
    """Groups of three near vectors of which one has no id, repeated ids with other vectors, extra columns."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(20):
        centre = rng.normal(0, 1, 16)
        for k in range(3):
            rows.append((None if k == g % 3 else 10 * g + k, (centre + rng.normal(0, 0.05, 16)).tolist(), 1))
    rows += [(7, [1.0] + [0.0] * 15, 1), (7, [0.0, 1.0] + [0.0] * 14, 1), (500, [0.0, 1.0] + [0.0] * 14, 1), (None, None, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), tiles=3).collect()
    assert len(got) == len(rows) and Counter((r.n_links, r.component_id) for r in got if r.vec_id is None) == Counter([(2, 10 * g + (1 if g % 3 == 0 else 0)) for g in range(20)] + [(0, None)])
    for r in got:
        if r.vec_id is not None and r.vec_id < 200 and r.vec_id != 7:
            g = r.vec_id // 10
            assert (r.n_links, r.component_id) == (2, 10 * g + (1 if g % 3 == 0 else 0))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in (7, 500)) >= Counter([(7, 0, 7), (7, 1, 7), (500, 1, 7)])


def test_doubtful_pairs_are_recomputed():
    """Pairs so near the threshold that codes can't tell."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 32)
    x /= np.linalg.norm(x)
    rows = []
    for _ in range(60):
        y = rng.normal(0, 1, 32)
        y -= (x @ y) * x
        c = 0.95 + rng.choice([-1, 1]) * 10.0 ** rng.integers(-9, -3)
        rows.append(c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y))
    raw = np.array([x, *rows])
    codes, scale, error = embeddings.quantise(raw)
    t = pa.table({"tile": np.zeros(61, dtype=np.int32), "x": np.zeros(61, dtype=np.int32), "y": np.zeros(61, dtype=np.int32), "dim": np.full(61, 32), "cls": np.arange(61), "n": np.ones(61, dtype=np.int64), "codes": [c.tobytes() for c in codes], "scale": scale, "error": error, "raw": [r.tobytes() for r in raw]})
    sure, late = (embeddings._join(0.95, late)(t) for late in (False, True))
    total = dict.fromkeys(range(61), 0)
    for out in (sure, late):
        for c, n in zip(out.column("cls").to_pylist(), out.column("links").to_pylist(), strict=True):
            total[c] += n
    cos = raw @ raw.T / np.sqrt((raw * raw).sum(1)[:, None] * (raw * raw).sum(1))
    want = (cos >= 0.95).sum(1) - 1
    assert [total[i] for i in range(61)] == want.tolist() and sum(sure.column("doubt").to_pylist()) > 30 and 0 < want[0] < 60


def test_embedding_bound_holds():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 24)) * rng.lognormal(0, 2, (200, 1))
    codes, scale, error = embeddings.quantise(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    product = (codes.astype(np.float64) @ codes.T) * scale[:, None] * scale
    slack = (1 + error)[:, None] * error + error[:, None] * (1 + error) + error[:, None] * error
    assert (np.abs(unit @ unit.T - product) <= slack).all()


# ----------------------------------------------------------------- 10 toxicity
def test_machine_equals_plain_loops():
    """Scores by every pair of terms, and training by gradients term by term."""
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine({}, 0.3, rng.normal(0, 1, 6), rng.normal(0, 1, (6, 3)))
    for r in ([], [2], [0, 3], [1, 2, 4, 5]):
        z = m.bias + sum(m.weights[i] for i in r) + sum(float(m.vectors[i] @ m.vectors[j]) for i in r for j in r if i < j)
        assert m.scores([r])[0] == pytest.approx(1 / (1 + np.exp(-z)))
    x, y = (rng.random((40, 6)) < 0.5).astype(np.int8), (rng.random(40) < 0.4).astype(np.float64)
    bias, w, v = toxicity.fit(x, y, factors=2, epochs=4, seed=3)
    draws = np.random.default_rng(3)
    base = (y.sum() + 1) / 42
    p = {"b": float(np.log(base / (1 - base)))} | {("w", i): 0.0 for i in range(6)}
    start = draws.normal(0, 0.01, (6, 2))
    p |= {("v", i, f): float(start[i, f]) for i in range(6) for f in range(2)}
    first, second = dict.fromkeys(p, 0.0), dict.fromkeys(p, 0.0)
    for t in range(1, 5):
        draws.permutation(40)
        grad = dict.fromkeys(p, 0.0)
        for row, label in zip(x, y, strict=True):
            on = np.flatnonzero(row).tolist()
            z = p["b"] + sum(p["w", i] for i in on) + sum(p["v", i, f] * p["v", j, f] for i in on for j in on if i < j for f in range(2))
            g = (1 / (1 + np.exp(-z)) - label) / 40
            grad["b"] += g
            for i in on:
                grad["w", i] += g
                for f in range(2):
                    grad["v", i, f] += g * sum(p["v", j, f] for j in on if j != i)
        for k in p:
            grad[k] += 0.0 if k == "b" else 2e-3 * p[k] / (10 if k[0] == "w" else 1)
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            p[k] -= 0.05 * (first[k] / (1 - 0.9**t)) / ((second[k] / (1 - 0.999**t)) ** 0.5 + 1e-8)
    assert bias == pytest.approx(p["b"]) and w == pytest.approx([p["w", i] for i in range(6)]) and v.ravel().tolist() == pytest.approx([p["v", i, f] for i in range(6) for f in range(2)])


def test_toxicity_of_the_table(spark, sf, texts):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        on = {m.index[b] for word in set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))) for b in toxicity.buckets(word.encode()) if b in m.index}
        z = m.bias + sum(m.weights[j] for j in on) + sum(float(m.vectors[j] @ m.vectors[k]) for j in on for k in on if j < k)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.7)


def test_toxicity_learns_words_and_pairs(spark, edge, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words += ["slurx"] * insult + ["groupy"] * group
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    held = toxicity.score(docs, model).where(toxicity.held_out()).join(truth, "doc_id")
    wrong = held.where("predicted <> toxic").count()
    assert wrong <= 0.02 * held.count()
    out = toxicity.score(edge, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"] and out.count() == len(EDGE) and out.where("score between 0 and 1").count() == len(EDGE)
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(docs, truth.limit(0))
    assert toxicity.score(edge, blank).where("predicted = 1").count() == 0


def test_held_out_labels_never_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.index == b.index and a.bias == b.bias and np.array_equal(a.weights, b.weights)


# ----------------------------------------------------------------- components
def test_components_of_random_edges(spark):
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 400, (300, 2)).tolist()
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
