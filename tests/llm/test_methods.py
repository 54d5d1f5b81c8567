"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storelens.llm import components, decontam, extract, langid, media, neardup, packing, quality, suffix, urls, warc
from storelens.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from tests.compare import assert_same, views

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), views(sf_dir).execute(ORACLE_SQL[name]).df())


# Media


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=5000))
def test_media_round_trip(raw):
    stored = media.store_payload(media.pad(raw))
    assert media.read_media([stored])[0][0] == media.pad(raw).tobytes()


@pytest.mark.parametrize("n", [196_416, 196_417, 5_000_001])
def test_media_keeps_long_payloads_in_one_frame(n):
    raw = np.random.default_rng(0).integers(0, 256, n, dtype=np.uint8).tobytes()
    stored = media.store_payload(media.pad(raw))
    assert len(list(media.parse_frames(stored))) == 1
    samples, width, height, _ = media.read_media([stored])[0]
    assert samples == media.pad(raw).tobytes() and max(width, height) <= 65_528


def test_damaged_media_have_an_error_and_spoil_no_others(spark):
    good = media.store_payload(media.pad(b"text " * 500))
    bad = [good[:-100], good[:300], b"", b"junk", good.replace(b"\xff\xc0", b"\xff\xc2")]
    rng = random.Random(2)
    for _ in range(40):
        scratched = bytearray(good)
        scratched[rng.randrange(len(good))] ^= 1 << rng.randrange(8)
        bad.append(bytes(scratched))
    df = spark.createDataFrame([(0, good), *((i, m) for i, m in enumerate(bad, 1)), (99, good)], "id long, media binary")
    rows = {r.id: r for r in media.media_features(df, ["id"]).collect()}
    assert len(rows) == len(bad) + 2 and rows[0].error is None and rows[99].payload_sha256 == rows[0].payload_sha256
    assert all(rows[i].error and rows[i].payload_sha256 is None and rows[i].media_bytes == len(bad[i - 1]) for i in range(1, 6))


def _bits(*pairs):
    text = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_media_reads_colour_with_ac_coefficients():
    """4:2:0, 16 x 32 pixels, no restarts: two MCUs of four luminance and two chroma blocks."""
    dc = media._dht(0x00, [0, 0, 0, 12] + [0] * 12, list(range(12)))
    ac = media._dht(0x10, [0, 2, 1] + [0] * 13, [0x00, 0x02, 0xF0])
    rng = random.Random(4)
    bits, want, last = [], [[], [], []], [0, 0, 0]
    for _ in range(2):
        for c in (0, 0, 0, 0, 1, 2):
            value = rng.randint(-100, 100)
            d, last[c] = value - last[c], value
            size = abs(d).bit_length()
            bits += [(size, 4), (d if d >= 0 else d + (1 << size) - 1, size)]
            for _ in range(rng.randint(0, 5)):
                bits += [(1, 2), (rng.randint(2, 3), 2)]  # a coefficient of two bits
            bits.append((0, 2))
            want[c].append(min(255, max(0, value * 8 // 8 + 128)))
    size = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 32, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    scan = b"\xff\xda" + bytes([0, 12, 3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    jpeg = b"\xff\xd8" + media._QUANTISER + size + dc + ac + scan + _bits(*bits) + b"\xff\xd9"
    frames = list(media.parse_frames(jpeg))
    got = media.decode_dc(frames, [np.frombuffer(jpeg, np.uint8)])[0]
    assert [g.tolist() for g in got] == want
    grid = media.thumbnail(frames[0], got[0])
    y = want[0]
    assert grid.tolist() == [[y[0], y[1]], [y[2], y[3]], [y[4], y[5]], [y[6], y[7]]]


def test_media_refuses_progressive():
    bad = media.store_payload(media.pad(b"x")).replace(b"\xff\xc0", b"\xff\xc2")
    with pytest.raises(ValueError):
        media.read_media([bad])


def test_null_medium_has_null_features(spark):
    df = spark.createDataFrame([(1, None)], "id long, media binary")
    assert media.media_features(df, ["id"]).first().payload_bytes is None


# Quality and language


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op2_quality"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_quality_without_labels_of_one_class(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality.score(docs, quality.fit(docs, labels), ["doc_id"]).collect()} == {0.999}


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op9_language"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_forward_sums_all_segmentations():
    model = langid._empty_model(["x", "y"], [b"a", b"ab", b"b", b"bc", b"abc", b" a"], [0x20, 97, 98, 99])
    p = np.random.default_rng(2).random(model.probability.shape)
    p[0] = 0
    model = model._replace(probability=p)
    share = {piece: p[i + 1] for i, piece in enumerate(model.pieces)}

    def total(word):
        return np.ones(2) if not word else sum(share[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in share)

    for word in (b"abcab", b"a", b"abcabcabcabcabcabcabc"):
        data = np.frombuffer(word, np.uint8)
        got = langid._forward(langid._matrix(data, np.array([0]), np.array([len(word)]), model), model)[0]
        assert np.allclose(got, np.log(total(b" " + word)))


# Text extraction


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>one &amp; two<br>three</p><script>x('<p>no</p>')</script>", "one & two three"),
        ("<body><nav><a href=/>Home, and more, of it, here it is</a></nav><article><h1>Title</h1><p>A sentence, long enough to count, stands here.</p></article><footer>(c), all rights, reserved, for ever</footer>", "Title A sentence, long enough to count, stands here."),
        ("<div class=main><p>First part, of the text, is here now.<p>Second part, of the text, is here too.</div><div class=comments><p>I, for one, like this text a lot, really.</div>", "First part, of the text, is here now. Second part, of the text, is here too."),
        ("<div><p>x<b>y</b>z&nbsp;\n w</p></div>", "xyz w"),
        ("<p>a<!-- <p>b</p> -->c</p>", "ac"),
        ("<form><p>Join us, please, it is free, and quick.</p></form>", ""),
    ],
)
def test_main_text(page, want):
    assert extract.main_text(page) == want


# Repeated strings


def brute_suffix(texts, length):
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for k, t in texts.items():
        marks = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[k] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3, 4, 7])
def test_suffix_equals_brute_force(docs, texts, batches):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_strings(docs, batches=batches).collect()}
    assert got == brute_suffix({k: t.encode() for k, t in texts.items()}, 200)


def test_suffix_on_small_alphabets(spark):
    """Many overlaps, periods and partial copies of a short length."""
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    rows = {i: "".join(rng.choice(parts)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6))) + "x" * rng.randint(0, 50) for i in range(60)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_strings(df, length=24, gram=6, batches=3).collect()}
    assert got == brute_suffix({k: t.encode() for k, t in rows.items()}, 24)


def test_levels_grow_geometrically(spark, docs):
    family = suffix.SuffixFamily(spark)
    named = docs.select(F.col("doc_id").alias("doc"), "text")
    for b in range(5):
        family.insert(named.where(F.pmod("doc", F.lit(5)) == b))
    assert sorted(family.levels) == [0, 2]
    family.drop()


def test_kept_text_has_whole_characters(spark):
    rows = [(0, "é" * 150 + "tail"), (1, "x" + "é" * 150 + "other")]
    got = suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert {r.doc_id: r.kept for r in got.collect()} == {0: "tail", 1: "xother"}


# Near duplicates


def brute_components(texts):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t.encode().translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in texts}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            where[g].append(k)
    pairs = {(a, b) for ks in where.values() for i, b in enumerate(ks) for a in ks[:i]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in texts}


def test_neardup_equals_brute_force(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)


def test_neardup_in_a_large_group_of_loose_copies(spark, monkeypatch):
    """Copies near the threshold, which one centre cannot settle, also by blocks."""
    monkeypatch.setattr(neardup, "LISTED", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for i in range(80):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([2, 4, 5, 6, 8])):
            own[at] = f"x{i}_{at}"
        rows[i] = " ".join(own)
    got = neardup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_components(rows)


def test_sketches_never_refuse_similar_sets():
    rng = np.random.default_rng(6)
    a = neardup.random_words(1, 128 * 3).astype(np.uint64)
    ones, twos = (a[:384] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (a[:384] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    limit = neardup.most_different(384, 0.75)
    for n in (30, 300, 3000):
        for _ in range(20):
            union = rng.integers(0, 2**63, n, dtype=np.uint64)
            x, y = union[: int(n * 0.875)], union[int(n * 0.125) :]
            samples = np.stack([neardup.minhashes(s, ones, twos) for s in (x, y)])
            sketch = neardup._sketch_columns(samples, 6)[1].view(np.uint64)
            assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= limit


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, edges):
    parent = list(range(26))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in nodes}


# Decontamination


def test_decontamination_finds_copies_and_paraphrases(spark, sf_dir, docs, texts):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    rng = random.Random(1)
    planted, rows = set(), []
    for n, (item, text) in enumerate(sorted(items.items())[:20]):
        own = text.split()
        for at in rng.sample(range(len(own)), len(own) // 6):
            own[at] = f"swapped{at}"
        rows.append((10_000 + n, f"filler before it {n} " * 30 + " ".join(own) + " and filler after it" * 30, "en"))
        planted.add((10_000 + n, item))
    exact = {(k, i) for k, t in texts.items() for i, q in items.items() if plain(q) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs.unionByName(spark.createDataFrame(rows, docs.schema)), benchmark).collect()}
    assert exact <= got and len(got & planted) >= 0.9 * len(planted) and not got - exact - planted


def test_search_equals_exact_cosine(spark, sf_dir, docs, texts):
    """The latent cosine of every passage with every item passage, against TF-IDF vectors over dictionaries."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    settings_ = decontam.Settings()
    named = docs.select(F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    items = list(decontam.item_blocks(benchmark, settings_))
    known = decontam.statistics(named, items, settings_)
    [block] = items
    space = decontam.fit_space(known, block, settings_)
    weight = dict(zip(space.features.tolist(), space.weight.tolist(), strict=True))

    def vector(ws):
        v = Counter(w for w in ws.tolist() if w in weight)
        v = {w: n * weight[w] for w, n in v.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()} if norm else {}

    asked = [vector(block.words[i][a:b]) for i, a, b in block.passages]
    exact, got = {}, {}
    for k in sorted(texts)[:60]:
        data = np.frombuffer(texts[k].lower().encode(), np.uint8)
        w = decontam._words(data, np.array([0, len(data)]))
        for begin in range(0, len(w.hashes), settings_.window // 2):
            own = vector(w.hashes[begin : begin + settings_.window])
            if not set(weight).isdisjoint(w.hashes[begin : begin + settings_.window // 2].tolist()):
                for q, other in enumerate(asked):
                    cosine = sum(x * other.get(f, 0.0) for f, x in own.items())
                    exact[k, begin, q] = cosine
        if len(data):
            for _, first, q, cosine in decontam._candidates(decontam._featured(w, space.features, space.present), space, settings_):
                got[k, first, q] = cosine
    assert {p for p, c in exact.items() if c >= settings_.cosine + 0.01} <= set(got)
    assert got and all(abs(exact[p] - c) < 0.01 and c <= 1 for p, c in got.items())


def test_a_passage_of_few_words_over_and_over_has_a_true_cosine(spark):
    benchmark = spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 10), (2, "unlike " * 9), (3, None), (4, "")], "doc_id long, text string")
    [row] = decontam.contaminated(docs, benchmark).collect()
    assert row.doc_id == 1 and 0.99 <= row.cosine <= 1


def _reworded(own, kind, rng):
    """Copies altered in one of three ways, with what they keep of the item in order."""
    out = list(own)
    if kind == "swapped":  # single words replaced
        for at in rng.sample(range(len(own)), len(own) // 4):
            out[at] = f"other{at}"
    elif kind == "inserted":  # words put between
        for at in sorted(rng.sample(range(len(own)), len(own) // 3), reverse=True):
            out.insert(at, f"more{at}")
    else:  # a clause moved to the end
        at, n = len(own) // 3, len(own) // 4
        out = own[:at] + own[at + n :] + own[at : at + n]
    return out


@pytest.mark.parametrize("kind", ["swapped", "inserted", "moved"])
def test_recall_of_paraphrases(spark, sf_dir, docs, kind):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rng = random.Random(7)
    asked = [(r.item_id, r.text.split()) for r in benchmark.collect()]
    rows = [(50_000 + i, " ".join([*[f"before{n}" for n in range(rng.randint(0, 60))], *_reworded(own, kind, rng), *["after it"] * 20]), "en") for i, own in asked]
    planted = spark.createDataFrame(rows, docs.schema)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs.unionByName(planted), benchmark).collect()}
    assert sum((50_000 + i, i) in got for i, _ in asked) >= 0.9 * len(asked)
    assert not {(d, i) for d, i in got if d >= 50_000 and d != 50_000 + i}


def test_a_text_with_very_many_copies_is_sampled_once(spark):
    hot = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(hot,)] * 500 + [(f"alpha beta number {i}",) for i in range(50)], "text string")
    [block] = decontam.item_blocks(spark.createDataFrame([(0, hot + " eta theta")], "item_id long, text string"), decontam.Settings())
    assert decontam.statistics(docs, [block], decontam.Settings()).rows <= 51


def test_the_basis_is_fitted_on_all_passages(spark, monkeypatch):
    """Far more documents than were sampled; the Gram matrix against dense products, in one band and in several."""
    rng = random.Random(4)
    kinds = [f"w{i}" for i in range(40)]
    texts = sorted({" ".join(rng.choices(kinds, k=rng.randint(1, 90))) for _ in range(3000)})
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "text string").repartition(3)
    settings_ = decontam.Settings()
    [block] = decontam.item_blocks(spark.createDataFrame([(0, " ".join(kinds[:30])), (1, " ".join(kinds[20:35]))], "item_id long, text string"), settings_)
    known = decontam.statistics(docs, [block], settings_)
    number = {h: i for i, h in enumerate(known.features.tolist())}
    rows = []
    for t in texts:
        hashes = decontam._hashes([t])[0].tolist()
        for a in range(0, len(hashes), settings_.window):
            own = [number[h] for h in hashes[a : a + settings_.window] if h in number]
            if len(set(own)) > 1:
                rows.append(np.bincount(own, minlength=len(number)) * known.weight)
    dense = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    v = np.random.default_rng(1).random((len(number), 3))
    assert known.rows == len(rows) > 3000
    for limit in (decontam.GRAM_BYTES, 8 * len(number) ** 2 // 3):
        monkeypatch.setattr(decontam, "GRAM_BYTES", limit)
        assert np.allclose(decontam._times(decontam._gram(known.passages, np.arange(len(number)), known.weight), v), dense.T @ (dense @ v), rtol=1e-4)


def test_decontamination_in_several_blocks(spark, sf_dir, docs):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole, cut = ({(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark, x).collect()} for x in (decontam.Settings(block=1024), decontam.Settings(block=20, space_bytes=1 << 20)))
    assert whole == cut


def test_altered_copies_of_full_blocks_are_found(spark):
    rng = random.Random(5)
    kinds = [f"w{i}" for i in range(5000)]
    items = [rng.choices(kinds, k=rng.randint(30, 60)) for _ in range(560)]
    rows = [(n, rng.choices(kinds, k=200)) for n in range(150)]
    for n, own in enumerate(items[::2]):
        altered = [w if rng.random() < 0.65 else rng.choice(kinds) for w in own]
        rows.append((1000 + n, [*rng.choices(kinds, k=rng.randint(0, 80)), *altered, *rng.choices(kinds, k=40)]))
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in rows], "doc_id long, text string").coalesce(4)
    benchmark = spark.createDataFrame([(n, " ".join(t), " ".join(t[::5])) for n, t in enumerate(items)], "item_id long, text string, answer string")
    assert max(len(b.passages) for b in decontam.item_blocks(benchmark, decontam.Settings())) > 500
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark, answer="answer").collect()}
    coded = lambda t: np.array([int(w[1:]) for w in t], np.uint64)
    brute = set()
    for doc, text in rows:
        for n, own in enumerate(items):
            if len(set(own).intersection(text)) > 10:  # fewer cannot be half of an item
                lcs = decontam.common_subsequence(coded(own), coded(text)) / len(own)
                if lcs >= 0.75 or (lcs >= 0.5 and len(set(own[::5]).intersection(text)) >= 0.6 * len(set(own[::5]))):
                    brute.add((doc, n))
    recall = len(brute & got) / len(brute)
    assert len(brute) > 100 and recall >= 0.97, (recall, len(brute))


def test_short_items_of_a_template_are_found_in_topical_text(spark):
    rng = random.Random(9)
    template = [f"tpl{i}" for i in range(10)]
    asked = [[f"left{n}", *template, f"right{n}"] for n in range(60)]
    topical = [[f"top{n}x{i}" for i in range(50)] for n in range(60)]
    kinds = [w for own in topical for w in own]
    rows = [(n, " ".join([*rng.sample(kinds, 31 + n), *asked[n], *rng.sample(kinds, 60)])) for n in range(5)]
    rows += [(100 + n, f"plain{n} text of its own " * 10) for n in range(400)]
    benchmark = spark.createDataFrame([(n, " ".join(own)) for n, own in enumerate(asked + topical)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert {(n, n) for n in range(5)} <= got and not {d for d, _ in got if d >= 100}


def test_words_scattered_over_a_long_text_are_no_copy(spark):
    rng = random.Random(3)
    own = [f"q{i}" for i in range(30)]
    clean = []
    for w in own:  # each word in order, thirty words apart, between other words of the item out of order
        clean += [w, *(rng.choice(own) if rng.random() < 0.3 else f"x{rng.randint(0, 400)}" for _ in range(29))]
    rows = [(1, " ".join(clean)), (2, " ".join([*clean[:300], *own[:10], "a", "b", *own[10:], *clean[300:600]])), (3, "something else " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, " ".join(own))], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, benchmark).collect()} == {2}


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontam.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


# Packing


def test_ids_equal_the_tokenizer(docs, texts):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_str(vocabulary().tokenizer_json)
    encode = packing.Encoder(vocabulary())
    for text in [*list(texts.values())[:40], "a b c\u0085d", "it's <|endoftext|> so", "日本 ١٢٣ ½ \U0001f600", "\x1c\x1d x"]:
        assert encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_is_tight(spark):
    rows = QUERIES["op6_packing"](spark, MEDIUM).toPandas()
    assert rows["sequence_id"].nunique() <= 1.01 * -(-rows["length"].sum() // 2048)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 100, 400))[::-1]
    capacity = packing.Capacity(120, 3, 9000)
    bins, offsets = packing.best_fit(lengths[lengths**2 <= 9000], capacity, (1.0, 0.5, 0.5), rule)
    lengths = lengths[lengths**2 <= 9000]
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 120 and len(own) <= 3 and (own**2).sum() <= 9000
        assert offsets[bins == b].tolist() == [0, *np.cumsum(own)[:-1]]


def test_impossible_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), packing.Capacity(20, 5, 50), packing.WEIGHTS, "norm")


# WARC and URLs


def test_records_are_rebuilt_byte_for_byte(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>ü</p>"), (2, "http://b/", "<p>ü</p>"), (3, None, None)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"), revisit_from=1)
    rows = {r.record_id: bytes(r.record) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert rows[2].endswith(b"Content-Length: 9\r\n\r\n<p>\xc3\xbc</p>\r\n\r\n") and rows[2].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert b"WARC-Refers-To: <urn:page:2>" in rows[1] and rows[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 2
    assert {r.record_id: r.record_type for r in warc.parse_records(warc.read_archive(spark, str(tmp_path / "w"))).collect()} == {1: "revisit", 2: "response", 3: "response"}


def test_a_page_without_a_key_keeps_its_payload(spark, tmp_path):
    pages = spark.createDataFrame([(None, "http://a/", "<p>alone</p>"), (1, "http://b/", "<p>x</p>")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    rows = warc.parse_records(warc.read_archive(spark, str(tmp_path / "w"))).collect()
    assert {(r.record_id, r.record_type, r.payload_bytes) for r in rows} == {(None, "response", 12), (1, "response", 8)}


def test_damaged_payload_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    good = spark.read.parquet(str(tmp_path / "w" / "payloads"))
    good.select("sha256", F.lit(bytearray(b"changed")).alias("payload")).write.parquet(str(tmp_path / "w2" / "payloads"))
    spark.read.parquet(str(tmp_path / "w" / "records")).write.parquet(str(tmp_path / "w2" / "records"))
    with pytest.raises(Exception, match="differs from digest"):
        warc.read_archive(spark, str(tmp_path / "w2")).collect()


def test_blocks_spread_to_aliases_but_not_over_allows(spark):
    rules = (urls.Rule("block", "bad.example", "/"), urls.Rule("allow", "good.example", "/"))
    pages = [(1, "http://bad.example/x", ""), (2, "http://a.example/1", '<link rel="canonical" href="http://bad.example/x">'), (3, "http://b.example/2", "<meta http-equiv='refresh' content='5;url=http://a.example/1'>"), (4, "http://good.example/", '<LINK href=http://bad.example/x rel="Canonical">'), (5, "http://c.example/p/q", '<link rel="canonical" href="/other">'), (6, "http://d.example/", '<link rel="stylesheet" href="http://bad.example/x">')]
    redirects = spark.createDataFrame([("http://c.example/other", "http://bad.example/x")], "u string, v string")
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, redirects)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}
