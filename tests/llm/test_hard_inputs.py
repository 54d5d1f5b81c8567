"""Operators on generated inputs with known answers, and on inputs that once crashed or stalled them."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from storelens.llm import extract, langid, markup, packing, quality, suffix, urls, warc
from storelens.llm.queries import BOUNDED, QUERIES, vocabulary
from tests.llm.test_methods import brute_suffix

PROSE = "the old house by the river was sold last year, and nobody, not even its owner, knew why it had stood empty for so long".split()


def sentence(rng, n):
    out = [rng.choice(PROSE) for _ in range(n)]
    for at in range(6, n, 7):
        out[at] += ","
    return " ".join(out) + "."


# Text extraction


def generated_page(rng, marked):
    """(html, main text): an article among menus, teasers, comments and a footer, with or without an article element or telling class names."""
    blocks = [sentence(rng, rng.randint(3, 8)).capitalize()] + [sentence(rng, rng.randint(25, 90)) for _ in range(rng.randint(2, 9))]
    head, *paragraphs = blocks
    inner = f"<h1>{head}</h1>" + "".join(rng.choice((f"<p>{p}</p>", f"<p>{p}", f"<p class=x>{p.replace(',', '&#44;')}</p>")) for p in paragraphs)
    menu = "".join(f'<li><a href="/{i}">{sentence(rng, 3)}</a></li>' for i in range(rng.randint(5, 12)))
    teasers = "".join(f'<div><a href="/t{i}">{sentence(rng, 9)}</a></div>' for i in range(6))
    opening, closing = rng.choice((("<article>", "</article>"), ("<main>", "</main>"))) if marked else rng.choice((("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")))
    page = f"<html><head><title>{sentence(rng, 4)}</title><style>p {{}}</style></head><body><nav><ul>{menu}</ul></nav><div><div>{teasers}</div>{opening}{inner}{closing}"
    page += f"<div class=comments><p>{sentence(rng, 40)}</p><p>{sentence(rng, 60)}</p></div></div><script>var a = '<p>{sentence(rng, 30)}</p>';</script><footer><p>{sentence(rng, 20)}</p></footer></body></html>"
    return page, " ".join(blocks)


@pytest.mark.parametrize("marked", [True, False])
def test_main_text_of_generated_pages(marked):
    rng = random.Random(11)
    pages = [generated_page(rng, marked) for _ in range(150)]
    wrong = [(p, w) for p, w in pages if extract.main_text(p) != w]
    assert not wrong, (len(wrong), wrong[0], extract.main_text(wrong[0][0]))


STALLED = {
    "unclosed blocks": "<div>" * 20_000 + "x</p>" * 20_000,
    "open quote": '<a href="' + "<p " * 60_000,
    "unclosed adverts": "<span class=ad>x" * 20_000,
    "unknown elements": "<x-y>" * 20_000 + "<p>a" * 20_000,
    "cells": "<table><tr><td>" * 20_000 + "<td>x" * 20_000,
    "unclosed sections": "<![CDATA[" * 60_000,
    "unbalanced quotes": '<a "x" ' * 60_000 + "'>'",
    "unclosed scripts": "<script>" * 50_000,
    "references": "&" * 200_000 + "&#" * 100_000 + "&#" + "9" * 10_000 + ";",
    "attributes": "<p " + 'class="' * 100_001 + ">x</p>",
    "white space": " \n" * 1_000_000,
    "long tag": "<meta content=" + "a" * 3_000_000 + ">",
}


@pytest.mark.parametrize("name", sorted(STALLED))
def test_damaged_pages_take_linear_time(name):
    begin = time.perf_counter()
    extract.main_text(STALLED[name])
    urls.named_links(STALLED[name])
    assert time.perf_counter() - begin < 10


def test_attributes_and_references():
    assert markup.attributes("""A="1" b='x y' c=&amp;z d e = "f" a=2 <junk """) == {"a": "1", "b": "x y", "c": "&z", "d": "", "e": "f", "<junk": ""}
    assert markup.decoded("&#0000065;&#x41;&#99999999999;&lt;&nosuch;") == "AA�<&nosuch;"


# URL filters


def test_links_are_read_outside_comments_and_scripts():
    page = """<!-- <link rel=canonical href=http://no/> --><script>'<link rel="canonical" href="http://no/">'</script>
    <LINK title="a > b" REL='x Canonical' href="http://yes/?a=1&amp;b=2"><meta http-equiv=refresh content="3; URL='http://next/'"><link rel=canonical href="">"""
    assert urls.named_links(page) == ["http://yes/?a=1&b=2", "http://next/"]


def test_aliases_in_chains_and_stars_of_many_pages(spark):
    """3,000 pages in groups of 1 to 400 URLs, against union-find; some links are relative, some targets no page."""
    rng = random.Random(8)
    rules = (urls.Rule("block", "bad.example", "/x/"), urls.Rule("allow", "good.example", "/"))
    pages, groups, n = [], [], 0
    while n < 3000:
        size = min(3000 - n, rng.choice((1, 1, 2, 3, 10, 400)))
        own = [f"http://{rng.choice(('a.example', 'b.example', 'good.example', 'sub.good.example'))}/g{len(groups)}/p{i}" for i in range(size)]
        if rng.random() < 0.3:
            own[rng.randrange(size)] = f"http://bad.example/x/{len(groups)}"
        shape, order = rng.choice(("chain", "star")), rng.sample(range(size), size)
        for rank, i in enumerate(order):
            target = own[order[rank + 1] if shape == "chain" and rank + 1 < size else order[0]]
            if own[i].split("/")[2] == target.split("/")[2] and rng.random() < 0.5:
                target = "/" + target.split("/", 3)[3]
            link = f'<link rel="canonical" href="{target}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={target}">'
            pages.append((n, own[i], f"<html><head><title>x</title>{link}</head><body>{sentence(rng, 30)}</body></html>"))
            n += 1
        groups.append(own)
    blocked = {u for own in groups if any(u.startswith("http://bad.example/x/") for u in own) for u in own}
    want = {i: "allow" if "good.example" in u else "block" if u in blocked else "allow" for i, u, _ in pages}
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert {r.page_id: r.verdict for r in got.collect()} == want and "block" in want.values()


def test_a_page_with_a_long_tag_is_judged(spark):
    pages = [(1, "http://a/", "<meta content=" + "a" * 1_000_000 + '><link rel=canonical href="http://bad/">'), (2, "http://b/", "<link " + 'x="y" ' * 50_000 + ">")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), (urls.Rule("block", "bad", "/"),))
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


# WARC


def test_a_url_cannot_end_its_header_line(spark, tmp_path):
    bad = ["http://a/\r\nContent-Length: 3\r\n", "http://b/\r\nWARC-Payload-Digest: sha1:NONE", "http://c/\r\n\r\n\x00\x7f", "plain"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(bad)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    assert {r.record_id: r.payload_bytes for r in warc.parse_records(records).collect()} == dict.fromkeys(range(4), 8)
    named = {r.record_id: r.t for r in records.select("record_id", warc.header_field(F.col("header"), "WARC-Target-URI").alias("t")).collect()}
    assert named[0] == "http://a/%0D%0AContent-Length: 3%0D%0A" and named[2] == "http://c/%0D%0A%0D%0A%00%7F" and named[3] == "plain"


# Packing


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "\n" * 5_000_000 + "b", "a" * 10_000_000, "ab \n" * 1_000_000, ("x" + " " * 4000) * 300, ("y" + " " * 255) * 4000], ids=range(6))
def test_ids_of_very_long_texts_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    encode = packing.Encoder(vocabulary())
    begin = time.perf_counter()
    got = encode(text)
    assert time.perf_counter() - begin < 40  # a second or two a million characters
    assert got.tolist() == Tokenizer.from_str(vocabulary().tokenizer_json).encode(text, add_special_tokens=False).ids


def fewest_bins(lengths, capacity):
    """The optimum by trying for every piece each bin that can take it, and one new bin."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        n = lengths[i]
        for b in {tuple(b): k for k, b in enumerate(bins)}.values():
            t, d, a = bins[b]
            if t + n <= capacity.tokens and d + 1 <= capacity.documents and a + n * n <= capacity.attention:
                place(i + 1, [*bins[:b], (t + n, d + 1, a + n * n), *bins[b + 1 :]])
        place(i + 1, [*bins, (n, 1, n * n)])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_is_near_the_optimum(rule):
    rng = np.random.default_rng(3)
    ours = best = 0
    for capacity in (packing.Capacity(100, 100, 10_000), packing.Capacity(100, 3, 10_000), packing.Capacity(100, 4, 3000)):
        for _ in range(12):
            lengths = np.sort(rng.integers(5, 54, 10))[::-1]
            bins = packing.best_fit(lengths, capacity, (1.0, 0.5, 0.5), rule)[0]
            n, least = len(set(bins.tolist())), fewest_bins(lengths.tolist(), capacity)
            assert least <= n <= least + 1
            ours, best = ours + n, best + least
    assert ours <= 1.05 * best


def test_each_capacity_decides_for_some_sequences(spark, sf_dir):
    rows = QUERIES["packing_capacities"](spark, sf_dir).toPandas()
    rows["cost"] = rows["length"] ** 2
    per = rows.groupby("sequence_id").agg(tokens=("length", "sum"), documents=("length", "size"), attention=("cost", "sum"))
    assert (per["tokens"] <= BOUNDED.tokens).all() and (per["documents"] <= BOUNDED.documents).all() and (per["attention"] <= BOUNDED.attention).all()
    lengths = np.sort(rows["length"].to_numpy())[::-1]
    sequences = lambda capacity: len(set(packing.best_fit(lengths, capacity, (1.0, 1.0, 1.0), "dot")[0].tolist()))
    assert all(sequences(BOUNDED._replace(**{name: 1 << 40})) < sequences(BOUNDED) for name in BOUNDED._fields)
    offsets = rows.sort_values("offset").groupby("sequence_id")
    assert all(o["offset"].tolist() == [0, *o["length"].cumsum().tolist()[:-1]] for _, o in offsets)


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(7, "the same words")] * 400, "doc_id long, text string")
    rows = packing.tokenize_and_pack(docs, vocabulary(), group=50).toPandas()
    assert len(rows) == 400 and (rows["sequence_id"] // (1 << 24)).nunique() > 4


# Quality


@pytest.fixture(scope="module")
def graded(spark):
    """Good and bad texts, one text in half of all rows, and texts of a megabyte."""
    rng = random.Random(4)
    good = [" ".join(rng.choice(PROSE) for _ in range(rng.randint(20, 200))) for _ in range(120)]
    bad = [" ".join(rng.choice(("buy", "now", "$$$", "click", "win", "free", "!!!")) for _ in range(rng.randint(20, 200))) for _ in range(120)]
    good[0], bad[0] = " ".join(rng.choice(PROSE) for _ in range(220_000)), "win free click " * 70_000
    texts = [*((t, 1) for t in good), *((t, 0) for t in bad), *[(good[5], 1)] * 240]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(texts)], "doc_id long, quality int")
    return docs, labels, texts


def test_quality_scores_equal_compression_by_hand(graded):
    docs, labels, texts = graded
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    size = {}
    for name, dictionary in (("good", model.good), ("bad", model.bad)):
        parameters = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
        with_dictionary = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=parameters)
        size[name] = lambda raw, c=with_dictionary: len(c.compress(raw))
    for i, (text, _) in enumerate(texts[:240]):
        raw = text.encode()
        cut = [raw[k : k + model.piece] for k in range(0, len(raw), model.piece)]
        saved = sum(size["bad"](p) - size["good"](p) for p in cut)
        x = (saved + model.usual * model.prior) / (len(raw) + model.prior)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.slope * x + model.offset)))) < 1e-9
    assert all((got[i] >= 0.5) == bool(q) for i, (_, q) in enumerate(texts))


def test_quality_fit_takes_bounded_pieces_of_different_texts(graded):
    docs, labels, texts = graded
    rows, counts = quality._chosen_texts(docs, labels, "doc_id", "text", "quality", 3000)
    assert counts == {0: 120, 1: 360} and rows.count() == 240
    taken = quality._sampled_pieces(rows, 1, 512, 50)
    assert len(taken) == 50 and all(len(p) <= 512 for p in taken)


# Language


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(6)
    chinese, thai = "我们今天去公园散步然后回家吃饭看书睡觉学习工作朋友", "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ"
    rows = []
    for i in range(40):
        rows += [("zh", "".join(rng.choice(chinese) for _ in range(rng.randint(30, 400)))), ("th", "".join(rng.choice(thai) for _ in range(rng.randint(30, 400)))), ("en", " ".join(rng.choice(PROSE) for _ in range(50)))]
    rows += [rows[2]] * 120  # one text in half of all rows
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def tongue_model(tongues):
    import public_tokenizers

    return langid.fit(tongues, langid.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def test_languages_without_spaces_are_learned(spark, tongues, tongue_model):
    rows = langid.predict(tongues, tongue_model, ["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred for r in rows)
    long = spark.createDataFrame([(1, "我们今天散步" * 30_000), (2, "ธนบปผพ" * 100)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(long, tongue_model, ["doc_id"]).collect()} == {1: "zh", 2: "th"}


def test_predictions_equal_sums_over_all_segmentations(spark, tongue_model):
    """Whole texts against a recursion over Python strings and the vocabulary file's own list."""
    import public_tokenizers

    pieces = langid.read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    number = {piece: i for i, piece in enumerate(tongue_model.pieces, 1)}
    share = {piece: tongue_model.probability[number[piece]] for piece in pieces}  # every one of the file's
    assert len(number) == len(share) + (b" " not in share) and np.allclose(tongue_model.probability.sum(axis=0), 1) and (tongue_model.probability[1:] > 0).all()

    def word(raw):
        sums = [np.ones(len(tongue_model.languages))] + [np.zeros(len(tongue_model.languages)) for _ in raw]
        for begin, end in itertools.combinations(range(len(raw) + 1), 2):
            if raw[begin:end] in share:
                sums[end] = sums[end] + sums[begin] * share[raw[begin:end]]
            elif end == begin + 1 and not tongue_model.codes[raw[begin]]:
                sums[end] = sums[end] + sums[begin] * tongue_model.unknown
        return np.log(sums[-1])

    texts = ["the owner knew", "公园散步 the river", "Why it stood zq?", "ปผพฟ house", "quantum chromodynamics", "xylophone jazz", "guten tag", "привет мир"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tongue_model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        total = sum(word(b" " + w.encode()) for w in text.lower().split())
        posterior = np.exp(total - total.max())
        posterior /= posterior.sum()
        assert got[i][0] == tongue_model.languages[int(posterior.argmax())] and abs(got[i][1] - posterior.max()) < 1e-9


def test_long_words_score_alike_either_way(tongue_model):
    raw = ("我们公园the owner" * 40).replace(" ", "").encode()
    data = np.frombuffer(raw, np.uint8)
    side_by_side = langid._forward(langid._matrix(data, np.array([0]), np.array([len(data)]), tongue_model), tongue_model)[0]
    assert np.allclose(side_by_side, langid._forward_long(raw, tongue_model, langid._steps(tongue_model)))


# Repeated strings


def test_repeated_strings_with_text_keys_and_a_hot_string(spark):
    rng = random.Random(12)
    hot = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = {f"id{i}": "".join(rng.choice("uvwxyz ") for _ in range(rng.randint(0, 150))) + (hot if i % 3 == 0 else "") + "".join(rng.choice("uvwxyz ") for _ in range(rng.randint(0, 150))) for i in range(300)}
    rows |= {f"copy{i}": rows["id1"] + hot[: 150 + i] for i in range(60)}
    df = spark.createDataFrame(list(rows.items()), "doc_id string, text string").repartition(5)
    want = brute_suffix({k: t.encode() for k, t in rows.items()}, 200)
    for batches in (1, 3, 7):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_strings(df, batches=batches).collect()}
        assert got == want


def test_repeated_strings_with_ids_that_stand_for_several_texts(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(400)
    rows = [(None, shared + text(900)), (None, text(30)), (None, shared[:250]), (5, text(10) + shared[:300]), (5, shared), (6, None), (6, "")]
    got = suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len(t or "") for _, t in rows)
