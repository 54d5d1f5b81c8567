"""Phrase collocations against counts of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from storelens.llm import phrases
from storelens.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same, views

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, support, top):
    f: dict = {}
    n = Counter()
    for text, lang in docs:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= support}
        held = {(g[i:j], a) for g, a in often.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g)}
        rows = []
        for g, a in often.items():
            if (g, a) not in held:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), a, left, right, n[lang], -s) for i, (s, _, p, a, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed=1, n=400):
    """Skewed words, repeats inside a phrase, shared passages, one word over and over, odd characters."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    made = [(" ".join(words[min(int(r.expovariate(0.25)), 29)] + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None])) for _ in range(n)]
    made += [("The same passage comes Again and again, here", "en")] * 12 + [("la " * 3000, "fr"), (None, "en"), ("", None), (" \t ", "en"), ("Été\x1fü\x00 été\x1fü\x00 x\x0by", "fr"), ("a b a b a b a b a", "und"), ("..;;!?", "de")]
    return made


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"block": 4}, {"dictionary": 5}, {"dictionary": 5, "block": 50}])
def test_equals_counts_of_all_phrases(spark, options):
    """With pivots in one part and in many, with and without the dictionary of words."""
    docs = texts()
    assert found(phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(6), support=4, top=60, **options)) == plain(docs, 4, 60)


def test_small_chunks_give_the_same(spark, monkeypatch):
    """Groups of a pivot that go on over batches are mined whole."""
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(phrases, "FRAGMENTS_AT_ONCE", 20)
    docs = texts(2, 150)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert found(phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), support=3, top=1000)) == plain(docs, 3, 1000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_products_beyond_64_bits(spark):
    """A score whose product needs more than 64 bits is exact."""
    from pyspark.sql import functions as F

    a, n, side = 9_000_000_000_001, 2_000_000_000_000_003, 9_000_000_000_777
    words = spark.createDataFrame([("en", "x", side, 0), ("en", "y", side, 1)], "lang string, word string, f long, id long")
    grams = spark.createDataFrame([([0, 1], a)], "gram array<long>, a long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert phrases._scored(grams, words, totals).select(F.col("score")).first()[0] == 1000 * a * n // (side * side)


def test_hashes_that_meet_do_not_mix_rows(monkeypatch):
    import numpy as np

    monkeypatch.setattr(phrases, "_mixed", lambda rows: np.zeros(len(rows), dtype=np.uint64))
    rows = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [0, 9]])
    order, starts = phrases._runs(rows)
    assert [rows[order[i]].tolist() for i in starts] == [[0, 9], [1, 2], [3, 4]] and np.diff([*starts, 5]).tolist() == [1, 2, 2]


def test_query_equals_sql(spark):
    import os

    sf_dir = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").rstrip("/")), "sf0.01")
    assert_same(QUERIES["op12_phrases"](spark, sf_dir).toPandas(), views(sf_dir).execute(ORACLE_SQL["op12_phrases"]).df())
