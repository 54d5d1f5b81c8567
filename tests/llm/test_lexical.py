"""Ranked lexical search against a plain scan of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from storelens.llm import lexical
from storelens.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same, views

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, sf_dir):
    assert_same(QUERIES["op11_search"](spark, sf_dir).toPandas(), views(sf_dir).execute(ORACLE_SQL["op11_search"]).df())


@pytest.mark.parametrize("block", [3, 10_000])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_equals_a_plain_scan(spark, k, block):
    """Skewed words, long texts, ties, copies and lists of every length; block=3 deals even short lists over many tasks."""
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(words[(i * i + j * (1 + i % 7)) % 40 if (i + j) % 3 else 0] for j in range(i % 23))) for i in range(300)]
    docs += [(900, "W1 w2,w3-w4"), (900, "W1 w2,w3-w4"), (901, "rare w1"), (None, "rare w2"), (902, None), (903, ""), (904, "w5 " * 20_000), (905, "été ÉTÉ Été")]
    items = [(1, "w0 w1 w2 w3 w4 w5 w6 w7"), (2, "rare w39"), (2, "W1"), (3, None), (None, "w9 w9 w10"), (4, "unseen"), (5, "été"), (6, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(lexical.search(d, q, k=k, block=block)) == plain(docs, items, k)


def test_ids_of_any_type_and_clashing_columns(spark):
    names = "doc string, term string, c string, query string, rank string, s string, n string"
    docs = spark.createDataFrame([("a", "red fox", *"xxxxxxx"), ("b", "red hen hen", *"xxxxxxx"), ("c", "blue sea", *"xxxxxxx")], f"doc_id string, text string, {names}")
    items = spark.createDataFrame([("q", "hen red", *"xxxxxxx")], f"item_id string, text string, {names}")
    found = lexical.search(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and [r["doc_id"] for r in found.orderBy("rank").collect()] == ["b", "a"]


def test_terms_that_only_share_a_bit_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_bitmap", lambda terms: b"\xff" * (lexical.BITMAP_BITS // 8))
    docs, items = [(1, "one two"), (2, "two three"), (3, "four")], [(0, "two")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(found) == plain(docs, items, 50)


def test_scores_and_candidates_stay_few(spark, tmp_path, monkeypatch):
    """The uniform threshold leaves long lists of common words unread: candidates are fewer than documents that match."""
    kept = {}
    monkeypatch.setattr(lexical.storage.Scratch, "drop", lambda self: kept.update(root=self.root))
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('the of ', if(id < 60, concat('needle', id % 3), ''), ' filler', id % 50) as text")
    items = spark.createDataFrame([(0, "the of needle0 needle1 needle2")], "item_id long, text string")
    assert lexical.search(docs, items, k=20).count() == 20
    import os

    names = os.listdir(kept["root"].removeprefix("file://"))
    candidates = next(n for n in names if n.endswith("candidates"))
    assert spark.read.parquet(f"{kept['root']}/{candidates}").count() <= 60
