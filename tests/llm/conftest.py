from __future__ import annotations

import os
from pathlib import Path

import pytest

LONG = "wort " * 40_000


def documents():
    """Nulls, empty, blank and very long texts, ties, exact and near copies."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60 ", "other ")
    texts = [None, "", "   \n\t", "one", "two words", LONG, base, base, near, "é" * 300, "%%% ### $$$", "Der Die Das und nicht mit einem Wort", "the of and that with from this", None, base + " <|endoftext|>", "☃ snow \U0001f600" * 20]
    return [(i, t, None if i % 5 == 0 else "de" if i % 2 else "en", None if i % 3 == 0 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


#: Extra columns whose names the operators use inside.
EXTRA = "id long, key string, doc string, codes string, u string, v string, n string, score string, component string, media string, piece string, _group string, _id string, rep string, centre string, kept string, items string, label string"


def extra(i: int):
    return (i, *["x"] * (EXTRA.count(",")))


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("edge")
    rows = [(*r, *extra(r[0])) for r in documents()]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").coalesce(2).write.parquet(f"{root}/documents.parquet")
    pages = [(0, "http://A.Example.org/es/1", "<p>hello</p>"), (1, None, None), (2, "no scheme", ""), (3, "https://x.example.com/de/1?q", "<p>hello</p>"), (4, "http://y.example.net/z", '<link rel="canonical" href="https://x.example.com/de/1?q"><p>' + LONG + "</p>"), (5, "http://a.example.org", None)]
    spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, record_id string, tag string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(6, 1, 0), (7, 1, None), (10, 0, 0), (5, 0, 1), (3, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, "word10 word11 word12 word13 word14 word15 word16 word17"), (1, None), (2, ""), (3, "nothing of this kind is found anywhere")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("empty")
    for name in os.listdir(edge_dir):
        spark.read.parquet(f"{edge_dir}/{name}").limit(0).write.parquet(str(Path(root) / name))
    return str(root)
