"""The whole pipeline against a plain-Python version of each stage, on whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from storelens.llm import decontam, quality
from storelens.llm.queries import vocabulary
from tests.llm.test_methods import brute_components


def brute_quality(spark, texts, docs, sf_dir):
    """Only the fitted dictionaries and curve are taken over; every text is compressed here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    parameters = zstandard.ZstdCompressionParameters.from_level(model.level, write_content_size=0, write_checksum=0, write_dict_id=0)
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=parameters) for d in (model.good, model.bad))
    out = {}
    for key, text in texts.items():
        raw = text.encode()
        pieces = [raw[k : k + model.piece] for k in range(0, len(raw), model.piece)]
        saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) + model.usual * model.prior
        if 1 / (1 + np.exp(-(model.slope * saved / (len(raw) + model.prior) + model.offset))) >= 0.3:
            out[key] = text
    return out


def brute_removal(texts):
    """Every byte under a 200-byte string that is met twice goes, and with it halves of characters."""
    raw = {k: t.encode() for k, t in texts.items()}
    seen: dict[bytes, int] = {}
    for t in raw.values():
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    out = {}
    for k, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out[k] = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode(errors="ignore")
    return out


def brute_leaks(texts, items):
    """Every item against every window of every text, without any retrieval; answer words by document frequency."""
    words = {k: decontam._hashes([t.lower()])[0] for k, t in texts.items()}
    asked = [w for w in decontam._hashes([t.lower() for t in items]) if len(w)]
    frequency: dict[int, int] = {}
    for w in words.values():
        for x in set(w.tolist()):
            frequency[x] = frequency.get(x, 0) + 1
    settings = decontam.Settings()
    leaking = set()
    for own in asked:
        rare = sorted(np.unique(own).tolist(), key=lambda x: frequency.get(x, 0))
        answer = np.array(rare[: max(1, len(rare) // 3)], np.uint64)
        for k, w in words.items():
            if k not in leaking and len(w) and np.isin(own, w).mean() >= settings.reworded and decontam._best_window(own, answer, w, settings)[0]:
                leaking.add(k)
    return leaking


def brute_pieces(texts):
    """(doc_id, piece, start, length, crc) by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_str(vocabulary().tokenizer_json), set()
    for key, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[start : first if start == 0 else start + 2048]
            out.add((key, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("name", ["/root/testdata/sf0.001"])
def test_pipeline_equals_brute_force(spark, name):
    docs = spark.read.parquet(f"{name}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    staged = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, name)
        staged.append({r.doc_id: r.text or "" for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    texts = brute_quality(spark, texts, spark.read.parquet(f"{name}/documents.parquet"), name)
    assert staged[0] == texts
    components = brute_components(texts)
    texts = {k: t for k, t in texts.items() if components[k][2]}
    assert staged[1] == texts
    texts = brute_removal(texts)
    assert staged[2] == texts
    leaking = brute_leaks(texts, [r.text for r in spark.read.parquet(f"{name}/benchmark.parquet").collect()])
    texts = {k: t for k, t in texts.items() if k not in leaking}
    assert staged[3] == texts and leaking
    rows = corpus_pipeline.run(spark, name).toPandas()
    assert set(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).to_numpy().tolist())) == brute_pieces(texts)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= 1.05 * rows["length"].sum() / 2048 + 1
