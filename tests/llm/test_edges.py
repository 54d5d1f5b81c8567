"""Every query over nulls, empty and long texts, copies, clashing columns and empty tables."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pytest

from storelens.llm.queries import QUERIES
from tests.llm.conftest import documents

TEXTS = {r[0]: r[1] or "" for r in documents()}


def result(spark, edge_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, edge_dir).collect()]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_media(spark, edge_dir):
    for r in result(spark, edge_dir, "op1_media"):
        raw = TEXTS[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_quality(spark, edge_dir):
    rows = result(spark, edge_dir, "op2_quality")
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in TEXTS if zlib.crc32(str(i).encode()) % 5 == 0}


def test_main_text(spark, edge_dir):
    rows = {r["page_id"]: r for r in result(spark, edge_dir, "op3_main_text")}
    assert [rows[i]["text"] for i in (0, 1, 2, 3)] == ["hello", "", "", "hello"]
    assert rows[4]["n_chars"] == len(rows[4]["text"]) == 40_000 * 5 - 1


def test_suffix(spark, edge_dir):
    rows = {r["doc_id"]: r for r in result(spark, edge_dir, "op4_suffix")}
    assert len(rows) == len(TEXTS) and rows[0]["n_bytes"] == rows[0]["n_removed"] == 0
    assert rows[6]["n_removed"] == rows[6]["n_bytes"] and rows[6]["n_spans"] == 1
    assert rows[5]["n_removed"] == rows[5]["n_bytes"]  # one word over and over
    assert rows[9]["n_removed"] == 600 and rows[11]["n_removed"] == 0


def test_warc(spark, edge_dir):
    rows = {r["page_id"]: r for r in result(spark, edge_dir, "op5_warc")}
    assert (rows[0]["record_type"], rows[0]["refers_to"]) == ("revisit", 3) and rows[3]["record_type"] == "response"
    assert [rows[i]["refers_to"] for i in (1, 2, 5)] == [5, 5, None]
    assert rows[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"").digest()).decode()


def test_packing(spark, edge_dir):
    rows = result(spark, edge_dir, "op6_packing")
    assert {r["doc_id"] for r in rows} == set(TEXTS)
    for sequence in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    by_doc = [r for r in rows if r["doc_id"] == 0]
    assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc] == [(0, 0, 1, zlib.crc32(b"\0\0\0\0"))]


def test_decontamination(spark, edge_dir):
    assert {(r["doc_id"], r["item_id"]) for r in result(spark, edge_dir, "op7_decontam")} == {(i, 0) for i in (6, 7, 8, 14)}


def test_urls(spark, edge_dir):
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in result(spark, edge_dir, "op8_urls")}
    assert rows[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and rows[1] == ("", "", None, "allow") and rows[2] == ("", "", None, "allow")
    assert rows[3] == ("x.example.com", "/de/1", "com/de/", "block") and rows[4] == ("y.example.net", "/z", None, "block") and rows[5] == ("a.example.org", "", None, "allow")


def test_language(spark, edge_dir):
    rows = {r["doc_id"]: r for r in result(spark, edge_dir, "op9_language")}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 10)] == ["und"] * 4 and rows[9]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_neardup(spark, edge_dir):
    rows = {r["doc_id"]: r for r in result(spark, edge_dir, "op10_neardup")}
    assert [rows[i]["component_id"] for i in (6, 7, 8, 14)] == [6, 6, 6, 6] and [rows[i]["kept"] for i in (6, 7)] == [True, False]
    assert [rows[i]["n_shingles"] for i in (0, 1, 2, 3, 5)] == [0, 0, 0, 1, 1] and rows[0]["component_id"] == 0


def test_search(spark, edge_dir):
    rows = result(spark, edge_dir, "op11_search")
    assert {r["doc_id"] for r in rows if r["item_id"] == 0} == {6, 7, 8, 14} and all(r["item_id"] in (0, 3) for r in rows)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["item_id"] == 0][:2] == [6, 7]


def test_phrases(spark, edge_dir):
    rows = result(spark, edge_dir, "op12_phrases")
    n = sum(len(t.split()) for i, t in TEXTS.items() if i % 5 == 0)  # rows without a language
    found = {r["phrase"]: (r["lang"], r["a"], r["n"]) for r in rows if "wort" in r["phrase"]}
    assert found == {" ".join(["wort"] * k): ("und", 40_001 - k, n) for k in range(2, 6)}  # each longer one is rarer by one


def test_secrets(spark, edge_dir):
    rows = {r["doc_id"]: r for r in result(spark, edge_dir, "op13_secrets")}
    assert len(rows) == len(TEXTS) and all((r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) == (0, 0, 0, "") for r in rows.values())
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_do_not_break(spark, edge_dir, tmp_path):
    for name in ("documents", "pages", "labels", "benchmark"):
        t = spark.read.parquet(f"{edge_dir}/{name}.parquet")
        t.unionByName(t).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() >= (0 if name in ("op7_decontam", "op12_phrases") else 10), name


def test_pipeline_over_edges(spark, edge_dir, empty_dir):
    import corpus_pipeline

    columns = spark.read.parquet(f"{edge_dir}/documents.parquet").columns
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edge_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
