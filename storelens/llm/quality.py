"""Quality classifier by compression.

Two Zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad.  A text is compressed with both in fixed pieces that cover
all of it; how many bytes the good dictionary saves per byte of text is the one
feature, and a logistic curve fitted on labelled texts that no dictionary has
seen turns it into a score between 0 and 1.

The fit uses a bounded sample: at most ``sample`` different labelled texts of
each class, those whose ids have the smallest hash.  One half gives the
dictionaries, from at most ``pieces`` pieces a class that lie anywhere in their
texts (those with the smallest hash), so the driver receives a bounded number of
bytes however long the texts are.  The other half is compressed where it lies,
whole, and only three numbers a text reach the driver for the curve.

Only texts enter a score.  Nulls and empty texts take the usual text's score; a
text is compressed whole however long it is.  Labels other than 0 and 1 are
ignored; of repeated labels of one id each counts.  Repeated documents are each
scored, and equal texts have equal scores.  With no usable labels of one class
every score is the share of good labels, or 0.5.  The columns in ``keep`` may
have any name but the score's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import storage
from storelens.llm.blocks import text_bytes


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float
    piece: int
    level: int
    usual: float = 0.0  # bytes saved per byte of text, over the labelled texts
    prior: int = 0  # bytes of such usual text that are added to every text


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the remainder."""
    return F.crc32(doc_id.cast("string")) % modulus == remainder


def _pieces(raw: bytes, size: int) -> list[bytes]:
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=settings)


def _saved(texts: list[bytes], model: Model) -> np.ndarray:
    """Bytes that the good dictionary saves over the bad one, over all pieces of each text."""
    good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
    return np.array([sum(len(bad.compress(p)) - len(good.compress(p)) for p in _pieces(raw, model.piece)) for raw in texts], dtype=float)


def _per_byte(saved: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Savings per byte of text and of the usual text added, which keeps texts of a few words near the usual."""
    return (saved + model.usual * model.prior) / np.maximum(1, sizes + model.prior)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few texts to select from: they are the dictionary themselves
        return b"\n".join(samples)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) by Newton steps with a little shrinkage; x is rescaled inside."""
    scale = float(x.std()) or 1.0
    features = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -35, 35)))
        gradient = features.T @ (weight * (y - p)) - np.array([1e-2, 0]) * beta
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-6) / scale, float(beta[1])


def _chosen_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """((label, text, h) of at most ``sample`` different texts of each class, number of labels of each class)."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("key")
    chosen = marked.where("label = 0").orderBy(order, "key").limit(sample).unionByName(marked.where("label = 1").orderBy(order, "key").limit(sample))
    # At most 2 * sample ids: a bound that does not depend on the tables.
    found = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    return found.select("label", "text", F.xxhash64("text").alias("h")).dropDuplicates(["label", "h"]), counts


def _sampled_pieces(rows: DataFrame, label: int, size: int, most: int) -> list[bytes]:
    """At most ``most`` pieces of the texts of a class, those with the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [p for value in batch.column(0) for p in _pieces(value.as_py().encode(), size) if len(p) >= 8]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["piece"])

    pieces = rows.where(F.col("label") == label).select("text").mapInArrow(run, "piece binary")
    return [bytes(r["piece"]) for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(most).collect()]


def _measured(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, bytes, bytes saved) of each text; three numbers a text come to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            saved = _saved([data[starts[i] : starts[i + 1]].tobytes() for i in range(len(batch))], Model(*shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(saved), batch.column(2)], names=["label", "size", "saved", "h"])

    found = rows.select("label", "text", "h").mapInArrow(run, "label int, size long, saved double, h long").toPandas().sort_values(["h", "label"])
    return found["label"].to_numpy(float), found["size"].to_numpy(float), found["saved"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, pieces: int = 20_000, dictionary_bytes: int = 256 << 10, piece: int = 1024, level: int = 3, prior: int = 192) -> Model:
    """Fits the model on at most ``sample`` texts of each class; callers drop held-out labels beforehand."""
    texts, counts = _chosen_texts(docs, labels, key, text, label, sample)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    unlearned = Model(b" ", b" ", 0.0, float(np.log(share / (1 - share))), piece, level)
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return unlearned
    scratch = storage.Scratch(docs.sparkSession, "quality")
    rows = scratch.written(texts, "texts")
    half = F.pmod(F.xxhash64("h"), F.lit(2))
    good, bad = (_dictionary(_sampled_pieces(rows.where(half == 0), c, piece, pieces), dictionary_bytes) for c in (1, 0))
    model = Model(good, bad, 1.0, 0.0, piece, level)
    y, sizes, saved = _measured(rows.where(half == 1), model)
    scratch.drop()
    if not len(y):
        return unlearned
    seen = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = len(y) / total * np.where(y == 1, counts[1] / max(1, seen[1]), counts[0] / max(1, seen[0]))
    model = model._replace(usual=float((weight * saved).sum() / max(1.0, (weight * sizes).sum())), prior=prior)
    slope, offset = _logistic(_per_byte(saved, sizes, model), y, weight)
    return model._replace(slope=slope, offset=offset)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns in keep and a score, named so, the higher the likelier label 1; every whole text is compressed."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))  # two dictionaries of a fixed size
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for batch in batches:
            data, starts = text_bytes(batch.column(at))
            saved = _saved([data[starts[i] : starts[i + 1]].tobytes() for i in range(len(batch))], fitted)
            x = _per_byte(saved, np.diff(starts), fitted)
            values = 1 / (1 + np.exp(-np.clip(fitted.slope * x + fitted.offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(values)], names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)
