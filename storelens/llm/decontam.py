"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into overlapping passages of ``window``
words.  Passages are TF-IDF vectors over the benchmark's vocabulary, with
document frequencies counted over all documents.  A randomised SVD (subspace
iteration) of the items' passages and the passages of all different documents
gives the latent space; every passage of every document is compared with the
items by cosine there.  Passages that score are checked on the words themselves:
the longest common subsequence of the item and the text around the passage, and
the share of the item's answer words found there, which finds paraphrases.  Both
are taken over windows of twice the item's length, so that words scattered over
a long text prove nothing.

The items are the query set.  Frequencies and passages are taken once for all of
them.  They are searched in blocks of at most ``block`` passages, each with a
latent space of its own, which has more dimensions than the block has passages;
in the fit each of these weighs as much as the documents together, so that the
space holds the items whole however many they are.  As many blocks as fit
``space_bytes`` are searched in one pass over all documents, so that what is
broadcast is bounded.  The basis is fitted on the items and all passages of two
features and more, equal documents once.  Candidates are checked in
the task that holds the text, so nothing is shuffled by item and a passage that
very many documents share makes no hot group.

Null and empty texts, and texts without words, match nothing.  An item without
words is never found; without items or documents the result is empty.  Repeated
items and documents are each reported.  Of several places in which a document
holds an item the best is reported: found before not found, then by common
subsequence, then by answer words; ties give equal values.  Only the named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm import storage
from storelens.llm.blocks import PUNCTUATED, blocks, random_words, text_bytes, word_hashes, words

RESULT = "item_id long, cosine double, lcs double, answer double"
_FILTER_BITS = 18
#: Dimensions beyond one for each of the items' passages, and of the iteration beyond the rank.
SPARE = 16
#: Share of an item's distinct words that are features at least.
KEPT_SHARE = 0.5


class Settings(NamedTuple):
    window: int = 40
    #: Least rank; a block with more passages has as many dimensions and SPARE.
    rank: int = 256
    block: int = 512
    #: Latent spaces that one pass over the documents takes along.
    space_bytes: int = 256 << 20
    #: Least cosine of a candidate, and the share of an item's words in common order that proves a copy.
    cosine: float = 0.3
    copied: float = 0.75
    #: A paraphrase: this share in common order, and this share of the answer words.
    reworded: float = 0.5
    answered: float = 0.6


class Items(NamedTuple):
    """One block of items, as hashes of their words."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    passages: list[tuple[int, int, int]]  # item number, first word, end
    stop: np.ndarray  # of the whole benchmark

    @property
    def features(self) -> np.ndarray:
        """Words of the items but the stop words, see ``stop_words``."""
        return np.setdiff1d(np.concatenate(self.words), self.stop)


class Space(NamedTuple):
    features: np.ndarray  # sorted word hashes
    present: np.ndarray  # a bit for each feature's low bits, to dismiss most words at once
    weight: np.ndarray  # inverse document frequency
    basis: np.ndarray  # feature, dimension; times the weight
    queries: np.ndarray  # dimension, passage; of length 1


def _hashes(texts: list[str]) -> list[np.ndarray]:
    data, starts = text_bytes(pa.array(texts, pa.string()))
    first, length, owner = words(data, starts, PUNCTUATED)
    return np.split(word_hashes(data, first, length), np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def _cuts(n: int, window: int) -> list[tuple[int, int]]:
    """Passages of a text of n words: every half window, the last one flush with the end."""
    half = max(1, window // 2)
    return [(a, min(n, a + window)) for a in range(0, max(1, n - window + half), half)] if n else []


def stop_words(texts: DataFrame) -> np.ndarray:
    """Hashes of the words in more than a twentieth of all items, but those that an item needs to keep its share of features.

    How often documents have a word does not count, so that an item that very
    many documents hold stays visible.  There are at most twenty times as many
    as an item has words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(w) for w in _hashes(batch.column(0).to_pylist())]
            kinds, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["word", "n"])

    most = max(3, texts.where("text <> ''").count() // 20)
    common = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > most).toPandas()
    hashes, uses = common["word"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    if not len(hashes):
        return hashes
    order = np.argsort(hashes)
    shared = texts.sparkSession.sparkContext.broadcast((hashes[order], uses[order]))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop, uses = shared.value
        for batch in batches:
            back = [np.zeros(0, np.uint64)]
            for own in map(np.unique, _hashes(batch.column(0).to_pylist())):
                mine = np.flatnonzero(np.isin(stop, own))
                short = int(np.ceil(KEPT_SHARE * len(own))) - (len(own) - len(mine))
                back.append(stop[mine[np.argsort(uses[mine], kind="stable")[: max(0, short)]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(back)).view(np.int64))], names=["word"])

    kept = texts.mapInArrow(needed, "word long").distinct().toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    return np.setdiff1d(hashes, kept)


def item_blocks(items: DataFrame, settings: Settings, key: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator[Items]:
    """The items in blocks of bounded size, in the order of their ids."""
    columns = [F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")]
    columns.append(F.lower(F.col(answer)).alias("answer") if answer else F.lit(None).cast("string").alias("answer"))
    ids: list[int] = []
    hashes: list[np.ndarray] = []
    answers: list[np.ndarray | None] = []
    passages: list[tuple[int, int, int]] = []
    stop = stop_words(items.select(columns[1]))

    def hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            own, given = ([h.view(np.int64) for h in _hashes(batch.column(c).fill_null("").to_pylist())] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, kind), pa.array([np.unique(h) for h in given], kind)], names=["id", "words", "answers"])

    hashed = items.select(*columns).orderBy("id", "text").mapInArrow(hash_words, T.StructType([T.StructField("id", items.schema[key].dataType), *T.StructType.fromDDL("words array<long>, answers array<long>")]))
    for row in hashed.toLocalIterator():
        own, given = (np.array(row[c], dtype=np.int64).view(np.uint64) for c in ("words", "answers"))
        if not len(own):
            continue
        cuts = _cuts(len(own), settings.window)
        if passages and len(passages) + len(cuts) > settings.block:
            yield Items(ids, hashes, answers, passages, stop)
            ids, hashes, answers, passages = [], [], [], []
        passages.extend((len(ids), a, b) for a, b in cuts)
        ids.append(row["id"])
        hashes.append(own)
        answers.append(given if len(given) else None)
    if passages:
        yield Items(ids, hashes, answers, passages, stop)


def _presence(features: np.ndarray) -> np.ndarray:
    present = np.zeros(1 << _FILTER_BITS, dtype=bool)
    present[(features & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return present


class _Words(NamedTuple):
    hashes: np.ndarray  # of all words of a block of texts
    owner: np.ndarray  # their text


class _Text(NamedTuple):
    hashes: np.ndarray
    owner: np.ndarray
    at: np.ndarray  # words that are features
    feature: np.ndarray  # and which


def _words(data: np.ndarray, starts: np.ndarray) -> _Words:
    first, length, owner = words(data, starts, PUNCTUATED)
    return _Words(word_hashes(data, first, length), owner)


def _featured(w: _Words, features: np.ndarray, present: np.ndarray) -> _Text:
    at = np.flatnonzero(present[(w.hashes & np.uint64(len(present) - 1)).astype(np.int64)])
    feature = np.minimum(np.searchsorted(features, w.hashes[at]), len(features) - 1)
    same = features[feature] == w.hashes[at]
    return _Text(w.hashes, w.owner, at[same], feature[same])


def document_frequencies(docs: DataFrame, features: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of documents, how many have each feature), over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((features, _presence(features)))  # the items' words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, present = shared.value
        counts, n = np.zeros(len(features), dtype=np.int64), 0
        for batch in batches:
            data, starts = text_bytes(batch.column(0))
            n += len(batch)
            for lo, hi in blocks(starts):
                t = _featured(_words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]), features, present)
                pairs = np.unique(t.owner[t.at] * len(features) + t.feature)
                counts += np.bincount(pairs % len(features), minlength=len(features))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], n))], names=["feature", "n"])

    found = docs.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(features), dtype=np.int64)
    words_found = found[found["feature"] >= 0]
    counts[words_found["feature"].to_numpy()] = words_found["n"].to_numpy()
    return int(found.loc[found["feature"] < 0, "n"].sum()), counts


def _passages(docs: DataFrame, features: np.ndarray, window: int) -> DataFrame:
    """(features, sizes) of every different text: the features of its passages that hold two of them, passage after passage, and how many each has."""
    shared = docs.sparkSession.sparkContext.broadcast((features, _presence(features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, present = shared.value
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for lo, hi in blocks(starts):
                t = _featured(_words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]), features, present)
                owner = t.owner[t.at]
                passage = owner << 32 | (t.at - np.searchsorted(t.owner, owner)) // window
                cut = np.flatnonzero(np.diff(passage, prepend=-1))
                number = np.cumsum(np.diff(passage, prepend=-1) != 0) - 1
                kinds = np.bincount(np.unique(number * len(features) + t.feature) // len(features), minlength=len(cut))
                several = kinds > 1
                kept = several[number] if len(number) else np.zeros(0, bool)
                sizes = np.bincount(number, minlength=len(cut))[several]
                of_text = np.arange(hi - lo + 1)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, of_text), pa.int32()), pa.array(values, pa.int32()))
                    for texts, values in ((owner[kept], t.feature[kept]), (owner[cut][several], sizes))
                ]
                held = pa.array(np.diff(lists[1].offsets.to_numpy()) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["h", "features", "sizes"]).filter(held)

    found = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, features array<int>, sizes array<int>")
    return found.dropDuplicates(["h"]).drop("h")


#: Tasks that sum a Gram matrix, at least, slices of its rows, and bytes of it that a task holds.
SUMS, SLICES, GRAM_BYTES = 8, 16, 256 << 20


def _edges(kinds: int) -> np.ndarray:
    """Where the slices of a Gram matrix begin and end: SLICES for each band of it that a task can hold."""
    bands = max(1, -(-8 * kinds * kinds // GRAM_BYTES))
    return np.linspace(0, kinds, SLICES * bands + 1).astype(np.int64)


def _gram(passages: DataFrame, own: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(slice, at, value): A'A of all passages A, of length 1 each in the features of a block, in slices of its rows.

    own: the block's number of each feature of the passages, or -1; weight: of the
    block's features.  A passage has fewer features than a latent space dimensions,
    so its pairs are summed once instead of multiplying it in each step.  A task
    holds at most GRAM_BYTES of the sums; a matrix beyond that takes more passes.
    """
    spark, kinds = passages.sparkSession, len(weight)
    edges = _edges(kinds)
    bands = (len(edges) - 1) // SLICES
    shared = spark.sparkContext.broadcast((own, weight, edges))
    tasks = max(SUMS, spark.sparkContext.defaultParallelism)

    def summing(band: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, weight, edges = shared.value
            first, last = edges[SLICES * band], edges[SLICES * (band + 1)]
            total = np.zeros((last - first) * len(weight))
            for batch in batches:
                of_block = own[batch.column(0).flatten().to_numpy()]
                sizes = batch.column(1).flatten().to_numpy()
                passage = np.repeat(np.arange(len(sizes)), sizes)[of_block >= 0]
                pairs, n = np.unique(passage * len(weight) + of_block[of_block >= 0], return_counts=True)
                passage, feature = pairs // len(weight), pairs % len(weight)
                x = n * weight[feature]
                x /= np.maximum(1e-12, np.sqrt(np.bincount(passage, x * x, minlength=len(sizes))))[passage]
                for apart in range(len(pairs)):  # pairs of features of one passage, so many places apart
                    same = np.flatnonzero(passage[apart:] == passage[: len(pairs) - apart])
                    if not len(same):
                        break
                    for a, b in ((same, same + apart), (same + apart, same))[: 2 if apart else 1]:
                        held = (feature[a] >= first) & (feature[a] < last)
                        np.add.at(total, (feature[a][held] - first) * len(weight) + feature[b][held], x[a][held] * x[b][held])
            for k in range(SLICES * band, SLICES * (band + 1)):
                part = total[(edges[k] - first) * len(weight) : (edges[k + 1] - first) * len(weight)]
                some = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x.tobytes()], pa.binary()) for x in (some.astype(np.int32), part[some].astype(np.float32)))], names=["slice", "at", "value"])

        return passages.coalesce(tasks).mapInArrow(run, "slice long, at binary, value binary")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["slice"].iloc[0])
        total = np.zeros((edges[k + 1] - edges[k]) * kinds)
        for at, value in zip(frame["at"], frame["value"], strict=True):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(value, np.float32)
        some = np.flatnonzero(total)
        return pd.DataFrame({"slice": [k], "at": [some.astype(np.int32).tobytes()], "value": [total[some].astype(np.float32).tobytes()]})

    parts = reduce(DataFrame.unionByName, map(summing, range(bands)))
    return parts.groupBy("slice").applyInPandas(add, "slice long, at binary, value binary")


def _times(gram: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix times a basis, slice by slice."""
    shared = gram.sparkSession.sparkContext.broadcast(basis)  # vocabulary of a block x rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for k, at, value in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at = np.frombuffer(at, np.int32)
                rows, inverse = np.unique(at // len(v), return_inverse=True)
                dense = np.zeros((len(rows), len(v)))
                dense[inverse, at % len(v)] = np.frombuffer(value, np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x.tobytes()], pa.binary()) for x in (rows, dense @ v))], names=["slice", "rows", "product"])

    out, edges = np.zeros_like(basis), _edges(len(basis))
    for row in gram.mapInArrow(run, "slice long, rows binary, product binary").collect():  # as large as the basis
        out[edges[row["slice"]] + np.frombuffer(row["rows"], np.int32)] = np.frombuffer(row["product"]).reshape(-1, basis.shape[1])
    return out


def _item_rows(items: Items, features: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature) counts times weights of the items' passages, dense, and their norms."""
    out = np.zeros((len(items.passages), len(features)))
    for row, (item, a, b) in enumerate(items.passages):
        own = items.words[item][a:b]
        np.add.at(out[row], np.searchsorted(features, own[np.isin(own, features)]), 1)
    out *= weight
    return out, np.maximum(1e-12, np.sqrt((out**2).sum(axis=1)))


class Statistics(NamedTuple):
    """What all blocks share."""

    features: np.ndarray  # sorted hashes of all items' words
    weight: np.ndarray  # inverse document frequency over all documents
    passages: DataFrame  # of all different documents
    rows: int  # passages in it
    path: str


def statistics(docs: DataFrame, items: list[Items], settings: Settings) -> Statistics:
    """Document frequencies and passages over all documents; docs has the column text."""
    features = np.unique(np.concatenate([b.features for b in items]))
    n, counts = document_frequencies(docs, features)
    weight = np.log1p(max(1, n) / np.maximum(counts, 1))
    path = storage.new_path(docs.sparkSession, "passages")
    passages = storage.written(_passages(docs, features, settings.window), "passages", path)
    (rows,) = passages.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    return Statistics(features, weight, passages, rows, path)


def _rank(items: Items, settings: Settings) -> int:
    return min(max(settings.rank, len(items.passages) + SPARE), len(items.features))


def fit_space(known: Statistics, items: Items, settings: Settings) -> Space:
    """The latent space of one block of items."""
    features = items.features
    at = np.searchsorted(known.features, features)
    weight = known.weight[at]
    own = np.full(len(known.features), -1, dtype=np.int64)
    own[at] = np.arange(len(features))
    dense, norms = _item_rows(items, features, weight)
    unit = dense / norms[:, None]
    rank = _rank(items, settings)
    wide = min(len(features), rank + SPARE)
    uniform = (random_words(23, len(features) * wide) >> np.uint64(11)).astype(np.float64).reshape(len(features), wide) / 2**53 - 0.5
    share = 1 / max(1, known.rows)  # an item's passage weighs as much as all of these
    v = np.linalg.qr(uniform)[0]
    path = storage.new_path(known.passages.sparkSession, "gram")
    gram = storage.written(_gram(known.passages, own, weight), "gram", path)
    for _ in range(2):  # subspace iteration
        v = np.linalg.qr(share * _times(gram, v) + unit.T @ (unit @ v))[0]
    small = v.T @ (share * _times(gram, v) + unit.T @ (unit @ v))
    storage.drop(known.passages.sparkSession, path)
    _, rotation = np.linalg.eigh((small + small.T) / 2)
    basis = v @ rotation[:, ::-1][:, :rank]
    latent = unit @ basis
    latent /= np.maximum(1e-12, np.sqrt((latent**2).sum(axis=1, keepdims=True)))
    return Space(features, _presence(features), weight, (basis * weight[:, None]).astype(np.float32), latent.T.astype(np.float32).copy())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = places.get(x)
        if hit:
            kept = row & hit
            row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def _energies(row: np.ndarray, t: _Text, space: Space, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared norm of each half window's vector, its product with the next half window's); row numbers the half windows of t.at."""
    kinds = len(space.features)
    pairs, n = np.unique(row * kinds + t.feature, return_counts=True)
    at, value = pairs // kinds, n * space.weight[pairs % kinds]
    same = np.minimum(np.searchsorted(pairs, pairs + kinds), len(pairs) - 1)
    both = np.where(pairs[same] == pairs + kinds, value * value[same], 0.0)
    return np.bincount(at, value**2, minlength=rows), np.bincount(at, both, minlength=rows)


def _candidates(t: _Text, space: Space, settings: Settings) -> Iterator[tuple[int, int, int, float]]:
    """(text, first word in the block, query passage, cosine) of the passages that score.

    A passage is two successive half windows.  Its norm is that of its whole
    TF-IDF vector, so that what the latent space leaves out counts.
    """
    half = max(1, settings.window // 2)
    base = np.searchsorted(t.owner, t.owner[t.at])
    piece = t.owner[t.at] << 32 | (t.at - base) // half
    new = np.diff(piece, prepend=-1) != 0
    cut = np.flatnonzero(new)
    if not len(cut):
        return
    keys = piece[cut]
    energy, product = _energies(np.cumsum(new) - 1, t, space, len(keys))
    size = np.diff(np.append(cut, len(piece)))
    for k in range(0, len(keys), 1024):
        last = min(k + 1025, len(keys))  # one more, for the passage that begins with this slice's last half
        order = np.argsort(-size[k:last], kind="stable")
        sorted_size, first = size[k:last][order], cut[k:last][order]
        sums = np.zeros((last - k, space.basis.shape[1]), dtype=np.float32)
        for j in range(int(sorted_size[0])):  # the j-th word of every half window that has one
            n = int(np.searchsorted(-sorted_size, -j))
            sums[:n] += space.basis[t.feature[first[:n] + j]]
        z = np.empty_like(sums)
        z[order] = sums
        norm = energy[k:last].copy()
        follows = np.flatnonzero(keys[k + 1 : last] == keys[k : last - 1] + 1)
        z[follows] += z[follows + 1]  # of the halves themselves: the right side is read first
        norm[follows] += energy[k + follows + 1] + 2 * product[k + follows]
        n = min(1024, len(keys) - k)
        cosine = (z[:n] @ space.queries) / np.sqrt(norm[:n])[:, None].astype(np.float32)
        for i, q in zip(*np.nonzero(cosine >= settings.cosine), strict=True):
            key = int(keys[k + i])
            text = key >> 32
            yield text, int(np.searchsorted(t.owner, text)) + (key & 0xFFFFFFFF) * half, int(q), min(1.0, float(cosine[i, q]))


def _answer_words(items: Items, item: int, space: Space) -> np.ndarray:
    """The given answer's words, or else the third of the item's words that is rarest."""
    if items.answers[item] is not None:
        return items.answers[item]
    own = np.unique(items.words[item])
    at = np.minimum(np.searchsorted(space.features, own), len(space.features) - 1)
    weight = np.where(space.features[at] == own, space.weight[at], 0.0)
    return own[np.argsort(-weight, kind="stable")[: max(1, len(own) // 3)]]


def _best_window(own: np.ndarray, answer: np.ndarray, near: np.ndarray, settings: Settings) -> tuple[bool, float, float]:
    """(whether the item is found, common subsequence, answer words) of the best window of twice the item's length.

    Windows begin every half length, so that a place of one and a half lengths
    lies whole in one.  Windows with too few of the item's words are not compared.
    """
    best = (False, 0.0, 0.0)
    held = np.concatenate([[0], np.cumsum(np.isin(near, own))])
    for a in range(0, max(1, len(near) - len(own)), max(1, len(own) // 2)):
        b = min(len(near), a + 2 * len(own))
        if held[b] - held[a] < min(settings.reworded, settings.copied) * len(own):
            continue
        lcs, answered = common_subsequence(own, near[a:b]) / len(own), float(np.isin(answer, near[a:b]).mean())
        best = max(best, (lcs >= settings.copied or (lcs >= settings.reworded and answered >= settings.answered), lcs, answered))
    return best


def _found(t: _Text, items: Items, space: Space, answers: dict[int, np.ndarray], settings: Settings) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item id, cosine, common subsequence, answer words) of the items of a block that texts hold."""
    regions: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for text, first, q, cosine in _candidates(t, space, settings):
        regions.setdefault((text, items.passages[q][0]), []).append((first, cosine))
    for (text, item), found in regions.items():
        own = items.words[item]
        begin, end = np.searchsorted(t.owner, [text, text + 1])
        if item not in answers:
            answers[item] = _answer_words(items, item, space)
        best = (False, 0.0, 0.0)
        found.sort()
        a = 0
        while a < len(found):  # passages near each other are one place
            b = a + 1
            while b < len(found) and found[b][0] - found[b - 1][0] <= len(own) + settings.window:
                b += 1
            near = t.hashes[max(begin, found[a][0] - len(own)) : min(end, found[b - 1][0] + settings.window + len(own))]
            best = max(best, _best_window(own, answers[item], near, settings))
            a = b
        if best[0]:
            yield text, items.ids[item], max(c for _, c in found), *best[1:]


def search(docs: DataFrame, searched: list[tuple[Items, Space]], settings: Settings) -> DataFrame:
    """(id, item_id, cosine, lcs, answer): one row for each document and item found in it; docs has columns id and text."""
    shared = docs.sparkSession.sparkContext.broadcast([(tuple(i), tuple(s)) for i, s in searched])  # bounded by settings.space_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(Items(*i), Space(*s), {}) for i, s in shared.value]
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            out: list[tuple[int, int, float, float, float]] = []
            for lo, hi in blocks(starts):
                w = _words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
                for items, space, answers in known:
                    t = _featured(w, space.features, space.present)
                    out.extend((lo + text, *rest) for text, *rest in _found(t, items, space, answers, settings))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], names=["id", "item_id", "cosine", "lcs", "answer"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *T.StructType.fromDDL(RESULT)]))


def _passes(items: list[Items], settings: Settings) -> Iterator[list[Items]]:
    """Blocks whose latent spaces go along in one pass over the documents."""
    now: list[Items] = []
    size = 0
    for block in items:
        own = 4 * len(block.features) * _rank(block, settings)
        if now and size + own > settings.space_bytes:
            yield now
            now, size = [], 0
        now.append(block)
        size += own
    if now:
        yield now


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """(key, item_id, cosine, lcs, answer) of every document in which an item is found."""
    spark: SparkSession = docs.sparkSession
    named = docs.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    items = list(item_blocks(benchmark, settings, item_key, item_text, answer))
    if not items:
        return spark.createDataFrame([], T.StructType([docs.schema[key], *T.StructType.fromDDL(RESULT)]))
    known = statistics(named.select("text"), items, settings)
    out = None
    for group in _passes(items, settings):
        found = search(named, [(b, fit_space(known, b, settings)) for b in group], settings)
        out = found if out is None else out.unionByName(found)
    storage.drop(spark, known.path)
    return out.withColumnRenamed("id", key)
