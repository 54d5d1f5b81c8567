"""Near-duplicate detection with banded MinHash and odd sketches.

1. One pass over the texts gives each document its shingle-set fingerprint,
   MinHash band keys and two odd sketches: its MinHash samples, and its whole
   set, folded into bitmaps in which every member flips one bit.  The bits in
   which two bitmaps differ estimate the samples in which two documents differ,
   and bound from below the shingles that only one of them has.
2. Documents with the same shingle set are one class, kept as its smallest id.
3. Classes that share a band key are compared with one of them, the first in
   one of a few random orders, so that a class meets several such centres of
   its group.  Pairs whose sketches allow the similarity are confirmed on the
   full sets.
4. Components of the confirmed links are contracted.  A key whose classes are
   still in several components has all its pairs across components compared by
   sketch, inside the join or in blocks of bounded size, and only those that
   pass are listed and confirmed.  So no pair inside a settled group is listed,
   and no link is lost to a cap.

Only the banding is probabilistic.  With ``rows=6`` and ``bands=64`` a pair at
the similarity 0.75 shares no band with probability 4e-6, at 0.8 with 3e-9.

Nulls, empty texts and texts without words have an empty set and are linked to
nothing; texts of any length count whole.  Documents should have unique ids:
repeated rows are each returned, as copies of one another that share an id, and
a row without an id is in the component of its text but never kept.  Of equal
documents the smallest id is the component's.  An empty table gives an empty
result.  Only the two named columns are read, so further columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm import storage
from storelens.llm.blocks import U64, blocks, mix, random_words, text_bytes, word_hashes, words
from storelens.llm.components import component_leaves

SKETCH_WORDS = 16
#: Standard errors by which a sketch may stay below the similarity before a pair is given up unconfirmed.
SLACK = 4.5
#: Members of a band key up to which its open pairs are found by a join; larger keys go by blocks of BLOCK.
LISTED, BLOCK = 64, 512
#: Random orders among which a key's centre is the first.
CENTRES = 4


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a shorter text's words are one shingle."""
    first, length, owner = words(data, starts)
    n = len(starts) - 1
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    hashes = word_hashes(data, first, length)
    weights = random_words(7, width) | U64(1)
    out: list[np.ndarray] = []
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1] * weights[0]
        for j in range(1, width):
            rolled = rolled + hashes[j : len(hashes) - width + 1 + j] * weights[j]
        rolled = mix(rolled)
    else:
        rolled = hashes[:0]
    for i in range(n):
        k, end = int(counts[i]), int(ends[i])
        if k >= width:
            s = np.sort(rolled[end - k : end - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif k:
            one = mix((hashes[end - k : end] * weights[:k]).sum(keepdims=True) + U64(k))
            out.append(one)
        else:
            out.append(hashes[:0])
    return out


def minhashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of every one of the functions a * x + b over the set, in pieces that stay in cache."""
    x = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    step = 256
    for k in range(0, len(x), step):
        values = a[:, None] * x[None, k : k + step]
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _sketch_columns(samples: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch words) of a matrix of MinHash samples, one row a document."""
    n, k = samples.shape
    wide = samples.astype(np.uint64)
    weights = random_words(11, rows) | U64(1)
    keys = (wide.reshape(n, k // rows, rows) * weights).sum(axis=2, dtype=np.uint64) + random_words(12, k // rows)
    sketch = odd_sketch(mix(wide + random_words(13, k)).reshape(-1), np.repeat(np.arange(n), k), n)
    return mix(keys).view(np.int64), sketch


def odd_sketch(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bitmaps, one row an owner, in which every value flips the bit that its low bits name."""
    width = 64 * SKETCH_WORDS
    at = owner.astype(np.int64) * width + (values & U64(width - 1)).astype(np.int64)
    flips = np.bincount(at, minlength=n * width).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, width), axis=1).view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, width: int, rows: int, bands: int) -> DataFrame:
    """(id, n_shingles, f1, f2, bands, sketch, parity) of every row; the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = random_words(17, 2 * rows * bands)
        a = (parameters[: rows * bands] >> U64(32)).astype(np.uint32) | np.uint32(1)
        b = (parameters[rows * bands :] >> U64(32)).astype(np.uint32)
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for lo, hi in blocks(starts):
                sets = shingle_sets(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                prints = np.zeros((len(sets), 2), dtype=np.uint64)
                samples = np.zeros((len(full), rows * bands), dtype=np.uint32)
                for row, i in enumerate(full):
                    prints[i] = mix(sets[i]).sum(), mix(sets[i] + U64(0x9E3779B97F4A7C15)).sum()
                    samples[row] = minhashes(sets[i], a, b)
                keys, sketch = _sketch_columns(samples, rows)
                every = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                parity = odd_sketch(every, np.repeat(np.arange(len(full)), sizes[full]), len(full))
                present = sizes > 0
                offsets = np.concatenate(([0], np.cumsum(present)))
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets * m, pa.int32()), pa.array(values.reshape(-1)), mask=pa.array(~present))
                    for values, m in ((keys, bands), (sketch, SKETCH_WORDS), (parity, SKETCH_WORDS))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), *lists],
                    names=["id", "n_shingles", "f1", "f2", "bands", "sketch", "parity"],
                )

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, parity array<long>")


def _differing(x: Column, y: Column) -> Column:
    return reduce(lambda p, q: p + q, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_WORDS)))


def sketches_allow(x: str, y: str, samples: int, percent: int) -> Column:
    """Whether the sketches of the rows x and y allow the similarity.

    At the similarity the sets differ in (100 - percent) / (100 + percent) of
    their summed sizes, and parity bitmaps never differ in more bits than that.
    """
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    sizes = (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (_differing(F.col(f"{x}.parity"), F.col(f"{y}.parity")) * (100 + percent) <= (a + b) * (100 - percent))
    return sizes & (_differing(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= most_different(samples, percent / 100))


def most_different(samples: int, similarity: float) -> int:
    """Bits in which sketches may differ for a pair at the similarity, SLACK standard errors included.

    A sample that differs flips one bit in either sketch, so d differing samples
    are 2 d flips among n bits, and n / 2 * (1 - exp(-4 d / n)) bits differ.
    """
    n = 64 * SKETCH_WORDS
    d = samples * (1 - similarity) + SLACK * (samples * similarity * (1 - similarity)) ** 0.5
    expected = n / 2 * (1 - np.exp(-4 * d / n))
    return int(np.ceil(expected + SLACK * (n / 4 * (1 - np.exp(-8 * d / n))) ** 0.5))


def confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets overlap by percent of their union, compared in whole numbers."""
    left = docs.select(F.col(key).alias("u"), F.col(text).alias("text_u"))
    right = docs.select(F.col(key).alias("v"), F.col(text).alias("text_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            datas = [text_bytes(batch.column(c)) for c in (2, 3)]
            for i in range(len(batch)):
                sets = []
                for data, starts in datas:
                    own = data[starts[i] : starts[i + 1]]
                    raw = own.tobytes()
                    if raw != last[0]:
                        found = shingle_sets(own, np.array([0, len(own)]), width)[0]
                        if data is datas[1][0]:
                            last = (raw, found)
                    else:
                        found = last[1]
                    sets.append(found)
                together = np.concatenate(sets)
                together.sort()
                shared = int((together[1:] == together[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(together) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["u", "v"])

    # v is the centre that many pairs share: its rows come last, so that its set is at hand for the next pair.
    with_text = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
    return with_text.mapInArrow(run, "u long, v long")


def _block_pairs(members: DataFrame, samples: int, percent: int) -> DataFrame:
    """Pairs across components in keys of more than LISTED members, block by block, filtered by sketch."""
    limit = most_different(samples, percent / 100)
    n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
    dealt = members.withColumns({"n": n_blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component", "n_shingles", "sketch", "parity")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = int(frame["p"].iloc[0]), int(frame["q"].iloc[0])
        bits, odd = (np.array(frame[c].tolist(), dtype=np.int64).view(np.uint64).reshape(len(frame), SKETCH_WORDS) for c in ("sketch", "parity"))
        ids, parts, own_block, sizes = (frame[c].to_numpy() for c in ("id", "component", "own", "n_shingles"))
        rows, columns = np.flatnonzero(own_block == p), np.flatnonzero(own_block == q)
        u, v = [], []
        for i in rows:
            hit = columns[(parts[columns] != parts[i]) & ((p != q) | (columns > i))]
            hit = hit[np.bitwise_count(odd[i] ^ odd[hit]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (sizes[i] + sizes[hit]) * (100 - percent)]
            hit = hit[np.bitwise_count(bits[i] ^ bits[hit]).sum(axis=1, dtype=np.int64) <= limit]
            u.append(np.maximum(ids[hit], ids[i]))
            v.append(np.minimum(ids[hit], ids[i]))
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"u": np.concatenate([none, *u]), "v": np.concatenate([none, *v])})

    return dealt.groupBy("key", "p", "q").applyInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, rows: int = 6, bands: int = 64) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs.

    component_id is the smallest id that links reach, the row's own included;
    kept marks the row that carries it.
    """
    spark, samples = docs.sparkSession, rows * bands
    scratch = storage.Scratch(spark, "neardup")
    table = scratch.written(sketches(docs, key, text, width, rows, bands), "sketches")
    classes = scratch.written(table.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "classes")
    reps = table.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    keyed = reps.select("id", F.explode("bands").alias("key"))
    order = F.xxhash64("id", F.pmod("key", F.lit(CENTRES)))
    shared = keyed.groupBy("key").agg(F.min_by("id", order).alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = scratch.written(keyed.join(shared, "key"), "members")
    lookup = table.where("n_shingles > 0").select("id", "n_shingles", "sketch", "parity")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs (u, v): by sketch inside the join, then on full sets."""
        with_u = pairs.select("u", "v").distinct().join(lookup, F.col("u") == F.col("id")).drop("id").alias("x")
        passed = with_u.join(lookup.alias("y"), (F.col("x.v") == F.col("y.id")) & sketches_allow("x", "y", samples, percent)).select("u", "v")
        links = scratch.written(confirm(scratch.written(passed, "pairs"), docs, key, text, width, percent), "links")
        return links

    links = confirmed(members.where("id <> centre").select(F.greatest("id", "centre").alias("u"), F.least("id", "centre").alias("v")))
    parts = component_leaves(links, scratch)

    now = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = now.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("key")
    unsettled = scratch.written(now.join(several, "key"), "unsettled")
    small = unsettled.where(F.col("members") <= LISTED).join(lookup, "id")
    inside = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & sketches_allow("x", "y", samples, percent)
    listed = small.alias("x").join(small.alias("y"), inside).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))
    large = _block_pairs(unsettled.where(F.col("members") > LISTED).join(lookup, "id"), samples, percent)
    open_pairs = scratch.written(listed.unionByName(large).distinct(), "pairs")
    links = links.unionByName(confirm(open_pairs, docs, key, text, width, percent))
    parts = component_leaves(links, scratch).withColumnRenamed("node", "rep")

    of_class = classes.join(parts, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    found = table.select("id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("id"))
    result = found.select(F.col("id").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))
    result = storage.written(result, "near-duplicates")
    scratch.drop()
    return result
