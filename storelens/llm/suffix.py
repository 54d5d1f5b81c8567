"""Exact removal of byte strings that occur more than once, by a logarithmic family of sampled suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else.  Not every suffix is indexed: an entry for each byte would fill
many times the space of the text.  In every window of ``length`` bytes the string
of ``gram`` bytes with the least hash is the window's anchor, chosen by content
alone, so equal windows have equal anchors at equal offsets.  Only suffixes that
begin at anchors are indexed, about one in 70 bytes.  Successive windows share an
anchor; together they form its *segment*, and one entry stands for all of them:
(first bytes of the suffix, 128-bit fingerprint of the segment, count, location).

* A batch's entries in the order of their suffixes are its suffix array.  The
  order is that of the first ``gram`` bytes, then of the fingerprint, as beyond
  these bytes only equality matters.  An array is a table dealt to buckets by
  its entries' hash and sorted in each, so that equal entries of any two arrays
  stand in the same bucket and arrays meet without a shuffle.
* A new batch is merge-scanned against every level of the family: a sort-merge
  join of the two sorted tables finds the segments that both hold, long matches
  as a whole.  Where a level is as large as the newcomer, scan and merge are one
  pass, in which equal entries add their counts; so an entry is rewritten a
  logarithmic number of times.
* In the end a segment counted more than once or met by a scan is a match as a
  whole.  A segment counted once whose anchor has no other segment holds none.
* What is left are anchors with several different segments: the ends of copied
  passages.  Their windows are compared in aligned groups of ``STEP`` by what
  the group has in common, and in groups with a match one by one, again by
  128-bit fingerprints.

Only locations that occur once travel back to their document: all windows that
are not listed there are matches.  So a string with very many copies is merged
to one row before each shuffle.

Null and empty texts have no bytes and lose none; a null id is an id like any
other.  Ids may be of any type and must each stand for one text; rows repeated as
a whole are copies of each other, and each is returned.  Texts of one id that
differ are not told apart, and what is removed from them is not defined; nothing
fails.  Of the copies of a string all are removed, so there are no ties to
settle.  Only the two named columns are read, so further columns may have any
name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.llm import storage
from storelens.llm.blocks import U64, Powers, blocks, mix, text_bytes

STEP = 8
_GOLDEN = U64(0x9E3779B97F4A7C15)
#: Kinds of listed locations.
SETTLED, OPEN, COPIED = 0, 1, 2


class Segments(NamedTuple):
    begin: np.ndarray  # first window of each segment
    windows: np.ndarray  # number of windows
    anchor: np.ndarray  # position of the anchor
    anchor_hash: np.ndarray
    prefixes: tuple[np.ndarray, np.ndarray]  # for two independent hashes of ranges


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def two_powers() -> tuple[Powers, Powers]:
    """Independent bases, which together give fingerprints of 128 bits."""
    return Powers(1), Powers(2)


def segments(data: np.ndarray, starts: np.ndarray, powers: tuple[Powers, Powers], length: int, gram: int) -> Segments:
    """The segments of all windows that lie within one text each."""
    n = len(data)
    prefixes = (powers[0].prefix(data), powers[1].prefix(data))
    grams = mix((prefixes[0][gram:] - prefixes[0][:-gram]) * powers[0].down[: n - gram + 1])
    bits = U64(int(n).bit_length())
    low = sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    anchor = (low & ((U64(1) << bits) - U64(1))).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, dtype=np.int32)
    last = starts[1:] - length + 1
    some = last > starts[:-1]
    np.add.at(valid, starts[:-1][some], 1)
    np.add.at(valid, last[some], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    change = np.ones(len(anchor), dtype=bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    change[starts[:-1][some]] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(anchor))
    keep = valid[begin]
    begin, end = begin[keep], end[keep]
    return Segments(begin, end - begin, anchor[begin], grams[anchor[begin]], prefixes)


def _fingerprints(powers: tuple[Powers, Powers], s: Segments, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of each byte range and its salt."""
    return [mix(p.ranges(prefix, begin, end) * _GOLDEN ^ salt) for p, prefix in zip(powers, s.prefixes, strict=True)]


def _merged(keys: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each key, its summed count)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(count[order], at) if len(at) else count[:0]


def _with_doc(docs: DataFrame, before: str, after: str) -> T.StructType:
    """A schema around the column doc, whose type is that of the documents' ids."""
    return T.StructType([*(T.StructType.fromDDL(before) if before else ()), docs.schema["doc"], *T.StructType.fromDDL(after)])


def entries(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(suffix, s1, s2, n, doc, code): one row for each different segment of a block of texts.

    docs has the columns doc and text.  suffix holds the first gram bytes, s1 and s2 the segment's
    fingerprint, code the first window and the number of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = two_powers()
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for lo, hi in blocks(starts):
                own, begins = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
                if len(own) < length:
                    continue
                s = segments(own, begins, powers, length, gram)
                if not len(s.begin):
                    continue
                whole = _fingerprints(powers, s, s.begin, s.begin + s.windows + length - 1, s.anchor_hash)
                at, n = _merged(whole, np.ones(len(s.begin), dtype=np.int64))
                owner = np.searchsorted(begins, s.begin[at], side="right") - 1
                suffix = own[s.anchor[at][:, None] + np.arange(gram)]
                places = np.arange(len(at) + 1, dtype=np.int32) * gram
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(suffix)]),
                        *(pa.array(h[at].view(np.int64)) for h in whole),
                        pa.array(n),
                        batch.column(0).take(pa.array(owner + lo)),
                        pa.array((s.begin[at] - begins[owner]) << 8 | s.windows[at]),
                    ],
                    names=["suffix", "s1", "s2", "n", "doc", "code"],
                )

    if not gram <= length - 2 or length - gram + 1 > 255:
        raise ValueError("a segment must have 2 to 255 windows: choose gram within 255 of length")
    return docs.mapInArrow(run, _with_doc(docs, "suffix binary, s1 long, s2 long, n long", "code long"))


class SortedTable:
    """A table in the shared folder, dealt to buckets by its key's hash and sorted by the key in each."""

    KEY = ("suffix", "s1", "s2")

    def __init__(self, rows: DataFrame, name: str):
        self.spark = rows.sparkSession
        self.path, self.name = storage.new_path(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with storage.shuffles_end_with_writes(self.spark):
            rows.write.bucketBy(buckets, *self.KEY).sortBy(*self.KEY).format("parquet").option("path", self.path).saveAsTable(self.name)
        storage.drop_at_end(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        storage.drop(self.spark, self.path)


class Level(NamedTuple):
    batches: range  # of which it holds the entries
    table: SortedTable


class Meeting(NamedTuple):
    """Segments that a batch shared with a level when it came."""

    batch: int
    with_batch: int  # the first of that level
    table: SortedTable


class SuffixFamily:
    """Levels of sampled suffix arrays; level k holds 2**k batches."""

    def __init__(self, spark: SparkSession, length: int = 200, gram: int = 32):
        self.spark, self.length, self.gram = spark, length, gram
        self.levels: dict[int, Level] = {}
        self.meetings: list[Meeting] = []
        self.inserted = 0

    def suffix_array(self, docs: DataFrame) -> SortedTable:
        """A batch's entries; equal ones are one, whose location is one of theirs."""
        rows = entries(docs, self.length, self.gram).groupBy(*SortedTable.KEY).agg(F.sum("n").alias("n"), F.first("doc").alias("doc"), F.first("code").alias("code"))
        return SortedTable(rows, "suffixes")

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted arrays as one, in one pass over both."""
        key = list(SortedTable.KEY)
        both = a.withColumnsRenamed({c: f"_{c}" for c in ("n", "doc", "code")}).join(b, key, "full")
        old = F.col("_n").isNotNull()
        place = (F.when(old, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("doc", "code"))
        return both.select(*key, (F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), *place)

    @staticmethod
    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """The segments that both sorted arrays hold."""
        key = list(SortedTable.KEY)
        return a.select(*key).join(b.select(*key), key)

    def insert(self, docs: DataFrame) -> None:
        """Adds a batch (columns doc, text): scans it against every level and merges levels of equal size."""
        number, new, level = self.inserted, self.suffix_array(docs), 0
        while level in self.levels:  # those that merge with the newcomer; the merge is their scan
            level += 1
        for k in sorted(k for k in self.levels if k > level):
            kept = self.levels[k]
            self.meetings.append(Meeting(number, kept.batches.start, SortedTable(self.met(new.rows(), kept.table.rows()), "meetings")))
        first = number
        for k in range(level):
            old = self.levels.pop(k)
            both = SortedTable(self.merged(old.table.rows(), new.rows()), "suffixes")
            old.table.drop()
            new.drop()
            new, first = both, old.batches.start
        self.levels[level] = Level(range(first, number + 1), new)
        self.inserted += 1

    def scan(self) -> DataFrame:
        """One entry of every segment in the family, with ``copied``: whether it occurs more than once.

        Of a segment that a newer level shares with an older one, the older entry stands for both.
        """
        key, out = list(SortedTable.KEY), None
        for batches, table in self.levels.values():
            rows = table.rows()
            apart = [m for m in self.meetings if (m.batch in batches) != (m.with_batch in batches)]  # others have merged
            newer = [m.table.rows() for m in apart if m.batch in batches]
            older = [m.table.rows() for m in apart if m.with_batch in batches]
            for met in newer:
                rows = rows.join(met, key, "left_anti")
            copied = F.col("n") > 1
            if older:
                met = reduce(DataFrame.unionByName, older)
                rows = rows.join((met if len(older) == 1 else met.distinct()).withColumn("_met", F.lit(True)), key, "left")
                copied = copied | F.col("_met").isNotNull()
            rows = rows.select(*key, "n", "doc", "code", copied.alias("copied"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def drop(self) -> None:
        for t in (*(level.table for level in self.levels.values()), *(m.table for m in self.meetings)):
            t.drop()
        self.levels.clear()
        self.meetings.clear()


def _lists(rows: DataFrame) -> DataFrame:
    """(doc, codes): the listed locations of each document; bounded by its length."""
    return rows.groupBy("doc").agg(F.collect_list("code").alias("codes"))


def _joined(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs with their codes; null ids meet too."""
    named = lists.select(F.col("doc").alias("_doc"), "codes")
    return docs.join(named, docs["doc"].eqNullSafe(named["_doc"]), "left").drop("_doc")


def _spans(n: int, length: int, begin: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed byte runs [from, to) of a text of n bytes whose only unmatched windows are those listed."""
    total = n - length + 1
    if total <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    order = np.argsort(begin, kind="stable")
    begin, end = np.minimum(begin[order], total), np.minimum(begin[order] + windows[order], total)
    reach = np.maximum.accumulate(end) if len(end) else end
    # Windows between the listed runs are matches; each covers ``length`` bytes.
    a = np.concatenate(([0], reach))
    b = np.concatenate((begin, [total]))
    some = b > a
    a, b = a[some], b[some] - 1 + length
    if not len(a):
        return a, b
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:] - 1, len(b) - 1)]


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _result(own: np.ndarray, length: int, codes: np.ndarray, with_text: bool) -> tuple[int, int, int, str, str | None]:
    a, b = _spans(len(own), length, codes >> 8, codes & 255)
    if not len(a):
        kept = own.tobytes()
        return len(own), 0, 0, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None
    edges = np.zeros(len(own) + 1, dtype=np.int8)
    edges[a] = 1
    edges[b] -= 1
    kept = own[np.cumsum(edges[:-1]) == 0].tobytes()
    return len(own), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None


def _settle(texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Rows (doc, text, codes) to results; rows with open codes keep text and codes for later instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            lists, texts_column = batch.column(2), batch.column(1)
            rows, later = [], np.zeros(len(batch), dtype=bool)
            empty = np.zeros(0, dtype=np.int64)
            for i in range(len(batch)):
                codes = lists[i].values.to_numpy() if lists[i].is_valid else empty
                if (codes & 3).any():
                    later[i] = True
                    rows.append((None,) * 5)
                else:
                    rows.append(_result(data[starts[i] : starts[i + 1]], length, codes >> 2, with_text))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            gone = pa.array(~later)
            none = pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pc.if_else(gone, none, texts_column.cast(pa.string())), pc.if_else(gone, pa.nulls(len(batch), pa.list_(pa.int64())), lists.cast(pa.list_(pa.int64())))],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", "codes"],
            )

    return texts.select("doc", F.coalesce("text", F.lit("")).alias("text"), "codes").mapInArrow(run, _with_doc(texts, "", _RESULT + ", text string, codes array<long>"))


def _groups(s: Segments, begin: int, codes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Aligned groups of windows of the listed open or copied segments of one text.

    Returns (segment number, first window, number of windows, aligned group number);
    windows are aligned by their offset to the anchor.
    """
    wanted = codes[(codes & 3) != SETTLED] if len(s.begin) else codes[:0]
    at = np.minimum(np.searchsorted(s.begin, (wanted >> 10) + begin), max(0, len(s.begin) - 1))
    high = s.anchor[at] - s.begin[at]  # offset of the first window, the largest
    low = high - s.windows[at] + 1
    n = high // step - low // step + 1
    which = np.repeat(at, n)
    k = np.repeat(low // step, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    top = np.minimum(np.repeat(high, n), k * step + step - 1)
    bottom = np.maximum(np.repeat(low, n), k * step)
    kinds = np.repeat(wanted & 3, n)
    return which, s.anchor[which] - top, top - bottom + 1, k << 2 | kinds


def _hashed(texts: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """(k1, k2, c, doc, code) of the window groups (step > 1) or windows (step 1) of open segments.

    A group's key is the fingerprint of the bytes that all its aligned windows have in common.
    With step 1, ``done`` lists groups that need no look at single windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = two_powers()
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            for lo, hi in blocks(starts):
                own, begins = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
                if len(own) < length:
                    continue
                s = segments(own, begins, powers, length, gram)
                parts = []
                for i in range(lo, hi):
                    codes = batch.column(2)[i].values.to_numpy()
                    which, first, width, k = _groups(s, int(begins[i - lo]), codes, STEP)
                    if step == 1:
                        done = batch.column(3)[i]
                        if done.is_valid:
                            keep = ~np.isin((first - begins[i - lo]) << 8 | width, done.values.to_numpy() >> 2)
                            which, first, width, k = which[keep], first[keep], width[keep], k[keep]
                        which, k = np.repeat(which, width), np.repeat(k, width)
                        first = np.repeat(first, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
                        width = np.ones(len(first), dtype=np.int64)
                    parts.append((np.full(len(which), i), which, first, width, k))
                owner, which, first, width, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                if not len(owner):
                    continue
                if step == 1:
                    a, b = first, first + length
                    salt = s.anchor_hash[which] ^ (s.anchor[which] - first).astype(np.uint64) * _GOLDEN
                else:
                    group = k >> 2
                    a, b = s.anchor[which] - group * step, s.anchor[which] - group * step - step + 1 + length
                    salt = s.anchor_hash[which] ^ group.astype(np.uint64) * _GOLDEN
                keys = _fingerprints(powers, s, a, b, salt)
                at, c = _merged(keys, np.ones(len(a), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k[at].view(np.int64)) for k in keys), pa.array(c), batch.column(0).take(pa.array(owner[at])), pa.array(((first[at] - begins[owner[at] - lo]) << 8 | width[at]) << 2 | (k[at] & 3))],
                    names=["k1", "k2", "c", "doc", "code"],
                )

    columns = ["doc", "text", "codes", *(["done"] if step == 1 else [])]
    return texts.select(*columns).mapInArrow(run, _with_doc(texts, "k1 long, k2 long, c long", "code long"))


def _alone(rows: DataFrame) -> DataFrame:
    """(doc, code) of keys that occur once."""
    return rows.groupBy("k1", "k2").agg(F.sum("c").alias("c"), F.first("doc").alias("doc"), F.first("code").alias("code")).where("c = 1").select("doc", "code")


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 32, batches: int = 3, with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row, and ``kept`` if asked for:
    the characters of which every byte remains.

    batches: how many parts the documents arrive in; the result does not depend on it.
    """
    spark = docs.sparkSession
    scratch = storage.Scratch(spark, "repeated")
    named = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    family = SuffixFamily(spark, length, gram)
    for b in range(batches):
        family.insert(named.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b))
    # The first bytes are hashed here: two suffixes that only share the hash are compared in vain, no more.
    found = family.scan().select(F.xxhash64("suffix").alias("anchor"), "s1", "s2", "n", "copied", "doc", "code")
    differ = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
    several = found.groupBy("anchor").agg(differ.alias("several")).where("several")
    marked = found.join(several, "anchor", "left").where("not copied or several")
    kind = F.when(F.col("copied"), COPIED).when(F.col("several"), OPEN).otherwise(SETTLED)
    coded = marked.select("doc", F.shiftleft("code", 2).bitwiseOR(kind.cast("long")).alias("code"))
    lists = scratch.written(_lists(coded), "lists")
    family.drop()

    settled = storage.written(_settle(_joined(named, lists), length, with_text), "settled")
    waiting = settled.where("text is not null").select("doc", "text", "codes")
    alone = scratch.written(_alone(_hashed(waiting, length, gram, STEP)), "groups")
    done = _joined(waiting, _lists(alone)).toDF("doc", "text", "codes", "done")
    windows = _alone(_hashed(done, length, gram, 1)).unionByName(alone).where(F.col("code").bitwiseAND(F.lit(3)) == OPEN)
    last = storage.written(_lists(windows.select("doc", F.shiftright("code", 2).alias("code"))), "windows")
    scratch.drop()

    certain = F.filter("first", lambda x: x.bitwiseAND(F.lit(3)) == SETTLED)
    found_later = F.transform(F.coalesce("codes", F.array().cast("array<long>")), lambda x: F.shiftleft(x, 2))
    rest = _joined(waiting.select("doc", "text", F.col("codes").alias("first")), last).select("doc", "text", F.concat(certain, found_later).alias("codes"))
    out = settled.where("text is null").unionByName(_settle(rest, length, with_text)).select(F.col("doc").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")
