"""Phrase collocations by pivot partitioning.

Every phrase belongs to its rarest word, its pivot.

1. Words are counted by language; words of at least ``support`` occurrences get
   ids in descending order of frequency, so a larger id is a rarer word.
2. Pieces are rewritten to ids.  Around each occurrence of a word, the part that
   its phrases can come from is cut out: up to four words to the left that are
   more frequent, up to four to the right that are not rarer, and none beyond an
   infrequent word.  So a phrase that holds its pivot more than once belongs to
   the first of them.  Equal fragments of a task are counted once.
3. Fragments are routed to their pivot, and tasks count the phrases that hold it.
   No other pivot has these phrases, so the counts are final.  The fragments of a
   pivot that occurs more than ``block`` times are dealt over several tasks, and
   only their phrases are counted in parts and summed.
4. Phrases that any longer phrase holds just as often are dropped, each phrase
   gets the cut of its lowest score from the counts of its parts, and each
   language's best are kept.

Workers look ids up in a dictionary of at most ``dictionary`` words.  Words
beyond that bound, if there are, get theirs by a join instead, and the result is
the same.  Arithmetic is exact: products are decimals of 38 digits.

Words are runs of characters other than space and tab in pieces between
``[.,;:!?]`` and line ends; only A-Z are lower-cased.  Null and empty texts have
none, a null language is ``und``, one with the rows that say so.  Repeated rows
count each.  Of ties after flooring the first cut counts, and equal phrases of a
language do not occur.  An empty table gives an empty result; other columns are
not read and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm import storage
from storelens.llm.blocks import U64, blocks, mix, text_bytes

LONGEST = 5
REACH = LONGEST - 1
DICTIONARY = 300_000
#: Occurrences of a word from which its fragments are dealt over several tasks.
BLOCK = 250_000
#: Words that a worker rewrites, and fragments that it mines, at a time.
WORDS_AT_ONCE, FRAGMENTS_AT_ONCE = 500_000, 200_000
#: Characters between pieces, and between words.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECES = bytes(10 if c in PIECE_ENDS else 32 if c in WORD_ENDS else _LOWER[c] for c in range(256))
_WORDS = bytes(32 if c in PIECE_ENDS + WORD_ENDS else _LOWER[c] for c in range(256))
#: Parts that a pivot can have at most; a fragment's key is its pivot and its part.
PARTS = 1 << 20
_FRAGMENT = "key long, sizes binary, codes binary"
#: The largest number that an entry of a fragment carries; a larger one takes several entries.
MOST = 255
Batches = Iterator[pa.RecordBatch]


def _raw(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        buffer = value.as_buffer()
        yield buffer.to_pybytes() if buffer is not None else b""


def word_counts(named: DataFrame) -> DataFrame:
    """(lang, word, f) of all words; a task sums what it holds."""

    def run(batches: Batches) -> Batches:
        def out(counts: dict[str, Counter]) -> pa.RecordBatch:
            langs = [k for k, c in counts.items() for _ in c]
            words = [w for c in counts.values() for w in c]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])

        counts: dict[str, Counter] = {}
        for batch in batches:
            for code, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
                counts.setdefault(code, Counter()).update(raw.translate(_WORDS).split())
                if sum(map(len, counts.values())) > WORDS_AT_ONCE:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    return named.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _look_up(held: Broadcast, batches: Batches) -> Iterator[np.ndarray]:
    """Texts as ids, -1 for a break, by the dictionary of every language."""
    for batch in batches:
        for code, raw in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), strict=True):
            known = held.value.get(code)
            if raw and known:
                ids = [-1]
                for piece in raw.translate(_PIECES).split(b"\n"):
                    if piece:
                        ids += [known.get(w, -1) for w in piece.split()]
                        ids.append(-1)
                yield np.array(ids)


def _listed(batches: Batches) -> Iterator[np.ndarray]:
    """Pieces as ids, from a column of lists."""
    for batch in batches:
        column = batch.column(0)
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True):
            yield flat[a:b]


def _ids_by_join(named: DataFrame, words: DataFrame) -> DataFrame:
    """(ids) of each piece, for any number of words: they meet the table of words."""
    pieces = named.select("lang", F.monotonically_increasing_id().alias("doc"), F.posexplode(F.split(F.translate("text", UPPER, LOWER), r"[.,;:!?\x0A-\x0D]")).alias("piece", "p"))
    placed = pieces.select("lang", "doc", "piece", F.posexplode(F.split(F.trim(F.translate("p", "\t", " ")), " +")).alias("at", "word"))
    found = placed.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    lined = found.groupBy("doc", "piece").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")))).alias("r"))
    end = F.array(F.lit(-1).cast("long"))
    return lined.select(F.concat(end, F.col("r.id"), end).alias("ids"))


def _windows(ids: np.ndarray) -> np.ndarray:
    """A fragment for every occurrence that has one: nine ids with the pivot in the middle, -1 beyond its ends."""
    ends = np.full(REACH, -1, dtype=ids.dtype)
    padded = np.concatenate([ends, ids, ends])
    n = len(ids)
    columns = [ids]
    on_left = on_right = ids >= 0
    for j in range(1, REACH + 1):
        near = padded[REACH - j : REACH - j + n]
        on_left = on_left & (near >= 0) & (near < ids)
        columns.insert(0, np.where(on_left, near, -1))
        near = padded[REACH + j : REACH + j + n]
        on_right = on_right & (near >= 0) & (near <= ids)
        columns.append(np.where(on_right, near, -1))
    some = (columns[REACH - 1] >= 0) | (columns[REACH + 1] >= 0)
    return np.column_stack([c[some] for c in columns])


def _mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for c in range(rows.shape[1]):
        h = mix(h ^ rows[:, c].astype(np.uint64)) + U64(c + 1)
    return h


def _runs(rows: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order in which equal rows lie together, and where runs of them begin.

    By hashes; should different rows share one, by the ids themselves, or with
    ``exact`` off in more than one run.
    """
    h = _mixed(rows)
    order = np.argsort(h)
    lined = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (lined[1:] != lined[:-1]).any(axis=1)
    if exact and (new[1:] & (h[order][1:] == h[order][:-1])).any():
        order = np.lexsort(rows.T[::-1])
        lined = rows[order]
        new[1:] = (lined[1:] != lined[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def _parts(pivot: np.ndarray, limits: list[int]) -> np.ndarray:
    """Over how many parts each pivot's fragments are dealt: twice as many for each limit that its id is within."""
    return 1 << sum((pivot <= limit for limit in limits), np.zeros(len(pivot), dtype=np.int64))


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Values that lie end to end."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _places(entries: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where in the codes of rows that lie end to end each entry's number is and each id's lowest byte, and how far apart its bytes are.

    entries and ids: where each row's begin.  A row has its numbers, then the
    lowest bytes of its ids, then the next ones: bytes that are alike lie together.
    """
    m, k = np.diff(entries), np.diff(ids)
    number = np.arange(entries[-1] - entries[0]) + np.repeat(width * (ids[:-1] - ids[0]), m)
    low = np.arange(ids[-1] - ids[0]) + np.repeat(entries[1:] - entries[0] + (width - 1) * (ids[:-1] - ids[0]), k)
    return number, low, np.repeat(k, k)


def _packed(key: np.ndarray, cut: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each key of fragments that lie by key: their sizes, numbers and ids, ``width`` bytes each and without the pivot's."""
    times = -(-n // MOST)
    if (times > 1).any():
        first = np.cumsum(times) - times
        key, cut, rest = np.repeat(key, times), np.repeat(cut, times, axis=0), np.repeat(n, times)
        n = np.minimum(rest - MOST * (np.arange(len(rest)) - np.repeat(first, times)), MOST)
    held = cut >= 0
    left, right = held[:, :REACH].sum(axis=1), held[:, REACH + 1 :].sum(axis=1)
    held[:, REACH] = False
    ids = cut[held]
    entries = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
    begins = np.concatenate([[0], np.cumsum(left + right)])[entries]
    number, low, apart = _places(entries, begins, width)
    codes = np.empty(len(key) + width * len(ids), dtype=np.uint8)
    codes[number] = n
    for i in range(width):
        codes[low + i * apart] = ids >> 8 * i & 255
    columns = [(left | right << 4).astype(np.uint8), codes]
    binary = [pa.BinaryArray.from_buffers(pa.binary(), len(entries) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]) for data, at in zip(columns, (entries, entries + width * begins), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[entries[:-1]]), *binary], names=["key", "sizes", "codes"])


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fragments as rows of nine ids, numbers), some rows of a batch at a time."""
    keys = batch.column(0).to_numpy()
    (sizes, entries), (codes, starts) = (text_bytes(batch.column(i)) for i in (1, 2))
    offsets = np.arange(-REACH, REACH + 1)
    for a, b in blocks(entries, FRAGMENTS_AT_ONCE):
        own = sizes[entries[a] : entries[b]].astype(np.int64)
        left, right, key = own & 15, own >> 4, np.repeat(keys[a:b], np.diff(entries[a : b + 1]))
        packed = codes[starts[a] : starts[b]]
        number, low, apart = _places(entries[a : b + 1], (starts[a : b + 1] - entries[a : b + 1]) // width, width)
        ids = sum(packed[low + i * apart].astype(np.int64) << 8 * i for i in range(width))
        rows = np.full((len(own), len(offsets)), -1, dtype=np.int64)
        rows[(offsets >= -left[:, None]) & (offsets <= right[:, None]) & (offsets != 0)] = ids
        rows[:, REACH] = key // PARTS
        yield key, rows, packed[number].astype(np.int64)


def _fragments(rows: Iterator[np.ndarray], limits: list[int], width: int) -> Batches:
    """Rewritten fragments of texts, equal ones of a chunk once with their number, by pivot."""

    def out(chunk: np.ndarray) -> pa.RecordBatch:
        cut = _windows(chunk.astype(np.int32) if width < 4 else chunk)
        order, starts = _runs(cut, exact=False)
        n = np.diff([*starts, len(cut)])
        cut = cut[order[starts]]
        key = cut[:, REACH].astype(np.int64) * PARTS + (_mixed(cut) >> U64(20)).astype(np.int64) % _parts(cut[:, REACH], limits)
        order = np.argsort(key, kind="stable")
        return _packed(key[order], cut[order], n[order], width)

    held: list[np.ndarray] = []
    size = 0
    for ids in rows:
        held.append(ids)
        size += len(ids)
        if size > WORDS_AT_ONCE:
            yield out(np.concatenate(held))
            held, size = [], 0
    if held:
        yield out(np.concatenate(held))


def fragments(named: DataFrame, words: DataFrame, limits: list[int], width: int, dictionary: int) -> DataFrame:
    """(key, sizes, codes) of all texts, a row for each key of a chunk; width: bytes of an id."""
    if words.count() > dictionary:
        return _ids_by_join(named, words).mapInArrow(lambda batches: _fragments(_listed(batches), limits, width), _FRAGMENT)
    held: dict[str, dict[bytes, int]] = {}
    for row in words.select("lang", "word", "id").collect():  # dictionary rows at most
        held.setdefault(row["lang"], {})[row["word"].encode()] = row["id"]
    shared = named.sparkSession.sparkContext.broadcast(held)
    return named.mapInArrow(lambda batches: _fragments(_look_up(shared, batches), limits, width), _FRAGMENT)


def _mine(rows: np.ndarray, weight: np.ndarray, whole: np.ndarray, support: int) -> Batches:
    """The phrases of whole groups of fragments, and how often each occurs.

    Phrases grow from their pivot; one that is infrequent ends those that hold it,
    where the group has all fragments of its pivot.
    """
    ended: dict[tuple[int, int], np.ndarray] = {}
    for size in range(2, LONGEST + 1):
        for a in range(size):
            b = size - 1 - a
            use = (rows[:, REACH - a] >= 0) & (rows[:, REACH + b] >= 0)
            for shorter in ((a - 1, b), (a, b - 1)):
                if shorter in ended:
                    use &= ~ended[shorter]
            gone = ~use
            at = np.flatnonzero(use)
            if len(at):
                grams = rows[at, REACH - a : REACH + b + 1]
                order, starts = _runs(grams)
                n = np.add.reduceat(weight[at[order]], starts)
                keep = (n >= support) | ~whole[at[order[starts]]]
                gone[at[order]] = np.repeat(~keep, np.diff([*starts, len(at)]))
                found = grams[order[starts[keep]]]
                if len(found):
                    ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * size)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1))), pa.array(n[keep])], names=["gram", "n"])
            ended[a, b] = gone


def mined(routed: DataFrame, limits: list[int], width: int, support: int) -> DataFrame:
    """(gram, n) of fragments that lie by key; a pivot in one part has its phrases' whole counts."""

    def run(batches: Batches) -> Batches:
        def out(rows: np.ndarray, n: np.ndarray) -> Batches:
            yield from _mine(rows, n, _parts(rows[:, REACH], limits) == 1, support)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, last = 0, None
        for batch in batches:
            for keys, rows, n in _unpacked(batch, width):
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                if size >= FRAGMENTS_AT_ONCE and (keys[0] != last or len(ends)):  # the last group goes on up to here
                    first = 0 if keys[0] != last else ends[0]
                    held.append((rows[:first], n[:first]))
                    yield from out(*map(np.concatenate, zip(*held, strict=True)))
                    held, size, rows, n = [], 0, rows[first:], n[first:]
                held.append((rows, n))
                size, last = size + len(rows), keys[-1]
        if held:
            yield from out(*map(np.concatenate, zip(*held, strict=True)))

    return routed.mapInArrow(run, "gram array<long>, n long")


def numbered(frequent: DataFrame, scratch: storage.Scratch) -> DataFrame:
    """Words with ids from 0 on, the most frequent first: places in sorted partitions, and how many words lie before each."""
    lined = scratch.written(frequent.orderBy(F.desc("f"), "lang", "word").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    parts = lined.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each sorted partition
    before = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return scratch.written(lined.join(F.broadcast(before), "part").select("lang", "word", "f", (F.col("before") + F.col("at") - F.col("first")).alias("id")), "words")


def _scored(grams: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases that no longer one holds as often, by the cut of the lowest score."""
    size = F.size("gram")
    longer = grams.where(size > 2).select(F.explode(F.array(F.slice("gram", 1, size - 1), F.slice("gram", 2, size - 1))).alias("gram"), "a")
    kept = grams.join(longer, ["gram", "a"], "left_anti")
    counts = grams.unionByName(words.select(F.array("id").alias("gram"), F.col("f").alias("a")))
    placed = kept.select("gram", F.posexplode("gram").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = placed.groupBy("gram").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w")).select("gram", "lang", F.array_join("w.word", " ").alias("phrase"))
    cuts = kept.join(spelled, "gram").join(totals, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.slice("gram", 1, F.col("k")).alias("head"), F.slice("gram", F.col("k") + 1, size - F.col("k")).alias("tail"))
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select(F.col("gram").alias(side), F.col("a").alias(name)), side)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 5 words."""
    scratch = storage.Scratch(docs.sparkSession, "phrases")
    try:
        named = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
        counts = scratch.written(word_counts(named), "counts")
        totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        words = numbered(counts.where(F.col("f") >= support), scratch)
        # A number for each doubling of block: bounded by the width of a count.
        most, *doubled = words.agg(F.max("id"), *(F.max(F.when(F.col("f") > F.lit(block << j), F.col("id"))).alias(f"m{j}") for j in range(20))).first()
        limits, width = [m for m in doubled if m is not None], max(1, -(-(most or 0).bit_length() // 8))
        routed = fragments(named, words, limits, width, dictionary).repartition("key").sortWithinPartitions("key")
        found = mined(routed, limits, width, support).groupBy("gram").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
        grams = scratch.written(found, "grams")
        w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = _scored(grams, words, totals).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        return storage.written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    finally:
        scratch.drop()
