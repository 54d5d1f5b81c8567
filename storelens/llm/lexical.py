"""Ranked lexical search: three-phase uniform thresholds (TPUT) over term-partitioned postings.

Every query gets its ``k`` best documents by a sum of integer term scores,
exactly.

1. One pass over the texts writes each document's length and its counts of the
   queries' terms, which a bitmap of ``BITMAP_BITS`` bits picks out; terms that
   only share a bit go in a later join.  Corpus counts cover all documents.
2. Postings are written by term, each list sorted by score.  A list of more than
   ``LIST_BLOCK`` postings is dealt over several sub-lists by document, so no
   task holds a long list.
3. *Heads.*  The first k entries of every list give partial sums.  The least
   exact score of a query's k best by these sums is its lower bound.
4. *Uniform threshold.*  With m lists, an unseen document whose every entry is
   under bound / m cannot reach the bound, so entries from that score on are
   fetched from every list.  Documents whose sum, with the most that their
   missing lists may hold, stays under the bound are given up, and once more
   when the k-th best sum has raised it.
5. *Lookup.*  The candidates left get their missing entries by (term, document).

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased.  Each row of the documents is a document, so rows that share an id
are ranked each; equal scores go by ascending id, a null id last.  Null and empty
texts have no terms.  Rows of queries that share an id, null too, are one query
with all their terms; a query without a term that any document has, or whose
terms weigh nothing, returns no row.  Empty tables give an empty result.  Other
columns are not read, so they may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm import storage

#: The characters between terms, as ASCII ranges.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP_BITS = 1 << 24
#: Postings of a list from which it is dealt over several sub-lists.
LIST_BLOCK = 20_000
#: Query terms up to which their thresholds are broadcast.
BROADCAST_ROWS = 200_000
#: Texts that a worker counts before it hands over a batch, in bytes.
BATCH_BYTES = 4 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def query_terms(queries: DataFrame, names: DataFrame, item: str, text: str) -> DataFrame:
    """(query, term), once each; names has a number ``query`` for every ``item``, null too."""
    words = F.split(F.translate(F.col(text), UPPER, LOWER), GAPS)
    asked = queries.select(F.col(item).alias("_item"), F.explode(words).alias("term")).where("term <> ''")
    return asked.join(names, F.col("_item").eqNullSafe(F.col("item"))).select("query", "term").distinct()


def _bit(term: Column) -> Column:
    return F.crc32(term) % F.lit(BITMAP_BITS)


def _bitmap(terms: DataFrame) -> bytes:
    """The terms' bits; BITMAP_BITS / 8 bytes at most, whatever their number."""
    bits = terms.select(_bit(F.col("term")).alias("b")).groupBy((F.col("b") / F.lit(8 * 4096)).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("b") % F.lit(8 * 4096)).alias("bits"))
    whole = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in bits.collect():
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return whole.tobytes()


def counted(docs: DataFrame, bitmap: bytes, doc_id: str, text: str) -> DataFrame:
    """(doc, doc_id, n, terms, tfs): every row's number of terms, and its counts of terms whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        bits, known = shared.value, {}

        def wanted(term: bytes) -> bool:
            found = known.get(term)
            if found is None:
                at = crc32(term) % BITMAP_BITS
                found = bool(bits[at >> 3] >> (at & 7) & 1)
                if len(known) < 1 << 20:
                    known[term] = found
            return found

        def batch(rows: list[int], source: pa.RecordBatch, lengths: list[int], offsets: list[int], terms: list[bytes], tfs: list[int]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            ends = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            return pa.RecordBatch.from_arrays([source.column(0).take(at), source.column(1).take(at), pa.array(lengths, pa.int64()), *lists], names=["doc", "doc_id", "n", "terms", "tfs"])

        for source in batches:
            rows, lengths, offsets, terms, tfs, held = [], [], [0], [], [], 0
            for i, value in enumerate(source.column(2)):
                raw = value.as_buffer()
                found = terms_of(raw.to_pybytes()) if raw is not None else []
                counts = Counter(found)
                own = [t for t in counts if wanted(t)]
                rows.append(i)
                lengths.append(len(found))
                terms += own
                tfs += [counts[t] for t in own]
                offsets.append(len(terms))
                held += raw.size if raw is not None else 0
                if held >= BATCH_BYTES:
                    yield batch(rows, source, lengths, offsets, terms, tfs)
                    rows, lengths, offsets, terms, tfs, held = [], [], [0], [], [], 0
            if rows:
                yield batch(rows, source, lengths, offsets, terms, tfs)

    named = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc long, doc_id {kind}, n long, terms array<string>, tfs array<long>")


def _best(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their ``rank``; each task sends k of a key at most."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(query, low): the k-th best sum of every query that has k."""
    return _best(sums.select("query", "s"), "query", k, F.desc("s")).where(F.col("rank") == k).select("query", F.col("s").alias("low"))


def _near(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, wanted: DataFrame, scratch: storage.Scratch, doc_id: str = "doc_id", text: str = "text", block: int = LIST_BLOCK) -> DataFrame:
    """(term, doc, c) with c > 0: what a term adds to a document's score, by term and descending score."""
    forward = scratch.written(counted(docs, _bitmap(wanted), doc_id, text), "forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = frequencies.join(wanted.select("term").distinct(), "term").select("term", weight.alias("w"), F.ceil(F.col("df") / F.lit(block)).alias("blocks")).where("w > 0")
    weights = scratch.written(weighed, "weights")
    measure = F.lit(50) + F.call_function("div", F.lit(50) * F.col("n") * F.lit(n_docs), F.lit(max(1, n_terms)))
    entries = forward.select("doc", measure.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("doc", "m", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    share = F.call_function("div", F.lit(1_000_000_000) * F.col("tf"), 1000 * F.col("tf") + 20 * F.col("m"))
    scored = entries.join(weights, "term").select("term", "doc", (F.col("w") * share).alias("c"), F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("_part")).where("c > 0")
    lists = scored.repartition("term", "_part").drop("_part").sortWithinPartitions("term", F.desc("c"))
    return scratch.written(lists, "postings")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", query_text: str = "text", block: int = LIST_BLOCK) -> DataFrame:
    """(item, rank, doc_id, score): every query's k best documents among all.

    block: postings of a list from which it is dealt over several tasks.
    """
    scratch = storage.Scratch(docs.sparkSession, "lexical")
    zero = F.lit(0).cast("long")
    try:
        names = scratch.written(queries.select(F.col(item).alias("item")).distinct().withColumn("query", F.monotonically_increasing_id()), "names")
        wanted = scratch.written(query_terms(queries, names, item, query_text), "terms")
        lists = postings(docs, wanted, scratch, doc_id, text, block)

        heads = scratch.written(_best(lists, "term", k, F.desc("c"), F.col("doc")), "heads")
        asked = scratch.written(wanted.join(heads.where("rank = 1").select("term", F.col("c").alias("top")), "term"), "asked")  # terms that some document has
        sums = heads.join(asked, "term").groupBy("query", "doc").agg(F.sum("c").alias("s"))
        first = scratch.written(_best(sums, "query", k, F.desc("s"), F.col("doc")).select("query", "doc"), "first")
        exact = lists.select("term", "doc", "c").join(first, "doc").join(asked.select("query", "term"), ["query", "term"]).groupBy("query", "doc").agg(F.sum("c").alias("s"))
        sizes = asked.groupBy("query").agg(F.count("*").alias("m"))
        low = F.coalesce("low", zero)
        bounds = sizes.join(_kth(exact, k), "query", "left").select("query", low.alias("low"), F.call_function("div", low + F.col("m") - 1, F.col("m")).alias("need"))
        # An entry that is not fetched holds less than need, and no more than its list's first.
        thresholds = scratch.written(asked.join(bounds, "query").select("query", "term", "low", "need", F.least("top", F.greatest(F.col("need") - 1, zero)).alias("gap")), "thresholds")

        # All entries of a document meet in one task first, so sums for many queries are not shuffled.
        least = thresholds.groupBy("term").agg(F.min("need").alias("least"))
        fetched = lists.select("term", "doc", "c").join(least, "term").where("c >= least").select("term", "doc", "c").repartition("doc")
        summed = fetched.join(_near(thresholds.select("query", "term", "need", "gap")), "term").where("c >= need").groupBy("doc", "query").agg(F.sum("c").alias("s"), F.sum("gap").alias("known"))
        gaps = thresholds.groupBy("query").agg(F.sum("gap").alias("gaps"), F.first("low").alias("low"))
        within = F.col("s") + F.col("gaps") - F.col("known") >= F.col("low")
        seen = scratch.written(summed.join(gaps, "query").where(within).select("query", "doc", "s", (F.col("gaps") - F.col("known")).alias("missing")), "seen")
        raised = seen.join(_kth(seen, k), "query", "left").where(F.col("s") + F.col("missing") >= F.coalesce("low", zero))
        candidates = scratch.written(raised.select("query", "doc", "s", "missing"), "candidates")

        asks = candidates.where("missing > 0").select("query", "doc").join(thresholds.where("gap > 0").select("query", "term", "need"), "query")
        looked_up = asks.join(lists.select("term", "doc", "c"), ["term", "doc"]).where("c < need").groupBy("query", "doc").agg(F.sum("c").alias("more"))
        scores = candidates.join(looked_up, ["query", "doc"], "left").select("query", "doc", (F.col("s") + F.coalesce("more", zero)).alias("score"))
        forward = scratch.read("forward").select("doc", "doc_id")
        ranked = _best(scores.join(forward, "doc"), "query", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("doc"))
        return storage.written(ranked.join(names, "query").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(doc_id), "score"), "ranked")
    finally:
        scratch.drop()
