"""Packs token sequences by vector best fit.

A document's token ids, closed by the id 0, are cut only where they exceed a
sequence.  Pieces are dealt at random to groups of bounded size; each group is
packed by decreasing length.  A bin has three residual capacities: tokens,
documents and attention cost (the sum of squared lengths).  Among the bins that
can take a piece under all three, the one with the least weighted residual norm
is chosen, or the one with the largest weighted dot product of the piece's
demand and the bin's residual.  A group leaves a few bins partly filled, which
is a waste of a fraction that falls with the group size.

Nulls and empty texts are a document of the id 0 alone; a text of any length is
encoded whole.  Repeated rows are packed as often as they occur.  Of bins that
fit equally well the first in the group's list is taken.  Without documents there
are no pieces.  ``pack`` keeps further columns of the pieces; ``sequence_id``,
``offset`` and ``_group`` must not be among them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm import storage


class Capacity(NamedTuple):
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


#: Of the weighted norm: the token residual decides, the others break its ties.
WEIGHTS = (1.0, 1e-4, 1e-4)
GROUP = 8192
END_ID = 0

#: The pre-tokeniser's pattern of the public byte-level vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class all libraries agree on; texts with others, or with a special token, take the slow library.
_PLAIN = r"\t\n\r\x20-\x7e\xa1-ɏ‐-―‘-‟…€"
#: On longer runs of white space the fast library is slow, and beyond some 100,000 characters it gives up.
_LONGEST_BLANK = 256


class Vocabulary(NamedTuple):
    """The two public files of one byte-level vocabulary; the ranks are its fast form."""

    tokenizer_json: str
    ranks: bytes

    @classmethod
    def read(cls, json_path: str, ranks_path: str) -> Vocabulary:
        with open(json_path, encoding="utf-8") as a, open(ranks_path, "rb") as b:
            return cls(a.read(), b.read())


class Encoder:
    """Ids of whole texts as the JSON tokenizer gives them."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.ranks.splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json, self.slow = vocabulary.tokenizer_json, None
        self.unusual = re.compile(rf"[^{_PLAIN}]|<\||\s{{{_LONGEST_BLANK}}}")

    def __call__(self, text: str) -> np.ndarray:
        if self.unusual.search(text) is None:
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
            except ValueError:  # its pattern gave up: the tokenizer's own does not
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.json)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document in pieces of at most ``size`` ids; only the first may be shorter."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # two files of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.array([END_ID], dtype="<u4"))
                first = len(ids) % size or size
                begins = [0, *range(first, len(ids), size)]
                for k, (begin, end) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True)):
                    rows.append((i, k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, c]) for c in (2, 3, 4))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    schema = docs.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select(key, text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces in the given order, which should fall in length."""
    full = np.array(capacity, dtype=float)
    w = np.array(weights)
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    residual = np.zeros((3, 64))
    number = np.zeros(64, dtype=np.int64)
    used = opened = 0
    least = lengths.min() if len(lengths) else 0
    for i, n in enumerate(lengths):
        demand = np.array([n, 1.0, float(n) * n])
        chosen = -1
        if used:
            left = residual[:, :used] - demand[:, None]
            fits = np.flatnonzero((left >= 0).all(axis=0))
            if len(fits):
                if rule == "norm":
                    chosen = int(fits[np.argmin((w / full) @ left[:, fits])])
                else:
                    chosen = int(fits[np.argmax((w * demand / full**2) @ residual[:, fits])])
        if chosen < 0:
            if (demand > full).any():
                raise ValueError(f"a piece of {n} ids exceeds a bin's capacities")
            if used == residual.shape[1]:
                residual = np.concatenate([residual, np.zeros_like(residual)], axis=1)
                number = np.concatenate([number, np.zeros_like(number)])
            residual[:, used], number[used] = full, opened
            chosen, used, opened = used, used + 1, opened + 1
        bins[i], offsets[i] = number[chosen], int(full[0] - residual[0, chosen])
        residual[:, chosen] -= demand
        if residual[0, chosen] < least or residual[1, chosen] < 1:  # nothing fits any more
            used -= 1
            residual[:, chosen], number[chosen] = residual[:, used], number[used]
    return bins, offsets


def pack(cut: DataFrame, key: str = "doc_id", capacity: Capacity = Capacity(), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    n_groups = max(1, -(-cut.count() // group))
    # The row's place counts, so that repeated rows do not meet in one group; cut is a table, whose rows keep their places.
    place = F.xxhash64(key, "piece", "ids_crc32", "length", F.monotonically_increasing_id())
    dealt = cut.withColumn("_group", F.pmod(place, F.lit(n_groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", key, "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, weights, rule)
        frame["sequence_id"] = frame["_group"].to_numpy() * (1 << 24) + bins
        frame["offset"] = offsets
        return frame.drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(run, cut.schema.add("sequence_id", "long").add("offset", "long"))


def tokenize_and_pack(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", capacity: Capacity = Capacity(), **options: object) -> DataFrame:
    """Whole documents to packed pieces; the pieces are written once, as texts are costly to cut twice."""
    cut = storage.written(pieces(docs, vocabulary, key, text, capacity.tokens), "pieces")
    return pack(cut, key, capacity, **options)
