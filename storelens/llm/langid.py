"""Language identification with segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary; a language is a probability for each.
The probability of a word is the sum, over all ways to cut it into pieces, of
the product of the pieces' probabilities, which a forward recursion gives
exactly.  A text's probability is the product over its words; the language with
the largest one wins, and its posterior under equal priors is the score.

Probabilities are fitted by expectation maximisation on word counts of a bounded
sample: at most ``sample`` different texts of each language, those with the
smallest hash, so that a text with very many copies counts once.  Words are runs
of bytes other than white space, lower-cased, with a space before them as in the
vocabulary.  In the fit a longer word, as languages without spaces have them, is
cut into parts of ``TRAINING_PART`` characters, all of which count, the first one
with the space; pieces over a cut are not counted there.  In scoring nothing is
cut.  Every piece of the vocabulary that a lower-cased word can hold is in the
model, seen in the fit or not, and a language's probabilities sum to 1.  Every
distinct word of a block is scored once.

A null or empty text, or one without a letter, is ``und`` with score 0.  Rows
whose language is null are not learned from; without any other every text is
``und``.  Of equally likely languages the first by name wins.  Repeated rows are
each predicted, and equal texts alike.  The columns in ``keep`` may have any name
but ``lang_pred`` and ``score``.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm import storage
from storelens.llm.blocks import blocks, text_bytes, word_hashes, words

#: Characters of a word that the fit takes in one part.
TRAINING_PART = 64
#: Longer words are scored one by one, shorter ones side by side.
LONG_WORD = 512
#: Expected count added to every piece of the vocabulary; of 0.002 to 0.2 the best on two-word texts that were held out.
SMOOTHING = 0.2
RESCALE_EVERY = 12
#: The trie's last row, from which no piece goes on; node 0 is the root.
DEAD = -1
WORK_BYTES = 4 << 20


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # byte -> column of the trie; 0 for bytes that only have their single-byte piece
    trie: np.ndarray  # node, column -> node; 0 where no piece goes on
    piece_of: np.ndarray  # node -> piece + 1, or 0
    probability: np.ndarray  # piece + 1, language; row 0 is zero
    unknown: np.ndarray  # language -> probability of a byte in column 0
    longest: int
    pieces: list[bytes]


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a ranks file that lower-cased words can hold."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted(p for p in found if p == p.lower() and not any(c in p[1:] for c in b" \t\n\r"))


def _empty_model(languages: list[str], pieces: list[bytes], alphabet: list[int]) -> Model:
    codes = np.zeros(256, dtype=np.int64)
    codes[alphabet] = np.arange(1, len(alphabet) + 1)
    pieces = sorted({p for p in pieces if all(codes[c] for c in p)} | {bytes([c]) for c in alphabet})
    children: list[dict[int, int]] = [{}]
    ends = [0]
    for number, piece in enumerate(pieces, 1):
        node = 0
        for c in piece:
            column = int(codes[c])
            if column not in children[node]:
                children[node][column] = len(children)
                children.append({})
                ends.append(0)
            node = children[node][column]
        ends[node] = number
    trie = np.zeros((len(children) + 1, len(alphabet) + 1), dtype=np.int32)
    for node, steps in enumerate(children):
        for column, child in steps.items():
            trie[node, column] = child
    share = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    share[0] = 0
    return Model(languages, codes, trie, np.array([*ends, 0]), share, np.full(len(languages), 1e-9), max(map(len, pieces), default=1), pieces)


def _shipped(model: Model) -> tuple:
    """What tasks need to build the model again: the pieces and their numbers, some 2 MB, without the trie."""
    return model.languages, model.pieces, np.flatnonzero(model.codes).tolist(), model.probability, model.unknown


def _built(shipped: tuple) -> Model:
    languages, pieces, alphabet, probability, unknown = shipped
    return _empty_model(languages, pieces, alphabet)._replace(probability=probability, unknown=unknown)


def _matrix(raw: np.ndarray, first: np.ndarray, length: np.ndarray, model: Model, opens: bool = True) -> np.ndarray:
    """Words of one length as rows of trie columns, with the space before them; a later part of a word has none."""
    n = int(length[0])
    out = np.empty((len(first), n + 1), dtype=np.int64)
    out[:, 0] = model.codes[0x20]
    out[:, 1:] = model.codes[raw[first[:, None] + np.arange(n)]]
    return out if opens else out[:, 1:]


def _walk(columns: np.ndarray, model: Model) -> dict[tuple[int, int], np.ndarray]:
    """Piece number of every span (begin, end) in which any word has a piece."""
    found = {}
    for begin in range(columns.shape[1]):
        node = np.zeros(len(columns), dtype=np.int64)
        for end in range(begin + 1, min(columns.shape[1], begin + model.longest) + 1):
            node = model.trie[node, columns[:, end - 1]]
            if not node.any():
                break
            node = np.where(node == 0, DEAD, node)
            piece = model.piece_of[node]
            if piece.any():
                found[begin, end] = piece
    return found


def _forward(columns: np.ndarray, model: Model) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed."""
    n, width = columns.shape
    alphas = {0: np.ones((n, len(model.languages)))}
    scale = np.zeros((n, len(model.languages)))
    nodes: dict[int, np.ndarray] = {}  # begin -> node reached so far
    for end in range(1, width + 1):
        column = columns[:, end - 1]
        nodes[end - 1] = np.zeros(n, dtype=np.int64)
        total = np.where((column == 0)[:, None], alphas[end - 1] * model.unknown, 0.0)
        for begin in list(nodes):
            node = model.trie[nodes[begin], column]
            if not node.any():
                del nodes[begin]
                continue
            total += alphas[begin] * model.probability[model.piece_of[node]]
            nodes[begin] = np.where(node == 0, DEAD, node)
        alphas[end] = total
        for old in [b for b in alphas if b not in nodes and b != end]:
            del alphas[old]
        if end % RESCALE_EVERY == 0:
            top = np.maximum(total, 1e-280)
            scale += np.log(top)
            for b in alphas:
                alphas[b] = alphas[b] / top
    return np.log(np.maximum(alphas[width], 1e-300)) + scale


def _forward_long(word: bytes, model: Model, steps: dict[tuple[int, int], int]) -> np.ndarray:
    """The sum of ``_forward`` for one word of any length, position by position; steps as ``_steps`` gives them."""
    columns = [int(model.codes[0x20]), *model.codes[np.frombuffer(word, np.uint8)].tolist()]
    window: list[np.ndarray | None] = [None] * (model.longest + 1)  # what reached the positions ahead
    window[0] = np.ones(len(model.languages))
    scale = np.zeros(len(model.languages))
    for begin in range(len(columns)):
        here = window.pop(0)
        window.append(None)
        if here is None:
            here = np.zeros(len(model.languages))
        if begin % RESCALE_EVERY == 0:
            top = np.maximum(here, 1e-280)
            scale += np.log(top)
            here = here / top
            window = [None if ahead is None else ahead / top for ahead in window]
        node = 0
        for k in range(min(model.longest, len(columns) - begin)):
            column = columns[begin + k]
            node = steps.get((node, column), 0)
            reached = here * model.probability[model.piece_of[node]] if node else None
            if k == 0 and column == 0:
                reached = here * model.unknown
            if reached is not None:
                window[k] = reached if window[k] is None else window[k] + reached
            if not node:
                break
    last = window[0]
    return np.log(np.maximum(last if last is not None else np.zeros(len(model.languages)), 1e-300)) + scale


def _steps(model: Model) -> dict[tuple[int, int], int]:
    """The trie as a dictionary (node, column) -> node."""
    nodes, columns = np.nonzero(model.trie)
    return dict(zip(zip(nodes.tolist(), columns.tolist(), strict=True), model.trie[nodes, columns].tolist(), strict=True))


def _expected(columns: np.ndarray, weight: np.ndarray, language: np.ndarray, model: Model) -> np.ndarray:
    """Expected number of uses of every piece, (pieces + 1, languages), from weighted words of known languages.

    Sums are kept as logarithms, so that words of any length keep their place.
    """
    n, width = columns.shape
    spans = _walk(columns, model)
    with np.errstate(divide="ignore"):
        own = {span: np.log(model.probability[piece, language]) for span, piece in spans.items()}
        unknown = np.log(model.unknown[language])
    alone = {at: np.where(columns[:, at] == 0, unknown, -np.inf) for at in range(width) if (columns[:, at] == 0).any()}
    alpha = np.full((width + 1, n), -np.inf)
    beta = np.full((width + 1, n), -np.inf)
    alpha[0] = beta[width] = 0
    by_end = sorted(own.items(), key=lambda x: x[0][1])
    by_begin = sorted(own.items(), key=lambda x: -x[0][0])
    k = 0
    for end in range(1, width + 1):
        if end - 1 in alone:
            alpha[end] = alpha[end - 1] + alone[end - 1]
        while k < len(by_end) and by_end[k][0][1] == end:
            (begin, _), p = by_end[k]
            alpha[end] = np.logaddexp(alpha[end], alpha[begin] + p)
            k += 1
    k = 0
    for begin in range(width - 1, -1, -1):
        if begin in alone:
            beta[begin] = beta[begin + 1] + alone[begin]
        while k < len(by_begin) and by_begin[k][0][0] == begin:
            (_, end), p = by_begin[k]
            beta[begin] = np.logaddexp(beta[begin], beta[end] + p)
            k += 1
    whole = np.maximum(alpha[width], -1e300)
    out = np.zeros((len(model.pieces) + 1, len(model.languages)))
    for (begin, end), piece in spans.items():
        np.add.at(out, (piece, language), weight * np.exp(np.minimum(alpha[begin] + own[begin, end] + beta[end] - whole, 0)))
    out[0] = 0
    return out


def fit(docs: DataFrame, vocabulary: list[bytes], text: str = "text", lang: str = "lang", sample: int = 1500, rounds: int = 3) -> Model:
    """Fits on at most ``sample`` texts of each language; callers drop held-out rows beforehand."""
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    cut = known.select("lang", F.xxhash64("text").alias("h")).groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    sizes = {r["lang"]: r["n"] for r in cut.collect()}
    languages = sorted(sizes)
    if not languages:
        return _empty_model(["und"], [], [0x20])  # nothing to tell apart
    # Different texts below a hash that leaves about twice the sample, then exactly the smallest ones; only hashes are ranked.
    limit = F.lit(1.0)
    for name, n in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * sample / n + 50.0 / n))).otherwise(limit)
    hashed = known.withColumn("h", F.xxhash64("text")).where((F.col("h") / F.lit(2.0**64) + 0.5) < limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ranked = hashed.select("lang", "h").distinct().withColumn("_rank", rank).where(F.col("_rank") <= sample).select("lang", "h")
    chosen = hashed.join(F.broadcast(ranked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # sample hashes a language
    spaced = F.explode(F.split(F.lower("text"), r"[ \t\n\u000B\f\r]+")).alias("word")
    parts = F.posexplode(F.regexp_extract_all("word", F.lit(f"(?s).{{1,{TRAINING_PART}}}"), F.lit(0))).alias("part", "word")
    counted = chosen.select("lang", spaced).where("word <> ''").select("lang", parts).groupBy("lang", "word", (F.col("part") == 0).alias("opens")).agg(F.count("*").alias("n"))
    table = storage.written(counted.select(F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).alias("language"), "word", "n", "opens"), "words")
    seen = table.select(F.explode(F.array_distinct(F.split(F.hex("word"), "(?<=\\G..)"))).alias("b")).where("b <> ''").distinct().collect()
    alphabet = sorted({0x20, *itertools.chain.from_iterable(vocabulary)} | {int(r["b"], 16) for r in seen})
    model = _empty_model(languages, vocabulary, alphabet)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(_shipped(model))  # vocabulary x languages: bounded by the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = _built(shared.value)
            total = np.zeros_like(now.probability)
            for batch in batches:
                data, starts = text_bytes(batch.column(1))
                length = np.diff(starts)
                language = batch.column(0).to_numpy() - 1
                weight = batch.column(2).to_numpy().astype(float)
                opens = batch.column(3).to_numpy(zero_copy_only=False)
                for n, o in {*zip(length.tolist(), opens.tolist(), strict=True)}:
                    at = np.flatnonzero((length == n) & (opens == o))
                    columns = _matrix(data, starts[:-1][at], length[at], now, o)
                    for k in range(0, len(at), 20_000):
                        total += _expected(columns[k : k + 20_000], weight[at[k : k + 20_000]], language[at[k : k + 20_000]], now)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], names=["piece", "language", "uses"])

        uses = table.mapInArrow(run, "piece long, language long, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses")).toPandas()
        counts = np.zeros_like(model.probability)
        counts[uses["piece"], uses["language"]] = uses["uses"]
        counts[1:] += SMOOTHING
        counts[0] = 0
        model = model._replace(probability=counts / counts.sum(axis=0), unknown=SMOOTHING / counts.sum(axis=0) / 256)
    return model


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode(errors="ignore"))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, ``lang_pred`` and ``score``; every word of every text counts."""
    shared = docs.sparkSession.sparkContext.broadcast(_shipped(model))  # pieces x languages
    letters = np.zeros(256, dtype=bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, steps = _built(shared.value), {}
        names = np.array([*now.languages, "und"], dtype=object)
        for batch in batches:
            data, starts = text_bytes(batch.column(len(keep)))
            pred, score = np.full(len(batch), len(now.languages)), np.zeros(len(batch))
            for lo, hi in blocks(starts, WORK_BYTES):
                own, begins = data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
                first, length, owner = words(own, begins)
                _, kind, inverse = np.unique(word_hashes(own, first, length, lower=False), return_index=True, return_inverse=True)
                log_p = np.zeros((len(kind), len(now.languages)))
                for n in np.unique(length[kind]):
                    at = np.flatnonzero(length[kind] == n)
                    if n > LONG_WORD:
                        steps = steps or _steps(now)
                        for i in at:
                            begin = first[kind[i]]
                            log_p[i] = _forward_long(own[begin : begin + n].tobytes(), now, steps)
                        continue
                    for k in range(0, len(at), 8_000):
                        some = at[k : k + 8_000]
                        log_p[some] = _forward(_matrix(own, first[kind[some]], length[kind[some]], now), now)
                totals = np.column_stack([np.bincount(owner, log_p[inverse, c], minlength=hi - lo) for c in range(len(now.languages))])
                totals -= totals.max(axis=1, keepdims=True)
                posterior = np.exp(totals)
                posterior /= posterior.sum(axis=1, keepdims=True)
                lettered = np.add.reduceat(np.append(letters[own], False), np.minimum(begins[:-1], len(own)))[: hi - lo].astype(bool) & (np.diff(begins) > 0)
                for i in np.flatnonzero(~lettered & (np.diff(begins) > 0)):
                    lettered[i] = _has_letter(own[begins[i] : begins[i + 1]].tobytes())
                best = posterior.argmax(axis=1)
                pred[lo:hi] = np.where(lettered, best, len(now.languages))
                score[lo:hi] = np.where(lettered, posterior[np.arange(hi - lo), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names[pred], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.lower(F.col(text)).alias(text)).mapInArrow(run, schema)
