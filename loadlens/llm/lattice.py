"""Language model scores: the marginal probability of a text over all its segmentations.

The pieces of an existing vocabulary, and single bytes, are a unigram model: a word is a
space and its bytes, any chain of pieces that spells it is a segmentation, and its
probability is the sum over all chains, by the forward recursion in log space over the
lattice of pieces. Pieces never cross words, so a text's probability is the product over
its words, times that of the end. Piece probabilities start from the order of the
vocabulary and are estimated by ``STEPS`` steps of expectation-maximisation, each over all
words of the training texts, weighted by their counts.

Word counts are gathered from all training texts. Scoring needs the count of every word:
the ``HEAD`` most frequent words are broadcast, all others are joined by word.

Edge cases: a null or empty text is its end only; without training texts all counts are 0
and pieces keep their first probabilities; a word of any length or bytes has a positive
probability; rows with a null id are scored and never learned from; repeated rows are
scored each; extra columns are ignored.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import exp, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

HEAD = 1 << 17
STEPS = 3
FLUSH_WORDS = 200_000
_END = -1  # a trie node's own log-probability, beside the bytes that go on
_LN10 = log(10)


def read_pieces(model_file: str) -> list[bytes]:
    """Pieces of a sentencepiece model in their order, a word's start written as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            found.append(piece)
    return found


def all_pieces(pieces: list[bytes]) -> list[bytes]:
    """The pieces without repetition, then those single bytes that are none."""
    own = list(dict.fromkeys(pieces))
    seen = set(own)
    return own + [b for b in (bytes((x,)) for x in range(256)) if b not in seen]


def first_log_probs(n: int) -> np.ndarray:
    """Pieces come in falling order of use: probability falls as one over the rank."""
    weight = 1.0 / np.arange(2, n + 2)
    return np.log(weight / weight.sum())


class Lattice:
    def __init__(self, pieces: list[bytes], log_probs: np.ndarray):
        self.trie: dict = {}
        for number, (piece, value) in enumerate(zip(pieces, log_probs.tolist(), strict=True)):
            node = self.trie
            for byte in piece:
                node = node.setdefault(byte, {})
            node[_END] = (value, number)

    def arcs(self, word: bytes) -> list[list[tuple[int, float, int]]]:
        """For every start the ends, log-probabilities and numbers of the pieces from there."""
        out, n = [], len(word)
        for start in range(n):
            node, own, at = self.trie, [], start
            while at < n and (node := node.get(word[at])) is not None:
                at += 1
                if (end := node.get(_END)) is not None:
                    own.append((at, *end))
            out.append(own)
        return out

    def forward(self, arcs: list[list[tuple[int, float, int]]]) -> list[float]:
        """Log of the summed probability of all ways to each position."""
        terms: list[list[float]] = [[] for _ in range(len(arcs) + 1)]
        alpha = [0.0] * (len(arcs) + 1)
        for start, own in enumerate(arcs):
            if start:
                alpha[start] = _log_sum(terms[start])
            here = alpha[start]
            for end, value, _ in own:
                terms[end].append(here + value)
        if arcs:
            alpha[-1] = _log_sum(terms[-1])
        return alpha

    def log_prob(self, word: bytes) -> float:
        """Natural logarithm of the word's marginal probability: ``forward`` without keeping the arcs."""
        word = b" " + word
        trie, here = self.trie, 0.0
        terms: list[list[float]] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            if start:
                own = terms[start]
                here = own[0] if len(own) == 1 else _log_sum(own)
            node = trie
            for end, byte in enumerate(word[start:], start + 1):
                node = node.get(byte)
                if node is None:
                    break
                found = node.get(_END)
                if found is not None:
                    terms[end].append(here + found[0])
        return _log_sum(terms[-1])

    def expected(self, word: bytes, count: float, into: list[float] | np.ndarray) -> None:
        """Add the expected number of times each piece is used in ``count`` words."""
        arcs = self.arcs(b" " + word)
        alpha = self.forward(arcs)
        n, whole = len(arcs), alpha[-1]
        beta = [0.0] * (n + 1)
        for start in range(n - 1, -1, -1):
            beta[start] = _log_sum([value + beta[end] for end, value, _ in arcs[start]])
            here = alpha[start] - whole
            for end, value, number in arcs[start]:
                into[number] += count * exp(here + value + beta[end])


class Pieces:
    """The vocabulary as tables of hashes, for all words of one length at a time."""

    def __init__(self, pieces: list[bytes], log_probs: np.ndarray):
        self.longest = max(map(len, pieces))
        self.log_probs = np.asarray(log_probs, float)
        self.keys = np.array([_rolled(p) for p in pieces], np.uint64)
        self.single = Lattice(pieces, log_probs)
        slots = self._slot(self.keys)
        self.first = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(pieces), dtype=np.int32)[::-1]
        # those that lost their slot to another piece, by their hash
        lost = np.flatnonzero(self.first[slots] != np.arange(len(pieces)))
        self.lost = lost[np.argsort(self.keys[lost])]

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of every hash, -1 where there is none."""
        out = self.first[self._slot(hashes)]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        if len(wrong):
            out[wrong] = -1
            if len(self.lost):
                keys = self.keys[self.lost]
                at = np.minimum(np.searchsorted(keys, hashes[wrong]), len(keys) - 1)
                hit = keys[at] == hashes[wrong]
                out[wrong[hit]] = self.lost[at[hit]]
        return out

    def _arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, rows and numbers of the pieces in words of one length."""
        length = words.shape[1]
        for start in range(length):
            hashes = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                hashes = hashes * _ROLL + words[:, end - 1]
                found = self.numbers(hashes)
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    yield start, end, rows, found[rows]

    def _forward(self, words: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Log of the summed probability of all ways to each position of every word."""
        alpha = np.full((words.shape[1] + 1, len(words)), -np.inf)
        alpha[0] = 0.0
        for start, end, rows, numbers in self._arcs(words):
            if kept is not None:
                kept.append((start, end, rows, numbers))
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_probs[numbers])
        return alpha

    def log_probs_of(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms of the words' marginal probabilities."""
        out = np.empty(len(words))
        for at, matrix in _by_length(words):
            if matrix is None:
                out[at] = [self.single.log_prob(words[i]) for i in at]
            else:
                out[at] = self._forward(matrix)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, into: np.ndarray) -> None:
        """Add the expected number of times each piece is used in the words, each ``counts`` times."""
        for at, matrix in _by_length(words):
            if matrix is None:
                for i in at:
                    self.single.expected(words[i], float(counts[i]), into)
                continue
            arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            alpha = self._forward(matrix, arcs)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            own = counts[at]
            for start, end, rows, numbers in reversed(arcs):
                value = self.log_probs[numbers] + beta[end, rows]
                used = own[rows] * np.exp(alpha[start, rows] + value - alpha[-1, rows])
                into += np.bincount(numbers, used, minlength=len(into))
                beta[start, rows] = np.logaddexp(beta[start, rows], value)


_ROLL, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 21
_LONG_WORD = 64  # bytes; longer words are taken one by one
_WORDS_AT_ONCE = 50_000


def _rolled(piece: bytes) -> int:
    out = 0
    for byte in piece:
        out = (out * int(_ROLL) + byte + 1) & (2**64 - 1)
    return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Numbers of the words of each length, with a row for each of a space and its bytes, all one higher."""
    lengths = np.array([len(w) for w in words])
    long = np.flatnonzero(lengths > _LONG_WORD)
    if len(long):
        yield long, None
    for n in np.unique(lengths[lengths <= _LONG_WORD]):
        at = np.flatnonzero(lengths == n)
        body = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), n)
        matrix = np.full((len(at), n + 1), ord(" ") + 1, np.uint64, order="F")
        matrix[:, 1:] = body
        matrix[:, 1:] += np.uint64(1)
        yield at, matrix


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of small batches together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    if len(terms) == 2:
        low, high = terms if terms[0] < terms[1] else (terms[1], terms[0])
        return high + log1p(exp(low - high))
    top = max(terms)
    return top + log(sum([exp(t - top) for t in terms]))


@dataclass(frozen=True)
class Scorer:
    pieces: list[bytes]
    log_probs: np.ndarray
    log_end: float
    head: dict[bytes, tuple[float, float]]  # log-probability and log10 of count + 1 of the most frequent words


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n`` over all texts; every task sends each of its words about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for value in batch.column(0):
                own.update(tokens(value.as_py()))
                if len(own) >= FLUSH_WORDS:
                    yield full()
                    own.clear()
        if own:
            yield full()

    counted = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def estimate(
    counts: DataFrame, pieces: list[bytes], start: np.ndarray, smoothing: float = 0.01
) -> tuple[np.ndarray, float]:
    """Log-probabilities of the pieces after one step over the words, and the pieces' expected total."""
    sent = counts.sparkSession.sparkContext.broadcast((pieces, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Pieces(*sent.value)
        used = np.zeros(len(lattice.keys))
        for block in _in_blocks(batches):
            lattice.expected(block["word"].to_pylist(), block["n"].to_numpy().astype(float), used)
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(used[at])], ["piece", "used"])

    # a row for each piece at the most
    found = counts.select("word", "n").mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).toArrow()
    used = np.zeros(len(pieces))
    used[found["piece"].to_numpy()] = found["used"].to_numpy()
    total = used.sum()
    if not total:
        return start, 0.0
    return np.log((used + smoothing) / (total + smoothing * len(pieces))), float(total)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """The work here makes no reference cycles, and looking for them takes a third of the time."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def _doc_rows(documents: DataFrame, scorer: Scorer, keep: list[Column], text: str) -> DataFrame:
    """Sums over a text's words in the head, and the other words with their counts."""
    sent = documents.sparkSession.sparkContext.broadcast((scorer.log_end, scorer.head))
    rows = documents.select(*keep, F.col(text).cast("binary").alias("__text"))
    kinds = "".join(f"`{name}` {kind}, " for name, kind in rows.dtypes[:-1])
    names = ["n_tokens", "head_sum", "head_known", "head_score", "tail_words", "tail_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_cycles():
            yield from score_all(batches)

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_end, head = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: list[tuple] = []
                for value in batch.column(batch.num_columns - 1):
                    words = tokens(value.as_py())
                    total, in_head, score = 0.0, 0, log_end
                    tail_words, tail_counts = [], []
                    for word, n in Counter(words).items():
                        values = head.get(word)
                        if values is None:
                            tail_words.append(word)
                            tail_counts.append(n)
                            continue
                        score += n * values[0]
                        total += n * values[1]
                        in_head += n
                    out.append((len(words) + 1, total, in_head, score / _LN10, tail_words, tail_counts))
                kinds_ = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *names])

    return rows.mapInArrow(
        run,
        f"{kinds}n_tokens long, head_sum double, head_known long, head_score double, tail_words array<binary>, tail_counts array<int>",
    )


def _word_scores(words: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``log10_prob`` to ``word`` and ``n``."""
    sent = words.sparkSession.sparkContext.broadcast((scorer.pieces, scorer.log_probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Pieces(*sent.value)
        for block in _in_blocks(batches):
            values = lattice.log_probs_of(block["word"].to_pylist()) / _LN10
            yield from block.append_column("log10_prob", pa.array(values, pa.float64())).to_batches()

    return words.select("word", "n").mapInArrow(run, "word binary, n long, log10_prob double")


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent of the words, ``limit`` at the most: those above a count that so many reach."""
    step = F.floor(F.log2("n") * 16)
    least, taken = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += row["count"]
        if taken > limit:
            break
        least = row["step"]
    return counts.where(step >= least)


def score(
    documents: DataFrame, learn_from: Column, pieces: list[bytes], keep: tuple[Column, ...] = (), text: str = "text",
    head: int = HEAD,
) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every text.

    Only texts where ``learn_from`` holds are learned from. ``base_score`` is of words with
    add-one counts, ``score`` the log10 marginal probability over all segmentations.
    """
    training = documents.where(learn_from)
    counts = stage(word_counts(training, text), "word-counts")
    ends = training.count()
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = row[0] + (ends > 0), row[1] + ends
    whole = all_pieces(pieces)
    log_probs = first_log_probs(len(whole))
    for _ in range(STEPS):
        log_probs, used = estimate(counts, whole, log_probs)
    # the end is one more piece, used once in a text
    share = ends / (used + ends) if ends else 0.5
    log_probs = log_probs + log(1 - share)
    scorer = Scorer(whole, log_probs, log(share), {})
    top = _word_scores(most_frequent(counts, head), scorer).toArrow()
    found = zip(top["word"].to_pylist(), top["log10_prob"].to_pylist(), top["n"].to_pylist(), strict=True)
    scorer.head.update({word: (value * _LN10, log10(n + 1)) for word, value, n in found})
    del top, found
    rows = stage(_doc_rows(documents, scorer, list(keep), text).withColumn("__row", F.monotonically_increasing_id()), "scored")
    tail = rows.select(
        "__row", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("t")
    ).select("__row", F.col("t.tail_words").alias("word"), F.col("t.tail_counts").alias("k"))
    # every other word is scored once, known or not; they are rare by definition: no key of these joins is hot
    words = stage(_word_scores(tail.select("word").distinct().join(counts, "word", "left"), scorer), "word-scores")
    n = F.coalesce("n", F.lit(0))
    sums = (
        tail.join(words, "word")
        .groupBy("__row")
        .agg(
            F.sum(F.col("k") * F.log10(n + 1)).alias("tail_sum"),
            F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("k") * F.col("log10_prob")).alias("tail_score"),
        )
    )
    per_token = log10(total + distinct + 1)
    return rows.join(sums, "__row", "left").select(
        *[c for c in rows.columns[: len(keep)]],
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(log10(ends + 1)) - F.col("n_tokens") * F.lit(per_token)
        ).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("score"),
    )
