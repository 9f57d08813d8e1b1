from collections import Counter
from math import exp, isclose, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import lattice
from tests.llm.cases import AWKWARD

PIECES = lattice.all_pieces([b" a", b"ab", b" ab", b"b", b"a", b"bc", b" abc"])


def chains(word, known):
    """Probabilities of all segmentations, one by one."""
    if not word:
        return [1.0]
    return [known[word[:n]] * p for n in range(1, len(word) + 1) if word[:n] in known for p in chains(word[n:], known)]


def test_forward_sums_all_segmentations():
    values = lattice.first_log_probs(len(PIECES))
    model = lattice.Lattice(PIECES, values)
    known = dict(zip(PIECES, np.exp(values), strict=True))
    for word in (b"a", b"abc", b"abcab", b"bcbcabab", b"", "é".encode(), b"\xff"):
        assert isclose(exp(model.log_prob(word)), sum(chains(b" " + word, known)), rel_tol=1e-9)
    assert model.log_prob(b"ab" * 20_000) < -1000  # no underflow


def test_expected_counts_are_those_of_all_segmentations_and_raise_the_likelihood():
    words = {b"abc": 5, b"ab": 3, b"bca": 1}
    values = lattice.first_log_probs(len(PIECES))
    before = after = 0.0
    used = np.zeros(len(PIECES))
    model = lattice.Lattice(PIECES, values)
    for word, n in words.items():
        own = np.zeros(len(PIECES))
        model.expected(word, n, own)
        # pieces spell the word and its space
        assert isclose(sum(len(p) * c for p, c in zip(PIECES, own, strict=True)), n * (len(word) + 1), rel_tol=1e-9)
        used += own
        before += n * model.log_prob(word)
    better = lattice.Lattice(PIECES, np.log((used + 1e-9) / (used.sum() + 1e-9 * len(PIECES))))
    after = sum(n * better.log_prob(w) for w, n in words.items())
    assert after > before


@pytest.mark.parametrize("slots", [3, 21])
def test_words_of_one_length_together_equal_words_one_by_one(monkeypatch, slots):
    monkeypatch.setattr(lattice, "_SLOT_BITS", slots)  # 3: most pieces lose their slot
    r = np.random.default_rng(slots)
    values = lattice.first_log_probs(len(PIECES)) + r.normal(0, 1, len(PIECES))
    one, many = lattice.Lattice(PIECES, values), lattice.Pieces(PIECES, values)
    words = [bytes(r.choice(list(b"abc\xc3\xa9"), r.integers(0, 30)).tolist()) for _ in range(300)] + [b"ab" * 200, b""]
    assert np.allclose(many.log_probs_of(words), [one.log_prob(w) for w in words], rtol=1e-10)
    counts = r.integers(1, 9, len(words)).astype(float)
    want, got = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    for word, n in zip(words, counts, strict=True):
        one.expected(word, n, want)
    many.expected(words, counts, got)
    assert np.allclose(got, want, rtol=1e-8)
    hashes = np.array([lattice._rolled(p) for p in (*PIECES, b"abcd")], np.uint64)
    assert many.numbers(hashes).tolist() == [*range(len(PIECES)), -1]


def test_most_frequent_words_stay_within_the_limit(spark):
    counts = spark.createDataFrame([(bytes([97 + k]), 2**k) for k in range(20)], "word binary, n long")
    for limit in (0, 1, 7, 99):
        found = sorted(r["n"] for r in lattice.most_frequent(counts, limit).collect())
        assert found == [2**k for k in range(20)][20 - min(limit, 20) :]
    assert lattice.most_frequent(counts.where("false"), 5).count() == 0


def test_scores_equal_counting_by_hand(spark, docs, monkeypatch):
    monkeypatch.setattr(lattice, "FLUSH_WORDS", 3)
    rows = [(i, t) for i, t in enumerate(["Ab abc ab", "ab  abc\tB", None, "", "new words ab", "é É"] * 3)]
    train = F.col("doc_id") < 12
    found = lattice.score(docs(rows), train, PIECES[:7], keep=("doc_id",), head=2).collect()
    counts, ends = Counter(), 0
    for key, text in rows:
        if key < 12:
            counts.update((text or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    assert len(found) == len(rows)
    for r in found:
        words = (dict(rows)[r["doc_id"]] or "").encode().lower().split()
        base = sum(log10((counts[w] + 1) / (total + distinct + 1)) for w in words) + log10((ends + 1) / (total + distinct + 1))
        assert isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(words) + 1
        assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1 and r["train_tokens"] == total
        assert r["score"] < 0


def test_score_is_the_product_over_words(spark, docs):
    rows = docs([(1, "ab"), (2, "abc"), (3, "ab abc ab"), (4, "")])
    s = {r["doc_id"]: r["score"] for r in lattice.score(rows, F.lit(True), PIECES, keep=("doc_id",)).collect()}
    assert isclose(s[3], 2 * s[1] + s[2] - 2 * s[4], rel_tol=1e-9)


def test_awkward_rows_and_no_training(spark, docs):
    frame = docs(AWKWARD)
    rows = lattice.score(frame, F.col("doc_id") < 9, PIECES, keep=("doc_id",)).collect()
    assert len(rows) == len(AWKWARD) and all(r["score"] < 0 for r in rows)
    untrained = lattice.score(frame, F.lit(False), PIECES, keep=("doc_id",)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in untrained} == {(0, 0, 0.0)}
    assert lattice.score(frame.where("false"), F.lit(True), PIECES).count() == 0


def test_every_step_learns_from_all_words(spark, docs):
    texts = ["ab ab ab ab a a a", "abc bca cab", "bcbc abab", "ca cb"]
    rows = docs(list(enumerate(texts)))
    by_hand, used = lattice.first_log_probs(len(PIECES)), None
    words = Counter(w for t in texts for w in t.encode().split())
    for _ in range(3):
        model, used = lattice.Lattice(PIECES, by_hand), np.zeros(len(PIECES))
        for word, n in words.items():
            model.expected(word, n, used)
        by_hand = np.log((used + 0.01) / (used.sum() + 0.01 * len(PIECES)))
    end = len(texts) / (used.sum() + len(texts))
    model = lattice.Lattice(PIECES, by_hand + np.log(1 - end))
    want = {k: (sum(model.log_prob(w) for w in t.encode().split()) + np.log(end)) / np.log(10) for k, t in enumerate(texts)}
    for head in (1, 100):
        found = lattice.score(rows, F.lit(True), PIECES, keep=("doc_id",), head=head).collect()
        assert len(found) == len(texts) and all(isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in found)
