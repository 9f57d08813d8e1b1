import random
import re
from collections import Counter

import numpy as np
import pytest

from loadlens.llm import collocations
from loadlens.llm.words import span_hashes, word_spans
from tests.llm.cases import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, longest=5, top=2000):
    n, f = Counter(), {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts = f.setdefault(lang or "und", Counter())
            for k in range(1, longest + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            longer = [q for q in candidates if len(q) > len(p) and counts[q] >= a]
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def talk(r, n, words=30):
    phrases = [" ".join(f"w{r.randint(0, words)}" for _ in range(r.randint(1, 7))) for _ in range(12)]
    return [
        (r.choice(("en", "de", None)), "".join(r.choice(phrases) + r.choice((" ", " ", "\t", ", ", ".\n", " É")) for _ in range(r.randint(0, 60))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("head", [1 << 18, 16, 0])
def test_phrases_equal_counting_by_hand(spark, monkeypatch, head):
    monkeypatch.setattr(collocations, "HEAD", head)  # sequences beyond it go by their hash
    rows = talk(random.Random(head), 80)
    frame = spark.createDataFrame([(*x, "extra") for x in rows], "lang string, text string, f string")
    found = collocations.collocations(frame, least=6, top=40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(x) for x in found.collect()} == by_hand(rows, 6, top=40)


def test_repeated_words_overlap(spark):
    rows = [("en", "hot hot hot hot. " * 5 + "Hot hot"), ("en", "a b c d e f " * 7)]
    found = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
    assert {tuple(x) for x in found.collect()} == by_hand(rows, 5)


def test_awkward_rows(spark, docs):
    rows = [("x", t) for _, t in AWKWARD] * 2
    frame = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, h int")
    found = collocations.collocations(frame, least=2)
    assert {tuple(x) for x in found.collect()} == by_hand(rows, 2)
    assert collocations.collocations(frame.where("false")).count() == 0
    assert collocations.collocations(frame.where("text = 'word'"), least=9).count() == 0


def test_tiles_count_every_pair(monkeypatch):
    r = np.random.default_rng(2)
    for dense in (1, 50, 1 << 17):
        monkeypatch.setattr(collocations, "DENSE", dense)
        first, second = (np.minimum(r.integers(0, 5000, 4000), r.integers(0, 5000, 4000)) for _ in range(2))
        first[::2], second[::3] = first[::2] % 30, second[::3] % 40
        pairs, n = collocations.count_tiles(collocations.packed(first, second))
        a, b = collocations.unpacked(pairs)
        expected = Counter(zip(first.tolist(), second.tolist(), strict=True))
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == expected
        a, b, n = collocations.count_others(first + 2**62, second)
        assert dict(zip(zip((a - 2**62).tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == expected
    none = np.empty(0, np.int64)
    assert not len(collocations.count_tiles(none)[0]) and not len(collocations.count_others(none, none)[0])


@pytest.mark.parametrize("overlap", [0, 1, 4])
def test_parts_hold_every_sequence_once(overlap):
    r = random.Random(overlap)
    for marks in (" ", "\t ", " ,", " ."):
        text = "".join(r.choice(("a", "bb", "c" * r.randint(1, 30))) + r.choice(marks) for _ in range(400))

        def sequences(part):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", part):
                words = re.findall(r"[^\x20\x09]+", piece)
                yield from (tuple(words[i : i + overlap + 1]) for i in range(len(words) - overlap))

        parts = [p.decode() for p in collocations.segments(text.encode(), overlap, 40)]
        assert len(parts) > 3
        assert Counter(s for p in parts for s in sequences(p)) == Counter(sequences(text))


def test_hashes_of_spans_do_not_depend_on_their_place(monkeypatch):
    data = np.frombuffer(b"one two " * 50 + b"x" * 300 + b" two", np.uint8)
    whole = span_hashes(data, *word_spans(data))
    monkeypatch.setattr("loadlens.llm.words._BYTES", 64)
    assert (span_hashes(data, *word_spans(data)) == whole).all()
    assert len(set(whole.tolist())) == 3
