import random
import re

import numpy as np
import pytest

from loadlens.llm import neardup
from loadlens.llm.components import connected
from tests.llm.cases import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def by_hand(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            n = len(s & sets[j])
            if s and sets[j] and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def family(r, n, words=60, edits=9):
    base = [f"w{r.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{r.randint(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_comparing_all_pairs(spark, docs, size, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 16)  # several tiles
    r = random.Random(4)
    texts = family(r, 120, edits=6) + family(r, 40, 200, 12) + family(r, 5) * 3 + [" ".join(f"x{r.randint(0, 9)}" for _ in range(k)) for k in range(8)]
    rows = list(enumerate(t.upper() if k % 5 == 0 else t for k, t in enumerate(texts)))
    r.shuffle(rows)
    found = neardup.near_duplicates(docs(rows), size=size, percent=percent).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == by_hand(rows, size, percent)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in found)


def test_awkward_rows(spark, docs):
    frame = docs(AWKWARD)
    rows = neardup.near_duplicates(frame).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (0, 1, 2, 8))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(frame.where("false")).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(frame).collect()]
    assert sorted(map(str, kept)) == sorted(str(x) for x in AWKWARD if x[0] != 4)


def test_repeated_rows_and_one_id_with_two_texts_leave_one(spark, docs):
    long = " ".join(f"w{k}" for k in range(80))
    kept = neardup.drop_near_duplicates(docs([(1, long), (1, long), (1, long + " more"), (2, "other words entirely")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_coordinates_are_minima_of_shifted_permutations(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 7, 500, 20)]
    whole = neardup.signatures(sets, 12)
    for s, own in zip(sets, whole, strict=True):
        sigma = neardup._permute((s & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ np.uint32(0x9E3779B9))
        assert [int(neardup._permute(sigma - np.uint32(k)).min()) for k in range(12)] == own.tolist()
    monkeypatch.setattr(neardup, "_BLOCK", 64)  # a set of several blocks
    assert (neardup.signatures(sets, 12) == whole).all()
    values = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(neardup._permute(values.copy()))) == len(values)


def test_share_of_equal_coordinates_estimates_similarity():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
    signature = neardup.signatures([base[:1500], base[500:]], 252)
    assert abs((signature[0] == signature[1]).mean() - 1000 / len(base)) < 0.1


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in path + star + path[:3] + [(500, 500)]]
    r.shuffle(edges)
    found = {x["node"]: x["root"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 151)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
