import random

import numpy as np
import pytest

from loadlens.llm import ngramjoin
from tests.llm.cases import AWKWARD
from tests.llm.test_neardup import by_hand, family


@pytest.mark.parametrize(("percent", "block"), [(90, 512), (90, 8), (80, 8), (70, 16)])
def test_components_equal_comparing_all_pairs(spark, docs, monkeypatch, percent, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", block)  # several blocks and tiles
    r = random.Random(percent + block)
    texts = family(r, 90, edits=4) + family(r, 40, 200, 8) + family(r, 5) * 3 + [" ".join(f"x{r.randint(0, 9)}" for _ in range(k)) for k in range(8)]
    base = [f"s{k}" for k in range(300)]
    texts += [" ".join(base[: 300 - k]) for k in range(0, 120, 5)]  # sizes shrink along a chain of links
    rows = list(enumerate(t.upper() if k % 5 == 0 else t for k, t in enumerate(texts)))
    r.shuffle(rows)
    found = ngramjoin.jaccard_components(docs(rows), percent=percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found.collect()} == by_hand(rows, 3, percent)


def test_awkward_rows(spark, docs):
    frame = docs(AWKWARD)
    rows = ngramjoin.jaccard_components(frame).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4)} == {3}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (0, 1, 2, 8))
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert ngramjoin.jaccard_components(frame.where("false")).count() == 0


def elements(r, n):
    return np.unique(r.integers(0, 2**64, n, np.uint64))


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_key(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        a = elements(r, int(10 ** r.uniform(0, 3.5)))
        drop = r.integers(0, ngramjoin.differing(len(a), len(a), percent) + 1)
        b = np.unique(np.concatenate((r.permutation(a)[drop:], elements(r, int(r.integers(0, drop + 1))))))
        n = len(np.intersect1d(a, b))
        if 100 * n >= percent * (len(a) + len(b) - n) and not np.array_equal(a, b):
            keys = [set(ngramjoin.range_keys(s, percent).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_bitmaps_bound_the_overlap_from_above():
    r = np.random.default_rng(3)
    sets = [elements(r, n) for n in (1, 5, 80, 900, 20_000)]
    sets += [np.unique(np.concatenate((s[: len(s) // 2], elements(r, len(s))))) for s in sets]
    maps, sizes = ngramjoin.bitmaps(sets), np.array([len(s) for s in sets])
    bound = ngramjoin.most_shared(maps[:, None], maps[None], sizes[:, None], sizes[None])
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (bound >= exact).all()
    assert (bound < np.minimum(sizes[:, None], sizes[None])).any()
    assert all(ngramjoin.shared(a, b) == exact[i, j] for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_forest_of_a_tile_joins_what_is_linked():
    r = np.random.default_rng(5)
    base = elements(r, 100)
    sets = [np.unique(np.concatenate((base[k:], elements(r, 1)))) for k in range(12)] + [elements(r, 100)]
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * (n := len(np.intersect1d(a, b))) >= 90 * (len(a) + len(b) - n)}
    forest = ngramjoin.tile_links(sets, np.ones(len(sets), bool), 90)
    assert set(forest) <= linked and len(forest) == 11
    first = np.arange(len(sets)) < 4
    assert all(i < 4 <= j for i, j in ngramjoin.tile_links(sets, first, 90))
