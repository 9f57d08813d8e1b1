import zlib

import pytest

from loadlens.llm import sharding
from tests.llm.cases import AWKWARD


def _shards(frame, **options):
    rows = sharding.shard(frame, **options).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return rows, by


def test_bytes_are_even_and_texts_stay_together(spark, docs):
    data = [(i, f"text {i} " * (1 + i % 7)) for i in range(3000)]
    rows, by = _shards(docs(data), shards=5, parts=3)
    assert len(rows) == 3000 and set(by) == set(range(5))
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in own) - total / 5) < 0.01 * total / 5 for own in by.values())
    texts = dict(data)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())


def test_a_third_of_equal_texts_is_cut_only_as_needed(spark, docs):
    data = [(i, "the same text everywhere" if i % 3 == 0 else f"text number {i:06d} xxxxx") for i in range(3000)]
    rows, by = _shards(docs(data), shards=6, parts=2)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) < 1.02 * sum(sizes) / 6
    hot = {r["shard"] for r in rows if r["doc_id"] % 3 == 0}
    assert 2 <= len(hot) <= 4


def test_awkward_rows(spark, docs):
    rows, _ = _shards(docs(AWKWARD), shards=4)
    assert len(rows) == len(AWKWARD) and all(0 <= r["shard"] < 4 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert _shards(docs(AWKWARD).where("false"), shards=4)[0] == []
    same = docs([(1, "twin")] * 50)  # rows that no key tells apart
    rows, by = _shards(same, shards=4)
    assert len(rows) == 50 and len(by) == 1
    with pytest.raises(ValueError):
        sharding.shard(same, shards=0)


def test_one_shard_and_more_shards_than_rows(spark, docs):
    assert {r["shard"] for r in _shards(docs([(1, "a"), (2, "b")]), shards=1)[0]} == {0}
    assert len(_shards(docs([(1, "a"), (2, "b")]), shards=16)[0]) == 2
