import re
from collections import Counter

import numpy as np

from loadlens.llm import rules
from tests.llm.cases import AWKWARD


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            twice.update(range(i, i + 5))
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(twice)


def test_counts_equal_those_by_hand(spark, docs):
    texts = [t for _, t in AWKWARD] + [
        "a b c d e a b c d e", "the the the the the the", "é é é é é é x", "l 1\nl 1\n\n\nl 1 \nl 1", "#tag |a| <b> 5%", "a b c d e f a b c d",
    ]
    rows = rules.statistics(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in rules.BASE) == by_hand(texts[r["doc_id"]])


def test_covering_finds_the_rules_behind_the_labels():
    random = np.random.default_rng(1)
    n = 3000
    values = {"a": random.random(n), "b": random.random(n), "c": random.random(n)}
    bad = (values["a"] > 0.8) | ((values["b"] < 0.2) & (values["c"] > 0.5))
    found = rules.sequential_covering(values, bad, np.arange(n))
    covered = np.zeros(n, bool)
    for rule in found:
        covered |= rules._covered(rule, values, n)
    assert (covered == bad).mean() > 0.97 and (covered & ~bad).sum() <= 0.01 * n


def test_noise_or_one_class_gives_no_rule():
    random = np.random.default_rng(2)
    values = {"a": random.random(900)}
    assert rules.sequential_covering(values, random.random(900) < 0.3, np.arange(900)) == []
    assert rules.sequential_covering(values, np.zeros(900, bool), np.arange(900)) == []
    assert rules.sequential_covering(values, np.ones(900, bool), np.arange(900)) == []


def test_list_becomes_one_ordered_conditional(spark, docs):
    rows = [(i, "plain words in a row here") for i in range(60)] + [(100 + i, "#### $$$$ %%%% words | words") for i in range(60)]
    counts = rules.statistics(docs(rows))
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    learned = rules.learn(counts, rules.pick_labels(labels))
    assert learned
    kept = counts.select("doc_id", rules.verdict(learned).alias("kept")).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in kept)
    assert rules.learn(counts, rules.pick_labels(labels.where("false"))) == []
    assert counts.select(rules.verdict([]).alias("k")).where("k").count() == len(rows)


def test_repeated_labelled_ids_do_not_push_out_others(spark, docs):
    # the bound takes rows by their id's hash, not by what they count
    rows = [(i, "plain words in a row here " * (1 + i % 9)) for i in range(40)] * 2
    counts = rules.statistics(docs(rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    picked = rules.pick_labels(labels, max_labelled=10)
    assert picked.count() == 10
    ids = {r["__key"] for r in picked.collect()}
    hashes = {r["doc_id"]: r["h"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    assert ids == set(sorted(hashes, key=hashes.get)[:10])
    seen = []

    def covering(values, bad, keys):
        seen.append(sorted(values["words"].tolist()))
        return []

    original, rules.sequential_covering = rules.sequential_covering, covering
    try:
        rules.learn(counts, picked, max_labelled=12)
    finally:
        rules.sequential_covering = original
    first = sorted(ids, key=hashes.get)[:6]
    assert seen == [sorted(6.0 * (1 + i % 9) for i in first for _ in range(2))]
