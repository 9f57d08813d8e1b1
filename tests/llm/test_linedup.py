import random
import re

import pytest

from loadlens.llm import linedup
from tests.llm.cases import AWKWARD


def by_hand(rows, least):
    """Lines in a run of ``least`` words that occurs at an earlier place too, by trying every run."""
    lines = {i: t.split("\n") for i, t in rows if t is not None}
    size = {i: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in own] for i, own in lines.items()}
    seen, gone = {}, {}
    for i in sorted(lines):
        own = lines[i]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(size[i][a:b]) >= least:
                    run = tuple(own[a:b])
                    if seen.setdefault(run, (i, a)) < (i, a):
                        gone.setdefault(i, set()).update(range(a, b))
    return {i: ("\n".join(x for k, x in enumerate(own) if k not in gone.get(i, ())), len(gone.get(i, ()))) for i, own in lines.items()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_trying_every_run(spark, docs, seed):
    r = random.Random(seed)
    alphabet = ["a b", "c", "", "d e f", "g h"]
    rows = [(i, "\n".join(r.choice(alphabet) for _ in range(r.randint(1, 12)))) for i in range(14)]
    found = {x["doc_id"]: (x["text"], x["n_deleted_lines"]) for x in linedup.dedup_lines(docs(rows), min_words=6).collect()}
    assert found == by_hand(rows, 6)


def test_passages_of_fifty_words_and_short_lines(spark, docs):
    passage = " ".join(f"w{k}" for k in range(55))
    two = "\n".join(" ".join(f"v{k}{part}" for k in range(30)) for part in "ab")
    short = "a short line that everybody has"
    rows = [(1, f"{short}\none\n{passage}"), (2, f"{short}\ntwo\n{passage}\nend"), (3, f"{two}\n{short}\nx"), (4, f"y\n{two}\n{short}")]
    found = {x["doc_id"]: x["text"] for x in linedup.dedup_lines(docs(rows)).collect()}
    assert found == {1: rows[0][1], 2: f"{short}\ntwo\nend", 3: rows[2][1], 4: "y"}


def test_exact_copies_and_a_hot_run(spark, docs):
    text = "\n".join(f"line {k} of a document that has many copies" for k in range(20))
    found = linedup.dedup_lines(docs([(i, text) for i in range(200)])).collect()
    assert [x["doc_id"] for x in found if x["text"]] == [0]


def test_awkward_rows(spark, docs):
    frame = docs(AWKWARD)
    rows = linedup.dedup_lines(frame).collect()
    assert len(rows) == len(AWKWARD)
    texts = sorted(str(t) for _, t in AWKWARD)
    assert sorted(str(r["text"]) for r in rows) == texts and all(r["score"] == "x" for r in rows)
    assert {r["n_lines"] for r in rows if r["text"] is None} == {0}
    assert linedup.dedup_lines(frame.where("false")).count() == 0
