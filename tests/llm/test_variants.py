import random
import re
from collections import Counter
from zlib import crc32

import pytest

from loadlens.llm import variants
from tests.llm.cases import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows, every=31, shortest=7, least=2):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if key is None else crc32(f"{key}:{run}".encode())
            found[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(words, times=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: v for w, v in best.items() if words[v] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def related(r, n):
    """Words that are close to one another, of many lengths."""
    out = []
    for _ in range(n):
        base = "".join(r.choice("abé") for _ in range(r.choice((7, 8, 9, 14, 30, 60))))
        for _ in range(r.randint(1, 6)):
            at = r.randrange(len(base))
            base = r.choice((base[:at] + base[at + 1 :], base[:at] + r.choice("abz") + base[at:], base[:at] + "q" + base[at + 1 :]))
            if len(base) >= 7:
                out.append(base)
    return out


@pytest.mark.parametrize("rows_of_tile", [1024, 3])
def test_near_words_equal_comparing_all(spark, monkeypatch, rows_of_tile):
    monkeypatch.setattr(variants, "TILE_ROWS", rows_of_tile)  # 3: every key of four words is cut into blocks
    r = random.Random(rows_of_tile)
    words = {w: int(10 ** r.uniform(0.3, 4)) for w in related(r, 120)}
    found = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in found.collect()} == by_hand(words)


def test_dense_tiles_of_many_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "CELLS", 1000)
    words = {f"wor{a}{b}{c}ds": 2 for a in "abcdé" for b in "abcde" for c in "abcd"} | {"wordéds": 30}
    found = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in found.collect()} == by_hand(words)


def test_chain_of_forms_leads_to_its_end(spark):
    words = {"abcdefg" + "x" * k: 3 * 10**k for k in range(9)}
    found = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["root"] for r in found} == {"abcdefg" + "x" * 8}


def test_documents(spark, docs):
    r = random.Random(1)
    pool = related(r, 60)
    rows = [(k, " ".join(r.choice(pool).upper() if r.random() < 0.1 else r.choice(pool) for _ in range(80)) + "—Ünïcode×") for k in range(60)]
    rows += [(None, rows[0][1]), rows[1]]
    found = variants.spelling_variants(docs(rows))
    words = words_by_hand(rows)
    assert {tuple(x) for x in found.collect()} == by_hand(words)


def test_awkward_rows(spark, docs):
    found = variants.spelling_variants(docs(AWKWARD), shortest=2)
    assert {tuple(x) for x in found.collect()} == by_hand(words_by_hand(AWKWARD, shortest=2))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    long = "x" * 50_000
    words = {long: 2, long + "y": 40, long[1:]: 2}
    found = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(x) for x in found.collect()} == by_hand(words)
    assert variants.spelling_variants(docs(AWKWARD).where("false")).count() == 0
