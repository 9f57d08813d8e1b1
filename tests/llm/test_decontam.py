import random
from collections import Counter

from pyspark.sql import functions as F

from loadlens.llm import decontam
from tests.llm.cases import AWKWARD


def _shingles(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def by_hand(rows, items, threshold=0.8):
    out = {}
    for key, text in rows:
        words = (text or "").split()
        for item, passage in items:
            own = passage.split()
            if not own:
                continue
            want, best = _shingles(own), None
            for start in range(max(1, len(words) - len(own) + 1)):
                window = words[start : start + len(own)]
                if len(window) < len(own):
                    continue
                have = _shingles(window)
                share = (want & have).total() / (want | have).total()
                if share >= threshold:
                    n = (best[2] if best else 0) + 1
                    best = (share, start, n) if best is None or share > best[0] else (*best[:2], n)
            if best:
                out[key, item] = best
    return out


def test_equals_comparing_every_window(spark, docs):
    r = random.Random(7)
    items = [(k, " ".join(f"v{r.randint(0, 40)}" for _ in range(r.choice((6, 15, 15, 30, 50))))) for k in range(12)]
    rows = []
    for key in range(60):
        words = [f"v{r.randint(0, 40)}" for _ in range(r.randint(0, 120))]
        if key % 2:
            passage = items[key % 12][1].split()
            for _ in range(r.choice((0, 0, 1, 2))):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = passage
        rows.append((key, " ".join(words)))
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    want = by_hand(rows, items)
    found = decontam.matches(docs(rows), benchmark).collect()
    assert len(want) > 12
    assert {(x["doc_id"], x["item_id"]): (round(x["similarity"], 9), x["start_word"], x["n_windows"]) for x in found} == {
        k: (round(s, 9), at, n) for k, (s, at, n) in want.items()
    }
    kept = {x["doc_id"] for x in decontam.drop_contaminated(docs(rows), benchmark).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in want}


def test_all_fingerprints_within_the_radius_share_an_entry(spark):
    r = random.Random(1)
    masks = set(decontam.near_values(23))
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 23)):
            b ^= 1 << bit
        assert any(((a ^ b) >> (8 * k)) & 0xFF in masks for k in range(8))


def test_fingerprint_is_the_majority_of_each_bit(spark):
    r = random.Random(2)
    hashes = [r.getrandbits(64) for _ in range(300)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    frame = spark.createDataFrame([(h,) for h in signed], "h long")
    sums = frame.agg(*decontam.simhash(F.col("h")), F.count("h").alias("total"))
    value = sums.select(decontam.fingerprint(F.col("total"))).first()[0] & (1 << 64) - 1
    assert value == sum((sum(h >> i & 1 for h in hashes) * 2 > 300) << i for i in range(64))


def test_awkward_rows(spark, docs):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "alpha beta gamma delta alpha beta"), (None, "word")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs(AWKWARD), benchmark).collect()}
    assert found >= {(3, 3), (4, 3), (3, None), (6, 4)} and not any(d in (0, 1, 2) for d, _ in found)
    assert decontam.matches(docs(AWKWARD).where("false"), benchmark).count() == 0
    assert decontam.matches(docs(AWKWARD), benchmark.where("false")).count() == 0
    assert decontam.drop_contaminated(docs(AWKWARD), benchmark.where("false")).count() == len(AWKWARD)


def test_letter_case_does_not_hide_an_item(spark, docs):
    lower = " ".join(f"item{k} caf\u00e9" for k in range(10))
    mixed = " ".join(w.capitalize() if k % 3 else w for k, w in enumerate(lower.split()))
    around = "Own Words before {} and OTHER words after it"
    rows = [(k, around.format(t)) for k, t in enumerate((lower, lower.upper(), mixed, "no item"))]
    for item in (lower, lower.upper(), mixed):
        # the last two are one text of one id
        benchmark = spark.createDataFrame([(1, "something else"), (2, item), (2, item.swapcase())], "item_id long, text string")
        found = decontam.matches(docs(rows), benchmark).collect()
        assert {(r["doc_id"], r["item_id"], r["similarity"], r["start_word"]) for r in found} == {(k, 2, 1.0, 3) for k in range(3)}
        assert len({r["n_windows"] for r in found}) == 1
        kept = {r["doc_id"]: r["text"] for r in decontam.drop_contaminated(docs(rows), benchmark).collect()}
        assert kept == {3: rows[3][1]}
    once = spark.createDataFrame([(2, lower)], "item_id long, text string")
    assert {r["n_windows"] for r in decontam.matches(docs(rows), once).collect()} == {r["n_windows"] for r in found}
