import hashlib
import re

from loadlens.llm import pii
from tests.llm.cases import AWKWARD

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def by_hand(text):
    out = []
    for number, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


TEXTS = [
    "write to a.b+c@x-y.co.uk, or A@b.c_d@e.f now",
    "@nobody a@b a@.b x@y.z.",
    "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 378282246310005 00000000000000000000 12",
    "+1 (743) 555-3824 +12 +1234567890123456 +44.20.7946.0958) + 1 +1(2",
    "é😀 +1 743 555 3824 😀 me@x.io  5.6.7.8",
    "+4111111111111111 mail 4111111111111111@x.io",
    "9" * 5000 + " " + "1 " * 3000 + "a" * 30000 + "@x.y",
]


def test_base_spans_equal_the_forms(spark, docs):
    texts = TEXTS + [t for _, t in AWKWARD]
    rows = pii.find_personal_data(docs(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = by_hand(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("other")] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in FORMS:
            assert r[f"n_{kind}"] == sum(s.startswith(kind) for s in want)


def test_contexts_of_seeds_discover_unseen_identifiers(spark, docs):
    rows = [(i, f"please contact me at user{i}@mail.example.com for more about it") for i in range(12)]
    rows += [(100, "please contact me at skype4711 for more about it"), (101, "version 12 of the licence, page 3 of 9")]
    rows += [(102, "later skype4711. came back"), (103, "please contact me at home for more about it")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs(rows)).collect()}
    for key in (100, 102):
        text, (span,) = dict(rows)[key], found[key]["spans"].split(",")
        kind, start, end = span.split(":")
        assert kind == "other" and text[int(start) : int(end)] == "skype4711"
    assert found[101]["spans"] == found[103]["spans"] == ""
    assert all(found[i]["n_other"] == 0 and found[i]["n_email"] == 1 for i in range(12))


def test_contexts_that_hold_other_numbers_too_teach_nothing(spark, docs):
    rows = [(i, f"we counted up to user{i}@mail.example.com of them") for i in range(6)]
    rows += [(50 + i, f"we counted up to {1000 + i} of them") for i in range(6)]
    assert all(r["n_other"] == 0 for r in pii.find_personal_data(docs(rows)).collect())


def test_awkward_rows(spark, docs):
    rows = pii.find_personal_data(docs(AWKWARD)).collect()
    assert len(rows) == len(AWKWARD) and all(r["spans"] == "" for r in rows)
    assert pii.find_personal_data(docs(AWKWARD).where("false")).count() == 0
    twice = pii.find_personal_data(docs([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")])).collect()
    assert [r["spans"] for r in twice] == ["email:0:6"] * 3


def test_keys_are_reported_where_their_context_is_supported(spark, docs):
    keys = ["%040x" % (0xABCDEF * 7**k + 10**40) for k in range(14)]
    keys = [k[-40:].replace("0", "a", 1) for k in keys]
    rows = [(i, f'some words token = "{k}"### and more {i} text') for i, k in enumerate(keys)]
    rows += [(50, 'later on token = "short77" follows'), (51, f"a digest {keys[0][::-1]} alone")]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs(rows)).collect()}
    for key in (0, 3, 5, 50):
        kind, start, end = found[key].split(":")
        assert kind == "other" and dict(rows)[key][int(start) : int(end)] == (keys[key] if key < 50 else "short77")
    assert found[51] == ""


def test_contexts_are_whole_words(spark, docs):
    long = "w" * 3000
    rows = [(i, f"see {long}{'xyz'[i % 3]} {long}q user{i}@mail.example.com " + "y" * 200 + " " + "z" * 9000 + " end") for i in range(36)]
    rows += [(100, f"see {long}x {long}q id77 else where"), (101, f"see {long}x {long}p id78 else where")]
    found = {r["doc_id"]: r["n_other"] for r in pii.find_personal_data(docs(rows), min_pattern=0.7, min_instance=0.7).collect()}
    # words that differ at their far end are different words
    assert found[100] == 1 and found[101] == 0
