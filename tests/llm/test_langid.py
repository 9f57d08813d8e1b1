import numpy as np

from loadlens.llm import langid
from tests.llm.cases import AWKWARD, LONG

EN = ["the cat and the dog", "this is the house that they built", "with the other of these things"]
DE = ["der hund und die katze", "das ist das haus von nicht gebaut", "mit der und auch sich werden"]


def _labelled(spark, rows):
    return spark.createDataFrame([(i, t, l, 0.5) for i, t, l in rows], "doc_id long, text string, lang string, score double")


def _rows():
    return [(i, t, "en") for i, t in enumerate(EN * 5)] + [(100 + i, t, "de") for i, t in enumerate(DE * 5)]


def test_predicts_held_out_texts_as_counted_by_hand(spark):
    model = langid.train(_labelled(spark, _rows()))
    assert model.languages == ("de", "en")
    texts = ["the things they built", "nicht werden und der", "dog"]
    best, score = langid.score_texts(texts, model)
    assert [model.languages[b] for b in best[:2]] == ["en", "de"]
    for text, b, s in zip(texts, best, score, strict=True):
        codes = langid.letters_only(text)
        log = model.priors.copy()
        for n in langid.ORDERS:
            for x in langid.buckets(codes, n, model.bits):
                log = log + model.weights[x]
        p = np.exp(log - log.max())
        assert b == log.argmax() and np.isclose(s, p.max() / p.sum())


def test_long_text_is_counted_once_across_slices(monkeypatch):
    whole = {tuple(np.sort(np.concatenate([b for b, _ in langid.blocks([LONG])])))}
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert {tuple(np.sort(np.concatenate([b for b, _ in langid.blocks([LONG])])))} == whole


def test_awkward_rows_and_empty_tables(spark, docs):
    model = langid.train(_labelled(spark, _rows() + [(7, None, "en"), (None, "the", "en"), (8, "x", None)]))
    rows = langid.predict(docs(AWKWARD), model, keep=("doc_id",)).collect()
    assert len(rows) == len(AWKWARD)
    unknown = [r for r in rows if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in unknown} >= {0, 1, 2, 8} and all(r["score"] == 0 for r in unknown)
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = langid.train(_labelled(spark, _rows()).where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs(AWKWARD), nothing).collect()} == {"und"}
    assert langid.predict(docs(AWKWARD).where("false"), model).count() == 0


def test_sampled_training_keeps_about_the_bound(spark):
    rows = [(i, EN[i % 3], "en") for i in range(400)] + [(1000 + i, DE[i % 3], "de") for i in range(400)]
    model = langid.train(_labelled(spark, rows), max_rows=40)
    best, _ = langid.score_texts(EN + DE, model)
    assert [model.languages[b] for b in best] == ["en"] * 3 + ["de"] * 3
