import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.cases import AWKWARD


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark; bad texts differ from good ones by a symbol in every word."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(100, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _rows():
    good = [(i, " ".join(f"plain{i}x{k:02d}a" for k in range(30)), "en", 1) for i in range(100, 200)]
    bad = [(i, " ".join(f"plain{i}x{k:02d}$" for k in range(30)), "en", 1) for i in range(200, 300)]
    item = " ".join(f"item{k}" for k in range(20))
    passage = " ".join(f"shared{k}" for k in range(60))
    copy = good[0][1].split()
    copy[5] = "edited"
    planted = [
        (1, f"some words before {item} and some after it here", "en", 1),
        (2, f"first own line of ten words that is only here now\n{passage}", "en", 1),
        (3, f"second own line of ten other words found only here too\n{passage}", "en", 1),
        (400, " ".join([*good[0][1].split(), "tail"]), "en", 1),
        (401, "too few words", "en", 1),
    ]
    return good + bad + planted


def test_each_stage_does_its_work_and_keeps_clean_rows(spark, tables):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, n_chars long").withColumn("n_words", F.lit("clash"))
    good, seen = set(range(100, 200)), []
    for name, work in pipeline.STAGES:
        out = work(spark, docs, tables)
        rows = out.collect()
        kept = {r["doc_id"] for r in rows}
        assert good <= kept, name
        seen.append(kept)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(r["n_words"] == "clash" for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "line dedup":
            texts = {r["doc_id"]: r for r in rows}
            assert "shared5" in texts[2]["text"] and "shared5" not in texts[3]["text"]
            assert texts[3]["n_chars"] == len(texts[3]["text"]) and texts[2]["n_chars"] == 1
    quality, lines, near, clean, tokens = seen
    assert not quality & (set(range(200, 300)) | {401}) and quality >= {1, 2, 3, 400}
    assert lines == quality and near == lines - {400} and clean == near - {1} and tokens == clean
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


@pytest.mark.parametrize("number", range(5))
def test_stages_take_awkward_and_empty_tables(spark, docs, tables, number):
    frame = docs(AWKWARD)
    _, work = pipeline.STAGES[number]
    assert work(spark, frame, tables).count() <= len(AWKWARD)
    assert work(spark, frame.where("false"), tables).count() == 0


def test_an_item_in_another_letter_case_is_dropped(spark, tables):
    item = " ".join(f"ITEM{k}" for k in range(20))
    rows = [(1, f"Some words before {item} and some after it here"), (2, "Nothing of the benchmark stands in this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(pipeline.STAGES)["decontamination"](spark, docs, tables).collect()
    assert [tuple(r) for r in kept] == [rows[1]]
