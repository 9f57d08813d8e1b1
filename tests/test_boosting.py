"""Boosted trees grown together against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loadlens.operators import boosting, models, prep, trees
from loadlens.operators.ordered import RN, order_rows

NAMES = ["a", "b", "c", "d"]
SETS = [{"max_iter": 6, "max_depth": d, "step_size": s, "max_bins": 32} for d in (3, 5) for s in (0.05, 0.1)]


def rows_of(spark, n, digits):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (n, 4)).round(digits)
    y = np.where(x[:, 0] > 0, 3 * x[:, 1], x[:, 2] ** 2) + 0.1 * x[:, 3]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], f"{RN} long, a double, b double, c double, d double, label double")
    return df.withColumn("features", array_to_vector(F.array(*NAMES))).repartition(3).cache(), x


@pytest.mark.parametrize("digits", [0, 6])
def test_trees_are_those_of_spark(spark, monkeypatch, digits):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    rows, x = rows_of(spark, 900, digits)
    parts = [rows.where(F.col(RN) < 400), rows]
    found = boosting.fit_boosted(parts, SETS)
    # of splits that part the training rows alike any may be taken: compared on these rows
    for part, own, x in zip(parts, found, (x[:400], x), strict=True):
        for parameters, got in zip(SETS, own, strict=True):
            want = trees.read_trees(spark, models.estimator("gradient_boosted_tree", None, **parameters).fit(part))
            assert got.weights.tolist() == want.weights.tolist()
            assert got.prefixes(x, [(None, None), (4, None)]) == pytest.approx(want.prefixes(x, [(None, None), (4, None)]), rel=1e-9)


def test_a_search_starts_few_jobs_and_scores_like_fits(spark):
    rows, _ = rows_of(spark, 400, 2)
    timed = rows.select(*NAMES, "label", F.timestamp_seconds(RN).alias("Timestamp"))
    data = models.prepare_task(order_rows(timed, ["Timestamp"]), prep.Task("t", "label", tuple(NAMES)))
    folds = prep.expanding_folds(data.train_rows)
    space = {"max_iter": [2, 4], "max_depth": [2, 3], "step_size": [0.05, 0.1], "max_bins": [32]}
    # an identifier that only the scheduler hands out
    number = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = number()
    results = models.tune(data, "gradient_boosted_tree", folds, space=space)
    between = number()
    slow = models._tune_by_fits(data, "gradient_boosted_tree", folds, models.param_grid(space), None, "rmse", 2)
    assert (between - start) * 2 < number() - between
    got = {str(r.parameters): r.fold_scores for r in results}
    assert len(got) == 8
    # the rows to validate on show which of equal splits was taken
    for r in slow:
        assert got[str(r.parameters)] == pytest.approx(r.fold_scores, rel=1e-2)


def test_other_parameters_are_left_to_spark():
    assert boosting.known({"max_iter": 50, "max_depth": 5, "subsample_rate": 1.0, "seed": 1})
    for other in ({"subsample_rate": 0.5}, {"max_iter": 0}, {"max_depth": 30}, {"loss_type": "absolute"}, {"max_bins": 1000}):
        assert not boosting.known(other)


def test_the_last_fit_is_a_model_of_spark_in_few_jobs(spark):
    rows, _ = rows_of(spark, 400, 2)
    timed = rows.select(*NAMES, "label", F.timestamp_seconds(RN).alias("Timestamp"))
    data = models.prepare_task(order_rows(timed, ["Timestamp"]), prep.Task("t", "label", tuple(NAMES)))
    given = {"max_iter": 12, "max_depth": 3, "step_size": 0.1, "seed": 42}
    number = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = number()
    (got,) = models.fit_models([data], "gradient_boosted_tree", given)
    between = number()
    want = models.estimator("gradient_boosted_tree", given).fit(data.compact(data.train))
    # a job for a level of a round and some for what is stored, but none for caches and checkpoints
    assert between - start <= 12 * 3 + 40
    assert (got.getNumTrees, got.treeWeights, got.getOrDefault("maxIter")) == (12, want.treeWeights, 12)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-9)
    scored = [m.transform(data.train).orderBy(RN).toPandas()["prediction"].to_numpy() for m in (got, want)]
    assert scored[0] == pytest.approx(scored[1], rel=1e-9)


def test_rows_meet_in_blocks_whatever_their_batches(spark):
    rows, _ = rows_of(spark, 900, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        made = boosting._blocks(rows.coalesce(1), 0, [np.array([0.0])] * 4, 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["n"] for r in made] == [900]


def test_rows_go_down_alike_in_shallow_and_deep_trees(monkeypatch):
    r = np.random.default_rng(3)
    bins = r.integers(0, 32, (5, 1000)).astype(np.uint8)
    feature, cut = r.integers(-1, 5, 128).astype(np.int32), r.integers(0, 31, 128).astype(np.int32)
    shallow = boosting._descend(bins, feature, cut, 6)
    monkeypatch.setattr(boosting, "SHALLOW", 0)
    assert (shallow == boosting._descend(bins, feature, cut, 6)).all() and len(np.unique(shallow)) > 5


def test_boosted_models_of_all_tasks_grow_together(spark, monkeypatch):
    calls, given = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda frames, sets: calls.append(len(frames)) or given(frames, sets))
    rows, _ = rows_of(spark, 300, 2)
    ordered = order_rows(rows.select(*NAMES, "label", F.timestamp_seconds(RN).alias("Timestamp")), ["Timestamp"])
    tasks = [models.prepare_task(ordered, prep.Task(n, "label", f)) for n, f in (("t", tuple(NAMES)), ("u", ("a", "b")))]
    settings = {"linear_regression": {}, "gradient_boosted_tree": {"max_iter": 3, "max_depth": 2, "seed": 1}}
    spaces = {"gradient_boosted_tree": {"max_depth": [1, 2]}}
    found = models.train_all(tasks, lambda d: prep.expanding_folds(d.train_rows), settings=settings, spaces=spaces)
    assert [(c.task, c.model_name, c.error) for c in found] == [(t, m, None) for t in "tu" for m in settings]
    assert calls == [4, 2]  # two folds of two tasks, then the two tasks
    for data, c in zip(tasks, found[1::2], strict=True):
        want = models.estimator("gradient_boosted_tree", settings["gradient_boosted_tree"], **c.parameters).fit(data.train)
        assert c.model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-9)


def test_staged_blocks_are_read_whole_by_few_tasks(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    monkeypatch.setattr(boosting, "shared_path", lambda session, label: f"{tmp_path}/odd name %/{label}")
    rows, x = rows_of(spark, 900, 2)
    staged = boosting._Staged.write(boosting._blocks(rows.repartition(20), 0, [np.array([0.0])] * 4, 1))
    assert len(staged.files) == 20

    def count(batches):
        found = [(n, len(label)) for part, bins, label, score in (r for b in batches for r in boosting._read(b, {0: [0]})) for n in [bins.sum()]]
        yield pa.RecordBatch.from_pydict({"above": [int(sum(n for n, _ in found))], "n": [sum(n for _, n in found)]})

    made = staged.map(count, "above long, n long").collect()
    assert len(made) <= spark.sparkContext.defaultParallelism
    assert (sum(r["n"] for r in made), sum(r["above"] for r in made)) == (900, int((x > 0).sum()))
    staged.delete()
    assert not list(tmp_path.rglob("*.parquet"))
