"""Rows prepared once for all tasks, and cut into blocks once for all models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loadlens.operators import boosting, features, models, prep, trees
from loadlens.operators.ordered import RN, OrderedRows, order_rows, row_frames
from loadlens.operators.sliding import add_frames

NAMES = ["a", "b", "c", "d"]
COLUMN = features.LAGGED_COLUMN


def readings(spark, n=3000):
    """Values with gaps; a label that is missing here and there."""
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (n, 4)).round(1)
    y = np.where(x[:, 0] > 0, 3 * x[:, 1], x[:, 2] ** 2)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "at long, a double, b double, c double, d double, y double")
    gaps = {"b": F.when(F.col("at") % 7 != 3, F.col("b")), "y": F.when(F.col("at") % 11 != 2, F.col("y")).otherwise(F.lit(float("nan")))}
    return df.withColumns(gaps).withColumn("Timestamp", F.timestamp_seconds("at")).repartition(5)


TASKS = [prep.Task("t", "y", tuple(NAMES)), prep.Task("u", "d", ("a", "c"))]


@pytest.mark.parametrize("in_chunks", [False, True])
def test_tasks_from_one_pass_are_those_prepared_one_by_one(spark, monkeypatch, in_chunks):
    monkeypatch.setattr(models, "PLACED_ROWS", 100)
    monkeypatch.setattr(OrderedRows, "chunk_rows", lambda self, reach=0: 100)
    ordered = order_rows(readings(spark), ["Timestamp"])
    given = ordered
    if in_chunks:
        whole = ordered.df.withColumn("chunk", F.expr(f"{RN} div 130")).repartition(6, "chunk").sortWithinPartitions("chunk", RN).drop("chunk")
        given = OrderedRows(whole, ordered.total, chunk=130)
    for task, got in zip(TASKS, models.prepare_tasks(given, TASKS, keep=["at"]), strict=True):
        want = models.prepare_task(ordered, task, keep=["at"])
        assert got.rows.total == want.rows.total
        columns = [RN, prep.ROW, prep.ROWS, "at", "Timestamp", models.FEATURES, models.LABEL]
        for part in ("train", "test"):
            rows = [sorted(getattr(data, part).select(columns).collect()) for data in (got, want)]
            assert rows[0] == rows[1] and rows[0]
        assert got.train.select(trees.feature_array(got.train).alias("x"), "features").where("size(x) = 0").count() == 0


def test_rows_out_of_order_are_an_error(spark):
    ordered = order_rows(readings(spark, 300), ["Timestamp"])
    given = OrderedRows(ordered.df.coalesce(1).sortWithinPartitions(F.col(RN).desc()), ordered.total, chunk=1000)
    with pytest.raises(Exception, match="not in order"):
        models.prepare_tasks(given, TASKS)


@pytest.mark.parametrize("series", [(), ("s",)])
def test_frames_by_chunks_have_the_digits_of_windows(spark, small_chunks, monkeypatch, series):
    monkeypatch.setattr("loadlens.operators.sliding.FRAME_CHUNK_ROWS", 7)
    monkeypatch.setattr("loadlens.operators.sliding.PIECE_ROWS", 50)
    r = np.random.default_rng(1)
    values = [None if u < 0.2 else float("nan") if u < 0.22 else float(v) for u, v in zip(r.random(700), r.normal(0, 10, 700).round(2))]
    df = spark.createDataFrame([(i, "a" if i < 3 else "b", v) for i, v in enumerate(values)], f"{RN} long, s string, {COLUMN} double")
    ordered = OrderedRows(df, 700, series)

    def build(w):
        made = features.lag_columns(w, COLUMN, [1, 5]) | features.difference_column(w, COLUMN)
        return made | features.rolling_columns(w, COLUMN, 4) | features.rolling_columns(w, COLUMN, 60)

    want, got = row_frames(ordered, build, 60).df, add_frames(ordered, COLUMN, [1, 5], [4, 60]).df
    assert got.dtypes == want.dtypes
    one, other = ([[repr(v) for v in row] for row in df.orderBy(RN).collect()] for df in (got, want))
    assert one == other


def test_cells_of_combined_features_are_those_of_each(monkeypatch):
    r = np.random.default_rng(2)
    cuts = [np.arange(k, dtype=float) for k in (31, 0, 4, 1, 31, 6, 17)]
    bins = np.stack([r.integers(0, len(c) + 1, 500) for c in cuts]).astype(np.uint8)
    target, weight, slot = r.normal(0, 1, 500), r.integers(0, 3, 500).astype(np.uint8), r.integers(0, 3, 500).astype(np.uint8)
    cells = boosting.Cells.of(cuts, 32)
    assert len(cells.bundles) < len(cuts) / 2 and sorted(f for b in cells.bundles for f in b) == list(range(7))
    got = cells.by_feature(cells.sums(cells.codes(bins), slot, 2, target, weight))
    for node in (1, 2):
        for f in range(7):
            here = slot == node
            assert got[0, node - 1, f].tolist() == np.bincount(bins[f][here], weight[here], 32).tolist()
            assert got[1, node - 1, f] == pytest.approx(np.bincount(bins[f][here], (weight * target)[here], 32))


def test_only_the_smaller_sibling_is_summed():
    rows = np.array([0, 0, 0, 0, 9, 3, 2, 5.0])
    assert boosting.fewer([1], rows) == [1] and boosting.fewer([4, 5, 6, 7], rows) == [5, 6]
    parents = np.arange(12.0).reshape(2, 2, 3) + 5
    sums = np.ones((2, 2, 3))
    whole = boosting.with_siblings(sums, [5, 6], [2, 3], parents)
    assert (whole[:, 1] == 1).all() and (whole[:, 2] == 1).all()
    assert (whole[:, 0] == parents[:, 0] - 1).all() and (whole[:, 3] == parents[:, 1] - 1).all()


@pytest.mark.parametrize("name", ["decision_tree", "random_forest", "gradient_boosted_tree"])
def test_scores_by_bins_are_those_of_the_trees(spark, monkeypatch, name):
    monkeypatch.setattr(trees, "SCORED_ROWS", 90)
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (400, 4)).round(2)
    y = np.where(x[:, 0] > 0, 3 * x[:, 1], x[:, 2] ** 2)
    df = spark.createDataFrame([(*map(float, x[i]), float(y[i])) for i in range(400)], "a double, b double, c double, d double, label double")
    rows = df.withColumn("features", array_to_vector(F.array(*NAMES)))
    settings = {"decision_tree": {"max_depth": 8}, "random_forest": {"num_trees": 5, "max_depth": 4}, "gradient_boosted_tree": {"max_iter": 4, "max_depth": 3}}
    found = trees.read_trees(spark, models.estimator(name, {**settings[name], "seed": 1}).fit(rows))
    assert all(h is not None for h in trees._Binned.of([found]).heaps[0])
    wanted = [(None, None), (None, 2), (1, 3)]
    want = y[:, None] - found.prefixes(x, wanted)
    for binned in (True, False):
        if not binned:
            monkeypatch.setattr(trees, "DEEPEST_HEAP", 0)
        errors = trees.prefix_errors(rows, found, wanted)
        assert [e["rmse"] for e in errors] == pytest.approx(np.sqrt((want**2).mean(0)), rel=1e-9)


def test_blocks_are_made_once_for_all_models(spark, monkeypatch):
    cut, written, given = [], [], boosting.cuts_of
    monkeypatch.setattr(boosting, "cuts_of", lambda *a: cut.append(a[1]) or given(*a))
    write = boosting._Staged.write.__func__
    monkeypatch.setattr(boosting._Staged, "write", classmethod(lambda cls, made: written.append("bins" in made.columns) or write(cls, made)))
    tasks = models.prepare_tasks(order_rows(readings(spark, 400), ["Timestamp"]), TASKS)
    settings = {"decision_tree": {"max_depth": 2}, "random_forest": {"num_trees": 2, "max_depth": 2, "seed": 1}, "gradient_boosted_tree": {"max_iter": 3, "max_depth": 2}}
    spaces = {name: {"max_depth": [1, 2], "max_bins": [32]} for name in settings}
    found = models.train_all(tasks, lambda d: prep.expanding_folds(d.train_rows), settings=settings, spaces=spaces)
    assert [c.error for c in found] == [None] * 6
    # two tasks with two folds each and the tasks themselves
    assert cut == [32] * 6 and sum(written) == 2
    for data, c in zip(tasks, found[::3], strict=True):
        want = models.estimator("decision_tree", settings["decision_tree"], **c.parameters).fit(data.train)
        assert c.model.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-9)


def test_thresholds_come_from_the_same_rows_with_and_without_a_sample(spark, monkeypatch):
    monkeypatch.setattr(models, "SAMPLED_ROWS", 1500)
    monkeypatch.setattr(boosting, "THRESHOLD_ROWS", 300)
    (data, _) = models.prepare_tasks(order_rows(readings(spark), ["Timestamp"]), TASKS)
    assert 0 < data.sample.train.count() < data.train.count()
    with_sample = boosting.cuts_of(data.train, 8, (data.sample.train, data.sample_share))
    without = boosting.cuts_of(data.train, 8)
    assert [c.tolist() for c in with_sample[0]] == [c.tolist() for c in without[0]]
    assert with_sample[1] == pytest.approx(without[1]) and with_sample[2] == without[2] == data.train.count()


def test_rows_of_a_block_are_shuffled_and_stay_together(spark):
    df = spark.range(500).select(F.col("id").alias(RN), F.col("id").cast("double").alias("label"), F.array(F.col("id").cast("double")).alias("x"))
    frame = df.coalesce(1).select(RN, "label", array_to_vector("x").alias("features"))
    (block,) = boosting._blocks(frame, 0, [np.arange(0.0, 500.0, 100.0)], 0).collect()
    bins, label, row = np.frombuffer(block["bins"], np.uint8), np.frombuffer(block["label"]), np.frombuffer(block["row"], np.int64)
    assert (np.diff(row) < 0).sum() > 100
    assert sorted(row.tolist()) == list(range(500)) and (label == row).all() and (bins == np.ceil(row / 100)).all()
