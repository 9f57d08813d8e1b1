"""Forests grown together: the trees are those of Spark on the rows that they take."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from loadlens.operators import boosting, forests, models, prep, trees
from loadlens.operators.ordered import RN, order_rows

NAMES = ["a", "b", "c", "d"]


def rows_of(spark, n, digits=0):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (n, 4)).round(digits)
    y = np.where(x[:, 0] > 0, 3 * x[:, 1], x[:, 2] ** 2) + 0.1 * x[:, 3]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], f"{RN} long, a double, b double, c double, d double, label double")
    return df.withColumn("features", array_to_vector(F.array(*NAMES))).repartition(3).cache(), x


def task_of(spark, n, name="t", features=tuple(NAMES)):
    rows, _ = rows_of(spark, n, 2)
    timed = rows.select(*NAMES, "label", F.timestamp_seconds(RN).alias("Timestamp"))
    return models.prepare_task(order_rows(timed, ["Timestamp"]), prep.Task(name, "label", features))


@pytest.mark.parametrize("depth", [2, 5])
def test_every_tree_is_that_of_spark_on_the_rows_it_takes(spark, monkeypatch, depth):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    rows, x = rows_of(spark, 600)
    ((made,),) = forests.fit_forests([rows], [{"num_trees": 6, "max_depth": depth, "feature_subset_strategy": "all"}])
    taken = np.stack(list(forests.row_weights(np.arange(600), 42, 6)))
    assert made.averaged and len(made.trees) == 6
    for tree, weights in zip(made.trees, taken, strict=True):
        counts = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], f"{RN} long, w double")
        fit = DecisionTreeRegressor(maxDepth=depth, weightCol="w", minInstancesPerNode=1).fit(rows.join(counts, RN).where("w > 0"))
        (want,) = trees.read_trees(spark, fit).trees
        # of splits that part the rows of a tree alike any may be taken: compared on these rows
        assert tree.predict(x[weights > 0]) == pytest.approx(want.predict(x[weights > 0]), rel=1e-9)


def test_rows_are_taken_as_a_poisson_number_says():
    taken = np.stack(list(forests.row_weights(np.arange(200_000), 1, 6)))
    assert np.bincount(taken.ravel(), minlength=4)[:4] / taken.size == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.003)
    assert abs(np.corrcoef(taken) - np.eye(6)).max() < 0.01
    assert (taken[0] != next(forests.row_weights(np.arange(200_000), 2, 6))).any()


def test_nodes_draw_their_own_features_as_many_as_in_spark(spark):
    assert [forests.drawn_features(s, 31, 100) for s in ("auto", "onethird", "sqrt", "log2", "all")] == [11, 11, 6, 5, 31]
    assert forests.drawn_features("auto", 31, 1) == 31
    tree = forests._Tree(5)
    tree.open = list(range(16, 32))
    tree.draw(42, 3, 31, 11)
    assert tree.drawn.shape == (16, 11) and len(np.unique(tree.drawn, axis=0)) > 10
    assert all(len(set(d)) == 11 for d in tree.drawn.tolist())


def test_a_forest_does_not_depend_on_how_rows_are_dealt_out(spark):
    rows, x = rows_of(spark, 500)
    given = [{"num_trees": 5, "max_depth": 3, "seed": 3}]
    one, other = (forests.fit_forests([f], given)[0][0] for f in (rows.coalesce(1), rows.repartition(7)))
    assert one.prefixes(x, [(None, None), (2, 2)]) == pytest.approx(other.prefixes(x, [(None, None), (2, 2)]), rel=1e-9)


def test_forests_are_as_good_as_those_of_spark(spark):
    data = task_of(spark, 1500)
    given = {"num_trees": 30, "max_depth": 5, "seed": 42}
    (got,) = models.fit_models([data], "random_forest", given)
    want = models.estimator("random_forest", given).fit(data.train)
    assert type(got) is type(want) and got.getNumTrees == 30 and got.getOrDefault("bootstrap")
    errors = [m.transform(data.test).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0] for m in (got, want)]
    assert errors[0] == pytest.approx(errors[1], rel=0.1)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.06)


def test_a_tree_is_that_of_spark(spark):
    data = task_of(spark, 700)
    given = {"max_depth": 6, "max_bins": 64, "min_instances_per_node": 5, "seed": 42}
    (got,) = models.fit_models([data], "decision_tree", given)
    want = models.estimator("decision_tree", given).fit(data.train)
    assert type(got) is type(want) and got.numNodes == want.numNodes
    scored = [m.transform(data.train).orderBy(RN).toPandas()["prediction"].to_numpy() for m in (got, want)]
    assert scored[0] == pytest.approx(scored[1], rel=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-6)


def test_all_forests_of_a_search_and_of_all_tasks_take_a_job_for_a_level(spark):
    tasks = [task_of(spark, 400), task_of(spark, 400, "u", ("a", "b"))]
    number = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = number()
    space = {"num_trees": [3, 6], "max_depth": [2, 3], "feature_subset_strategy": ["auto", "sqrt"]}
    found = models.tune_together(tasks, "random_forest", [prep.expanding_folds(d.train_rows) for d in tasks], space=space)
    # levels, four parts to prepare and to score
    assert number() - start < 60
    assert [len(results) for results in found] == [8, 8]
    slow = models._tune_by_fits(tasks[0], "random_forest", prep.expanding_folds(tasks[0].train_rows), models.param_grid(space), {"seed": 42}, "rmse", 2)
    got = {str(r.parameters): r.mean_score for r in found[0]}
    assert sorted(got) == sorted(str(r.parameters) for r in slow)
    assert np.mean(list(got.values())) == pytest.approx(np.mean([r.mean_score for r in slow]), rel=0.15)


def test_other_parameters_are_left_to_spark():
    assert forests.known({"num_trees": 100, "max_depth": 5, "feature_subset_strategy": "auto", "seed": 42})
    for other in ({"num_trees": -1}, {"max_depth": 20}, {"feature_subset_strategy": "0.5"}, {"subsample_rate": 0.5}):
        assert not forests.known(other)
    assert models._grown_sets("decision_tree", [{"max_depth": 99}]) is None


def test_a_task_fails_only_when_all_its_models_fail(spark):
    data = task_of(spark, 200)
    settings = {"linear_regression": {"max_iter": -1}, "random_forest": {"num_trees": 2, "seed": 1}}
    made = models.train_all([data], settings=settings)
    assert [(c.model_name, c.error is None) for c in made] == [("linear_regression", False), ("random_forest", True)]
    with pytest.raises(RuntimeError, match="every model failed"):
        models.train_all([data], settings={"random_forest": {"num_trees": -1}})
