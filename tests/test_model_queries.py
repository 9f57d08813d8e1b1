"""Model queries cover every task and model."""

import os

import pytest

from loadlens.operators import models as ml
from loadlens.plans import model_queries as mq

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
QUICK = {
    "linear_regression": {"max_iter": 5},
    "decision_tree": {"max_depth": 1, "seed": 1},
}
SPACES = {"linear_regression": {"reg_param": [0.0, 0.1]}, "decision_tree": {"max_depth": [1, 2]}}


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(ml, "SETTINGS", QUICK)
    monkeypatch.setattr(ml, "SEARCH_SPACES", SPACES)


def pairs(rows, task, model):
    return {(r[task], r[model]) for r in rows}


EVERY = {(task, model) for task in mq.TASKS for model in QUICK}


def test_every_task_is_predicted(spark, quick):
    assert pairs(mq.ml_tree_predict(spark, SF_DIR).collect(), "Task", "Model") == {(t, "decision_tree") for t in mq.TASKS}
    assert pairs(mq.ml_predictions_long(spark, SF_DIR).collect(), "Task", "Model") == EVERY
    rows = mq.ml_feature_importance(spark, SF_DIR).collect()
    assert {(r["task"], r["feature"]) for r in rows} == {(t.name, f) for t in mq.TASKS.values() for f in t.features}


def test_every_model_of_every_task_is_tuned(spark, quick):
    rows = mq.ml_tune(spark, SF_DIR).collect()
    assert pairs(rows, "task", "model") == EVERY and len(rows) == 2 * len(EVERY)


def test_training_takes_the_tuned_parameters(spark, quick, monkeypatch):
    made = []
    given = ml.train_candidates
    monkeypatch.setattr(ml, "train_candidates", lambda *a, **b: made.extend(x := given(*a, **b)) or x)
    rows = mq.ml_train_all(spark, SF_DIR).collect()
    assert pairs(rows, "task_name", "model_name") == EVERY
    assert {(c.task, c.model_name) for c in made if c.parameters} == EVERY
