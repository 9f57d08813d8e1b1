"""Training, tuning and scoring of Spark ML regressors.

The loops over tasks, models and parameter sets run on the driver and start Spark
jobs; rows stay on the executors. Assembled vectors of a task are staged once and
every fold and fit reads them as a range of row positions.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import reduce
from math import ceil
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.operators import boosting, forests, gram, prep, trees
from loadlens.operators.evaluate import regression_metrics
from loadlens.operators.features import DAY_ROWS, LAGGED_COLUMN, SMOOTHING_ROWS, add_day_lag, add_lags, add_smoothed
from loadlens.operators.ordered import MAX_CHUNKS, RN, OrderedRows, order_rows
from loadlens.sources.shared import shared_path, stage

# Parameters and search spaces per model family
ESTIMATORS = {
    "linear_regression": LinearRegression,
    "decision_tree": DecisionTreeRegressor,
    "random_forest": RandomForestRegressor,
    "gradient_boosted_tree": GBTRegressor,
}
SETTINGS = {
    "linear_regression": {"max_iter": 100, "reg_param": 0.0, "elastic_net_param": 0.0, "standardization": True},
    "decision_tree": {"max_depth": 5, "min_instances_per_node": 1, "seed": 42},
    "random_forest": {
        "num_trees": 100, "max_depth": 5, "min_instances_per_node": 1, "feature_subset_strategy": "auto", "seed": 42,
    },
    "gradient_boosted_tree": {"max_iter": 50, "max_depth": 5, "step_size": 0.1, "subsample_rate": 1.0, "seed": 42},
}
SEARCH_SPACES = {
    "linear_regression": {"reg_param": [0.0, 0.01, 0.1], "elastic_net_param": [0.0, 0.5], "max_iter": [100]},
    "decision_tree": {"max_depth": [3, 5, 7], "max_bins": [32, 64], "min_instances_per_node": [1, 5]},
    "random_forest": {
        "num_trees": [50, 100], "max_depth": [3, 5], "max_bins": [32], "feature_subset_strategy": ["auto", "sqrt"],
    },
    "gradient_boosted_tree": {"max_iter": [30, 50], "max_depth": [3, 5], "step_size": [0.05, 0.1], "max_bins": [32]},
}
SEARCH_SEED = 42
FORECAST_FOREST = {"num_trees": 20, "max_depth": 10, "seed": 42}

FEATURES, LABEL = "features", "label"
#: rows that a fit reads in one task: no task for fewer, a task of its own for as many
ROWS_A_TASK = 50_000
MOST_ROWS_A_TASK = 100_000
#: rows that are numbered at a time in ``prepare_tasks``, and rows of a task of which thresholds are made
PLACED_ROWS = 131_072
SAMPLED_ROWS = 131_072


# parameters whose Spark name is not their own in camel case
RENAMED = {"subsample_rate": "subsamplingRate"}


def _spark_name(name: str) -> str:
    if name in RENAMED:
        return RENAMED[name]
    first, *rest = name.split("_")
    return first + "".join(part.capitalize() for part in rest)


def candidate_models(settings: dict[str, dict] | None = None) -> list[str]:
    """Names of the enabled models; a setting ``enabled: False`` leaves one out."""
    return [name for name, given in (settings or SETTINGS).items() if given.get("enabled", True)]


def estimator(name: str, settings: dict | None = None, **changes: object) -> Estimator:
    """An unfitted regressor; unknown names and parameters are errors."""
    if name not in ESTIMATORS:
        raise ValueError(f"unknown model {name}, known are {', '.join(ESTIMATORS)}")
    given = {**(SETTINGS[name] if settings is None else settings), **changes}
    parameters = {_spark_name(k): v for k, v in given.items() if k != "enabled"}
    return ESTIMATORS[name](featuresCol=FEATURES, labelCol=LABEL, **parameters)


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Feature columns to one vector; rows with a missing feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip")


def fit_pipeline(df: DataFrame, features: Sequence[str], est: Estimator) -> tuple[PipelineModel, float]:
    """Assembler and regressor fitted together, with the seconds it took."""
    started = time.perf_counter()
    model = Pipeline(stages=[assembler(features), est]).fit(df)
    return model, time.perf_counter() - started


def side_by_side(session: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Results of ``work`` for every item, in order; threads see the session and the staging scope of the caller."""
    contexts = [copy_context() for _ in items]
    run = inheritable_thread_target(session)(lambda context, item: context.run(work, item))
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return list(pool.map(run, contexts, items))


def param_grid(
    space: dict[str, Sequence],
    *,
    strategy: str = "grid_search",
    combinations: int | None = None,
    seed: int = SEARCH_SEED,
) -> list[dict[str, object]]:
    """All combinations, or for ``random_search`` a seeded sample of ``combinations``.

    A grid search with more than the given ``combinations`` is an error.
    """
    if strategy not in ("grid_search", "random_search"):
        raise ValueError(f"unknown strategy {strategy}")
    searched = {k: v for k, v in space.items() if v}
    if not searched:
        return []
    grid = [dict(zip(searched, values)) for values in itertools.product(*searched.values())]
    if strategy == "random_search":
        if combinations is None:
            raise ValueError("a random search needs a number of combinations")
        return random.Random(seed).sample(grid, min(len(grid), combinations))
    if combinations is not None and len(grid) > combinations:
        raise ValueError(f"{len(grid)} combinations, {combinations} are allowed")
    return grid


def fitting(part: DataFrame, total: int) -> DataFrame:
    """``part`` of ``total`` rows in as many tasks as a fit of trees asks for.

    Trees keep their rows in memory, many times as large as they are stored: files are read
    in parts of so many bytes, rows go by their positions.
    """
    if total <= MOST_ROWS_A_TASK:
        return part.coalesce(-(-total // ROWS_A_TASK))
    # blocks of positions are dealt out; sorted, as a fit depends on the order of its rows
    block = F.expr(f"{RN} div {MOST_ROWS_A_TASK // 100}")
    return part.repartition(-(-total // MOST_ROWS_A_TASK), block).sortWithinPartitions(RN)


@dataclass
class TaskData:
    """Staged vectors of one task in order: position, series, time, keys, vector and label.

    Positions have no gaps; every series is split and folded at its own points.
    """

    task: prep.Task
    rows: OrderedRows
    test_ratio: float = prep.TEST_RATIO
    #: that share of the rows, those whose position's hash is small
    sample: TaskData | None = None
    sample_share: float = 0.0

    @property
    def train_rows(self) -> int:
        """Training rows of a table without series."""
        return prep.train_rows(self.rows.total, self.test_ratio)

    def compact(self, part: DataFrame) -> DataFrame:
        """``part`` of the rows in no more tasks than its size asks for: tree fits are many short jobs."""
        return fitting(part, self.rows.total)

    @property
    def train(self) -> DataFrame:
        return self.rows.df.where(prep.in_training(self.test_ratio))

    @property
    def test(self) -> DataFrame:
        return self.rows.df.where(~prep.in_training(self.test_ratio))

    @property
    def training_rows(self) -> OrderedRows:
        """The training rows, with their number in each series."""
        kept = F.floor(F.round(F.col(prep.ROWS) * (1 - self.test_ratio), 9))
        return self.rows.with_df(self.train.withColumn(prep.ROWS, kept))

    def fold_frames(self, fold: prep.Fold) -> tuple[DataFrame, DataFrame]:
        """A fold of the training rows."""
        return prep.fold_frames(self.training_rows, fold)


def prepare_task(
    ordered: OrderedRows,
    task: prep.Task,
    *,
    ts: str = "Timestamp",
    keep: Sequence[str] = (),
    test_ratio: float = prep.TEST_RATIO,
) -> TaskData:
    """Complete cases of a task, assembled, numbered again without gaps and staged."""
    keys = list(dict.fromkeys([*ordered.series, *keep]))
    projected = prep.task_projection(ordered.df, task, ts=ts, keep=[*keys, RN])
    complete = assembler(task.features).transform(prep.complete_cases(projected, task))
    # the old position is unique and sorts by series first
    renumbered = order_rows(complete.select(F.col(RN).alias("__old"), *keys, ts, FEATURES, LABEL), ["__old"])
    if not renumbered.total:
        raise ValueError("no complete rows to train on")
    placed = prep.series_rows(OrderedRows(renumbered.df.drop("__old"), renumbered.total, ordered.series))
    staged = stage(placed.df.select(RN, prep.ROW, prep.ROWS, *keys, ts, FEATURES, LABEL), "task")
    return TaskData(task, placed.with_df(staged), test_ratio)


def prepare_tasks(
    ordered: OrderedRows, tasks: Sequence[prep.Task], *, ts: str = "Timestamp", keep: Sequence[str] = (), test_ratio: float = prep.TEST_RATIO
) -> list[TaskData]:
    """``prepare_task`` for several tasks from one pass over the rows, which are staged once.

    A row has its number among the complete rows of each task. Vectors are made when they are read, for
    Spark's models only; beside them are the same values as an array.
    """
    if ordered.series:
        return [prepare_task(ordered, task, ts=ts, keep=keep, test_ratio=test_ratio) for task in tasks]
    keys = list(dict.fromkeys(keep))
    columns = list(dict.fromkeys([RN, *keys, ts, *(c for task in tasks for c in (*task.features, task.target))]))
    prep.require(ordered.df, columns)
    kinds = dict(ordered.df.dtypes)

    def known(name: str) -> Column:
        there = F.col(name).isNotNull()
        return there & ~F.isnan(name) if kinds[name] in ("double", "float") else there

    # chunks of positions, so that a row's number is that in its chunk and the rows of the chunks before
    rows = ordered.chunk or max(min(PLACED_ROWS, ordered.chunk_rows()), ceil(ordered.total / MAX_CHUNKS))
    flags, places = ([f"{name}_{k}" for k in range(len(tasks))] for name in ("__in", "__at"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, passed = -1, -1, np.zeros(len(tasks), np.int64)
        for batch in batches:
            for start, end in _runs(batch.column("__chunk").to_numpy()):
                part = batch.slice(start, end - start)
                position = part.column(RN).to_numpy()
                if part.column("__chunk")[0].as_py() != chunk:
                    chunk, last, passed = part.column("__chunk")[0].as_py(), -1, np.zeros(len(tasks), np.int64)
                if position[0] <= last or (np.diff(position) <= 0).any():
                    raise ValueError("rows of a chunk are not in order")
                last, numbers = position[-1], []
                for k, flag in enumerate(flags):
                    inside = part.column(flag).to_numpy(zero_copy_only=False)
                    numbers.append(pa.array(passed[k] + np.cumsum(inside) - 1, pa.int64(), mask=~inside))
                    passed[k] += inside.sum()
                kept = [part.column(c) for c in (*columns, "__chunk")]
                yield pa.RecordBatch.from_arrays([*kept, *numbers], [*columns, "__chunk", *places])

    def number_chunk(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(number(iter(table.sort_by(RN).to_batches())))

    inside = [reduce(lambda a, b: a & b, map(known, (*task.features, task.target))).alias(flags[k]) for k, task in enumerate(tasks)]
    chunked = ordered.df.select(*columns, F.expr(f"{RN} div {rows}").alias("__chunk"), *inside)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "__chunk long", *(f"{place} long" for place in places)])
    numbered = chunked.mapInArrow(number, schema) if ordered.chunk else chunked.groupBy("__chunk").applyInArrow(number_chunk, schema)
    staged = stage(numbered, "tasks")
    # one row for each chunk
    sizes = staged.groupBy("__chunk").agg(*[F.count(place).alias(place) for place in places]).toArrow().sort_by("__chunk")
    counts = {place: sizes[place].to_numpy() for place in places}
    totals = [int(counts[place].sum()) for place in places]
    if not all(totals):
        raise ValueError("no complete rows to train on")
    starts = {"__chunk": sizes["__chunk"], **{f"{place}_start": np.cumsum(n) - n for place, n in counts.items()}}
    placed = staged.join(F.broadcast(ordered.df.sparkSession.createDataFrame(pa.table(starts))), "__chunk")
    positions = [F.col(f"{place}_start") + F.col(place) for place in places]

    def rows_of(table: DataFrame, k: int) -> OrderedRows:
        values = F.array(*[F.col(c).cast("double") for c in tasks[k].features])
        own = table.where(F.col(places[k]).isNotNull()).select(
            positions[k].alias(RN), positions[k].alias(prep.ROW), F.lit(totals[k]).cast("long").alias(prep.ROWS), *keys, ts,
            array_to_vector(values).alias(FEATURES), values.alias(trees.array_name(FEATURES)), F.col(tasks[k].target).cast("double").alias(LABEL),
        )
        return OrderedRows(own, totals[k])

    made = [TaskData(task, rows_of(placed, k), test_ratio) for k, task in enumerate(tasks)]
    if max(totals) > SAMPLED_ROWS:
        # some rows of each task for the thresholds of trees, from one pass for all tasks
        share = SAMPLED_ROWS / max(totals)
        picked = reduce(lambda a, b: a | b, [F.coalesce(boosting.picked(position, share), F.lit(False)) for position in positions])
        sampled = stage(placed.where(picked), "sample")
        for k, data in enumerate(made):
            own = rows_of(sampled, k)
            data.sample = TaskData(data.task, own.with_df(own.df.where(boosting.picked(F.col(RN), share))), test_ratio)
            data.sample_share = share
    return made


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in itertools.pairwise(cuts) if a < b]


@dataclass
class TrainedCandidate:
    """A fitted model with its times, or the error that kept it from being fitted."""

    task: str
    model_name: str
    parameters: dict[str, object] = field(default_factory=dict)
    model: Model | None = None
    training_time: float | None = None
    prediction_time: float | None = None
    predictions_path: str | None = None
    error: str | None = None


def score(
    model: Model, rows: DataFrame, task: str, name: str, ts: str = "Timestamp", series: Sequence[str] = ()
) -> DataFrame:
    """Predictions in the shared long form; ``Row`` is the position, which pairs rows of equal time."""
    numbered = [F.col(RN).alias("Row")] if RN in rows.columns else []
    return model.transform(rows).select(
        *series,
        *numbered,
        F.col(ts).alias("Timestamp"),
        F.col(LABEL).alias("Actual"),
        F.col("prediction").alias("Predicted"),
        F.lit(task).alias("Task"),
        F.lit(name).alias("Model"),
    )


BOOSTED, FOREST, TREE = "gradient_boosted_tree", "random_forest", "decision_tree"
#: models of all tasks that are one piece of work
TOGETHER = (BOOSTED, FOREST, TREE)


def _grown_sets(name: str, given: Sequence[dict[str, object]]) -> list[dict[str, object]] | None:
    """The parameter sets as ``boosting`` or ``forests`` takes them; None where one is left to Spark's fit."""
    given = [{p: v for p, v in g.items() if p != "enabled"} for g in given]
    if name == FOREST and all(map(forests.known, given)):
        return [{**forests.DEFAULTS, **g} for g in given]
    if name == TREE and not any({*g} - {"max_depth", "max_bins", "min_instances_per_node", "seed"} for g in given):
        # a tree is a boosted model of one round
        given = [{**g, "max_iter": 1} for g in given]
    elif name != BOOSTED:
        return None
    if not all(map(boosting.known, given)):
        return None
    return [{p: {**boosting.DEFAULTS, **g}[p] for p in boosting.DEFAULTS} for g in given]


def _training_parts(tasks: Sequence[TaskData]) -> boosting.Parts:
    return boosting.Parts([data.train for data in tasks], [(data.sample.train, data.sample_share) if data.sample else None for data in tasks])


class SharedParts:
    """The training rows of all tasks and of their folds: cut into blocks once for all models that grow from them."""

    def __init__(self, tasks: Sequence[TaskData], folds: Callable[[TaskData], Sequence[prep.Fold]] | None) -> None:
        self.trains = _training_parts(tasks)
        self._tasks, self._folds, self._lock = tasks, folds, Lock()
        self._rows: list[tuple[int, tuple[DataFrame, DataFrame]]] = []
        self._parts: boosting.Parts | None = None

    def folds(self) -> tuple[list[tuple[int, tuple[DataFrame, DataFrame]]], boosting.Parts]:
        with self._lock:
            if self._parts is None:
                folds = [self._folds(data) for data in self._tasks]
                self._rows = _rows_of_folds(self._tasks, folds)
                samples = [
                    (data.sample.fold_frames(f)[0], data.sample_share) if data.sample else None
                    for data, own in zip(self._tasks, folds, strict=True) for f in own
                ]
                self._parts = boosting.Parts([train for _, (train, _) in self._rows], samples)
            return self._rows, self._parts

    def delete(self) -> None:
        self.trains.delete()
        if self._parts is not None:
            self._parts.delete()


def _grow(name: str, frames: Sequence[DataFrame], sets_of: Sequence[Sequence[dict[str, object]]]) -> list[list[trees.Trees]]:
    return (forests.grow if name == FOREST else boosting.grow)(frames, sets_of)


def fit_models(
    tasks: Sequence[TaskData], name: str, settings: dict | None = None, changes: Sequence[dict[str, object]] | None = None,
    shared: SharedParts | None = None,
) -> list[Model]:
    """A model of the training rows of every task, with the ``changes`` of that task.

    Trees, forests and boosted models are grown together from blocks of bins (``boosting``, ``forests``), unless
    a parameter is one that only Spark's fit has, and are Spark's models all the same.
    """
    changes = changes or [{}] * len(tasks)
    unfitted = [estimator(name, settings, **c) for c in changes]
    sets = _grown_sets(name, [{**(SETTINGS[name] if settings is None else settings), **c} for c in changes])
    made: dict[int, trees.Trees] = {}
    for bins in sorted({s["max_bins"] for s in sets or []}):
        own = [k for k, s in enumerate(sets) if s["max_bins"] == bins]
        if shared:
            grown = _grow(name, shared.trains, [[s] if s["max_bins"] == bins else [] for s in sets])
            made.update({k: grown[k][0] for k in own})
            continue
        parts = _training_parts([tasks[k] for k in own])
        try:
            grown = _grow(name, parts, [[sets[k]] for k in own])
        finally:
            parts.delete()
        made.update({k: one for k, (one,) in zip(own, grown, strict=True)})

    def fit(k: int) -> Model:
        if k in made:
            return trees.stored_model(tasks[k].train, unfitted[k], made[k])
        return unfitted[k].fit(tasks[k].compact(tasks[k].train))

    return side_by_side(tasks[0].rows.df.sparkSession, fit, range(len(tasks)), len(tasks))


@dataclass
class TuningResult:
    model_name: str
    parameters: dict[str, object]
    fold_scores: list[float]
    mean_score: float
    error: str | None = None


#: parameters whose smaller values are held in a fit with a larger one: trees of a model, depth of a tree
NESTED = {
    "decision_tree": (None, "max_depth"),
    "random_forest": ("num_trees", "max_depth"),
    "gradient_boosted_tree": ("max_iter", None),
}
#: parameters that sums of products answer
_LINEAR = {"reg_param", "elastic_net_param", "standardization", "max_iter"}


def nested_sets(name: str, grid: Sequence[dict[str, object]]) -> list[tuple[dict[str, object], list[int]]]:
    """Parameter sets that one fit answers: what to fit, and the numbers of the sets in ``grid``."""
    inner = [p for p in NESTED.get(name, ()) if p]
    groups: dict[str, list[int]] = {}
    for k, parameters in enumerate(grid):
        rest = {p: v for p, v in parameters.items() if p not in inner}
        held = sorted(p for p in parameters if p in inner)
        groups.setdefault(repr((sorted(rest.items(), key=lambda x: x[0]), held)), []).append(k)
    out = []
    for numbers in groups.values():
        widest = dict(grid[numbers[0]])
        for p in inner:
            if p in widest:
                widest[p] = max(grid[k][p] for k in numbers)
        out.append((widest, numbers))
    return out


def _fold_sums(data: TaskData, folds: Sequence[prep.Fold]) -> list[tuple[gram.Gram, gram.Gram]]:
    """Sums of the training and validation rows of every fold, from one pass over the rows."""
    kinds = {f.slices for f in folds}
    found: dict[object, tuple[list[int], dict[object, gram.Gram]]] = {}
    for slices in kinds:
        own = [f for f in folds if f.slices == slices]
        cuts = sorted({at for f in own for span in (f.train, f.validation) for at in span})
        found[slices] = cuts, gram.grams(data.training_rows.df, prep.slice_of(cuts, slices))

    def total(fold: prep.Fold, span: tuple[int, int]) -> gram.Gram | None:
        cuts, sums = found[fold.slices]
        parts = [sums[k] for k in range(1, len(cuts)) if span[0] <= cuts[k - 1] and cuts[k] <= span[1] and k in sums]
        return reduce(lambda a, b: a + b, parts) if parts else None

    out = []
    for f in folds:
        pair = total(f, f.train), total(f, f.validation)
        if pair[0] is None or pair[1] is None:
            raise ValueError(f"fold {f.number} has no rows to train or to validate on")
        out.append(pair)
    return out


def _tune_linear(
    data: TaskData, folds: Sequence[prep.Fold], grid: Sequence[dict[str, object]], settings: dict, metric: str
) -> list[TuningResult]:
    """Every penalty on every fold from sums: no fit reads a row."""
    sums = _fold_sums(data, folds)
    results = []
    for parameters in grid:
        given = {k: v for k, v in {**settings, **parameters}.items() if k in _LINEAR - {"max_iter"}}
        scores = [validation.errors(*train.fit(**given))[metric] for train, validation in sums]
        results.append(_tuned("linear_regression", parameters, scores, metric))
    return results


def _tuned(name: str, parameters: dict[str, object], scores: list[float | None], metric: str) -> TuningResult:
    if any(s is None for s in scores):
        return TuningResult(name, parameters, [], float("nan"), f"{metric} is not defined on a fold")
    return TuningResult(name, parameters, scores, sum(scores) / len(scores))


def tune(
    data: TaskData,
    name: str,
    folds: Sequence[prep.Fold],
    *,
    space: dict[str, Sequence] | None = None,
    settings: dict | None = None,
    metric: str = "rmse",
    parallelism: int = 4,
    **grid_options: object,
) -> list[TuningResult]:
    """Mean score of each parameter set over the folds, best first.

    A set that cannot be fitted on a fold comes last, with its error; when none is left
    that is an error. An empty ``space`` scores the settings as they are. Folds without
    rows are an error.

    Linear models are solved from one pass over the rows, unless ``mae`` is wanted. Of
    trees, forests and boosted models the largest is fitted, and its prefixes stand for
    the smaller ones: for trees and boosting these are the models that Spark would fit,
    a smaller forest is one of the same kind from the same seed. Those of all sets and folds grow
    together (``boosting``, ``forests``), unless a parameter is one that only Spark's fit has.
    """
    if metric not in ("rmse", "mae", "r2"):
        raise ValueError(f"unknown metric {metric}")
    grid = param_grid(SEARCH_SPACES[name] if space is None else space, **grid_options) or [{}]
    given = SETTINGS[name] if settings is None else settings
    if name == "linear_regression" and metric != "mae" and {*given, *grid[0]} - {"enabled"} <= _LINEAR:
        results = _tune_linear(data, folds, grid, given, metric)
    elif _grown_sets(name, [{**given, **p} for p in grid]):
        (results,) = _tune_grown([data], name, [folds], grid, given, metric, parallelism)
    else:
        results = _tune_by_fits(data, name, folds, grid, settings, metric, parallelism)
    return _best_first(name, results, metric)


def tune_together(
    tasks: Sequence[TaskData], name: str, folds: Sequence[Sequence[prep.Fold]], *, space: dict[str, Sequence] | None = None,
    settings: dict | None = None, metric: str = "rmse", parallelism: int = 4, shared: SharedParts | None = None, **grid_options: object,
) -> list[list[TuningResult]]:
    """``tune`` of the trees, forests or boosted models of several tasks, which grow together."""
    grid = param_grid(SEARCH_SPACES[name] if space is None else space, **grid_options) or [{}]
    given = SETTINGS[name] if settings is None else settings
    if metric not in ("rmse", "mae", "r2") or not _grown_sets(name, [{**given, **p} for p in grid]):
        options = {"space": space, "settings": settings, "metric": metric, "parallelism": parallelism, **grid_options}
        return [tune(data, name, own, **options) for data, own in zip(tasks, folds, strict=True)]
    found = _tune_grown(tasks, name, folds, grid, given, metric, parallelism, shared)
    return [_best_first(name, results, metric) for results in found]


def _best_first(name: str, results: Sequence[TuningResult], metric: str) -> list[TuningResult]:
    scored = [r for r in results if r.error is None]
    if not scored:
        raise RuntimeError(f"{name}: no parameter set could be fitted, first {results[0].error}")
    scored.sort(key=lambda r: -r.mean_score if metric == "r2" else r.mean_score)
    return scored + [r for r in results if r.error is not None]


def _fold_rows(data: TaskData, folds: Sequence[prep.Fold]) -> list[tuple[DataFrame, DataFrame]]:
    frames = [data.fold_frames(f) for f in folds]
    for f, pair in zip(folds, frames, strict=True):
        if any(frame.isEmpty() for frame in pair):
            raise ValueError(f"fold {f.number} has no rows to train or to validate on")
    return frames


def _rows_of_folds(tasks: Sequence[TaskData], folds: Sequence[Sequence[prep.Fold]]) -> list[tuple[int, tuple[DataFrame, DataFrame]]]:
    return [(k, pair) for k, data in enumerate(tasks) for pair in _fold_rows(data, folds[k])]


def _tune_grown(
    tasks: Sequence[TaskData], name: str, folds: Sequence[Sequence[prep.Fold]], grid: Sequence[dict[str, object]], settings: dict,
    metric: str, parallelism: int, shared: SharedParts | None = None,
) -> list[list[TuningResult]]:
    """Every set on every fold of every task from trees that grow together; sets with other numbers of bins apart."""
    if shared:
        rows, trains = shared.folds()
    else:
        rows = _rows_of_folds(tasks, folds)
        trains = [train for _, (train, _) in rows]
    groups = nested_sets(name, grid)
    of_trees, of_depth = NESTED[name]
    full = _grown_sets(name, [{**settings, **widest} for widest, _ in groups])
    made: dict[tuple[int, int], trees.Trees] = {}
    for bins in sorted({f["max_bins"] for f in full}):
        own = [k for k, f in enumerate(full) if f["max_bins"] == bins]
        grown = _grow(name, trains, [[full[k] for k in own]] * len(rows))
        made.update({(part, k): t for part, each in enumerate(grown) for k, t in zip(own, each, strict=True)})

    def scores(part: int) -> dict[tuple[int, int], float | None]:
        wanted = [(made[part, g], [(grid[k].get(of_trees), grid[k].get(of_depth)) for k in numbers]) for g, (_, numbers) in enumerate(groups)]
        errors = trees.errors_of_all(rows[part][1][1], wanted)
        return {(k, part): e[metric] for (_, numbers), own in zip(groups, errors, strict=True) for k, e in zip(numbers, own, strict=True)}

    scored = side_by_side(tasks[0].rows.df.sparkSession, scores, range(len(rows)), parallelism)
    found = {k: v for one in scored for k, v in one.items()}
    parts = [[part for part, (k, _) in enumerate(rows) if k == task] for task in range(len(tasks))]
    return [[_tuned(name, p, [found[k, part] for part in own], metric) for k, p in enumerate(grid)] for own in parts]


def _tune_by_fits(
    data: TaskData, name: str, folds: Sequence[prep.Fold], grid: Sequence[dict[str, object]], settings: dict | None,
    metric: str, parallelism: int,
) -> list[TuningResult]:
    session = data.rows.df.sparkSession
    frames = _fold_rows(data, folds)
    of_trees, of_depth = NESTED.get(name, (None, None))

    def scores(work: tuple[dict[str, object], list[int], int]) -> dict[tuple[int, int], float | str | None]:
        """The score, or the error, of every set of a group on a fold."""
        widest, numbers, fold = work
        train, validation = frames[fold]
        try:
            model = estimator(name, settings, **widest).fit(data.compact(train))
            if name in NESTED:
                wanted = [(grid[k].get(of_trees), grid[k].get(of_depth)) for k in numbers]
                found = [e[metric] for e in trees.prefix_errors(validation, trees.read_trees(session, model), wanted)]
            else:
                scored = regression_metrics(model.transform(validation), [], actual=LABEL, predicted="prediction")
                found = [scored.first()[metric]] * len(numbers)
            return {(k, fold): value for k, value in zip(numbers, found, strict=True)}
        except Exception as error:  # told by the caller
            if len(numbers) == 1:
                return {(numbers[0], fold): f"{type(error).__name__}: {error}"}
            # the largest may be what cannot be fitted
            alone = [scores((grid[k], [k], fold)) for k in numbers]
            return {key: value for one in alone for key, value in one.items()}

    work = [(widest, numbers, fold) for widest, numbers in nested_sets(name, grid) for fold in range(len(folds))]
    found = {k: v for one in side_by_side(session, scores, work, parallelism) for k, v in one.items()}
    results = []
    for k, parameters in enumerate(grid):
        own = [found[k, fold] for fold in range(len(folds))]
        errors = [v for v in own if isinstance(v, str)]
        results.append(
            TuningResult(name, parameters, [], float("nan"), errors[0]) if errors else _tuned(name, parameters, own, metric)
        )
    return results


def tune_all(
    tasks: Sequence[TaskData], folds: Callable[[TaskData], Sequence[prep.Fold]], *, settings: dict[str, dict] | None = None, **options: object
) -> list[tuple[str, list[TuningResult]]]:
    """Tune every enabled model of every task; tasks and models run side by side."""
    all_settings = settings or SETTINGS
    names = candidate_models(all_settings)
    work = [(tasks, n) for n in TOGETHER if n in names] + [([data], n) for n in reversed(names) if n not in TOGETHER for data in tasks]

    def one(item: tuple[Sequence[TaskData], str]) -> list[list[TuningResult]]:
        some, name = item
        if name in TOGETHER:
            return tune_together(some, name, [folds(data) for data in some], settings=all_settings[name], shared=shared, **options)
        return [tune(data, name, folds(data), settings=all_settings[name], **options) for data in some]

    session = tasks[0].rows.df.sparkSession
    shared = SharedParts(tasks, folds)
    try:
        found = side_by_side(session, one, work, len(work))
    finally:
        shared.delete()
    order = {data.task.name: k for k, data in enumerate(tasks)}
    made = [
        (data.task.name, name, results)
        for (some, name), each in zip(work, found, strict=True) for data, results in zip(some, each, strict=True)
    ]
    made.sort(key=lambda x: (order[x[0]], names.index(x[1])))
    return [(task, results) for task, _, results in made]


def tuning_table(spark: SparkSession, task: str, results: Iterable[TuningResult]) -> DataFrame:
    """Tuning results, one row per parameter set."""
    rows = [
        (task, r.model_name, {k: str(v) for k, v in r.parameters.items()}, len(r.fold_scores), r.mean_score, i + 1)
        for i, r in enumerate(r for r in results if r.error is None)
    ]
    schema = "task string, model string, parameters map<string,string>, folds int, mean_score double, rank int"
    return spark.createDataFrame(rows, schema)


def train_candidates(
    data: TaskData,
    *,
    ts: str = "Timestamp",
    settings: dict[str, dict] | None = None,
    folds: Sequence[prep.Fold] | None = None,
    spaces: dict[str, dict[str, Sequence]] | None = None,
    parallelism: int = 4,
    search: dict[str, object] | None = None,
    all_may_fail: bool = False,
) -> list[TrainedCandidate]:
    """Fit every enabled model of a task on its training rows and predict its test rows.

    With ``folds`` the parameters are tuned first; ``search`` has further arguments of ``tune``, such
    as the metric or a random search. A model that fails is kept with its error; when all fail that is an
    error unless ``all_may_fail``. Models are fitted side by side, ``parallelism`` at a time.
    """
    all_settings = settings or SETTINGS

    def train(name: str) -> TrainedCandidate:
        return _train(data, name, ts, all_settings[name], folds, _space(name, spaces), search)

    candidates = side_by_side(data.rows.df.sparkSession, train, candidate_models(all_settings), parallelism)
    if not all_may_fail:
        _any_fitted(data.task.name, candidates)
    return candidates


def _any_fitted(task: str, candidates: Sequence[TrainedCandidate]) -> None:
    if all(c.error for c in candidates):
        raise RuntimeError(f"{task}: every model failed, first {candidates[0].error}")


def _space(name: str, spaces: dict[str, dict[str, Sequence]] | None) -> dict[str, Sequence]:
    """A model that the spaces do not name is not tuned."""
    return (SEARCH_SPACES if spaces is None else spaces).get(name, {})


def _train(
    data: TaskData, name: str, ts: str, settings: dict, folds: Sequence[prep.Fold] | None, space: dict[str, Sequence],
    search: dict[str, object] | None,
) -> TrainedCandidate:
    candidate = TrainedCandidate(data.task.name, name)
    try:
        if folds:
            tuned = tune(data, name, folds, space=space, settings=settings, **(search or {})) if space else []
            candidate.parameters = tuned[0].parameters if tuned else {}
        started = time.perf_counter()
        (candidate.model,) = fit_models([data], name, settings, [candidate.parameters])
        candidate.training_time = time.perf_counter() - started
        _predict(candidate, data, ts)
    except Exception as error:
        candidate.error = f"{type(error).__name__}: {error}"
    return candidate


def _predict(candidate: TrainedCandidate, data: TaskData, ts: str) -> None:
    path = shared_path(data.rows.df.sparkSession, "predictions")
    started = time.perf_counter()
    score(candidate.model, data.test, data.task.name, candidate.model_name, ts, data.rows.series).write.parquet(path)
    candidate.prediction_time = time.perf_counter() - started
    candidate.predictions_path = path


def _train_together(
    tasks: Sequence[TaskData], name: str, ts: str, settings: dict, folds: Callable[[TaskData], Sequence[prep.Fold]] | None,
    space: dict[str, Sequence], search: dict[str, object] | None, shared: SharedParts,
) -> list[TrainedCandidate]:
    """The trees, forests or boosted models of all tasks, grown together; a task's training time is its share."""
    candidates = [TrainedCandidate(data.task.name, name) for data in tasks]
    try:
        if folds and space:
            options = {"space": space, "settings": settings, "shared": shared, **(search or {})}
            found = tune_together(tasks, name, [folds(data) for data in tasks], **options)
            for candidate, tuned in zip(candidates, found, strict=True):
                candidate.parameters = tuned[0].parameters
        started = time.perf_counter()
        models = fit_models(tasks, name, settings, [c.parameters for c in candidates], shared)
        seconds = time.perf_counter() - started
        for candidate, data, model in zip(candidates, tasks, models, strict=True):
            candidate.model, candidate.training_time = model, seconds / len(tasks)
            _predict(candidate, data, ts)
        return candidates
    except Exception:  # one by one, so that each task has its own model or error
        return [_train(data, name, ts, settings, folds(data) if folds else None, space, search) for data in tasks]


def train_all(
    tasks: Sequence[TaskData], folds: Callable[[TaskData], Sequence[prep.Fold]] | None = None, *, ts: str = "Timestamp",
    settings: dict[str, dict] | None = None, spaces: dict[str, dict[str, Sequence]] | None = None,
    search: dict[str, object] | None = None, **options: object,
) -> list[TrainedCandidate]:
    """``train_candidates`` for every task, side by side; with ``folds`` each is tuned first.

    Trees, forests and boosted models of all tasks grow together, from the same blocks of rows.
    """
    session = tasks[0].rows.df.sparkSession
    all_settings = settings or SETTINGS
    names = candidate_models(all_settings)
    others = {n: all_settings[n] for n in names if n not in TOGETHER}

    def one(work: TaskData | str) -> list[TrainedCandidate]:
        if isinstance(work, str):
            return _train_together(tasks, work, ts, all_settings[work], folds, _space(work, spaces), search, shared)
        own = folds(work) if folds else None
        return train_candidates(work, folds=own, ts=ts, settings=others, spaces=spaces, search=search, all_may_fail=True, **options)

    work = [n for n in TOGETHER if n in names] + (list(tasks) if others else [])
    shared = SharedParts(tasks, folds)
    try:
        found = side_by_side(session, one, work, len(work))
    finally:
        shared.delete()
    order = {data.task.name: k for k, data in enumerate(tasks)}
    made = sorted((c for each in found for c in each), key=lambda c: (order[c.task], names.index(c.model_name)))
    for data in tasks:
        _any_fitted(data.task.name, [c for c in made if c.task == data.task.name])
    return made


def predictions_of(spark: SparkSession, candidates: Sequence[TrainedCandidate]) -> DataFrame:
    """Long predictions of all candidates that have some."""
    return spark.read.parquet(*[c.predictions_path for c in candidates if c.predictions_path])


def candidate_metrics(spark: SparkSession, candidates: Sequence[TrainedCandidate]) -> DataFrame:
    """Metrics of all fitted candidates in one aggregation, with their times."""
    times = spark.createDataFrame(
        [(c.task, c.model_name, c.training_time, c.prediction_time) for c in candidates if not c.error],
        "Task string, Model string, training_time double, prediction_time double",
    )
    metrics = regression_metrics(predictions_of(spark, candidates)).join(times, ["Task", "Model"])
    return metrics.select(
        F.col("Task").alias("task_name"),
        F.col("Model").alias("model_name"),
        "rmse",
        "mae",
        "r2",
        "training_time",
        "prediction_time",
        F.lit(None).cast("double").alias("memory_usage_mb"),
        F.lit(None).cast("double").alias("cpu_usage_pct"),
        "num_rows",
    )


def failed_candidates(spark: SparkSession, candidates: Sequence[TrainedCandidate]) -> DataFrame:
    """Candidates that could not be fitted."""
    rows = [(c.task, c.model_name, c.error) for c in candidates if c.error]
    return spark.createDataFrame(rows, "task_name string, model_name string, error string")


def feature_importance(
    spark: SparkSession, candidates: Sequence[TrainedCandidate], tasks: dict[str, prep.Task]
) -> DataFrame:
    """Importances of the tree models, largest first; other models have none."""
    rows = []
    for c in candidates:
        if c.model is None or not hasattr(c.model, "featureImportances"):
            continue
        weights = zip(tasks[c.task].features, c.model.featureImportances.toArray().tolist())
        ordered = sorted(weights, key=lambda pair: (-pair[1], pair[0]))
        rows += [(c.task, c.model_name, name, weight, i + 1) for i, (name, weight) in enumerate(ordered)]
    return spark.createDataFrame(rows, "task string, model string, feature string, importance double, rank int")


def save_model(model: PipelineModel, path: str, *, overwrite: bool = True) -> str:
    """Write a fitted pipeline."""
    writer = model.write().overwrite() if overwrite else model.write()
    writer.save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


MODEL_RECORD = (
    "version string, task string, model string, is_selected boolean, target string, features array<string>,"
    " parameters map<string,string>, training_time double, path string"
)


def save_models(
    spark: SparkSession, candidates: Sequence[TrainedCandidate], tasks: dict[str, prep.Task], base: str, version: str,
    selected: dict[str, str], *, overwrite: bool = False,
) -> DataFrame:
    """Keep every fitted candidate with its assembler, and a table of what they are.

    Models lie in ``<base>/<version>/<task>/<model>``; ``selected`` names the winner of each
    task. A version that is there is an error unless ``overwrite``.
    """
    records = []
    for c in candidates:
        if c.model is None:
            continue
        task = tasks[c.task]
        path = save_model(PipelineModel([assembler(task.features), c.model]), f"{base}/{version}/{c.task}/{c.model_name}", overwrite=overwrite)
        parameters = {k: str(v) for k, v in c.parameters.items()}
        records.append((
            version, c.task, c.model_name, selected.get(c.task) == c.model_name, task.target, list(task.features),
            parameters, c.training_time, path,
        ))
    table = spark.createDataFrame(records, MODEL_RECORD)
    table.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{base}/{version}/records")
    return table


def model_records(spark: SparkSession, base: str, version: str) -> DataFrame:
    """The table of the models of a version."""
    return spark.read.parquet(f"{base}/{version}/records")


def load_selected(spark: SparkSession, base: str, version: str, task: str) -> PipelineModel:
    """The winner of a task; none is an error."""
    found = model_records(spark, base, version).where((F.col("task") == task) & F.col("is_selected")).first()
    if found is None:
        raise ValueError(f"no selected model of {task} in version {version}")
    return load_model(found["path"])


def forecast_tail(
    ordered: OrderedRows,
    *,
    ts: str = "Timestamp",
    column: str = LAGGED_COLUMN,
    holdout_rows: int = prep.HOLDOUT_ROWS,
    day_rows: int = DAY_ROWS,
    smoothing_rows: int = SMOOTHING_ROWS,
    forest: dict | None = None,
) -> DataFrame:
    """Forecast the last rows from hour, weekday (Monday = 0) and the value a day before.

    Actual and predicted values are also returned smoothed over ``smoothing_rows`` rows.
    """
    lag = f"{column}_Lag_{day_rows}"
    # the first day has no value a day before and is left out
    lagged = add_day_lag(ordered, column, day_rows).df.where(F.col(lag).isNotNull() & F.col(column).isNotNull())
    dated = lagged.select(
        RN, *ordered.series, ts, F.hour(ts).alias("Hour"), F.weekday(ts).alias("DayOfWeek"), lag, F.col(column).alias(LABEL)
    )
    rows = ordered.with_df(stage(dated, "forecast"))
    train, test = prep.tail_holdout(rows, holdout_rows)
    model, _ = fit_pipeline(fitting(train, ordered.total), ["Hour", "DayOfWeek", lag], estimator("random_forest", forest or FORECAST_FOREST))
    predicted = model.transform(test).select(RN, *ordered.series, ts, F.col(LABEL).alias("Actual"), F.col("prediction").alias("Predicted"))
    return add_smoothed(rows.with_df(predicted), ["Actual", "Predicted"], smoothing_rows).df.drop(RN)


def forecast_by_series(
    ordered: OrderedRows, column: str, *, horizon: int, lags: int = 1, reg_param: float = 0.0
) -> DataFrame:
    """Forecast ``horizon`` steps beyond the last reading of every series from its own predictions.

    Each series has a regression of its value on the ``lags`` values before it, fitted from
    sums over its rows. A step's prediction is a value of the next step. Returned are the
    series, ``step`` (from 1) and ``prediction``. A series with fewer than ``lags`` + 1 readings, or
    without a value among the last ``lags``, has no forecast.
    """
    names = [f"{column}_Lag_{k}" for k in range(1, lags + 1)]
    lagged = add_lags(ordered, column, list(range(1, lags + 1)))
    # read for the sums and for the last values
    placed = prep.series_rows(ordered.with_df(stage(lagged.df.select(RN, *ordered.series, column, *names), "lagged"))).df
    series = list(ordered.series) or ["__all"]
    if not ordered.series:
        placed = placed.withColumn("__all", F.lit(0))

    def all_known(columns: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])

    vectors = assembler(names).transform(placed.where(all_known([column, *names]))).select(*series, FEATURES, F.col(column).alias(LABEL))
    fits = gram.fit_by_series(vectors, series, reg_param=reg_param)
    # the latest value first
    newest = [column, *names][:lags]
    last = placed.where((F.col(prep.ROW) == F.col(prep.ROWS) - 1) & all_known(newest))
    started = last.select(*series, F.array(*[F.col(c).cast("double") for c in newest]).alias("state"))
    step = f"""aggregate(sequence(1, {int(horizon)}), named_struct('held', state, 'made', cast(array() as array<double>)), (s, i) ->
        transform(array(intercept + aggregate(zip_with(s.held, coefficients, (x, w) -> x * w), 0.0D, (t, v) -> t + v)),
            y -> named_struct('held', slice(concat(array(y), s.held), 1, {int(lags)}), 'made', concat(s.made, array(y))))[0]).made"""
    made = started.join(fits, series).select(*series, F.posexplode(F.expr(step)).alias("step", "prediction"))
    return made.select(*ordered.series, (F.col("step") + 1).alias("step"), "prediction")
