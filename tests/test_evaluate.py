import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.functions import stats
from loadlens.functions.formatting import number_text, scientific_text
from loadlens.operators import chartdata as ch
from loadlens.operators import evaluate as ev


def predictions(spark, actual, **models):
    rows = [(t, "task", m, a, p) for m, ps in models.items() for t, (a, p) in enumerate(zip(actual, ps))]
    return spark.createDataFrame(rows, "Timestamp long, Task string, Model string, Actual double, Predicted double")


def test_metrics(spark):
    row = ev.regression_metrics(predictions(spark, [1.0, 2.0, 4.0], m=[1.0, 3.0, 2.0])).first()
    assert row["rmse"] == pytest.approx(math.sqrt(5 / 3)) and row["mae"] == 1.0
    assert row["r2"] == pytest.approx(1 - 5 / (3 * np.var([1, 2, 4])))
    assert row["mape"] == pytest.approx((0 + 0.5 + 0.5) / 3) and row["mape_is_reliable"]


def test_constant_target_has_no_r2(spark):
    assert ev.regression_metrics(predictions(spark, [2.0, 2.0], m=[1.0, 2.0])).first()["r2"] is None


def test_mape_with_six_percent_zeros_is_unreliable(spark):
    actual = [0.0] * 6 + [1.0] * 94
    row = ev.regression_metrics(predictions(spark, actual, m=[1.0] * 100)).first()
    assert not row["mape_is_reliable"] and row["mape"] == pytest.approx(0.06 / 1e-6)


def test_absent_predictor_counts_as_zero_rows(spark):
    metrics = ev.regression_metrics(predictions(spark, [1.0], m=[1.0]))
    expected = spark.createDataFrame([("task", "m"), ("task", "n")], "Task string, Model string")
    row = ev.with_expected(metrics, expected).where("Model = 'n'").first()
    assert (row["rmse"], row["num_rows"], row["mape_is_reliable"]) == (0.0, 0, False)


def noisy(seed, rows, spread):
    rng = random.Random(seed)
    return [rng.gauss(0, spread) for _ in range(rows)]


def test_few_pairs_are_not_tested(spark):
    zeros = [0.0] * 29
    row = ev.compare_predictors(predictions(spark, zeros, a=noisy(1, 29, 1), b=noisy(2, 29, 9)), "a").first()
    assert (row["p_value"], row["is_significant"], row["correction_method"]) == (1.0, False, "none")
    assert row["notes"] == "not tested: 29 pairs, 30 are needed" and row["ci_lower"] is None


@pytest.mark.parametrize("test", ["wilcoxon", "paired_t"])
def test_identical_errors(spark, test):
    made = predictions(spark, [0.0] * 40, a=[1.0] * 40, b=[1.0] * 40)
    row = ev.compare_predictors(made, "a", test=test).first()
    assert (row["ci_lower"], row["ci_upper"], row["is_significant"]) == (0.0, 0.0, False)


def brute_wilcoxon(d):
    sizes = sorted(abs(x) for x in d)
    rank = {s: np.mean([i + 1 for i, x in enumerate(sizes) if x == s]) for s in set(sizes)}
    zeros = sum(rank[0.0] / 2 for x in d if x == 0)
    plus = sum(rank[abs(x)] for x in d if x > 0) + zeros
    minus = sum(rank[abs(x)] for x in d if x < 0) + zeros
    return plus, minus


def test_wilcoxon_with_ties_and_zeros(spark, small_chunks):
    rng = random.Random(3)
    a, b = ([float(rng.randrange(6)) for _ in range(200)] for _ in range(2))
    made = predictions(spark, [0.0] * 200, a=a, b=b)
    row = ev.wilcoxon(ev.paired_errors(made, "a")).first()
    plus, minus = brute_wilcoxon([x - y for x, y in zip(a, b)])
    assert (row["r_plus"], row["r_minus"]) == (plus, minus)
    assert row["sample_size"] == 200 and row["has_zeros"]


def test_comparisons_per_task_share_alpha(spark):
    zeros = [0.0] * 60
    made = predictions(spark, zeros, a=noisy(1, 60, 1), b=noisy(2, 60, 1), c=noisy(3, 60, 5))
    rows = {r["candidate_model"]: r for r in ev.compare_predictors(made, "a").collect()}
    assert {r["alpha"] for r in rows.values()} == {0.025}
    assert rows["c"]["is_significant"] and not rows["b"]["is_significant"]
    assert rows["c"]["ci_lower"] < rows["c"]["ci_upper"]
    plain = ev.compare_predictors(made, "a", correction="none").first()
    assert (plain["alpha"], plain["correction_method"]) == (0.05, "none")


def test_normal_tail():
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-15)


@pytest.mark.parametrize("df", [1, 2, 5, 29, 1000])
@pytest.mark.parametrize("t", [0.1, 1.0, 2.5, 6.0])
def test_t_tail_by_integration(df, t):
    # substitute x = sqrt(df) * tan(u): the tail becomes an integral of cos^(df-1)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    u = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 200_001)
    y = np.cos(u) ** (df - 1)
    step = u[1] - u[0]
    area = step / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    assert stats.t_two_sided(t, df) == pytest.approx(2 * scale * area, rel=1e-9)


def test_t_quantile_inverts_the_tail():
    assert stats.t_quantile(0.025, 1) == pytest.approx(12.706204736, rel=1e-9)  # tan(0.475 * pi)
    for df in (3, 40, 5000):
        assert stats.t_two_sided(stats.t_quantile(0.0125, df), df) == pytest.approx(0.025, rel=1e-10)


def test_exact_rank_sums_by_enumeration():
    n, statistic = 8, 5
    sums = [sum(r for r in range(1, n + 1) if mask >> (r - 1) & 1) for mask in range(2**n)]
    want = min(1.0, 2 * sum(s <= statistic for s in sums) / 2**n)
    assert stats.rank_sum_two_sided(statistic, n) == pytest.approx(want)


def test_small_sample_uses_the_exact_distribution(spark):
    rng = random.Random(8)
    a = [rng.uniform(0, 3) for _ in range(35)]
    b = [rng.uniform(0, 2) for _ in range(35)]
    made = predictions(spark, [0.0] * 35, a=a, b=b)
    row = ev.compare_predictors(made, "a", method="exact").first()
    assert row["p_value"] == pytest.approx(stats.rank_sum_two_sided(row["statistic"], 35))
    assert ev.compare_predictors(made, "a").first()["p_value"] != row["p_value"]
    few = ev.compare_predictors(made, "a", min_pairs=36).first()
    assert few["p_value"] == 1.0 and few["notes"] == "not tested: 35 pairs, 36 are needed"
    with pytest.raises(ValueError, match="at most"):
        stats.rank_sum_two_sided(5, stats.EXACT_RANK_ROWS + 1)


@pytest.mark.parametrize("t", [1e-3, 0.5, 1.5, 3.0, 8.0])
def test_t_tail_of_large_samples(t):
    for df in (1e10, 1e11, 1e12, 1e13):
        # the first correction to the normal limit is of order t^4 / df
        assert stats.t_two_sided(t, df) == pytest.approx(stats.normal_two_sided(t), rel=max(1e-9, t**4 / df))
    for df in (1_000, 5_000):
        want = stats.incomplete_beta(df / 2, 0.5, df / (df + t * t))
        assert stats._t_tails(t, df) == pytest.approx(want, rel=1e-9)
    if t <= 3:
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        first = stats.normal_two_sided(t) + 2 * density * (t**3 + t) / 4e6
        assert stats.t_two_sided(t, 1e6) == pytest.approx(first, rel=1e-9)
    assert stats.t_quantile(0.0125, 1e13) == pytest.approx(2.241402727604947, rel=1e-9)


def test_beta_function_without_convergence_raises():
    with pytest.raises(ArithmeticError):
        stats._beta_fraction(1e15, 1e15, 0.5)


def test_rows_without_prediction_do_not_count(spark):
    row = ev.regression_metrics(predictions(spark, [1.0, 2.0, 9.0], m=[1.0, 2.0, None])).first()
    assert (row["r2"], row["num_rows"], row["rmse"]) == (1.0, 2, 0.0)
    empty = ev.regression_metrics(predictions(spark, [1.0], m=[1.0]).where("false"), []).first()
    assert empty["num_rows"] == 0 and empty["rmse"] is None


def test_sampled_pairs_are_whole_rows(spark):
    made = ev.paired_errors(predictions(spark, [0.0] * 400, a=[1.0] * 400, b=[2.0] * 400, c=[3.0] * 400), "a")
    kept = ev.sample_pairs(made, 0.5)
    assert 500 > kept.count() > 300 and set(r["count"] for r in kept.groupBy("Timestamp").count().collect()) == {2}
    assert ev.sample_pairs(made, 1).count() == 800 and ev.sample_pairs(made, 0).count() == 0


def test_histogram_matches_numpy(spark):
    x = noisy(4, 500, 2.0)
    rows = ch.residual_histogram(predictions(spark, x, m=[0.0] * 500)).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=60)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["left_edge"] for r in rows] == pytest.approx(edges[:-1].tolist())
    flat = ch.residual_histogram(predictions(spark, [1.0] * 5, m=[0.0] * 5)).where("count > 0").first()
    assert flat["count"] == 5 and flat["bin"] == 30


def test_kde_matches_brute_force(spark):
    x = np.array(noisy(5, 300, 3.0))
    rows = ch.residual_kde(predictions(spark, x.tolist(), m=[0.0] * 300)).orderBy("point").collect()
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(x.min(), x.max(), 300)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["density"] for r in rows] == pytest.approx(want.tolist(), rel=1e-12)


@pytest.mark.parametrize("n", [10, 50, 51, 137, 1000])
def test_display_sample_matches_linspace(spark, n):
    made = predictions(spark, [float(i) for i in range(n)], m=[0.0] * n)
    steps = ch.residual_series(made)
    got = sorted(r["step"] for r in ch.display_sample(steps, points=50).collect())
    want = np.round(np.linspace(0, n - 1, 50)).astype(int).tolist() if n > 50 else list(range(n))
    assert got == want


def test_number_text(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.71828,)], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == ["1.0000", "N/A", "N/A", "2.7183"]


def test_scientific_text_of_the_smallest_numbers(spark):
    given = [49 * 5e-324, 10057 * 5e-324, 1.0, 0.0, float("nan"), None]
    df = spark.createDataFrame([(x,) for x in given], "x double").coalesce(1)
    found = [r[0] for r in df.select(scientific_text(F.col("x"))).collect()]
    assert found == ["2.4209e-322", "4.9688e-320", "1.0000e+00", "0.0000e+00", "N/A", "N/A"]
