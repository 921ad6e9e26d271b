"""Probes against Newton's method in numpy, and odd vectors."""

import numpy as np
import pytest
from ledgerlens.operators import probes
from pyspark.sql import functions as F

SCHEMA = "vector array<double>, exposure_label int, docid int"


def newton(x, y, c):
    """Weights and intercept of the summed logistic loss with penalty |w|^2 / (2 c), on standardised x."""
    deviation = x.std(0)
    z = np.c_[(x - x.mean(0)) / np.where(deviation == 0, 1, deviation), np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.diag([1 / c] * x.shape[1] + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return w[:-1], w[-1]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 240)
    x = np.c_[rng.normal(y[:, None] * [0.8, -0.5, 0.0], [1, 3, 0.2]), np.full(240, 2.5)]
    return x, y


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_fit_equals_newton(spark, sample, c):
    x, y = sample
    odd = [(None, 1, 0), ([1.0, 2.0, float("nan"), 0.0], 1, 0), ([1.0, None, 2.0, 0.0], 0, 0), ([1.0], 1, 0), ([9.0, 9.0, 9.0, 9.0], None, 0)]
    rows = spark.createDataFrame([(v.tolist(), int(k), i % 12) for i, (v, k) in enumerate(zip(x, y))] + odd, SCHEMA).repartition(3)
    probe = probes.fit(rows, c)
    weights, intercept = newton(x, y, c)
    assert np.allclose(probe.weights[:3], weights[:3], atol=2e-4) and probe.weights[3] == 0 and probe.intercept == pytest.approx(intercept, abs=2e-4)
    assert np.allclose(probe.mean, x.mean(0)) and np.allclose(probe.scale, x.std(0), atol=1e-7)
    got = probes.scored(rows, probe).select("score", probes.alarm(F.col("score"), 0.5).alias("alarm")).collect()
    assert sum(r.score is None for r in got) == 4 and not any(r.alarm for r in got if r.score is None)


def test_separable_rows_are_ranked(spark):
    rows = spark.createDataFrame([([float(i), 1.0], int(i >= 20), i % 7) for i in range(40)], SCHEMA)
    assert probes.ranking(probes.scored(rows, probes.fit(rows, 1.0))) == (1.0, pytest.approx(1.0))
    found = probes.cross_validated(rows, "docid", 2, [0.1, 1.0])
    assert found.count() == 4 and probes.best_c(found).first().c in (0.1, 1.0)


def test_one_class_cannot_be_trained(spark):
    with pytest.raises(ValueError):
        probes.fit(spark.createDataFrame([([1.0], 1, 0)], SCHEMA), 1.0)
    with pytest.raises(ValueError):
        probes.fit(spark.createDataFrame([], SCHEMA), 1.0)


def test_selection_rule():
    r = lambda status, specificity, ap, c, layer: {"status": status, "specificity": specificity, "ap": ap, "c": c, "layer": layer}
    assert probes.select([r("selected", 0.8, 0.9, 1.0, 0), r("selected", 0.9, 0.5, 1.0, 1), r("insufficient", None, 0.99, 1.0, 2)])["layer"] == 1
    assert probes.select([r("selected", 0.8, 0.9, 1.0, 0), r("selected", 0.8, 0.9, 0.1, 1), r("selected", 0.8, 0.9, 0.1, 0)]) == r("selected", 0.8, 0.9, 0.1, 0)
    assert probes.select([r("insufficient", None, 0.7, 1.0, 0), r("insufficient", None, 0.8, 1.0, 1), r("insufficient", None, None, 1.0, 2)])["layer"] == 1


def test_distances_and_duplicates(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    got = rows.select(*(c.alias(n) for n, c in probes.distances(F.col("a"), F.col("b")).items())).collect()
    assert tuple(got[0]) == (5.0, 5.0, 1.0, 0.0, 0.0, 0.0) and got[1].cosine == 0 and got[1].unit_distance == pytest.approx(2**0.5)
    assert got[2].cosine is None and got[2].distance == pytest.approx(2**0.5) and got[3].norm_a is None
    same = spark.createDataFrame([([0.00001, -0.00001],), ([0.0, 0.0],), ([0.1, 0.2],), (None,)], "vector array<double>")
    assert tuple(probes.duplicate_vectors(same).first()) == (3, 2, 1) and tuple(probes.duplicate_vectors(same.limit(0)).first()) == (0, 0, 0)
