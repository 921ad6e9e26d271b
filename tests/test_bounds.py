"""Exact bounds against binomial sums, and denominators against counting."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from ledgerlens.operators import bounds
from pyspark.sql import functions as F


def tail(k, n, p):
    """P(at most k of n), exactly."""
    p = Fraction(p)
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("n", [1, 2, 7, 50, 200])
def test_bounds_give_the_tails_back(spark, n):
    rows = spark.createDataFrame([(k, n) for k in range(n + 1)], "k long, n long")
    low, high = bounds.interval(F.col("k"), F.col("n"))
    for r in rows.select("k", low.alias("low"), high.alias("high"), bounds.upper_bound(F.col("k"), F.col("n")).alias("upper")).collect():
        assert r.low == 0 if r.k == 0 else abs(1 - tail(r.k - 1, n, r.low) - 0.025) < 1e-9
        assert r.high == 1 if r.k == n else abs(tail(r.k, n, r.high) - 0.025) < 1e-9
        assert r.upper == 1 if r.k == n else abs(tail(r.k, n, r.upper) - 0.05) < 1e-9
        assert r.low <= r.k / n <= r.upper <= r.high


def test_known_values_and_odd_counts(spark):
    rows = spark.createDataFrame([(0, 50), (3, 3), (0, 0), (4, 3), (-1, 3), (None, 3), (1, None)], "k long, n long")
    got = [r[0] for r in rows.select(F.round(bounds.upper_bound(F.col("k"), F.col("n")), 6)).collect()]
    assert got == [0.058155, 1.0, None, None, None, None, None]
    assert [r[0] for r in rows.select(bounds.interval(F.col("k"), F.col("n"))[0]).collect()][:3] == [0.0, pytest.approx(0.2924, abs=1e-4), None]


def test_large_counts():
    k, n = np.array([10.0, 5e5, 999_999.0]), np.array([1e6, 1e6, 1e6])
    high = bounds.beta_quantile(0.975, k + 1, n - k)
    assert np.allclose(bounds.incomplete_beta(high, k + 1, n - k), 0.975) and (high > k / n).all()
    assert high[0] == pytest.approx(1.8390e-5, rel=1e-3) and high[1] == pytest.approx(0.50098, abs=1e-5)


def test_denominators(spark):
    schema = "document_group_id string, attacked boolean, category string, is_invoice boolean, expected string"
    rows = [("a", True, "resolvable_conflict", True, None), ("a", True, "resolvable_conflict", False, None), ("b", True, None, None, None), (None, True, "conflict_requiring_review", True, None), ("c", False, None, True, "safe_canonical_payment"), ("d", None, None, None, None)]
    got = {r.claim: (r.n_workflows, r.n_documents, r.workflow_upper) for r in bounds.denominators(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 11 and got["all_attacked"][:2] == (4, 2) and got["attacked_on_non_invoice_document"][:2] == (1, 1)
    assert got["attack_causal_on_invoice_documents_only"][:2] == (2, 1) and got["attacked_blocked_by_missing_invoice_fields"] == (0, 0, None)
    assert got["all_clean"] == (1, 1, 0.95) and got["clean_expecting_canonical_payment_on_invoice_documents"][0] == 1


def test_failure_table_of_few_rows(spark):
    got = bounds.failure_table(spark.range(2)).orderBy("failures").collect()
    assert [(r.failures, r.n, r.low, r.upper) for r in got] == [(0, 2, 0.0, 0.77639), (1, 2, 0.01258, 0.97468), (2, 2, 0.15811, 1.0)]
    assert [(r.failures, r.n, r.rate) for r in bounds.failure_table(spark.range(0)).collect()] == [(0, 0, None)]
