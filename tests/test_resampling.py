"""Bootstrap and permutation null against plain loops over the same hashes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from ledgerlens.operators import resampling

SCHEMA = "sample_id long, docid string, score double, exposure_label int"


def drawn(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def auroc(pos, neg):
    return np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])


def precision(rows):
    """Average precision of (score, label, weight)."""
    p, total = sum(w for _, y, w in rows if y), 0.0
    for t in {s for s, *_ in rows}:
        above = [(y, w) for s, y, w in rows if s >= t]
        tp = sum(w for y, w in above if y)
        total += sum(w for s, y, w in rows if s == t and y) / p * tp / sum(w for _, w in above)
    return total


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(i, f"d{rng.randint(0, 7)}", round(rng.random(), 1), rng.randint(0, 1)) for i in range(50)] + [(90, "d1", None, 1), (91, "gone", float("nan"), 1), (92, "gone", 0.5, None)]


def test_bootstrap_equals_loops(spark, rows):
    got = {r.b: r for r in resampling.resampled(spark.createDataFrame(rows, SCHEMA).repartition(5), 0.5, resamples=20, seed=3).collect()}
    used = [r for r in rows if r[2] is not None and r[2] == r[2] and r[3] is not None]
    documents = sorted({r[1] for r in used}, key=lambda d: (drawn(3, d), d))
    assert sorted(got) == list(range(20))
    for b, r in got.items():
        times = Counter(documents[drawn(3, b, j) % len(documents)] for j in range(len(documents)))
        assert sum(times.values()) == len(documents)
        sample = [(s, y) for _, d, s, y in used for _ in range(times[d])]
        pos, neg = [s for s, y in sample if y], [s for s, y in sample if not y]
        assert r.auroc == pytest.approx(auroc(pos, neg)) and r.ap == pytest.approx(precision([(s, y, 1) for s, y in sample]))
        assert r.recall == pytest.approx(np.mean([s >= 0.5 for s in pos])) and r.fpr == pytest.approx(np.mean([s >= 0.5 for s in neg]))


def test_percentiles_interpolate_and_skip_missing(spark):
    values = [(float(x), None) for x in range(11)] + [(None, None)]
    got = {r.metric: (r.n, r.p2_5, r.median, r.p97_5) for r in resampling.percentiles(spark.createDataFrame(values, "auroc double, ap double"), ["auroc", "ap"]).collect()}
    assert got == {"auroc": (11, 0.25, 5.0, 9.75), "ap": (0, None, None, None)}


def test_one_class_and_no_rows(spark, rows):
    one = resampling.resampled(spark.createDataFrame([(1, "a", 0.2, 1), (2, None, 0.9, 1)], SCHEMA), 0.5, resamples=5).collect()
    assert len(one) == 5 and all(r.auroc is None and r.ap is None and r.fpr is None and r.recall is not None for r in one)
    assert resampling.resampled(spark.createDataFrame([], SCHEMA), 0.5, resamples=5).count() == 0


def test_permutations_equal_loops(spark, rows):
    got = {r.b: r.ap for r in resampling.permuted_precision(spark.createDataFrame(rows, SCHEMA), 12, seed=4).collect()}
    used = [r for r in rows if r[2] is not None and r[2] == r[2] and r[3] is not None]
    positives = sum(r[3] for r in used)
    for b in range(12):
        order = sorted(used, key=lambda r: (drawn(4, b, r[0]), r[0]))
        assert got[b] == pytest.approx(precision([(r[2], i < positives, 1) for i, r in enumerate(order)]))
    assert len({round(x, 9) for x in got.values()}) > 1


def test_p_value_counts_the_observed_order(spark):
    perfect = [(i, "d", i / 40, int(i >= 20)) for i in range(40)]
    r = resampling.permutation_test(spark.createDataFrame(perfect, SCHEMA), 19).collect()[0]
    assert (r.observed, r.n, r.p_value) == (pytest.approx(1.0), 19, 0.05) and r.null_max < 1


def test_numbers_are_dense_within_groups(spark):
    rows = [(g, i) for g in range(3) for i in range(100 * (g + 1))]
    numbers = defaultdict(list)
    from pyspark.sql import functions as F

    for r in resampling.numbered(spark.createDataFrame(rows, "g int, i int").repartition(4), resampling.drawn(F.col("i") % 60), "g").collect():
        numbers[r.g].append(r.number)
    assert all(sorted(n) == list(range(100 * (g + 1))) for g, n in numbers.items())
