"""Linear probes over vectors: scores, training with grouped selection, and checks of the vectors.

A probe standardises a vector by the training rows' mean and population deviation, and scores it by a logistic function of a
weighted sum. Training is Spark's logistic regression. Its penalty is set so that the weights are those of a loss summed
over the rows with penalty |w|^2 / (2 C) on vectors standardised with n in the denominator: Spark averages the loss and
standardises with n - 1, so the penalty is (n - 1) / (n^2 C).

Selection fits every candidate on the training documents, scores the validation documents, and prefers those whose
threshold meets the recall floors: greatest specificity, then average precision, then the smaller C, then the earlier part.

Defined results. A vector that is NULL, of another length or holds a NULL or non-finite component has a NULL score and no
alarm, and trains nothing. A component without variance has deviation 1. A NULL label trains nothing. Fewer than two
classes can't be trained.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.registers import group_fold
from ledgerlens.operators.thresholds import auroc, average_precision, contract_threshold, running_counts, score_counts
from ledgerlens.sources.tables import read

C_GRID = [0.01, 0.1, 1.0, 10.0]


@dataclass(frozen=True)
class Probe:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float


def usable(vector: Column, length: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == length) & ~bad, F.lit(False))


def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def logit(vector: Column, probe: Probe) -> Column:
    """Weighted sum of the standardised components; a deviation of 0 counts as 1."""
    scale = _array([s or 1.0 for s in probe.scale])
    z = F.zip_with(F.zip_with(vector.cast("array<double>"), _array(probe.mean), lambda x, m: x - m), scale, lambda x, s: x / s)
    terms = F.zip_with(z, _array(probe.weights), lambda x, w: x * w)
    return F.when(usable(vector, len(probe.mean)), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + probe.intercept)


def probability(vector: Column, probe: Probe) -> Column:
    return 1 / (1 + F.exp(-logit(vector, probe)))


def alarm(score: Column, threshold: float) -> Column:
    return F.coalesce(score >= threshold, F.lit(False))


def fit(rows: DataFrame, c: float) -> Probe:
    """rows: vector, exposure_label (0 or 1)."""
    length = rows.where("vector is not null").agg(F.max(F.size("vector"))).first()[0] or 0
    used = rows.where("exposure_label is not null").where(usable(F.col("vector"), length)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.col("exposure_label").cast("double").alias("label"))
    if used.select("label").distinct().limit(2).count() < 2:
        raise ValueError("a probe needs rows of two classes")
    stats = used.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    n, mean = stats["count"], stats["mean"].toArray()
    scale = (stats["variance"].toArray() * (n - 1) / n) ** 0.5
    model = LogisticRegression(regParam=(n - 1) / (n * n * c), elasticNetParam=0.0, standardization=True, maxIter=500, tol=1e-9).fit(used)
    raw = model.coefficients.toArray()
    return Probe(mean.tolist(), scale.tolist(), (raw * scale).tolist(), float(model.intercept + raw @ mean))


def scored(rows: DataFrame, probe: Probe) -> DataFrame:
    return rows.withColumn("score", probability(F.col("vector"), probe))


def ranking(rows: DataFrame) -> tuple[float | None, float | None]:
    """AUROC and average precision."""
    running = running_counts(score_counts(rows))
    return auroc(running).first()[0], average_precision(running).first()[0]


def candidates(rows: DataFrame, parts: list[str], grid: list[float] = C_GRID, recall_floor: float = 0.95, surface_floor: float = 0.9) -> list[dict]:
    """A result for each part of the vectors and C. rows: a column a part, partition (train or validation), exposure_label, attack_surface."""
    found = []
    for layer, part in enumerate(parts):
        train, held = (rows.where(F.col("partition") == p).withColumn("vector", F.col(part)) for p in ("train", "validation"))
        for c in grid:
            probe = fit(train, c)
            out = scored(held, probe).cache()
            area, precision = ranking(out)
            at = contract_threshold(out, recall_floor, surface_floor).first().asDict()
            found.append({"part": part, "layer": layer, "c": c, "auroc": area, "ap": precision, **at, "probe": probe})
            out.unpersist()
    return found


def select(results: list[dict]) -> dict:
    """The best candidate by the rule above."""
    met = [r for r in results if r["status"] == "selected"]
    order = lambda r: (r["specificity"] if met else 0.0, r["ap"] if r["ap"] is not None else -1.0, -r["c"], -r["layer"])
    return max(met or results, key=order)


def cross_validated(rows: DataFrame, group: str, folds: int = 5, grid: list[float] = C_GRID) -> DataFrame:
    """c, fold, auroc, ap over folds that keep groups together. rows: vector, exposure_label and the group."""
    dealt = rows.withColumn("fold", group_fold(F.col(group), folds))
    out = []
    for c in grid:
        for k in range(folds):
            held = dealt.where(F.col("fold") == k)
            area, precision = ranking(scored(held, fit(dealt.where(F.col("fold") != k), c)))
            out.append((c, k, area, precision))
    return rows.sparkSession.createDataFrame(out, "c double, fold int, auroc double, ap double")


def best_c(results: DataFrame) -> DataFrame:
    """The C of greatest mean average precision, then AUROC, then the smallest."""
    means = results.groupBy("c").agg(F.avg("ap").alias("ap"), F.avg("auroc").alias("auroc"))
    return means.orderBy(F.desc_nulls_last("ap"), F.desc_nulls_last("auroc"), "c").limit(1)


def duplicate_vectors(rows: DataFrame, digits: int = 4) -> DataFrame:
    """vectors, distinct vectors after rounding, and how many of those stand more than once. Digests are counted, not vectors."""
    rounded = F.transform(F.col("vector"), lambda x: F.round(x.cast("double"), digits) + 0.0)
    groups = rows.where("vector is not null").groupBy(F.sha2(F.to_json(F.struct(rounded.alias("v"))), 256).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.count("*").alias("distinct_vectors"), F.count_if(F.col("n") > 1).alias("repeated"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distances(a: Column, b: Column) -> dict[str, Column]:
    """norms, cosine similarity and distance, Euclidean distance, and that of the unit vectors; NULL for a vector of norm 0."""
    norm_a, norm_b, between = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b)), _dot(a, b)
    cosine = F.try_divide(between, norm_a * norm_b)
    apart = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)
    return {"norm_a": norm_a, "norm_b": norm_b, "cosine": cosine, "cosine_distance": 1 - cosine, "distance": F.sqrt(_dot(apart, apart)), "unit_distance": F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine))}


def _vectors(s, d) -> DataFrame:
    """Embeddings in two halves, exposed from label 5 on; documents by the hundred, a fifth of them for validation."""
    rows = read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), (F.col("label") >= 5).cast("int").alias("exposure_label"), (F.col("vec_id") % 50).alias("docid"), F.when(F.col("label") >= 5, F.concat(F.lit("s"), (F.col("label") % 5).cast("string"))).alias("attack_surface"))
    return rows.withColumns({"first": F.slice("vector", 1, 32), "second": F.slice("vector", 33, 32), "partition": F.when(group_fold(F.col("docid"), 5) == 0, "validation").otherwise("train")})


#: A probe of the length of the given vectors, for scoring by itself: mean, deviation (one of them 0) and weights by rule.
EXAMPLE = Probe([0.01 * (i % 5 - 2) for i in range(64)], [0.0 if i == 9 else 0.1 + 0.001 * i for i in range(64)], [0.3 * (-1) ** i for i in range(64)], 0.25)


def _rounded(**columns: Column) -> list[Column]:
    return [F.round(c, 9).alias(name) for name, c in columns.items()]


def _selected(s, d) -> DataFrame:
    results = candidates(_vectors(s, d), ["first", "second"], [0.1, 1.0])
    best = select(results)
    return s.createDataFrame([(r["part"], r["c"], r["auroc"], r["ap"], r["status"], r is best) for r in results], "part string, c double, auroc double, ap double, status string, selected boolean")


QUERIES = {
    "prj5_probe_scores": lambda s, d: _vectors(s, d).select("vec_id", *_rounded(logit=logit(F.col("vector"), EXAMPLE), probability=probability(F.col("vector"), EXAMPLE)), alarm(probability(F.col("vector"), EXAMPLE), 0.5).alias("alarm")),
    "fn42_distances": lambda s, d: _vectors(s, d).select("vec_id", *_rounded(**distances(F.col("first"), F.col("second")))),
    "agg51_duplicate_vectors": lambda s, d: duplicate_vectors(_vectors(s, d).withColumn("vector", F.slice("vector", 1, 2)), 1),
    "ml1_held_out": lambda s, d: (lambda rows: s.createDataFrame([ranking(scored(rows.where("partition = 'validation'"), fit(rows.where("partition = 'train'"), 1.0)))], "auroc double, ap double"))(_vectors(s, d)),
    "ml2_selection": _selected,
    "ml5_best_c": lambda s, d: best_c(cross_validated(_vectors(s, d), "docid", 3, [0.1, 1.0])),
}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_Z = f"list_transform(list_zip(embedding, {EXAMPLE.mean}, {[s or 1.0 for s in EXAMPLE.scale]}, {EXAMPLE.weights}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) / z[3]::DOUBLE * z[4]::DOUBLE)"
SQL = {
    "prj5_probe_scores": f"WITH s AS (SELECT vec_id, list_sum({_Z}) + 0.25::DOUBLE AS l FROM embeddings) SELECT vec_id, round(l, 9) AS logit, round(1 / (1 + exp(-l)), 9) AS probability, 1 / (1 + exp(-l)) >= 0.5 AS alarm FROM s",
    "fn42_distances": f"WITH h AS (SELECT vec_id, embedding[1:32] AS a, embedding[33:64] AS b FROM embeddings), n AS (SELECT vec_id, sqrt({_DOT.format('a', 'a')}) AS na, sqrt({_DOT.format('b', 'b')}) AS nb, {_DOT.format('a', 'b')} AS d, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS e FROM h)"
    " SELECT vec_id, round(na, 9) AS norm_a, round(nb, 9) AS norm_b, round(d / (na * nb), 9) AS cosine, round(1 - d / (na * nb), 9) AS cosine_distance, round(e, 9) AS distance, round(sqrt(greatest(0, 2 - 2 * d / (na * nb))), 9) AS unit_distance FROM n",
    "agg51_duplicate_vectors": "WITH v AS (SELECT list_transform(embedding[1:2], lambda x: round(x::DOUBLE, 1) + 0.0) AS r FROM embeddings), g AS (SELECT r, count(*) AS n FROM v GROUP BY r) SELECT CAST(sum(n) AS BIGINT) AS vectors, count(*) AS distinct_vectors, count(*) FILTER (n > 1) AS repeated FROM g",
}
