"""Bootstrap over documents and a permutation null, for ranking metrics.

Draws come from hashes, so that a seed fixes every resample, whatever the partitioning. Documents get dense numbers (by
bands of their hash, so that no task sorts them all); a resample draws as many documents as there are, with replacement,
and a document's rows count as often as it is drawn. Samples are counted by document and score first; these counts meet
the weights in one shuffle, and all resamples' metrics follow from weighted counts by score.

The permutation null deals the labels anew: in each permutation as many rows as are positive, those with the smallest
hashes, are positive.

Defined results. Rows with NULL or NaN score or NULL label take no part, documents that only such rows name neither. A NULL
document is a document of its own. A resample with one class only has no AUROC and no average precision, without positives
no recall, without negatives no false-positive rate; percentiles are taken over the others. No rows give NULL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.rates import rate
from ledgerlens.operators.thresholds import auroc, average_precision, running_counts, score_counts
from ledgerlens.sources.tables import PREDICTIONS_DUCK, predictions

RESAMPLES, PERMUTATIONS = 2000, 50
METRICS = ["auroc", "ap", "recall", "fpr"]
PERCENTILES = {"p2_5": 0.025, "median": 0.5, "p97_5": 0.975}


def drawn(*parts: Column) -> Column:
    """A number of 32 bits from the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, key: Column, by: str | None = None) -> DataFrame:
    """rows with `number`, from 0, in the order of their band (the key's first 12 bits) and key; within each value of `by`, if given. key: of 32 bits, then made unique by the other columns."""
    groups = [by] if by else []
    banded = rows.withColumn("__key", key).withColumn("__band", F.shiftright("__key", 20))
    totals = banded.groupBy(*groups, "__band").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__band", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*groups, "__band").orderBy("__key", *[c for c in rows.columns if c not in groups])
    return banded.join(offsets, [*groups, "__band"]).withColumn("number", F.row_number().over(inside) - 1 + F.col("__before")).drop("__key", "__band", "__before")


def document_weights(documents: DataFrame, resamples: int, seed: int) -> DataFrame:
    """b, number, weight: how often resample b draws each document. documents: number, dense from 0."""
    size = documents.agg(F.count("*").alias("size"))
    slots = documents.select("number", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).join(F.broadcast(size))
    return slots.groupBy("b", (drawn(F.lit(seed), F.col("b"), F.col("number")) % F.col("size")).alias("number")).agg(F.count("*").alias("weight"))


def resampled(rows: DataFrame, threshold: float, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """b, auroc, ap, recall, fpr of every resample. rows: docid, score, exposure_label."""
    counts = score_counts(rows.where("exposure_label is not null").withColumn("docid", F.coalesce(F.col("docid").cast("string"), F.lit(""))), "docid")
    documents = numbered(counts.select("docid").distinct(), drawn(F.lit(seed), F.col("docid")))
    weights = document_weights(documents, resamples, seed)
    weighted = counts.join(documents, "docid").drop("docid").join(weights, "number").groupBy("b", "score").agg(F.sum(F.col("weight") * F.col("pos")).alias("pos"), F.sum(F.col("weight") * F.col("neg")).alias("neg"))
    at = lambda c: F.sum(F.when(F.col("score") >= threshold, F.col(c)).otherwise(0))
    rates = weighted.groupBy("b").agg(rate(at("pos"), F.sum("pos")).alias("recall"), rate(at("neg"), F.sum("neg")).alias("fpr"), (F.least(F.sum("pos"), F.sum("neg")) > 0).alias("both"))
    running = running_counts(weighted, "b")
    found = rates.join(auroc(running, "b"), "b", "left").join(average_precision(running, "b"), "b", "left")
    return found.select("b", "auroc", F.when(F.col("both"), F.col("ap")).alias("ap"), "recall", "fpr")


def percentiles(resamples: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """A row a metric: the resamples that have it, 2.5th, 50th and 97.5th percentile, interpolated. One value a resample."""
    long = resamples.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("r")).select("r.metric", "r.x")
    return long.groupBy("metric").agg(F.count("x").alias("n"), *(F.percentile("x", F.lit(q)).alias(name) for name, q in PERCENTILES.items()))


def permuted_precision(rows: DataFrame, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """b, ap of every permutation of the labels. rows: sample_id, score, exposure_label."""
    used = rows.where("score is not null and not isnan(score) and exposure_label is not null").select("sample_id", "score", "exposure_label")
    positives = used.agg(F.count_if(F.col("exposure_label") == 1).alias("positives"))
    dealt = used.select("sample_id", "score", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("b"))
    ranked = numbered(dealt, drawn(F.lit(seed), F.col("b"), F.col("sample_id")), "b").join(F.broadcast(positives))
    labelled = ranked.select("b", "score", (F.col("number") < F.col("positives")).cast("int").alias("exposure_label"))
    return average_precision(running_counts(score_counts(labelled, "b"), "b"), "b")


def permutation_test(rows: DataFrame, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """observed average precision, the null's mean and largest, and the share of permutations, the observed order counted in, that reach it."""
    observed = average_precision(running_counts(score_counts(rows))).select(F.col("ap").alias("observed"))
    null = permuted_precision(rows, permutations, seed).join(F.broadcast(observed))
    least = F.col("ap") >= F.col("observed") - 1e-12
    return null.groupBy("observed").agg(F.count("*").alias("n"), F.avg("ap").alias("null_mean"), F.max("ap").alias("null_max"), ((F.count_if(least) + 1) / (F.count("*") + 1)).alias("p_value"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes))


QUERIES = {
    "agg47_document_bootstrap": lambda s, d: _rounded(percentiles(resampled(predictions(s, d), 0.6))).select("metric", "n", "p2_5", "p97_5"),
    "agg48_bootstrap_medians": lambda s, d: _rounded(percentiles(resampled(predictions(s, d), 0.6, 500, 48), ["auroc", "ap"])),
    "agg49_permutation_null": lambda s, d: _rounded(permutation_test(predictions(s, d))),
}

_MD5 = "('0x' || substr(md5({}), 1, 8))::UBIGINT"


def _bootstrap_sql(resamples: int, seed: int, metrics: list[str], columns: str) -> str:
    return f"""
WITH rows AS (SELECT CAST(docid AS VARCHAR) AS docid, score, exposure_label FROM ({PREDICTIONS_DUCK})),
docs AS (SELECT docid, row_number() OVER (ORDER BY {_MD5.format(f"'{seed}:' || docid")}, docid) - 1 AS number, count(*) OVER () AS size FROM (SELECT DISTINCT docid FROM rows)),
weights AS (SELECT b, {_MD5.format(f"'{seed}:' || b || ':' || number")} % size AS number, count(*) AS w FROM docs, range({resamples}) t(b) GROUP BY ALL),
cells AS MATERIALIZED (SELECT b, score, sum(w) FILTER (exposure_label = 1) AS pos, sum(w) FILTER (exposure_label = 0) AS neg FROM rows JOIN docs USING (docid) JOIN weights USING (number) GROUP BY ALL),
run AS (SELECT b, score, coalesce(pos, 0)::DOUBLE AS pos, coalesce(neg, 0)::DOUBLE AS neg, sum(coalesce(pos, 0)) OVER down AS tp, sum(coalesce(neg, 0)) OVER down AS fp, sum(coalesce(pos, 0)) OVER (PARTITION BY b) AS p, sum(coalesce(neg, 0)) OVER (PARTITION BY b) AS n FROM cells WINDOW down AS (PARTITION BY b ORDER BY score DESC)),
m AS (SELECT b, CASE WHEN min(p) > 0 AND min(n) > 0 THEN sum(neg * (tp - pos + pos / 2)) / min(p) / min(n) END AS auroc, CASE WHEN min(p) > 0 AND min(n) > 0 THEN sum(pos / p * tp / (tp + fp)) END AS ap,
        CASE WHEN min(p) > 0 THEN sum(pos) FILTER (score >= 0.6) / min(p) END AS recall, CASE WHEN min(n) > 0 THEN sum(neg) FILTER (score >= 0.6) / min(n) END AS fpr FROM run GROUP BY b),
long AS ({" UNION ALL ".join(f"SELECT '{x}' AS metric, {x} AS x FROM m" for x in metrics)})
SELECT metric, count(x) AS n, {columns} FROM long GROUP BY metric
"""


_QUANTILES = {name: f"round(quantile_cont(x, {q}), 6) AS {name}" for name, q in PERCENTILES.items()}
SQL = {
    "agg47_document_bootstrap": _bootstrap_sql(RESAMPLES, 0, METRICS, f"{_QUANTILES['p2_5']}, {_QUANTILES['p97_5']}"),
    "agg48_bootstrap_medians": _bootstrap_sql(500, 48, ["auroc", "ap"], ", ".join(_QUANTILES.values())),
    "agg49_permutation_null": f"""
WITH rows AS (SELECT sample_id, score, exposure_label AS y FROM ({PREDICTIONS_DUCK})),
dealt AS (SELECT -1 AS b, score, y FROM rows UNION ALL SELECT b, score, CAST(row_number() OVER (PARTITION BY b ORDER BY {_MD5.format("'0:' || b || ':' || sample_id")}, sample_id) <= (SELECT sum(y) FROM rows) AS INT) FROM rows, range({PERMUTATIONS}) t(b)),
cells AS (SELECT b, score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM dealt GROUP BY ALL),
ap AS (SELECT b, sum(pos / p * tp / r) AS ap FROM (SELECT b, pos, sum(pos) OVER (PARTITION BY b ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY b ORDER BY score DESC) AS r, sum(pos) OVER (PARTITION BY b) AS p FROM cells) GROUP BY b),
o AS (SELECT ap AS observed FROM ap WHERE b = -1)
SELECT round(observed, 6) AS observed, count(*) AS n, round(avg(ap), 6) AS null_mean, round(max(ap), 6) AS null_max, round((count(*) FILTER (ap >= observed - 1e-12) + 1)::DOUBLE / (count(*) + 1), 6) AS p_value FROM ap, o WHERE b >= 0 GROUP BY observed
""",
}
