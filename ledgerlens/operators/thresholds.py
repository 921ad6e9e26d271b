"""Ranking metrics and operating points from scored samples.

Everything starts from counts by distinct score, combined before the shuffle. Running counts over scores are taken in two
steps, within bands of the score and over the bands' totals, so that no task sorts all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.rates import rate
from ledgerlens.sources.tables import PREDICTIONS_DUCK, predictions

BANDS = 4096


def score_counts(rows: DataFrame, *by: str) -> DataFrame:
    """pos and neg by distinct score."""
    return rows.where("score is not null and not isnan(score)").groupBy(*by, "score").agg(F.count_if(F.col("exposure_label") == 1).alias("pos"), F.count_if(F.col("exposure_label") == 0).alias("neg"))


def running_counts(counts: DataFrame, *by: str) -> DataFrame:
    """counts with tp and fp (at or above the score) and the totals p and n. Scores lie in [0, 1]; others go to the end bands."""
    banded = counts.withColumn("band", F.least(F.greatest(F.floor(F.col("score") * BANDS), F.lit(0)), F.lit(BANDS)))
    totals = banded.groupBy(*by, "band").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    all_, above = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "band", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("bp", "bn")), F.sum("bp").over(all_).alias("p"), F.sum("bn").over(all_).alias("n"))
    inside = Window.partitionBy(*by, "band").orderBy(F.desc("score"))
    return banded.join(offsets, [*by, "band"]).select(*by, "score", "pos", "neg", (F.sum("pos").over(inside) + F.col("bp_before")).alias("tp"), (F.sum("neg").over(inside) + F.col("bn_before")).alias("fp"), "p", "n")


def auroc(running: DataFrame, *by: str) -> DataFrame:
    """Share of pairs (positive, negative) in the right order, ties half; NULL with one class only. Counted twofold in whole numbers."""
    twice = F.sum((F.col("neg") * (2 * (F.col("tp") - F.col("pos")) + F.col("pos"))).cast("decimal(38,0)"))
    return running.groupBy(*by).agg(rate(twice, 2 * F.max("p") * F.max("n")).alias("auroc"))


def average_precision(running: DataFrame, *by: str) -> DataFrame:
    return running.groupBy(*by).agg(F.sum(rate(F.col("pos"), F.col("p")) * rate(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))


def curve(running: DataFrame) -> DataFrame:
    """Every point of the ROC and precision-recall curves."""
    tp, fp = F.col("tp"), F.col("fp")
    return running.select(F.col("score").alias("threshold"), tp, fp, rate(tp, F.col("p")).alias("tpr"), rate(fp, F.col("n")).alias("fpr"), rate(tp, tp + fp).alias("precision"))


def confusion_at(running: DataFrame) -> DataFrame:
    """A row a threshold: confusion, recall, fpr, precision, f1, accuracy, specificity, routing rate."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    rows = running.select("score", "tp", "fp", (n - fp).alias("tn"), (p - tp).alias("fn"), rate(tp, p).alias("recall"), rate(fp, n).alias("fpr"), rate(tp, tp + fp).alias("precision"), rate(n - fp, n).alias("specificity"), rate(tp + n - fp, p + n).alias("accuracy"), rate(tp + fp, p + n).alias("routing_rate"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / both)).withColumnRenamed("score", "threshold")


def best_by(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """The row with the greatest order struct, of each group."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.expr(f"struct({order})")).alias("x")).select(*by, "x.*")


def operating_point(points: DataFrame, cap: float) -> DataFrame:
    return best_by(points.where(F.col("fpr") <= cap), "recall, -fpr, coalesce(precision, -1), threshold")


def operating_points(points: DataFrame, caps: list[float]) -> DataFrame:
    capped = points.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where("fpr <= cap")
    return best_by(capped, "recall, -fpr, coalesce(precision, -1), threshold", "cap")


def contract_threshold(rows: DataFrame, recall_floor: float, surface_floor: float) -> DataFrame:
    """Greatest specificity with recall and every surface's recall at or above their floors; ties to the highest threshold. A row with status, always."""
    points = confusion_at(running_counts(score_counts(rows)))
    surfaces = rows.where("exposure_label = 1 and attack_surface is not null")
    least = surfaces.groupBy("attack_surface").agg(F.count("*").alias("n"))
    # the highest threshold at which a surface still meets its floor, from its counts by score
    reached = running_counts(score_counts(surfaces, "attack_surface"), "attack_surface").join(least.select("attack_surface"), "attack_surface").where(rate(F.col("tp"), F.col("p")) >= surface_floor).groupBy("attack_surface").agg(F.max("score").alias("most"))
    limit = reached.agg(F.min("most").alias("most"), F.count("*").alias("met"))
    fit = points.where(F.col("recall") >= recall_floor).crossJoin(F.broadcast(limit)).where("threshold <= most")
    found = fit.agg(F.max_by(F.struct("threshold", "recall", "specificity", "tp", "fp", "tn", "fn"), F.struct("specificity", "threshold")).alias("x"))
    return found.select(F.when(F.col("x").isNull(), "insufficient").otherwise("selected").alias("status"), "x.*")


def summary(rows: DataFrame, threshold: float) -> DataFrame:
    """Confusion and rates at one threshold, AUROC and average precision."""
    y, hit = F.col("exposure_label") == 1, F.col("score") >= threshold
    c = rows.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rates = c.select("*", rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))
    running = running_counts(score_counts(rows))
    return rates.crossJoin(auroc(running)).crossJoin(average_precision(running))


def quantiles(rows: DataFrame) -> DataFrame:
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    return rows.groupBy("exposure_label").agg(*[F.percentile("score", q).alias(f"q{int(q * 100):02d}") for q in at])


def by_subgroup(rows: DataFrame, *dims: str) -> DataFrame:
    """AUROC and average precision along several dimensions, one long table."""
    long = rows.select("exposure_label", "score", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("exposure_label", "score", "x.*")
    running = running_counts(score_counts(long, "dimension", "value"), "dimension", "value")
    return auroc(running, "dimension", "value").join(average_precision(running, "dimension", "value"), ["dimension", "value"])


def routing_volume(rows: DataFrame, prevalences: list[float], threshold: float) -> DataFrame:
    """Share routed at each prevalence of attacks: p tpr + (1 - p) fpr."""
    point = summary_rates(rows, threshold)
    return point.select(F.explode(F.array(*[F.lit(p) for p in prevalences])).alias("prevalence"), "tpr", "fpr").select("prevalence", (F.col("prevalence") * F.col("tpr") + (1 - F.col("prevalence")) * F.col("fpr")).alias("routed"))


def summary_rates(rows: DataFrame, threshold: float) -> DataFrame:
    y, hit = F.col("exposure_label") == 1, F.col("score") >= threshold
    return rows.agg(rate(F.count_if(hit & y), F.count_if(y)).alias("tpr"), rate(F.count_if(hit & ~y), F.count_if(~y)).alias("fpr"))


def misses(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k lowest-scored missed attacks and the k highest-scored clean samples."""
    missed = rows.where((F.col("exposure_label") == 1) & (F.col("score") < threshold)).orderBy("score", "sample_id").limit(k).select(F.lit("missed").alias("kind"), "sample_id", "score")
    high = rows.where("exposure_label = 0").orderBy(F.desc("score"), "sample_id").limit(k).select(F.lit("high_clean").alias("kind"), "sample_id", "score")
    return missed.unionByName(high)


def quartiles(rows: DataFrame, column: str) -> DataFrame:
    """Quartile 0 to 3 by interpolated edges; a value on an edge goes up."""
    edges = rows.agg(*[F.percentile(column, q).alias(f"e{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    above = sum(((F.col(column) >= F.col(f"e{i}")).cast("int") for i in range(3)), F.lit(0))
    return rows.crossJoin(F.broadcast(edges)).groupBy(above.alias("quartile")).agg(F.count("*").alias("n"), F.count_if(F.col("exposure_label") == 1).alias("attacks"))


def length_percentiles(rows: DataFrame, column: str) -> DataFrame:
    """min, p50, p95, p99 and max by position int(n p) of the sorted values, not interpolated. Counts by value first."""
    counts = rows.groupBy(F.col(column).alias("v")).count()
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select("v", F.sum("count").over(upto).alias("upto"), F.sum("count").over(Window.partitionBy()).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v")))
    return placed.agg(F.min("v").alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("v").alias("max"))


def _running(s, d):
    return running_counts(score_counts(predictions(s, d)))


_P = f"""WITH preds AS ({PREDICTIONS_DUCK}), byscore AS (SELECT score, count(*) FILTER (exposure_label = 1) AS pos, count(*) FILTER (exposure_label = 0) AS neg FROM preds GROUP BY 1),
run AS (SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM byscore WINDOW w AS (ORDER BY score DESC)),
points AS (SELECT score AS threshold, tp, fp, n - fp AS tn, p - tp AS fn, tp / p AS recall, fp / n AS fpr, tp / (tp + fp) AS precision, (n - fp) / n AS specificity, (tp + n - fp) / (p + n) AS accuracy, (tp + fp) / (p + n) AS routing_rate,
  CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) END AS f1 FROM run) """
_AUC = "(SELECT count(*) FILTER (a.score > b.score) + 0.5 * count(*) FILTER (a.score = b.score) FROM preds a, preds b WHERE a.exposure_label = 1 AND b.exposure_label = 0) / (SELECT count(*) FILTER (exposure_label = 1) * count(*) FILTER (exposure_label = 0) FROM preds)"
_AP = "(SELECT sum(pos / p * (tp / (tp + fp))) FROM run)"

QUERIES = {
    "win6_auroc": lambda s, d: auroc(_running(s, d)),
    "win7_average_precision": lambda s, d: average_precision(_running(s, d)),
    "win8_curve": lambda s, d: curve(_running(s, d)),
    "agg12_binary_metrics": lambda s, d: summary(predictions(s, d), 0.55),
    "agg12_score_quantiles": lambda s, d: quantiles(predictions(s, d)),
    "agg13_confusion_at_thresholds": lambda s, d: confusion_at(_running(s, d)),
    "agg14_operating_point": lambda s, d: operating_point(confusion_at(_running(s, d)), 0.20),
    "agg15_points_by_cap": lambda s, d: operating_points(confusion_at(_running(s, d)), [0.05, 0.10, 0.20, 0.30]),
    "agg16_contract_threshold": lambda s, d: contract_threshold(predictions(s, d), 0.95, 0.80),
    "agg17_best_f1": lambda s, d: best_by(confusion_at(_running(s, d)).where("f1 is not null"), "f1, recall, precision, threshold"),
    "agg18_balanced_accuracy": lambda s, d: summary(predictions(s, d), 0.55).select(((F.coalesce("recall", F.lit(0.0)) + F.coalesce("specificity", F.lit(0.0))) / 2).alias("balanced_accuracy"), F.coalesce("precision", F.lit(0.0)).alias("precision")),
    "agg46_routing_volume": lambda s, d: routing_volume(predictions(s, d), [0.01, 0.05, 0.1, 0.5], 0.55),
    "agg50_subgroups": lambda s, d: by_subgroup(predictions(s, d), "docid", "label"),
    "agg60_length_percentiles": lambda s, d: length_percentiles(s.read.parquet(f"{d}/documents.parquet").select(F.length("text").alias("n")), "n"),
    "srt12_misses": lambda s, d: misses(predictions(s, d), 0.55, 25),
    "win19_quartiles": lambda s, d: quartiles(predictions(s, d), "score"),
}
SQL = {
    "win6_auroc": _P + f"SELECT {_AUC} AS auroc",
    "win7_average_precision": _P + f"SELECT {_AP} AS ap",
    "win8_curve": _P + "SELECT score AS threshold, tp, fp, tp / p AS tpr, fp / n AS fpr, tp / (tp + fp) AS precision FROM run",
    "agg12_binary_metrics": _P + f"""SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, fp / nullif(fp + tn, 0) AS fpr, fn / nullif(fn + tp, 0) AS fnr,
        2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, {_AUC} AS auroc, {_AP} AS ap FROM (SELECT count(*) FILTER (h AND y) AS tp, count(*) FILTER (h AND NOT y) AS fp, count(*) FILTER (NOT h AND NOT y) AS tn, count(*) FILTER (NOT h AND y) AS fn FROM (SELECT score >= 0.55 AS h, exposure_label = 1 AS y FROM preds))""",
    "agg12_score_quantiles": _P + "SELECT exposure_label, quantile_cont(score, 0.05) AS q05, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS q50, quantile_cont(score, 0.75) AS q75, quantile_cont(score, 0.95) AS q95 FROM preds GROUP BY 1",
    "agg13_confusion_at_thresholds": _P + "SELECT * FROM points",
    "agg14_operating_point": _P + "SELECT * FROM points WHERE fpr <= 0.20 ORDER BY recall DESC, fpr, precision DESC NULLS LAST, threshold DESC LIMIT 1",
    "agg15_points_by_cap": _P + "SELECT * FROM (SELECT * FROM points, (SELECT unnest([0.05, 0.10, 0.20, 0.30]::DOUBLE[]) AS cap) WHERE fpr <= cap) QUALIFY row_number() OVER (PARTITION BY cap ORDER BY recall DESC, fpr, precision DESC NULLS LAST, threshold DESC) = 1",
    "agg16_contract_threshold": _P + """, surf AS (SELECT t.threshold, attack_surface, avg(CASE WHEN x.score >= t.threshold THEN 1 ELSE 0 END) AS r FROM points t, preds x WHERE exposure_label = 1 GROUP BY 1, 2),
        fit AS (SELECT * FROM points WHERE recall >= 0.95 AND threshold IN (SELECT threshold FROM surf GROUP BY 1 HAVING min(r) >= 0.8) ORDER BY specificity DESC, threshold DESC LIMIT 1)
        SELECT CASE WHEN threshold IS NULL THEN 'insufficient' ELSE 'selected' END AS status, threshold, recall, specificity, tp, fp, tn, fn FROM (SELECT 1) LEFT JOIN fit ON true""",
    "agg17_best_f1": _P + "SELECT * FROM points WHERE f1 IS NOT NULL ORDER BY f1 DESC, recall DESC, precision DESC, threshold DESC LIMIT 1",
    "agg18_balanced_accuracy": _P + "SELECT (avg(CASE WHEN score >= 0.55 THEN 1 ELSE 0 END) FILTER (exposure_label = 1) + avg(CASE WHEN score < 0.55 THEN 1 ELSE 0 END) FILTER (exposure_label = 0)) / 2 AS balanced_accuracy, avg(exposure_label) FILTER (score >= 0.55) AS precision FROM preds",
    "agg46_routing_volume": _P + "SELECT prevalence, prevalence * tpr + (1 - prevalence) * fpr AS routed FROM (SELECT avg(CASE WHEN score >= 0.55 THEN 1 ELSE 0 END) FILTER (exposure_label = 1) AS tpr, avg(CASE WHEN score >= 0.55 THEN 1 ELSE 0 END) FILTER (exposure_label = 0) AS fpr FROM preds), (SELECT unnest([0.01, 0.05, 0.1, 0.5]::DOUBLE[]) AS prevalence)",
    "agg50_subgroups": _P + """, l AS (SELECT exposure_label AS y, score, 'docid' AS dimension, CAST(docid AS VARCHAR) AS value FROM preds UNION ALL SELECT exposure_label, score, 'label', CAST(label AS VARCHAR) FROM preds),
        a AS (SELECT dimension, value, (count(*) FILTER (a.score > b.score) + 0.5 * count(*) FILTER (a.score = b.score)) / count(*) AS auroc FROM l a JOIN l b USING (dimension, value) WHERE a.y = 1 AND b.y = 0 GROUP BY 1, 2),
        r AS (SELECT dimension, value, score, count(*) FILTER (y = 1) AS pos, count(*) AS c FROM l GROUP BY 1, 2, 3),
        q AS (SELECT dimension, value, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS tot, sum(pos) OVER (PARTITION BY dimension, value) AS p FROM r WINDOW w AS (PARTITION BY dimension, value ORDER BY score DESC)),
        ap AS (SELECT dimension, value, sum(CASE WHEN p > 0 THEN pos / p * (tp / tot) END) AS ap FROM q GROUP BY 1, 2) SELECT dimension, value, auroc, ap FROM ap LEFT JOIN a USING (dimension, value)""",
    "agg60_length_percentiles": "SELECT v[1] AS min, v[CAST(floor(n * 0.5) AS INT) + 1] AS p50, v[CAST(floor(n * 0.95) AS INT) + 1] AS p95, v[CAST(floor(n * 0.99) AS INT) + 1] AS p99, v[n] AS max FROM (SELECT list_sort(list(CAST(length(text) AS INT))) AS v, count(*) AS n FROM documents)",
    "srt12_misses": _P + "(SELECT 'missed' AS kind, sample_id, score FROM preds WHERE exposure_label = 1 AND score < 0.55 ORDER BY score, sample_id LIMIT 25) UNION ALL (SELECT 'high_clean', sample_id, score FROM preds WHERE exposure_label = 0 ORDER BY score DESC, sample_id LIMIT 25)",
    "win19_quartiles": _P + "SELECT CAST(CASE WHEN score < e[1] THEN 0 WHEN score < e[2] THEN 1 WHEN score < e[3] THEN 2 ELSE 3 END AS INT) AS quartile, count(*) AS n, count(*) FILTER (exposure_label = 1) AS attacks FROM preds, (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS e FROM preds) GROUP BY 1",
}
