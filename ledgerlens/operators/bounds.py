"""Exact binomial bounds of failure rates, and the claims' denominators they are taken over.

A bound is the p at which a binomial tail has a given probability, found by bisection over the regularised incomplete beta
function, for a whole batch of (failures, trials) at once. Rows are counts by then, so the function sees one row a group.

Defined results. Failures equal to trials have the upper bound 1, no failures the lower bound 0. NULL, negative or
impossible counts, and no trials, have NULL bounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import DECISIONS, decisions

CONFIDENCE = 0.95
_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp((_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)).astype(float) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        ratio = 1 - (p + q) * y / (p + 1)
        down = 1 / np.where(np.abs(ratio) < tiny, tiny, ratio)
        up, value = np.ones_like(y), down.copy()
        for m in range(1, 20_000):
            last = value
            for term in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                down = 1 + term * down
                down = 1 / np.where(np.abs(down) < tiny, tiny, down)
                up = 1 + term / up
                up = np.where(np.abs(up) < tiny, tiny, up)
                value = value * down * up
            if np.all(np.abs(value - last) <= 1e-15 * np.abs(value)):
                break
        found = front * value
    return np.where(y <= 0, np.where(turned, 1.0, 0.0), np.where(turned, 1 - found, found))


def beta_quantile(probability: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with incomplete_beta(x, a, b) = probability, by bisection."""
    low, high = np.zeros(np.broadcast(probability, a, b).shape), np.ones(np.broadcast(probability, a, b).shape)
    for _ in range(70):
        middle = (low + high) / 2
        above = incomplete_beta(middle, a, b) > probability
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def _bound(tail: float, upper: bool):
    def run(failures: pd.Series, trials: pd.Series) -> pd.Series:
        k, n = failures.to_numpy(float), trials.to_numpy(float)
        right = (k >= 0) & (n > 0) & (k <= n)
        sure = right & ((k == n) if upper else (k == 0))
        out = np.where(sure, 1.0 if upper else 0.0, np.nan)
        ask = np.flatnonzero(right & ~sure)
        if len(ask):
            out[ask] = beta_quantile(1 - tail, k[ask] + 1, n[ask] - k[ask]) if upper else beta_quantile(tail, k[ask], n[ask] - k[ask] + 1)
        return pd.Series(out)

    run.__annotations__ = {"failures": pd.Series, "trials": pd.Series, "return": pd.Series}
    made = F.pandas_udf(run, "double")
    return lambda k, n: F.nanvl(made(k.cast("double"), n.cast("double")), F.lit(None))


def upper_bound(k: Column, n: Column, confidence: float = CONFIDENCE) -> Column:
    """One-sided exact upper bound."""
    return _bound(1 - confidence, True)(k, n)


def interval(k: Column, n: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """Two-sided exact bounds."""
    return _bound((1 - confidence) / 2, False)(k, n), _bound((1 - confidence) / 2, True)(k, n)


def zero_failure_upper(n: Column, confidence: float = CONFIDENCE) -> Column:
    """upper_bound(0, n) in closed form."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - confidence), 1 / n))


def zero_failure_block(rows: DataFrame, *by: str) -> DataFrame:
    """Workflows and distinct documents of each group, and the bounds that no failure would give at both levels. rows: document_group_id."""
    documents = rows.groupBy(*by, "document_group_id").agg(F.count("*").alias("n"))
    counts = documents.groupBy(*by).agg(F.sum("n").alias("n_workflows"), F.count("document_group_id").alias("n_documents"))
    levels = [("workflow", F.col("n_workflows")), ("document", F.col("n_documents"))]
    bounds = [c for name, n in levels for c in (F.round(zero_failure_upper(n), 5).alias(f"{name}_upper"), F.round(F.when(n > 0, 3 / n), 5).alias(f"{name}_rule_of_three"), F.round(F.when(n > 0, 1 - F.pow(F.lit((1 - CONFIDENCE) / 2), 1 / n)), 5).alias(f"{name}_two_sided_upper"))]
    return counts.select(*by, "n_workflows", "n_documents", F.round(F.col("n_workflows") / F.when(F.col("n_documents") > 0, F.col("n_documents")), 2).alias("per_document"), *bounds)


#: Claims and the rows that each is made over (fixed values).
CLAIMS = {
    "all_attacked": "attacked",
    "attack_causal (resolvable + requiring review)": "attacked AND category IN ('resolvable_conflict', 'conflict_requiring_review')",
    "attack_causal_on_invoice_documents_only": "attacked AND category IN ('resolvable_conflict', 'conflict_requiring_review') AND is_invoice",
    "resolvable_attack_conflicts": "attacked AND category = 'resolvable_conflict'",
    "attack_conflicts_requiring_review": "attacked AND category = 'conflict_requiring_review'",
    "attacked_blocked_by_missing_invoice_fields": "attacked AND category = 'attack_on_incomplete_invoice'",
    "attacked_blocked_by_trusted_vendor_state": "attacked AND category = 'attack_with_trusted_state_block'",
    "attacked_on_non_invoice_document": "attacked AND NOT is_invoice",
    "all_clean": "NOT attacked",
    "clean_expecting_canonical_payment (false-alarm denominator)": "NOT attacked AND expected = 'safe_canonical_payment'",
    "clean_expecting_canonical_payment_on_invoice_documents": "NOT attacked AND expected = 'safe_canonical_payment' AND is_invoice",
}


def denominators(rows: DataFrame) -> DataFrame:
    """A zero_failure_block for every claim, one without rows included; each row is read once, whatever the number of claims."""
    claims = F.array(*(F.when(F.expr(f"coalesce({rule}, false)"), F.lit(name)) for name, rule in CLAIMS.items()))
    found = zero_failure_block(rows.withColumn("claim", F.explode(F.array_compact(claims))), "claim")
    every = rows.sparkSession.createDataFrame([(c,) for c in CLAIMS], "claim string")
    return every.join(found, "claim", "left").fillna(0, ["n_workflows", "n_documents"])


def failure_table(rows: DataFrame, most: int = 5) -> DataFrame:
    """Bounds for 0 to `most` failures among the rows."""
    tries = rows.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(most))).alias("failures"), "n").where("failures <= n")
    low, high = interval(F.col("failures"), F.col("n"))
    return tries.select("failures", "n", F.round(F.col("failures") / F.when(F.col("n") > 0, F.col("n")), 5).alias("rate"), F.round(low, 5).alias("low"), F.round(high, 5).alias("high"), F.round(upper_bound(F.col("failures"), F.col("n")), 5).alias("upper"))


def subgroup_bounds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Zero-failure bounds by value of each column, NULL a value of its own."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    sizes = rows.select(pairs.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    return sizes.select("column", "value", "n", F.round(zero_failure_upper(F.col("n")), 4).alias("upper"), F.round(3 / F.col("n"), 4).alias("rule_of_three"))


#: The columns that claims are made over, beside those of a decision.
_CLAIM_COLUMNS = [
    "ground_truth_class = 'malicious' AS attacked",
    "k % 6 > 0 AS is_invoice",
    "CASE WHEN k % 4 = 0 THEN 'resolvable_conflict' WHEN k % 4 = 1 THEN 'conflict_requiring_review' WHEN k % 4 = 2 THEN 'attack_on_incomplete_invoice' WHEN routed_agent = 'agent_1' THEN 'attack_with_trusted_state_block' END AS category",
    "CASE WHEN final_action = 'propose_payment_executed' THEN 'safe_canonical_payment' ELSE final_action END AS expected",
]
CLAIM_ROWS = f"SELECT *, {', '.join(_CLAIM_COLUMNS)} FROM ({DECISIONS}) claims"


def _claims(s, d):
    return decisions(s, d).selectExpr("*", *_CLAIM_COLUMNS)


def _by_surface(s, d):
    return decisions(s, d).where("attack_surface is not null").groupBy("attack_surface").agg(F.count_if(~F.col("was_safe")).alias("k"), F.count("*").alias("n"))


def _with_interval(rows: DataFrame, digits: int) -> DataFrame:
    low, high = interval(F.col("k"), F.col("n"))
    return rows.select("attack_surface", "k", "n", F.round(low, digits).alias("low"), F.round(high, digits).alias("high"))


QUERIES = {
    "agg28_zero_failure_block": lambda s, d: zero_failure_block(_claims(s, d).where("attacked")),
    "agg29_denominators": lambda s, d: denominators(_claims(s, d)),
    "agg30_rounded_interval": lambda s, d: _with_interval(_by_surface(s, d), 5),
    "agg31_upper_bound": lambda s, d: _by_surface(s, d).select("attack_surface", "k", "n", F.round(upper_bound(F.col("k"), F.col("n")), 5).alias("upper")),
    "agg56_failure_table": lambda s, d: failure_table(_claims(s, d).where("attacked")),
    "agg56_subgroups": lambda s, d: subgroup_bounds(_claims(s, d).where("attacked"), ["attack_surface", "category", "routed_agent", "final_action"]),
    "agg57_interval": lambda s, d: _with_interval(_by_surface(s, d), 9),
}

_BLOCK = """count(*) AS n_workflows, count(DISTINCT document_group_id) AS n_documents, round(count(*)::DOUBLE / count(DISTINCT document_group_id), 2) AS per_document,
""" + ",\n".join(f"round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / {n}), 5) AS {name}_upper, round(3.0::DOUBLE / {n}, 5) AS {name}_rule_of_three, round(1 - pow(0.025::DOUBLE, 1.0::DOUBLE / {n}), 5) AS {name}_two_sided_upper" for name, n in (("workflow", "count(*)"), ("document", "count(DISTINCT document_group_id)")))

_SURFACES = f"g AS (SELECT attack_surface, count(*) FILTER (NOT was_safe) AS k, count(*) AS n FROM ({DECISIONS}) WHERE attack_surface IS NOT NULL GROUP BY 1)"


def _bisection(groups: str, asks: str) -> str:
    """Bounds for the distinct (k, n) of table g by bisection over the binomial sum; asks: rows (name, tail, number of leading terms, whether the sum falls below the tail)."""
    return f"""WITH RECURSIVE {groups}, kn AS (SELECT DISTINCT k, n FROM g), ask AS ({asks}),
terms AS (SELECT k, n, name, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS c FROM ask, range(0, last + 1) t(i)),
search AS (SELECT k, n, name, tail, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS step FROM ask
  UNION ALL SELECT k, n, name, tail, CASE WHEN s > tail THEN mid ELSE low END, CASE WHEN s > tail THEN high ELSE mid END, step + 1
  FROM (SELECT s.k, s.n, s.name, s.tail, s.low, s.high, s.step, any_value((s.low + s.high) / 2) AS mid, sum(exp(c + i * ln((s.low + s.high) / 2) + (s.n - i) * ln(1 - (s.low + s.high) / 2))) AS s
        FROM search s JOIN terms t USING (k, n, name) WHERE step < 55 GROUP BY ALL) m),
bounds AS (SELECT k, n, name, (low + high) / 2 AS x FROM search WHERE step = 55)
"""


_TWO_SIDED = "SELECT k, n, 'low' AS name, 0.975::DOUBLE AS tail, k - 1 AS last FROM kn WHERE k > 0 UNION ALL SELECT k, n, 'high', 0.025::DOUBLE, k FROM kn WHERE k < n"
_ONE_SIDED = "SELECT k, n, 'upper' AS name, 0.05::DOUBLE AS tail, k AS last FROM kn WHERE k < n"
_LOW = "coalesce((SELECT x FROM bounds b WHERE b.k = g.k AND b.n = g.n AND name = 'low'), 0.0::DOUBLE)"
_HIGH = _LOW.replace("'low'", "'high'").replace("0.0::DOUBLE", "1.0::DOUBLE")
_UPPER = _HIGH.replace("'high'", "'upper'")
_TABLE = f"g AS (SELECT t.k, count(*) AS n FROM ({CLAIM_ROWS}) x, range(6) t(k) WHERE attacked GROUP BY t.k)"
SQL = {
    "agg28_zero_failure_block": f"SELECT {_BLOCK} FROM ({CLAIM_ROWS}) WHERE attacked",
    "agg29_denominators": " UNION ALL ".join(f"SELECT '{name}' AS claim, {_BLOCK} FROM ({CLAIM_ROWS}) WHERE {rule}" for name, rule in CLAIMS.items()),
    "agg30_rounded_interval": _bisection(_SURFACES, _TWO_SIDED) + f"SELECT attack_surface, k, n, round({_LOW}, 5) AS low, round({_HIGH}, 5) AS high FROM g",
    "agg31_upper_bound": _bisection(_SURFACES, _ONE_SIDED) + f"SELECT attack_surface, k, n, round({_UPPER}, 5) AS upper FROM g",
    "agg56_failure_table": _bisection(_TABLE, f"{_TWO_SIDED} UNION ALL {_ONE_SIDED}") + f"SELECT CAST(k AS INT) AS failures, n, round(k::DOUBLE / n, 5) AS rate, round({_LOW}, 5) AS low, round({_HIGH}, 5) AS high, round({_UPPER}, 5) AS upper FROM g",
    "agg56_subgroups": f"SELECT c AS \"column\", v AS value, count(*) AS n, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / count(*)), 4) AS upper, round(3.0::DOUBLE / count(*), 4) AS rule_of_three FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM ({CLAIM_ROWS}) WHERE attacked" for c in ("attack_surface", "category", "routed_agent", "final_action")) + ") GROUP BY 1, 2",
    "agg57_interval": _bisection(_SURFACES, _TWO_SIDED) + f"SELECT attack_surface, k, n, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high FROM g",
}
