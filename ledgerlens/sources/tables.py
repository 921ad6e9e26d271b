"""Readers of the driver's tables and the views that bind them to audit concepts.

Each binding is one SQL text that Spark and DuckDB both run, so that a query and its twin see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The six owners, in the order of the published table (fixed values).
OWNERS = ["agent_1", "agent_s", "vendor", "human_reviewer", "deterministic_policy", "unresolved"]
CLASSES = ["benign", "malicious"]

#: One routed decision a row, from events.
DECISIONS = """
SELECT *, CASE WHEN ground_truth_class = 'malicious' THEN concat('s', cast(k % 5 AS STRING)) END AS attack_surface,
       final_action = 'propose_payment_executed' AS payment_attempted,
       NOT (ground_truth_class = 'malicious' AND final_action = 'propose_payment_executed' AND k % 7 = 0) AS was_safe,
       agent_1_tokens + agent_s_tokens AS tokens, agent_1_ms + probe_ms + agent_s_ms AS latency_ms
FROM (SELECT *, CASE resolution_owner WHEN 'vendor' THEN 'request_vendor_clarification' WHEN 'human_reviewer' THEN 'submit_evidence_report'
                WHEN 'deterministic_policy' THEN 'fail_closed' WHEN 'unresolved' THEN 'unresolved'
                ELSE CASE WHEN k % 3 = 0 THEN 'finish_review' ELSE 'propose_payment_executed' END END AS final_action,
             cast(100 + k AS BIGINT) AS agent_1_tokens, cast(CASE WHEN routed_agent = 'agent_s' THEN 50 + k ELSE 0 END AS BIGINT) AS agent_s_tokens,
             cast(round(value * 100) AS BIGINT) AS agent_1_ms, cast(k AS BIGINT) AS probe_ms, cast(CASE WHEN routed_agent = 'agent_s' THEN 2 * k ELSE 0 END AS BIGINT) AS agent_s_ms
      FROM (SELECT *, CASE WHEN routed_agent = 'agent_1' THEN 'agent_1' WHEN k % 5 = 0 THEN 'agent_s' WHEN k % 5 = 1 THEN 'vendor'
                      WHEN k % 5 = 2 THEN 'human_reviewer' WHEN k % 5 = 3 THEN 'deterministic_policy' ELSE 'unresolved' END AS resolution_owner
            FROM (SELECT event_id AS workflow_id, user_id AS document_group_id, ts, value, event_type,
                         cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
                         CASE WHEN event_type IN ('error', 'signup') THEN 'malicious' ELSE 'benign' END AS ground_truth_class,
                         value / (1 + value) AS probe_score,
                         CASE WHEN value / (1 + value) >= 0.95 THEN 'agent_s' ELSE 'agent_1' END AS routed_agent FROM events) x) y) z
"""

#: One scored sample a row, from embeddings: the score is the first component moved into [0, 1].
PREDICTIONS = """
SELECT vec_id AS sample_id, vec_id % 50 AS docid, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS exposure_label,
       CASE WHEN label >= 5 THEN concat('s', cast(label % 5 AS STRING)) END AS attack_surface, label,
       round(0.5 + {first} / 2 + CASE WHEN label >= 5 THEN 0.1 ELSE 0 END, 2) AS score FROM embeddings
"""
PREDICTIONS_SPARK, PREDICTIONS_DUCK = PREDICTIONS.format(first="cast(embedding[0] AS DOUBLE)"), PREDICTIONS.format(first="cast(embedding[1] AS DOUBLE)")

#: Payment intents, in integer minor units, from orders.
INTENTS = """
SELECT o_orderkey AS intent_id, o_custkey AS source_account_id, o_orderkey % 97 AS beneficiary_id, cast(round(o_totalprice * 100) AS BIGINT) AS amount_minor_units,
       CASE o_orderstatus WHEN 'F' THEN 'executed' WHEN 'O' THEN 'proposed' ELSE 'blocked' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'USD' WHEN o_orderkey % 3 = 1 THEN 'usd' ELSE 'EUR' END AS currency, o_orderpriority AS priority, o_orderdate AS created_at FROM orders
"""

#: A tool call a row, from events: a run for each user, steps in order of time.
STEPS = """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_id, ts, k,
       CASE event_type WHEN 'view' THEN 'read_email' WHEN 'click' THEN 'read_invoice' WHEN 'signup' THEN 'get_vendor_record' WHEN 'error' THEN 'search_memory' ELSE 'finish' END AS action,
       concat('{"id":', cast(k % 4 AS STRING), '}') AS args, k % 5 <> 0 AS success, k % 11 = 0 AS stale, value / (1 + value) AS score
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: read(spark, sf_dir, table)})


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, DECISIONS, "events")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, PREDICTIONS_SPARK, "embeddings")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, INTENTS, "orders")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, STEPS, "events")


def domain(spark: SparkSession, values: list, name: str) -> DataFrame:
    """A fixed domain as a table, for results that list every value."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
