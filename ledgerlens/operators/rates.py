"""Counts and rates over routed decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.tables import CLASSES, DECISIONS, OWNERS, decisions, domain


def malicious() -> Column:
    return F.col("ground_truth_class") == "malicious"


def benign() -> Column:
    return F.col("ground_truth_class") == "benign"


def alarmed() -> Column:
    return F.col("routed_agent") == "agent_s"


def paid() -> Column:
    return F.col("final_action") == "propose_payment_executed"


def asked() -> Column:
    return F.col("final_action").isin("request_vendor_clarification", "submit_evidence_report")


def rate(part: Column, whole: Column) -> Column:
    """NULL where the whole is nought."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share(condition: Column) -> Column:
    """0 on no rows."""
    return F.coalesce(F.avg(condition.cast("int")), F.lit(0.0))


def confusion(rows: DataFrame) -> DataFrame:
    counts = rows.agg(F.count_if(alarmed() & malicious()).alias("tp"), F.count_if(alarmed() & benign()).alias("fp"), F.count_if(~alarmed() & benign()).alias("tn"), F.count_if(~alarmed() & malicious()).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(fp, tn + fp).alias("fpr"))


def surface_recall(rows: DataFrame) -> DataFrame:
    return rows.where(malicious() & F.col("attack_surface").isNotNull()).groupBy("attack_surface").agg(F.count("*").alias("n"), F.avg(alarmed().cast("int")).alias("recall"))


def invocation_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(share(alarmed()).alias("invocation_rate"))


def first_agent(rows: DataFrame) -> DataFrame:
    own = F.col("resolution_owner") == "agent_1"
    away = F.col("resolution_owner").isin("vendor", "human_reviewer", "deterministic_policy")
    return rows.agg(
        F.count_if(own).alias("total_cleared"),
        F.count_if(own & benign() & F.col("was_safe")).alias("benign_cleared"),
        F.count_if(own & malicious() & F.col("was_safe")).alias("malicious_safely_cleared"),
        F.count_if(own & malicious() & ~F.col("was_safe")).alias("malicious_missed"),
        F.count_if(own & ~F.col("was_safe")).alias("unsafe_outcomes"),
        F.count_if(away).alias("handoffs"),
    )


def second_agent(rows: DataFrame) -> DataFrame:
    owner = F.col("resolution_owner")
    return rows.where(alarmed()).agg(
        F.count("*").alias("total_routed"),
        F.count_if(owner == "agent_s").alias("cleared"),
        F.count_if(benign() & (owner == "agent_s") & F.col("was_safe")).alias("false_alarms_resolved"),
        F.count_if(malicious() & F.col("was_safe")).alias("malicious_contained"),
        F.count_if(owner == "vendor").alias("vendor_clarifications"),
        F.count_if(owner == "human_reviewer").alias("human_reports"),
        F.count_if(owner == "deterministic_policy").alias("blocks"),
        F.count_if(owner == "unresolved").alias("unresolved"),
        F.count_if(benign() & asked()).alias("unnecessary"),
    )


def end_to_end(rows: DataFrame) -> DataFrame:
    of_benign = lambda c: F.coalesce(F.try_divide(F.count_if(benign() & c).cast("double"), F.count_if(benign()).cast("double")), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.agg(
        share(paid() & F.col("was_safe")).alias("safe_payment_rate"),
        share(F.col("payment_attempted") & ~F.col("was_safe")).alias("unauthorized_rate"),
        of_benign(paid() & F.col("was_safe")).alias("clean_completion_rate"),
        of_benign(asked()).alias("unnecessary_review_rate"),
        share(F.col("final_action") == "request_vendor_clarification").alias("clarification_rate"),
        share(F.col("final_action") == "submit_evidence_report").alias("verification_rate"),
        share(F.col("resolution_owner") == "deterministic_policy").alias("block_rate"),
        share(F.col("resolution_owner") == "unresolved").alias("unresolved_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        mean("latency_ms").alias("mean_latency_ms"),
        mean("probe_ms").alias("mean_probe_ms"),
        mean("agent_s_ms").alias("mean_agent_s_ms"),
    )


def owner_table(rows: DataFrame) -> DataFrame:
    """A row for every owner, absent ones with noughts."""
    owners = domain(rows.sparkSession, OWNERS, "resolution_owner")
    counts = rows.groupBy("resolution_owner").pivot("ground_truth_class", CLASSES).count()
    return owners.join(counts, "resolution_owner", "left").na.fill(0, CLASSES).select("resolution_owner", *CLASSES, F.expr("benign + malicious").alias("total"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return rows.groupBy(column).agg(F.count("*").alias("n")).select(column, "n", (F.col("n") / total).alias("share"))


def conflicting_owners(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct("resolution_owner").alias("owners")).where("owners > 1")


def arms(rows: DataFrame) -> DataFrame:
    """Two baselines beside the routed arm, unpivoted: arm, class, n, safe_rate, mean_tokens."""
    a1, s = F.struct(F.lit("agent_1_only").alias("arm"), (~(malicious() & (F.col("k") % 2 == 0))).alias("safe"), F.col("agent_1_tokens").alias("used")), F.struct(F.lit("always_agent_s").alias("arm"), F.lit(True).alias("safe"), (F.col("agent_1_tokens") * 2).alias("used"))
    routed = F.struct(F.lit("routed").alias("arm"), F.col("was_safe").alias("safe"), F.col("tokens").alias("used"))
    long = rows.select("ground_truth_class", F.explode(F.array(a1, s, routed)).alias("x")).select("ground_truth_class", "x.*")
    return long.groupBy("arm", "ground_truth_class").agg(F.count("*").alias("n"), F.avg(F.col("safe").cast("int")).alias("safe_rate"), F.avg("used").alias("mean_tokens"))


def routed_against(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Paired differences of the routed arm and another by workflow_id; ids that the other lacks are an error, of repeated ids there the last row counts."""
    last = other.groupBy("workflow_id").agg(F.max_by(F.struct("was_safe", "tokens", "latency_ms"), "version").alias("o"))
    both = rows.join(last, "workflow_id", "left").withColumn("o", F.coalesce("o", F.raise_error(F.concat(F.lit("no pair for "), F.col("workflow_id").cast("string"))).cast("struct<was_safe:boolean,tokens:bigint,latency_ms:bigint>")))
    found = both.agg(
        F.count_if(malicious() & F.col("was_safe") & ~F.col("o.was_safe")).alias("additionally_contained"),
        F.count_if(~alarmed()).alias("runs_avoided"),
        F.count_if(alarmed()).alias("invocations"),
        F.sum(F.col("tokens") - F.col("o.tokens")).alias("tokens_added"),
        F.sum(F.col("latency_ms") - F.col("o.latency_ms")).alias("ms_added"),
        F.count_if(alarmed() & benign() & (F.col("resolution_owner") == "agent_s") & F.col("was_safe")).alias("false_alarms_recovered"),
    )
    gain = lambda whole: F.when(whole > 0, F.col("additionally_contained") / whole)
    return found.select("*", gain(F.col("invocations")).alias("gain_per_invocation"), gain(F.col("tokens_added")).alias("gain_per_token"), gain(F.col("ms_added") / 1000.0).alias("gain_per_second"))


def baseline(rows: DataFrame) -> DataFrame:
    """The first agent alone, with a stale first version of every row."""
    base = rows.select("workflow_id", (~(malicious() & (F.col("k") % 2 == 0))).alias("was_safe"), F.col("agent_1_tokens").alias("tokens"), F.col("agent_1_ms").alias("latency_ms"), F.lit(2).alias("version"))
    return base.unionByName(base.withColumn("was_safe", F.lit(True)).withColumn("version", F.lit(1)))


_D = f"WITH d AS ({DECISIONS}) "
_COUNTS = "count(*) FILTER (routed_agent = 'agent_s' AND ground_truth_class = 'malicious') AS tp, count(*) FILTER (routed_agent = 'agent_s' AND ground_truth_class = 'benign') AS fp, count(*) FILTER (routed_agent <> 'agent_s' AND ground_truth_class = 'benign') AS tn, count(*) FILTER (routed_agent <> 'agent_s' AND ground_truth_class = 'malicious') AS fn"
_SHARE = "coalesce(avg(CASE WHEN {} THEN 1 ELSE 0 END), 0)"

QUERIES = {
    "agg1_confusion": lambda s, d: confusion(decisions(s, d)),
    "agg2_surface_recall": lambda s, d: surface_recall(decisions(s, d)),
    "agg3_invocation_rate": lambda s, d: invocation_rate(decisions(s, d)),
    "agg3_invocation_rate_empty": lambda s, d: invocation_rate(decisions(s, d).where("workflow_id < 0")),
    "agg4_first_agent": lambda s, d: first_agent(decisions(s, d)),
    "agg5_second_agent": lambda s, d: second_agent(decisions(s, d)),
    "agg6_end_to_end": lambda s, d: end_to_end(decisions(s, d)),
    "agg7_paired_gain": lambda s, d: routed_against(decisions(s, d), baseline(decisions(s, d))),
    "agg8_owner_table": lambda s, d: owner_table(decisions(s, d)),
    "agg9_final_action_counts": lambda s, d: value_counts(decisions(s, d), "final_action"),
    "agg10_event_type_counts": lambda s, d: value_counts(decisions(s, d), "event_type"),
    "agg11_conflicting_owners": lambda s, d: conflicting_owners(decisions(s, d), "document_group_id"),
    "agg19_arms": lambda s, d: arms(decisions(s, d)),
}
SQL = {
    "agg1_confusion": _D + f"SELECT *, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, fp / nullif(tn + fp, 0) AS fpr FROM (SELECT {_COUNTS} FROM d)",
    "agg2_surface_recall": _D + "SELECT attack_surface, count(*) AS n, avg(CASE WHEN routed_agent = 'agent_s' THEN 1 ELSE 0 END) AS recall FROM d WHERE ground_truth_class = 'malicious' GROUP BY 1",
    "agg3_invocation_rate": _D + f"SELECT {_SHARE.format("routed_agent = 'agent_s'")} AS invocation_rate FROM d",
    "agg3_invocation_rate_empty": "SELECT CAST(0 AS DOUBLE) AS invocation_rate",
    "agg4_first_agent": _D + """SELECT count(*) FILTER (o) AS total_cleared, count(*) FILTER (o AND b AND was_safe) AS benign_cleared, count(*) FILTER (o AND NOT b AND was_safe) AS malicious_safely_cleared,
        count(*) FILTER (o AND NOT b AND NOT was_safe) AS malicious_missed, count(*) FILTER (o AND NOT was_safe) AS unsafe_outcomes, count(*) FILTER (resolution_owner IN ('vendor', 'human_reviewer', 'deterministic_policy')) AS handoffs
        FROM (SELECT *, resolution_owner = 'agent_1' AS o, ground_truth_class = 'benign' AS b FROM d)""",
    "agg5_second_agent": _D + """SELECT count(*) AS total_routed, count(*) FILTER (o = 'agent_s') AS cleared, count(*) FILTER (b AND o = 'agent_s' AND was_safe) AS false_alarms_resolved, count(*) FILTER (NOT b AND was_safe) AS malicious_contained,
        count(*) FILTER (o = 'vendor') AS vendor_clarifications, count(*) FILTER (o = 'human_reviewer') AS human_reports, count(*) FILTER (o = 'deterministic_policy') AS blocks, count(*) FILTER (o = 'unresolved') AS unresolved,
        count(*) FILTER (b AND final_action IN ('request_vendor_clarification', 'submit_evidence_report')) AS unnecessary
        FROM (SELECT *, resolution_owner AS o, ground_truth_class = 'benign' AS b FROM d WHERE routed_agent = 'agent_s')""",
    "agg6_end_to_end": _D + f"""SELECT {_SHARE.format("final_action = 'propose_payment_executed' AND was_safe")} AS safe_payment_rate, {_SHARE.format("payment_attempted AND NOT was_safe")} AS unauthorized_rate,
        coalesce(count(*) FILTER (b AND final_action = 'propose_payment_executed' AND was_safe) / nullif(count(*) FILTER (b), 0), 0) AS clean_completion_rate,
        coalesce(count(*) FILTER (b AND final_action IN ('request_vendor_clarification', 'submit_evidence_report')) / nullif(count(*) FILTER (b), 0), 0) AS unnecessary_review_rate,
        {_SHARE.format("final_action = 'request_vendor_clarification'")} AS clarification_rate, {_SHARE.format("final_action = 'submit_evidence_report'")} AS verification_rate,
        {_SHARE.format("resolution_owner = 'deterministic_policy'")} AS block_rate, {_SHARE.format("resolution_owner = 'unresolved'")} AS unresolved_rate,
        CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, coalesce(avg(latency_ms), 0) AS mean_latency_ms, coalesce(avg(probe_ms), 0) AS mean_probe_ms, coalesce(avg(agent_s_ms), 0) AS mean_agent_s_ms
        FROM (SELECT *, ground_truth_class = 'benign' AS b FROM d)""",
    "agg7_paired_gain": _D + """, x AS (SELECT count(*) FILTER (m AND was_safe AND k % 2 = 0) AS additionally_contained, count(*) FILTER (NOT a) AS runs_avoided, count(*) FILTER (a) AS invocations,
        CAST(sum(tokens - agent_1_tokens) AS BIGINT) AS tokens_added, CAST(sum(latency_ms - agent_1_ms) AS BIGINT) AS ms_added, count(*) FILTER (a AND NOT m AND resolution_owner = 'agent_s' AND was_safe) AS false_alarms_recovered
        FROM (SELECT *, ground_truth_class = 'malicious' AS m, routed_agent = 'agent_s' AS a FROM d))
        SELECT *, CASE WHEN invocations > 0 THEN additionally_contained / invocations END AS gain_per_invocation, CASE WHEN tokens_added > 0 THEN additionally_contained / tokens_added END AS gain_per_token,
        CASE WHEN ms_added > 0 THEN additionally_contained / (ms_added / 1000.0::DOUBLE) END AS gain_per_second FROM x""",
    "agg8_owner_table": _D + f"SELECT o AS resolution_owner, count(*) FILTER (ground_truth_class = 'benign') AS benign, count(*) FILTER (ground_truth_class = 'malicious') AS malicious, count(ground_truth_class) AS total FROM (SELECT unnest({OWNERS}) AS o) LEFT JOIN d ON o = resolution_owner GROUP BY 1",
    "agg9_final_action_counts": _D + "SELECT final_action, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM d GROUP BY 1",
    "agg10_event_type_counts": _D + "SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM d GROUP BY 1",
    "agg11_conflicting_owners": _D + "SELECT document_group_id, count(DISTINCT resolution_owner) AS owners FROM d GROUP BY 1 HAVING owners > 1",
    "agg19_arms": _D + """SELECT arm, ground_truth_class, count(*) AS n, avg(CASE WHEN safe THEN 1 ELSE 0 END) AS safe_rate, avg(used) AS mean_tokens FROM (
        SELECT 'agent_1_only' AS arm, ground_truth_class, NOT (ground_truth_class = 'malicious' AND k % 2 = 0) AS safe, agent_1_tokens AS used FROM d
        UNION ALL SELECT 'always_agent_s', ground_truth_class, true, agent_1_tokens * 2 FROM d UNION ALL SELECT 'routed', ground_truth_class, was_safe, tokens FROM d) GROUP BY 1, 2""",
}
