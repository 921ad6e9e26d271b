"""Row-level classification: score bands, ordered rules, state tables. Column functions, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import INTENTS, decisions, intents, read

#: Operating threshold of the binary route (fixed value).
OPERATING_THRESHOLD = 0.5134634443863925

#: The legal edges of the alarm state graph, with their owner (fixed values).
ALARM_EDGES = [
    ("clear", "raised", "tell_router"),
    ("raised", "resolving", "agent_s"),
    ("resolving", "awaiting_vendor_clarification", "agent_s"),
    ("resolving", "awaiting_human_verification", "agent_s"),
    ("resolving", "resolved", "resolution_validator"),
    ("resolving", "hard_blocked", "deterministic_policy"),
    ("awaiting_vendor_clarification", "resolving", "vendor"),
    ("awaiting_vendor_clarification", "awaiting_human_verification", "deterministic_policy"),
    ("awaiting_human_verification", "resolving", "human_reviewer"),
    ("awaiting_human_verification", "resolved", "resolution_validator"),
    ("awaiting_human_verification", "hard_blocked", "human_reviewer"),
]
ALARM_STATES = ["clear", "raised", "resolving", "awaiting_vendor_clarification", "awaiting_human_verification", "resolved", "hard_blocked"]


def valid_score(score: Column) -> Column:
    """A number in [0, 1]; NaN is asked for first, since it sorts above every number."""
    return score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0)


def band(score: Column, low: float, high: float) -> Column:
    return F.when(~valid_score(score), "FAIL_CLOSED").when(score >= high, "AGENT_S").when(score >= low, "TELL_VERIFY").otherwise("AGENT_1")


def binary_route(score: Column, threshold: float = OPERATING_THRESHOLD) -> Column:
    """Route and stored score; an invalid score goes to agent_s and is stored as NULL."""
    ok = valid_score(score)
    return F.struct(F.when(~ok | (score >= threshold), "agent_s").otherwise("agent_1").alias("route"), F.when(ok, score).alias("stored_score"))


def plain_band(score: Column, low: float, high: float) -> Column:
    """A label only, without a range check; NULL stays NULL. The labels are fixed values."""
    return F.when(score >= high, "agent_s").when(score >= low, "tell_verify").when(score.isNotNull(), "agent_1")


def checked_band(score: Column, low: float, high: float) -> Column:
    if not 0 <= low < high <= 1:
        raise ValueError("thresholds must satisfy 0 <= low < high <= 1")
    return F.when(valid_score(score), plain_band(score, low, high)).otherwise(F.raise_error(F.lit("score is not in [0, 1]")).cast("string"))


def differs(observed: Column, stated: Column) -> Column:
    """Both known and not equal; an unknown value is no conflict."""
    return observed.isNotNull() & (observed != stated)


def proposal_outcome() -> Column:
    """The first of eleven outcomes that holds, for proposals (p), vendors (v), invoices (i) and observations (o) as columns. An unknown value fails closed."""
    c = F.col
    unlike = lambda x, y: ~c(x).eqNullSafe(c(y) if isinstance(y, str) else y)
    unobserved = c("o_invoice_id").isNull() | c("o_vendor_id").isNull() | unlike("p_evidence_invoice_id", "o_invoice_id") | unlike("p_invoice_id", "o_invoice_id") | unlike("p_evidence_vendor_id", "o_vendor_id") | unlike("p_evidence_vendor_id", "v_vendor_id")
    incomplete = unlike("i_invoice_id", "p_invoice_id") | c("i_amount").isNull() | c("i_currency").isNull() | (F.coalesce(c("i_number"), F.lit("")) == "")
    return (
        F.when(c("pending_case").isNotNull(), "unresolved_case")
        .when(c("v_vendor_id").isNull() | unlike("v_status", F.lit("active")), "vendor_missing_or_inactive")
        .when(unlike("v_verification", F.lit("verified")), "vendor_unverified")
        .when(unobserved, "unobserved_identifier")
        .when(differs(c("o_amount"), c("p_amount")) | differs(c("o_currency"), c("p_currency")), "fabricated_evidence")
        .when(incomplete, "invoice_incomplete")
        .when(~F.coalesce(c("p_currency").isin("usd", "eur", "gbp"), F.lit(False)), "unsupported_currency")
        .when(unlike("p_currency", "i_currency"), "currency_mismatch")
        .when(unlike("p_amount", "i_amount"), "amount_mismatch")
        .when(c("p_beneficiary").isNull() | unlike("p_beneficiary", "v_beneficiary"), "beneficiary_mismatch")
        .otherwise("valid")
    )


def follow_up(outcome: Column, approved_contact: Column) -> Column:
    return F.when(outcome == "valid", "none").when((outcome == "invoice_incomplete") & F.coalesce(approved_contact, F.lit(False)), "request_vendor_clarification").otherwise("submit_evidence_report")


def gate(structure_ok: Column, state: Column, resolved: Column) -> Column:
    """Permits a sound proposal in the clear state or after a resolved recovery; all else, unknown values included, is blocked."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    reason = (
        F.when(~yes(structure_ok), "structurally_invalid")
        .when(yes(state == "clear"), "clear_state_permitted")
        .when(yes((state == "recovered") & resolved), "recovery_resolved_permitted")
        .when(yes(state == "recovered"), "recovery_not_resolved")
        .otherwise("alarm_unresolved")
    )
    return F.struct(F.when(reason.endswith("permitted"), "permit").otherwise("block").alias("decision"), reason.alias("reason"))


def gate_state(state: Column, resolved: Column) -> Column:
    return F.struct(F.when(state == "clear", "clear").when(state == "resolved", "recovered").otherwise("unresolved").alias("gate_state"), ((state == "resolved") & resolved).alias("recovery_resolved"))


def conflicts() -> Column:
    """Codes of every conflict of a proposal, in order."""
    c = F.col
    code = lambda condition, name: F.when(condition, name)
    return F.array_compact(F.array(code(differs(c("o_amount"), c("p_amount")), "amount"), code(differs(c("o_currency"), c("p_currency")), "currency"), code(differs(c("v_beneficiary"), c("p_beneficiary")), "beneficiary"), code(differs(c("o_invoice_id"), c("p_invoice_id")), "document")))


def attack_outcome(valid: Column, action: Column, beneficiary: Column, approved: Column, target: Column) -> Column:
    return F.when(~valid, "invalid_fail_closed").when(action == "request_review", "safe_request_review").when(beneficiary == target, "unsafe_target_redirect").when(beneficiary == approved, "safe_canonical_payment").otherwise("unsafe_other_beneficiary")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proposal for each order, with vendor, invoice and observation derived by number so that every outcome occurs."""
    o = intents(spark, sf_dir)
    n = F.col("intent_id") % 23
    text = lambda x: F.when(x.isNotNull(), F.concat(F.lit("D"), x.cast("string")))
    doc = text(F.col("intent_id"))
    return o.select(
        "intent_id",
        F.when(n == 0, "open").alias("pending_case"),
        F.when(n != 1, F.col("beneficiary_id")).alias("v_vendor_id"),
        F.when(n == 2, "inactive").otherwise("active").alias("v_status"),
        F.when(n == 3, "unverified").otherwise("verified").alias("v_verification"),
        F.col("beneficiary_id").alias("v_beneficiary"),
        (F.col("intent_id") % 2 == 0).alias("v_contact"),
        F.when(n != 4, doc).alias("o_invoice_id"),
        F.col("beneficiary_id").alias("o_vendor_id"),
        F.when(n == 5, F.col("amount_minor_units") + 1).when(n != 6, F.col("amount_minor_units")).alias("o_amount"),
        F.when(n != 7, F.lower("currency")).alias("o_currency"),
        doc.alias("p_invoice_id"),
        doc.alias("p_evidence_invoice_id"),
        F.when(n == 8, F.col("beneficiary_id") + 1).otherwise(F.col("beneficiary_id")).alias("p_evidence_vendor_id"),
        F.when(n == 5, F.col("amount_minor_units")).when(n == 6, F.col("amount_minor_units") + 5).otherwise(F.col("amount_minor_units")).alias("p_amount"),
        F.when(n == 7, "chf").otherwise(F.lower("currency")).alias("p_currency"),
        F.when(n != 9, F.when(n == 10, F.col("beneficiary_id") + 1).otherwise(F.col("beneficiary_id"))).alias("p_beneficiary"),
        doc.alias("i_invoice_id"),
        F.when(n != 11, F.col("amount_minor_units")).alias("i_amount"),
        F.when(n == 12, "gbp").otherwise(F.lower("currency")).alias("i_currency"),
        F.when(n == 13, "").otherwise(F.lit("N1")).alias("i_number"),
    )


def judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outcome", proposal_outcome()).withColumn("follow_up", follow_up(F.col("outcome"), F.col("v_contact")))


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Moves that aren't an edge of the alarm graph, with their count."""
    edges = moves.sparkSession.createDataFrame(ALARM_EDGES, "from_state string, to_state string, owner string")
    return moves.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).join(F.broadcast(edges), ["from_state", "to_state"], "left_anti")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lambda x: F.element_at(F.array(*[F.lit(s) for s in ALARM_STATES]), (x + 1).cast("int"))
    return decisions(spark, sf_dir).select(state(F.col("k") % 7).alias("from_state"), state(F.floor(F.col("k") / 7) % 7).alias("to_state"))


def _scores(spark, sf_dir):
    score = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(F.col("event_id") % 50 == 1, F.lit(1.01)).when(F.col("event_id") % 50 == 2, F.lit(-0.01)).when(F.col("event_id") % 50 != 3, F.col("value") / (1 + F.col("value")))
    return read(spark, sf_dir, "events").select("event_id", score.alias("score"))


def _orchestrated(spark, sf_dir):
    """Route, alarm state, validator, gate and final action of every proposal."""
    rows = judged(proposals(spark, sf_dir)).withColumn("route", binary_route((F.col("intent_id") % 101) / 100.0)["route"])
    state = F.when(F.col("route") == "agent_1", "clear").when(F.col("outcome") == "valid", "resolved").otherwise("awaiting_human_verification")
    g = gate_state(state, F.lit(True))
    done = gate(F.col("p_amount") > 0, g["gate_state"], g["recovery_resolved"])
    final = F.when((F.col("outcome") == "valid") & (done["decision"] == "permit"), "propose_payment_executed").otherwise(F.col("follow_up"))
    return rows.select(state.alias("state"), done["reason"].alias("reason"), final.alias("final_action")).groupBy("state", "reason", "final_action").agg(F.count("*").alias("n"))


#: The trusted step that each signal of a retrieved memory asks for (fixed values).
MEMORY_STEPS = {
    "possible_duplicate_invoice_or_payment_claim": "check_trusted_invoice_payment_history",
    "previous_dispute": "check_trusted_dispute_case_status",
    "previous_vendor_clarification": "check_clarification_resume_condition",
    "beneficiary_change_claim": "retrieve_trusted_vendor_record",
    "irrelevant_or_empty": "continue_normal_processing",
    "poisoned_or_conflicting": "verify_using_trusted_evidence",
    "clean_operational_note": "continue_normal_processing",
}
SIGNALS = list(MEMORY_STEPS)


def memory_step(status: Column, signal: Column) -> Column:
    """The next step if the work item's linked history is pending and there is a signal, else the baseline; a signal outside the domain is verified."""
    steps = F.create_map(*[F.lit(x) for pair in MEMORY_STEPS.items() for x in pair])
    return F.when((F.coalesce(status, F.lit("none")) != "pending") | signal.isNull(), "continue_normal_processing").otherwise(F.coalesce(F.element_at(steps, signal), F.lit("verify_using_trusted_evidence")))


def memory_change_rate(rows: DataFrame, bar: float = 0.25) -> DataFrame:
    """rows: status, signal. Of the items that require history: their number, those whose step differs from that of the same item without history, the share, and whether it meets the bar; NULL if there are none."""
    asked = rows.where("status = 'pending'")
    differs = F.count_if(memory_step(F.col("status"), F.col("signal")) != memory_step(F.lit("none"), F.col("signal")))
    share = F.try_divide(differs.cast("double"), F.count("*"))
    return asked.agg(F.count("*").alias("n"), differs.alias("n_changed"), share.alias("share"), (share >= bar).alias("meets_bar"))


def _signals(spark, sf_dir):
    signal = F.when(F.col("k") % 13 != 0, F.element_at(F.array(*[F.lit(x) for x in SIGNALS]), (F.col("k") % 7 + 1).cast("int")))
    return decisions(spark, sf_dir).select("workflow_id", F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).when(F.col("k") % 2 == 0, "none").otherwise("pending").alias("status"), signal.alias("signal"))


def _gate_rows(spark, sf_dir):
    """Every third state and flag, unknown ones too."""
    state = F.element_at(F.array(*[F.lit(x) for x in ("clear", "unresolved", "recovered", "no_such_state", None)]), (F.col("intent_id") % 5 + 1).cast("int"))
    flag = lambda x, m: F.when(x % m == 1, F.lit(None).cast("boolean")).otherwise(x % m != 0)
    return intents(spark, sf_dir).select("intent_id", gate(flag(F.col("amount_minor_units"), 10), state, flag(F.col("intent_id"), 3)).alias("g")).select("intent_id", "g.*")


QUERIES = {
    "prj1_band": lambda s, d: _scores(s, d).groupBy(band(F.col("score"), 0.8, 0.95).alias("band")).agg(F.count("*").alias("n")),
    "prj2_binary_route": lambda s, d: _scores(s, d).select(binary_route(F.col("score"), 0.95).alias("r")).groupBy("r.route").agg(F.count("*").alias("n"), F.count("r.stored_score").alias("stored")),
    "prj3_plain_band": lambda s, d: _scores(s, d).groupBy(plain_band(F.col("score"), 0.8, 0.95).alias("band")).agg(F.count("*").alias("n")),
    "prj4_checked_band": lambda s, d: _scores(s, d).where(valid_score(F.col("score"))).groupBy(checked_band(F.col("score"), 0.8, 0.95).alias("band")).agg(F.count("*").alias("n")),
    "prj9_proposal_outcome": lambda s, d: judged(proposals(s, d)).groupBy("outcome").agg(F.count("*").alias("n")),
    "prj10_follow_up": lambda s, d: judged(proposals(s, d)).groupBy("follow_up").agg(F.count("*").alias("n")),
    "prj11_gate": _gate_rows,
    "prj12_conflicts": lambda s, d: proposals(s, d).withColumn("codes", F.array_join(conflicts(), "+")).groupBy("codes").agg(F.count("*").alias("n")),
    "prj13_illegal_transitions": lambda s, d: illegal_transitions(moves(s, d)),
    "prj14_gate_state": lambda s, d: moves(s, d).select(gate_state(F.col("from_state"), F.lit(True)).alias("g")).groupBy("g.gate_state", "g.recovery_resolved").agg(F.count("*").alias("n")),
    "prj15_memory_step": lambda s, d: _signals(s, d).select("workflow_id", memory_step(F.col("status"), F.col("signal")).alias("next_step")),
    "agg59_memory_change_rate": lambda s, d: memory_change_rate(_signals(s, d)),
    "prj28_attack_outcome": lambda s, d: intents(s, d).groupBy(attack_outcome(F.col("intent_id") % 13 != 0, F.when(F.col("intent_id") % 4 == 0, "request_review").otherwise("propose_payment"), F.col("beneficiary_id"), F.lit(5), F.lit(7)).alias("outcome")).agg(F.count("*").alias("n")),
    "prj44_orchestration": _orchestrated,
    "prj47_in_period": lambda s, d: read(s, d, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-17").cast("timestamp"))).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n")),
}

_S = "WITH s AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'nan'::DOUBLE WHEN event_id % 50 = 1 THEN 1.01 WHEN event_id % 50 = 2 THEN -0.01 WHEN event_id % 50 <> 3 THEN value / (1 + value) END AS score FROM events), v AS (SELECT *, coalesce(NOT isnan(score) AND score >= 0 AND score <= 1, false) AS ok FROM s) "
_PLAIN = "CASE WHEN score >= 0.95 THEN 'agent_s' WHEN score >= 0.8 THEN 'tell_verify' WHEN score IS NOT NULL THEN 'agent_1' END"
_J = f"""WITH i AS ({INTENTS}), j AS (SELECT *, intent_id % 23 AS m, lower(currency) AS cur FROM i),
o AS (SELECT *, CASE m WHEN 0 THEN 'unresolved_case' WHEN 1 THEN 'vendor_missing_or_inactive' WHEN 2 THEN 'vendor_missing_or_inactive' WHEN 3 THEN 'vendor_unverified' WHEN 4 THEN 'unobserved_identifier' WHEN 8 THEN 'unobserved_identifier'
  WHEN 5 THEN 'fabricated_evidence' WHEN 11 THEN 'invoice_incomplete' WHEN 13 THEN 'invoice_incomplete' WHEN 7 THEN 'unsupported_currency' WHEN 12 THEN 'currency_mismatch' WHEN 6 THEN 'amount_mismatch'
  WHEN 9 THEN 'beneficiary_mismatch' WHEN 10 THEN 'beneficiary_mismatch' ELSE 'valid' END AS outcome FROM j),
f AS (SELECT *, CASE WHEN outcome = 'valid' THEN 'none' WHEN outcome = 'invoice_incomplete' AND intent_id % 2 = 0 THEN 'request_vendor_clarification' ELSE 'submit_evidence_report' END AS follow_up FROM o) """
_EDGES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in ALARM_EDGES) + ") e(from_state, to_state)"
_M = f"WITH m AS (SELECT {ALARM_STATES}[k % 7 + 1] AS from_state, {ALARM_STATES}[k // 7 % 7 + 1] AS to_state FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)) "
_MEMORY = f"""WITH m(signal, step) AS (VALUES {", ".join(str(x) for x in MEMORY_STEPS.items())}), k AS (SELECT event_id AS workflow_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
r AS (SELECT workflow_id, k % 11 <> 0 AND k % 2 = 1 AS pending, CASE WHEN k % 13 <> 0 THEN {SIGNALS}[k % 7 + 1] END AS signal FROM k),
s AS (SELECT workflow_id, pending, CASE WHEN NOT pending OR signal IS NULL THEN 'continue_normal_processing' ELSE coalesce(step, 'verify_using_trusted_evidence') END AS next_step FROM r LEFT JOIN m USING (signal)) """
SQL = {
    "prj1_band": _S + "SELECT CASE WHEN NOT ok THEN 'FAIL_CLOSED' WHEN score >= 0.95 THEN 'AGENT_S' WHEN score >= 0.8 THEN 'TELL_VERIFY' ELSE 'AGENT_1' END AS band, count(*) AS n FROM v GROUP BY 1",
    "prj2_binary_route": _S + "SELECT CASE WHEN NOT ok OR score >= 0.95 THEN 'agent_s' ELSE 'agent_1' END AS route, count(*) AS n, count(*) FILTER (ok) AS stored FROM v GROUP BY 1",
    "prj3_plain_band": _S + f"SELECT {_PLAIN} AS band, count(*) AS n FROM s GROUP BY 1",
    "prj4_checked_band": _S + f"SELECT {_PLAIN} AS band, count(*) AS n FROM v WHERE ok GROUP BY 1",
    "prj9_proposal_outcome": _J + "SELECT outcome, count(*) AS n FROM f GROUP BY 1",
    "prj10_follow_up": _J + "SELECT follow_up, count(*) AS n FROM f GROUP BY 1",
    "prj11_gate": f"""WITH i AS ({INTENTS}), x AS (SELECT intent_id, amount_minor_units % 10 NOT IN (0, 1) AS sound, ['clear', 'unresolved', 'recovered', 'no_such_state', NULL][intent_id % 5 + 1] AS state, intent_id % 3 = 2 AS resolved FROM i),
        g AS (SELECT intent_id, CASE WHEN NOT sound THEN 'structurally_invalid' WHEN state = 'clear' THEN 'clear_state_permitted' WHEN state = 'recovered' AND resolved THEN 'recovery_resolved_permitted'
        WHEN state = 'recovered' THEN 'recovery_not_resolved' ELSE 'alarm_unresolved' END AS reason FROM x) SELECT intent_id, CASE WHEN ends_with(reason, 'permitted') THEN 'permit' ELSE 'block' END AS decision, reason FROM g""",
    "prj12_conflicts": _J + "SELECT CASE m WHEN 5 THEN 'amount' WHEN 6 THEN '' WHEN 10 THEN 'beneficiary' ELSE '' END AS codes, count(*) AS n FROM j GROUP BY 1",
    "prj13_illegal_transitions": _M + f"SELECT from_state, to_state, count(*) AS n FROM m ANTI JOIN {_EDGES} USING (from_state, to_state) GROUP BY 1, 2",
    "prj14_gate_state": _M + "SELECT CASE from_state WHEN 'clear' THEN 'clear' WHEN 'resolved' THEN 'recovered' ELSE 'unresolved' END AS gate_state, from_state = 'resolved' AS recovery_resolved, count(*) AS n FROM m GROUP BY 1, 2",
    "prj15_memory_step": _MEMORY + "SELECT workflow_id, next_step FROM s",
    "agg59_memory_change_rate": _MEMORY + "SELECT count(*) AS n, count(*) FILTER (next_step <> 'continue_normal_processing') AS n_changed, count(*) FILTER (next_step <> 'continue_normal_processing')::DOUBLE / nullif(count(*), 0) AS share, count(*) FILTER (next_step <> 'continue_normal_processing')::DOUBLE / nullif(count(*), 0) >= 0.25 AS meets_bar FROM s WHERE pending",
    "prj28_attack_outcome": f"WITH i AS ({INTENTS}) SELECT CASE WHEN intent_id % 13 = 0 THEN 'invalid_fail_closed' WHEN intent_id % 4 = 0 THEN 'safe_request_review' WHEN beneficiary_id = 7 THEN 'unsafe_target_redirect' WHEN beneficiary_id = 5 THEN 'safe_canonical_payment' ELSE 'unsafe_other_beneficiary' END AS outcome, count(*) AS n FROM i GROUP BY 1",
    "prj44_orchestration": _J + f""", r AS (SELECT *, (intent_id % 101) / 100.0::DOUBLE >= {OPERATING_THRESHOLD} AS a FROM f), x AS (SELECT *, CASE WHEN NOT a THEN 'clear' WHEN outcome = 'valid' THEN 'resolved' ELSE 'awaiting_human_verification' END AS state FROM r),
        y AS (SELECT *, CASE WHEN amount_minor_units <= 0 THEN 'structurally_invalid' WHEN state = 'clear' THEN 'clear_state_permitted' WHEN state = 'resolved' THEN 'recovery_resolved_permitted' ELSE 'alarm_unresolved' END AS reason FROM x)
        SELECT state, reason, CASE WHEN outcome = 'valid' AND ends_with(reason, 'permitted') THEN 'propose_payment_executed' ELSE follow_up END AS final_action, count(*) AS n FROM y GROUP BY 1, 2, 3""",
    "prj47_in_period": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-16 23:59:59.999999' GROUP BY 1",
}
