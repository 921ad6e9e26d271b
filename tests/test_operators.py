"""Operators on rows whose result is known by hand."""

import hashlib
import json
import math

from ledgerlens.functions import scalars
from ledgerlens.operators import corpus, rates, registers, rules, sequences, thresholds
from pyspark.sql import functions as F


def test_auroc_and_precision_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.1, 1)], "score double, exposure_label int")
    assert thresholds.auroc(thresholds.running_counts(thresholds.score_counts(rows))).first()[0] == 0.625
    more = rows.union(spark.createDataFrame([(0.9, 0)], rows.schema))
    assert math.isclose(thresholds.average_precision(thresholds.running_counts(thresholds.score_counts(more))).first()[0], 0.542857, abs_tol=1e-6)


def test_one_class_only_has_no_auroc(spark):
    rows = spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, exposure_label int")
    assert thresholds.auroc(thresholds.running_counts(thresholds.score_counts(rows))).first()[0] is None


def test_invalid_scores_fail_closed(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (-0.01,), (1.01,), (None,), (1.0,), (0.0,)], "score double")
    assert [r[0] for r in rows.select(rules.band(F.col("score"), 0.3, 0.7)).collect()] == ["FAIL_CLOSED"] * 6 + ["AGENT_S", "AGENT_1"]


def test_confusion_of_no_rows(spark):
    rows = spark.createDataFrame([], "ground_truth_class string, routed_agent string")
    found = rates.confusion(rows).first()
    assert (found.tp, found.recall, rates.invocation_rate(rows).first()[0]) == (0, None, 0.0)


def test_hash_chain(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y")], "run_id long, step int, action string, args string")
    h = ""
    for e in ("0:a:x", "1:b:y"):
        h = hashlib.sha256((h + e).encode()).hexdigest()
    assert sequences.hash_chain(rows).first().hash == h


def test_repeat_needs_success_and_freshness(spark):
    rows = spark.createDataFrame([(1, 0, "read_email", "x", True, False), (1, 1, "read_email", "x", False, False), (1, 2, "read_email", "x", True, True), (1, 3, "read_email", "x", True, False)], "run_id long, step int, action string, args string, success boolean, stale boolean")
    assert [r.repeat for r in sequences.with_repeats(rows).orderBy("step").collect()] == [False, True, False, False]


def test_hash_chain_of_a_long_run(spark):
    events = [(r, i, f"a{i % 7}", 'é "x"') for r, n in ((1, 130), (2, 51), (3, 1)) for i in range(n)]

    def last(rows, seed, text):
        out = {}
        for r, i, a, x in rows:
            out[r] = hashlib.sha256((out.get(r, seed) + text(i, a, x)).encode()).hexdigest()
        return out

    def table(rows):
        return spark.createDataFrame(rows[::-1], "run_id long, step int, action string, args string")

    def canon(i, a, x):
        return json.dumps({"step": i, "action": a, "args": x}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    assert {r.run_id: r.hash for r in sequences.hash_chain(table(events)).collect()} == last(events, "", lambda *e: ":".join(map(str, e)))
    found = {r.run_id: r.hash for r in sequences.reference_chain(table(events)).collect()}
    assert found == last(events, "0" * 64, canon)
    changed = [(r, i, "other" if (r, i) == (1, 3) else a, x) for r, i, a, x in events]
    again = {r.run_id: r.hash for r in sequences.reference_chain(table(changed)).collect()}
    assert again[1] != found[1] and again[2] == found[2]


def test_a_hot_stratum_is_ranked_by_several_tasks(spark):
    pool = spark.createDataFrame([(i, "hot" if i % 10 else None) for i in range(3000)], "sample_id long, stratum string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = corpus.stratified(pool, "stratum", 0.5, "s").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    order = sorted((i for i in range(3000) if i % 10), key=lambda i: hashlib.sha256(f"s:stratum:{i}".encode()).hexdigest())
    assert {r.sample_id for r in found if r.stratum} == set(order[:1350]) and sum(r.stratum is None for r in found) == 150
    assert len({r.task for r in found if r.stratum}) > 1


def test_unknown_values_fail_closed(spark):
    rows = spark.createDataFrame([(True, None, None), (True, "no_such_state", False), (None, "clear", True), (True, "recovered", None), (True, "clear", None), (True, "recovered", True)], "ok boolean, state string, resolved boolean")
    assert [r[0] for r in rows.select(rules.gate(F.col("ok"), F.col("state"), F.col("resolved"))["decision"]).collect()] == ["block"] * 4 + ["permit"] * 2
    good = {"pending_case": None, "v_vendor_id": 1, "v_status": "active", "v_verification": "verified", "v_beneficiary": 1, "o_invoice_id": "D", "o_vendor_id": 1, "o_amount": 5, "o_currency": "usd", "p_invoice_id": "D", "p_evidence_invoice_id": "D", "p_evidence_vendor_id": 1, "p_amount": 5, "p_currency": "usd", "p_beneficiary": 1, "i_invoice_id": "D", "i_amount": 5, "i_currency": "usd", "i_number": "N"}
    optional = {"pending_case", "o_amount", "o_currency"}
    cases = [good] + [good | {k: None} for k in good if k not in optional]
    types = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in good.items())
    found = [r[0] for r in spark.createDataFrame([tuple(c.values()) for c in cases], types).select(rules.proposal_outcome()).collect()]
    assert found[0] == "valid" and "valid" not in found[1:]


def test_memory_steps(spark):
    rows = spark.createDataFrame([("pending", "previous_dispute"), ("none", "previous_dispute"), ("pending", None), (None, "previous_dispute"), ("pending", "clean_operational_note")], "status string, signal string")
    assert [r[0] for r in rows.select(rules.memory_step(F.col("status"), F.col("signal"))).collect()] == ["check_trusted_dispute_case_status", "continue_normal_processing", "continue_normal_processing", "continue_normal_processing", "continue_normal_processing"]
    assert tuple(rules.memory_change_rate(rows).first()) == (3, 1, 1 / 3, True)
    assert tuple(rules.memory_change_rate(rows.limit(0)).first()) == (0, 0, None, None)
    odd = spark.createDataFrame([("pending", "no such signal")], rows.schema)
    assert odd.select(rules.memory_step(F.col("status"), F.col("signal"))).first()[0] == "verify_using_trusted_evidence"


STEP = "run_id long, step int, action string, args string, success boolean, stale boolean, score double"


def test_routing_is_decided_once(spark):
    sources = ["read_email", "read_invoice", "get_vendor_record"]
    run = lambda r, actions, scores, failed=(): [(r, i, a, "x", i not in failed, False, s) for i, (a, s) in enumerate(zip(actions, scores))]
    rows = [
        *run(1, [*sources, "finish", "finish"], [0.99, 0.99, 0.99, 0.5, 0.99]),  # early and late readings only monitor
        *run(2, [*sources, "finish", "finish"], [0.1, 0.1, 0.1, 0.96, 0.1]),
        *run(3, [*sources, "finish"], [0.1, 0.1, 0.1, 0.85]),
        *run(4, [*sources, "finish"], [0.99] * 4, failed={2}),  # never had the vendor record
        *run(5, [*sources, "finish"], [0.1, 0.1, 0.1, None]),  # fails closed
    ]
    table = spark.createDataFrame(rows, STEP)
    got = {r.run_id: (r.since, r.decision, r.second_agent_steps) for r in sequences.latch(table, 0.95, 0.8).collect()}
    assert got == {1: (3, "clear", 0), 2: (3, "alarm", 2), 3: (3, "verify", 1), 4: (None, None, 0), 5: (3, "alarm", 1)}
    assert {r.run_id for r in sequences.routing_decisions(table, 0.95, 0.8).collect()} == {1, 2, 3, 5}


def test_history_and_prefetched_sources(spark):
    schema = STEP + ", history_required boolean, prefetched_sources array<string>"
    read = ["read_email", "read_invoice", "get_vendor_record"]
    run = lambda r, actions, history, had: [(r, i, a, "x", True, False, 0.1, history, had) for i, a in enumerate(actions)]
    rows = [*run(1, [*read, "finish"], True, None), *run(2, [*read, "finish"], True, ["memory"]), *run(3, [*read, "search_memory", "finish"], True, None), *run(4, [*read, "search_memory", "finish"], False, None), *run(5, ["read_email", "read_invoice", "get_vendor_record", "finish"], None, ["email"])]
    table = spark.createDataFrame(rows, schema)
    assert [r.run_id for r in sequences.with_seen(table).where("premature").collect()] == [1]
    found = sequences.trajectory_rates(table).first()
    assert (found.tool_calls, found.unnecessary, found.terminals, found.premature) == (17, 2, 5, 1)


def test_loops_are_of_reads(spark):
    rows = [(1, 0, "finish", "x", True, False, 0.1), (1, 1, "finish", "x", True, False, 0.1), (2, 0, "read_email", "x", False, False, 0.1), (2, 1, "read_email", "x", True, False, 0.1), (2, 2, "read_email", "x", True, False, 0.1)]
    assert [tuple(r) for r in sequences.loops(spark.createDataFrame(rows, STEP)).collect()] == [(2, 1)]


def test_a_run_without_success_is_at_the_first_stage(spark):
    rows = [(1, 0, "read_email", "x", False, False, 0.1), *((2, i, a, "x", True, False, 0.1) for i, a in enumerate(registers.STAGES)), (3, 0, "read_invoice", "x", True, False, 0.1)]
    assert {r.run_id: r.stage for r in registers.active_stage(spark.createDataFrame(rows, STEP)).collect()} == {1: "read_email", 2: None, 3: "read_email"}


def test_ibans(spark):
    rows = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",), ("12345",), ("de89370400440532013000",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(scalars.iban_valid(F.col("t"))).collect()] == [True, False, None, True, None, None]


def test_economics(spark):
    schema = "workflows double, input_tokens double, output_tokens double, usd_in double, usd_out double, hardware double, opex double, months int, seconds double"
    rows = [(1000.0, 2e5, 1e5, 1.0, 2.0, 1200.0, 100.0, 12, 36.0), (10.0, 2e5, 1e5, 1.0, 2.0, 1200.0, 100.0, 12, 36.0), (10.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 12, 0.0), (None,) * 9]
    got = scalars.economics(spark.createDataFrame(rows, schema)).select("cost", "avoided", "break_even_months", "needed_savings", "required_workflows", "least_workflows", "net_savings", "serial_hours").collect()
    assert [round(x, 6) for x in got[0]] == [0.4, 300.0, 4.0, 200.0, 500.0, 500, 2400.0, 10.0]
    assert got[1].break_even_months is None and got[1].net_savings < 0 and got[2].required_workflows is None and got[2].least_workflows is None and set(got[3]) == {None}
