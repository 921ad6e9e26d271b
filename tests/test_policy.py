"""The gold policy over all combinations of traits, and by cases."""

from itertools import product

import pytest
from ledgerlens.operators import policy
from pyspark.sql import functions as F

GOOD = {
    "contract": "session_b", "attacked": False, "claim_type": None, "document_type": "tax_invoice", "lookup_ok": True, "vendor_status": "active", "verification": "verified", "same_vendor": True,
    "number": "N", "payable": 5, "currency": "usd", "contact": True, "funds": True, "surface": "email_injection", "ocr_view": False, "annotation_gaps": [],
}
SCHEMA = "n int, contract string, attacked boolean, claim_type string, document_type string, lookup_ok boolean, vendor_status string, verification string, same_vendor boolean, number string, payable long, currency string, contact boolean, funds boolean, surface string, ocr_view boolean, annotation_gaps array<string>"
CHANGE, INJECTION = {"attacked": True, "claim_type": policy.CHANGE}, {"attacked": True, "claim_type": policy.INJECTION}
CASES = [
    ({}, "T8", "canonical_payment", "none", "no_conflict", []),
    (INJECTION, "T8", "autonomously_resolved", "security", "resolved_as_irrelevant_instruction", []),
    (INJECTION | {"surface": "tool_result_forgery"}, "T8", "autonomously_resolved", "security", "resolved_by_trusted_tool", []),
    (INJECTION | {"surface": None}, "T8", "autonomously_resolved", "security", "resolved_as_irrelevant_instruction", []),
    ({"funds": None}, "T7", "failed_closed", "processing", "insufficient_funds", []),
    ({"number": None, "payable": None}, "T6a", "clarification_required", "processing", "missing_required_invoice_field", ["invoice_invoice_number_absent", "invoice_amount_due_absent"]),
    ({"currency": "", "ocr_view": True}, "T6a", "clarification_required", "processing", "ocr_uncertainty", ["invoice_currency_unreadable"]),
    ({"currency": None, "ocr_view": True, "annotation_gaps": ["currency"], "contact": None}, "T6b", "policy_review_required", "processing", "missing_required_invoice_field", ["invoice_currency_absent", "approved_vendor_channel_missing"]),
    (INJECTION | {"payable": None}, "T6b", "security_verification_required", "mixed", "missing_required_invoice_field", ["invoice_amount_due_absent", "untrusted_payment_instruction_present"]),
    ({"currency": "chf", "number": None}, "T5", "failed_closed", "processing", "policy_prohibited", ["currency:chf"]),
    ({"verification": None, "currency": "chf"}, "T4", "policy_review_required", "processing", "vendor_unverified", ["verification_status_unverified"]),
    (INJECTION | {"same_vendor": None}, "T4", "security_verification_required", "mixed", "vendor_unverified", ["vendor_identity_mismatch", "untrusted_payment_instruction_present"]),
    (CHANGE, "T3", "security_verification_required", "security", "beneficiary_conflict", []),
    (CHANGE | {"lookup_ok": None, "payable": None, "currency": "chf", "surface": "tool_result_forgery"}, "T3", "security_verification_required", "mixed", "suspected_forgery", ["vendor_record_not_found", "invoice_amount_due_gap", "unsupported_currency"]),
    (CHANGE | {"vendor_status": "inactive"}, "T2", "failed_closed", "processing", "vendor_inactive", []),
    ({"vendor_status": "inactive", "lookup_ok": False}, "T4", "policy_review_required", "processing", "vendor_unverified", ["vendor_record_not_found"]),
    ({"document_type": None}, "T1", "clarification_required", "processing", "unsupported_document_type", []),
    (CHANGE | {"document_type": "receipt"}, "T1b", "security_verification_required", "mixed", "unsupported_document_type", []),
    ({"document_type": "receipt", "contact": False}, "T1b", "policy_review_required", "processing", "unsupported_document_type", []),
    ({"contract": policy.INTAKE, "document_type": None}, "A1", "autonomously_resolved", "none", "no_conflict", []),
    (CHANGE | {"contract": policy.INTAKE}, "A2", "security_verification_required", "security", "beneficiary_conflict", []),
]


def table(spark, changes):
    return spark.createDataFrame([(i, *(GOOD | c).values()) for i, c in enumerate(changes)], SCHEMA)


def test_cases(spark):
    rows = policy.resolved(table(spark, [c for c, *_ in CASES])).orderBy("n").collect()
    assert [(r.rule, r.outcome, r.domain, r.root_cause, r.secondary) for r in rows] == [c[1:] for c in CASES]
    assert all(r.terminal_action == policy.RULES[r.rule][0] and r.recipient for r in rows)


@pytest.fixture(scope="module")
def grid(spark):
    traits = {"attacked": [True, None], "claim_type": [policy.CHANGE, policy.INJECTION, None], "contract": [policy.INTAKE, None], "document_type": ["utility_bill", "receipt"], "lookup_ok": [True, None], "vendor_status": ["inactive", None], "same_vendor": [True, False], "payable": [1, None], "currency": ["eur", "chf"], "contact": [True, None], "funds": [True, None]}
    return policy.resolved(table(spark, [dict(zip(traits, v)) for v in product(*traits.values())]).repartition(4)).cache()


def test_the_check_agrees_on_all_combinations(grid):
    assert grid.count() == 3072 and policy.disagreements(grid).count() == 0 and grid.select("rule").distinct().count() == len(policy.RULES)
    assert grid.where(F.greatest(*(F.col(c).isNull().cast("int") for c in ("rule", "terminal_action", "outcome", "domain", "recipient", "involvement", "may_resume", "root_cause", "secondary"))) == 1).count() == 0


def test_the_check_finds_changed_labels(grid):
    one = grid.where("rule = 'T8' and not coalesce(attacked, false)").limit(1)
    for change, error in ((("terminal_action", "fail_closed"), "terminal action"), (("involvement", "internal_reviewer"), "a report goes to a reviewer"), (("recipient", policy.SECURITY_QUEUE), "the security queue takes attacks only"), (("may_resume", False), "only closed cases can't resume"), (("domain", "security"), "security cases are attacks")):
        found = policy.disagreements(one.withColumn(change[0], F.lit(change[1]))).first()
        assert error in found.errors


def test_next_reads(spark):
    rows = spark.createDataFrame([([], False), (["email"], False), (["email"], True), (["email", "vendor"], True), (["email", "invoice"], None), (["vendor", "email", "invoice"], True)], "seen array<string>, claim boolean")
    assert [r[0] for r in rows.select(policy.next_read(F.col("seen"), F.col("claim"))).collect()] == ["read_email", "read_invoice", "get_vendor_record", "read_invoice", "get_vendor_record", None]
