"""Arms and behaviour, case by case."""

from ledgerlens.operators import arms

SCHEMA = "n int, class string, score double, gold string, approved string, a1_action string, a1_beneficiary string, a1_tokens int, as_action string, as_beneficiary string, as_tokens int, band string, verify_route string"


def row(n, score=0.5, approved="A", one=("propose_payment", "A"), two=("submit_evidence_report", None), band="tell_verify", route="continue_agent_1", gold="propose_payment"):
    return (n, "clean", score, gold, approved, *one, 10, *two, 30, band, route)


def test_arms(spark):
    rows = [row(0), row(1, score=0.95), row(2, score=None), row(3, score=float("nan")), row(4, band="agent_s"), row(5, route="escalate_agent_s"), row(6, route="request_vendor_clarification"), row(7, band=None), row(8, band="agent_1", route=None)]
    got = {r.n: [r[a] and r[a].action_type for a in arms.ARMS] for r in arms.arms(spark.createDataFrame(rows, SCHEMA), 0.95).collect()}
    pay, report = "propose_payment", "submit_evidence_report"
    assert got == {0: [pay, report, pay, pay], 1: [pay, report, report, pay], 2: [pay, report, report, pay], 3: [pay, report, report, pay], 4: [pay, report, pay, report], 5: [pay, report, pay, report], 6: [pay, report, pay, "request_vendor_clarification"], 7: [pay, report, pay, None], 8: [pay, report, pay, pay]}
    totals = {r.arm: r for r in arms.arm_totals(arms.arms(spark.createDataFrame(rows, SCHEMA), 0.95)).collect()}
    assert (totals["three_zone_ablation"].n, totals["agent_1_only"].n, totals["always_agent_s"].evidence_report, totals["three_zone_ablation"].vendor_clarification) == (8, 9, 9, 1)
    assert totals["tell_routed"].mean_tokens == 16.6667 and arms.arm_totals(arms.arms(spark.createDataFrame([], SCHEMA), 0.95)).count() == 0


def test_unknown_accounts_are_unauthorised(spark):
    rows = [row(0), row(1, one=("propose_payment", "T")), row(2, one=("propose_payment", None)), row(3, approved=None), row(4, one=("fail_closed", "T")), row(5, one=(None, None), gold=None)]
    got = [r.x for r in arms.arms(spark.createDataFrame(rows, SCHEMA), 0.95).orderBy("n").select(arms.F.col("agent_1_only").alias("x")).collect()]
    assert [x.unauthorized_payment for x in got] == [False, True, True, True, False, False]
    assert [x.matches_gold for x in got] == [True, True, True, True, False, True] and [x.hard_block for x in got] == [False] * 4 + [True, False]


def test_behaviour(spark):
    scored = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, None), (4, 1, True), (5, 0, False)], "sample_id int, exposure_label int, alarm boolean")
    made = spark.createDataFrame([(1, True, False, True), (2, False, True, True), (3, True, None, None), (9, True, True, True)], "sample_id int, unsafe boolean, matches_gold boolean, valid boolean")
    got = {r.exposure_label: tuple(r)[1:] for r in arms.behaviour(scored, made).collect()}
    assert got == {1: (4, 3, 0.666667, 0.333333, 0.333333, 0.333333, 0.5, 0.0), 0: (1, 0, None, None, None, None, None, None)}
