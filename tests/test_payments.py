"""Payment intents over hand-made cases, in batch and as a stream."""

import pytest
from ledgerlens.operators import payments
from ledgerlens.streaming import payments as stream

ACCOUNTS = [("c1", "company", "usd", 1000), ("c2", "company", "usd", 50), ("c3", "company", "eur", 1000), ("s1", "supplier", "usd", 0), ("s2", "supplier", "eur", 0)]
INVOICES = [("f1", "usd"), ("f2", "eur")]


def create(seq, intent, invoice="f1", source="c1", to="s1", amount=100, currency="usd"):
    return (seq, "create", intent, invoice, source, to, amount, currency, None)


def decide(seq, intent, decision="permit"):
    return (seq, "decide", intent, None, None, None, None, None, decision)


def execute(seq, intent):
    return (seq, "execute", intent, None, None, None, None, None, None)


#: (command, outcome)
CASES = [
    (create(1, "a"), "payment_intent_created"),
    (execute(2, "a"), "execution_rejected_not_permitted"),
    (decide(3, "a"), "permitted"),
    (decide(4, "a", "block"), "gate_decision_already_recorded"),
    (execute(5, "a"), "payment_executed"),
    (execute(6, "a"), "duplicate_execution_rejected"),
    (create(7, "a"), "duplicate_intent"),
    (create(10, "b"), "payment_intent_created"),
    (decide(11, "b", "block"), "blocked"),
    (execute(12, "b"), "execution_rejected_not_permitted"),
    (create(20, "c", amount=0), "invalid_amount"),
    (create(21, "c", amount=None), "invalid_amount"),
    (create(22, "c", amount=-5, currency="xyz"), "invalid_amount"),
    (create(23, "c", currency="USD"), "unsupported_currency"),
    (create(24, "c", currency=None), "unsupported_currency"),
    (create(25, "c", invoice="f9"), "unknown_invoice"),
    (create(26, "c", invoice=None), "unknown_invoice"),
    (create(27, "c", invoice="f2"), "currency_mismatch"),
    (create(28, "c", source="nobody"), "unknown_account"),
    (create(29, "c", to=None), "unknown_account"),
    (create(30, None), "missing_intent_id"),
    (decide(31, "c"), "unknown_intent"),
    (execute(32, "c"), "unknown_intent"),
    (decide(33, None), "unknown_intent"),
    (create(40, "d", source="c2", amount=60), "payment_intent_created"),
    (create(41, "e", source="c2", amount=30), "payment_intent_created"),
    (create(42, "g", source="c2", amount=20), "payment_intent_created"),
    (create(43, "h", source="c2", amount=1), "payment_intent_created"),
    *((decide(50 + i, x), "permitted") for i, x in enumerate("degh")),
    (execute(60, "d"), "insufficient_funds"),
    (execute(61, "e"), "payment_executed"),
    (execute(62, "d"), "insufficient_funds"),
    (execute(63, "g"), "payment_executed"),
    (execute(64, "h"), "insufficient_funds"),
    (execute(65, "e"), "duplicate_execution_rejected"),
    (create(70, "k", source="c3"), "payment_intent_created"),
    (decide(71, "k", "maybe"), "invalid_decision"),
    (decide(72, "k", None), "invalid_decision"),
    (decide(73, "k"), "permitted"),
    (execute(74, "k"), "currency_mismatch"),
    (create(80, "m", amount=900), "payment_intent_created"),
    (decide(81, "m"), "permitted"),
    (execute(82, "m"), "payment_executed"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(INVOICES, "invoice_id string, currency string"), spark.createDataFrame(ACCOUNTS, "account_id string, account_type string, currency string, balance long")


def test_batch(spark, tables):
    commands = spark.createDataFrame([c for c, _ in reversed(CASES)], stream.COMMAND_SCHEMA).repartition(3)
    made, decided, executed = payments.ledger(commands, *tables)
    got = {r.seq: r.event_type for r in payments.audit(made, decided, executed).collect()}
    assert got == {c[0]: outcome for c, outcome in CASES}
    entries = payments.journal(executed)
    assert payments.unbalanced(entries).count() == 0 and entries.count() == 8
    assert payments.unbalanced(entries.where("direction = 'debit' or intent_id <> 'a'")).count() == 1
    assert {r.account_id: r.balance for r in payments.balances(tables[1], entries).collect()} == {"c1": 0, "c2": 0, "c3": 1000, "s1": 1050, "s2": 0}


def test_no_commands(spark, tables):
    made, decided, executed = payments.ledger(spark.createDataFrame([], stream.COMMAND_SCHEMA), *tables)
    assert made.count() == decided.count() == executed.count() == 0


def test_stream_in_batches_and_after_a_restart(spark, tables, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    folder = str(tmp_path / "commands")
    source = lambda: spark.readStream.schema(stream.COMMAND_SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    cuts = [0, 6, 30, len(CASES)]
    for a, b in zip(cuts, cuts[1:]):  # each part is a query of its own over one checkpoint
        spark.createDataFrame([c for c, _ in CASES[a:b]], stream.COMMAND_SCHEMA).coalesce(1).write.mode("append").json(folder)
        stream.write_outcomes(source(), *tables, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.seq, r.outcome) for r in got.collect()) == sorted((c[0], outcome) for c, outcome in CASES)
    assert payments.unbalanced(payments.journal(got)).count() == 0
    assert {r.account_id: r.balance for r in payments.balances(tables[1], payments.journal(got)).collect()} == {"c1": 0, "c2": 0, "c3": 1000, "s1": 1050, "s2": 0}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
