"""Payment intents in batch: created, decided once, executed once, with balanced entries and an audit trail.

Commands carry a number `seq`, the order in which they count. Each command gets an outcome; nothing is dropped. Rules are
checked in the order in which they are listed below, and the first that fails names the outcome.

What depends on one intent only is decided by joins and first rows of an intent. Funds depend on all requests of an
account, in order: an account whose requests all fit its balance needs no order and is decided by a sum; the requests of
the others are sorted by account and folded in one pass that holds one number an account. Credits of a run count for the
next run's balances only, so an account's funds never depend on another account's.

Defined results. A NULL amount, currency, id or decision fails its rule like an unknown value. invoices and accounts have one
row a key. `ledgerlens.streaming.payments` gives the same outcomes over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.shared import settled
from ledgerlens.sources.tables import read

#: Supported currencies, decisions and names of outcomes (fixed values).
CURRENCIES = ["usd", "eur", "gbp"]
DECISIONS = {"permit": "permitted", "block": "blocked"}
CREATED, EXECUTED = "payment_intent_created", "payment_executed"
DUPLICATE, NOT_PERMITTED = "duplicate_execution_rejected", "execution_rejected_not_permitted"
NO_FUNDS, MISMATCH, UNKNOWN = "insufficient_funds", "currency_mismatch", "unknown_intent"
AGAIN = "gate_decision_already_recorded"

#: Accounts with opening balances, invoices and numbered commands, from customers, suppliers and orders.
ACCOUNTS = """
SELECT concat('C', cast(c_custkey AS STRING)) AS account_id, 'company' AS account_type, CASE WHEN c_custkey % 7 = 0 THEN 'eur' ELSE 'usd' END AS currency,
       cast(greatest(0, round(c_acctbal * 4000)) AS BIGINT) AS balance FROM customer
UNION ALL SELECT concat('S', cast(s_suppkey AS STRING)), 'supplier', CASE WHEN s_suppkey % 5 = 0 THEN 'eur' ELSE 'usd' END, cast(0 AS BIGINT) FROM supplier
"""
INVOICES = """
SELECT concat('F', cast(o_orderkey AS STRING)) AS invoice_id, CASE WHEN o_orderkey % 19 = 0 THEN 'eur' ELSE 'usd' END AS currency FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 3 > 0
"""
COMMANDS = """
SELECT o_orderkey * 8 + step AS seq, command, concat(CASE WHEN o_orderkey % 29 = 0 AND step = 2 THEN 'X' ELSE 'I' END, cast(o_orderkey AS STRING)) AS intent_id,
       CASE WHEN step < 2 THEN concat('F', cast(o_orderkey AS STRING)) END AS invoice_id, CASE WHEN step < 2 THEN concat('C', cast(o_custkey AS STRING)) END AS source_account_id,
       CASE WHEN step < 2 THEN concat('S', cast(o_orderkey % 12 AS STRING)) END AS beneficiary_account_id,
       CASE WHEN step < 2 THEN cast(CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE round(o_totalprice * 100) END AS BIGINT) END AS amount,
       CASE WHEN step < 2 THEN CASE WHEN o_orderkey % 23 = 0 THEN 'USD' ELSE 'usd' END END AS currency,
       CASE WHEN step IN (2, 3) THEN CASE WHEN o_orderstatus = 'P' THEN 'block' WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'permit' END END AS decision
FROM orders, (VALUES (0, 'create'), (1, 'create'), (2, 'decide'), (3, 'decide'), (4, 'execute'), (5, 'execute')) AS s(step, command)
WHERE step IN (0, 2, 4) OR (step = 1 AND o_orderkey % 13 = 0) OR (step = 3 AND o_orderkey % 17 = 0) OR (step = 5 AND o_orderkey % 7 = 0)
"""


def creation_fault(valid_invoice: Column, invoice_currency: Column, known_accounts: Column) -> Column:
    """Why a create command fails by itself; NULL if it doesn't."""
    return (
        F.when(F.col("intent_id").isNull(), "missing_intent_id")
        .when(F.coalesce(F.col("amount") <= 0, F.lit(True)), "invalid_amount")
        .when(~F.coalesce(F.col("currency").isin(CURRENCIES), F.lit(False)), "unsupported_currency")
        .when(~valid_invoice, "unknown_invoice")
        .when(~F.coalesce(invoice_currency == F.col("currency"), F.lit(False)), MISMATCH)
        .when(~known_accounts, "unknown_account")
    )


def checked(commands: DataFrame, invoices: DataFrame, accounts: DataFrame) -> DataFrame:
    """commands with `fault` of the create commands and `same_currency` of their accounts. Works on streams, too."""
    of = lambda side: accounts.select(F.col("account_id").alias(f"{side}_account_id"), F.col("currency").alias(f"{side}_currency"))
    known = commands.join(invoices.select("invoice_id", F.col("currency").alias("invoice_currency")), "invoice_id", "left").join(of("source"), "source_account_id", "left").join(of("beneficiary"), "beneficiary_account_id", "left")
    fault = creation_fault(F.col("invoice_currency").isNotNull(), F.col("invoice_currency"), F.col("source_currency").isNotNull() & F.col("beneficiary_currency").isNotNull())
    same = F.coalesce((F.col("source_currency") == F.col("currency")) & (F.col("beneficiary_currency") == F.col("currency")), F.lit(False))
    return known.select(*commands.columns, F.when(F.col("command") == "create", fault).alias("fault"), F.when(F.col("command") == "create", same).alias("same_currency"))


def creations(commands: DataFrame) -> DataFrame:
    """seq, intent_id, outcome of every create command: the first without a fault makes the intent. commands: as checked()."""
    rows = commands.where("command = 'create'")
    first = rows.where("fault is null").groupBy("intent_id").agg(F.min("seq").alias("first"))
    outcome = F.coalesce("fault", F.when(F.col("seq") == F.col("first"), CREATED).when(F.col("seq") > F.col("first"), "duplicate_intent"))
    return rows.join(first, "intent_id", "left").withColumn("outcome", outcome).drop("first")


def decisions(commands: DataFrame, intents: DataFrame) -> DataFrame:
    """seq, intent_id, outcome of every decision: the first valid one after the creation counts. intents: created rows."""
    rows = commands.where("command = 'decide'").select("seq", "intent_id", "decision").join(intents.select("intent_id", F.col("seq").alias("created")), "intent_id", "left")
    valid = F.coalesce(F.col("decision").isin(list(DECISIONS)), F.lit(False))
    known = F.coalesce(F.col("created") < F.col("seq"), F.lit(False))
    first = rows.where(valid & known).groupBy("intent_id").agg(F.min("seq").alias("first"))
    taken = F.when(F.col("decision") == "permit", DECISIONS["permit"]).otherwise(DECISIONS["block"])
    return rows.join(first, "intent_id", "left").select("seq", "intent_id", F.when(~valid, "invalid_decision").when(~known, UNKNOWN).when(F.col("seq") == F.col("first"), taken).otherwise(AGAIN).alias("outcome"))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of account and seq; each is funded if the balance still allows it."""
    account, left = None, 0
    for batch in batches:
        out = []
        for now, amount, balance in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if now != account:
                account, left = now, balance
            out.append(amount <= left)
            left -= amount if out[-1] else 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], names=["seq", "funded"])


def funded(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """seq and whether its account pays it: in order of seq, each request that the balance still allows. requests: seq, source_account_id, amount."""
    need = requests.groupBy("source_account_id").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("need"))
    rows = requests.join(need, "source_account_id").join(accounts.select(F.col("account_id").alias("source_account_id"), "balance"), "source_account_id")
    easy = rows.where("need <= balance").select("seq", F.lit(True).alias("funded"))
    short = rows.where("need > balance").select("seq", "source_account_id", "amount", "balance")
    folded = short.where("amount <= balance").repartition("source_account_id").sortWithinPartitions("source_account_id", "seq").mapInArrow(_fold, "seq long, funded boolean")
    return easy.unionByName(folded).unionByName(short.where("amount > balance").select("seq", F.lit(False).alias("funded")))


def executions(commands: DataFrame, intents: DataFrame, decided: DataFrame, accounts: DataFrame) -> DataFrame:
    """seq, intent_id, outcome of every execute command, with the intent's accounts, amount and currency where it has any."""
    known = intents.select("intent_id", F.col("seq").alias("created"), "source_account_id", "beneficiary_account_id", "amount", "currency", "same_currency")
    permits = decided.where(F.col("outcome") == DECISIONS["permit"]).select("intent_id", F.col("seq").alias("permitted"))
    rows = commands.where("command = 'execute'").select("seq", "intent_id").join(known, "intent_id", "left").join(permits, "intent_id", "left")
    rows = rows.withColumn("open", F.coalesce(F.col("permitted") < F.col("seq"), F.lit(False)))
    first = rows.where("open").groupBy("intent_id").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "intent_id", "left")
    requests = rows.where("open and same_currency and seq = first").select("seq", "source_account_id", "amount")
    pays = funded(requests, accounts).withColumnRenamed("seq", "first")
    paid = F.when(~F.col("same_currency"), MISMATCH).when(~F.col("funded"), NO_FUNDS).when(F.col("seq") == F.col("first"), EXECUTED).otherwise(DUPLICATE)
    outcome = F.when(~F.coalesce(F.col("created") < F.col("seq"), F.lit(False)), UNKNOWN).when(~F.col("open"), NOT_PERMITTED).otherwise(paid)
    return rows.join(pays, "first", "left").select("seq", "intent_id", outcome.alias("outcome"), "source_account_id", "beneficiary_account_id", "amount", "currency")


def ledger(commands: DataFrame, invoices: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Creations, decisions and executions. The first two are read several times and kept as checkpoints."""
    made = settled(creations(checked(commands, invoices, accounts)))
    intents = made.where(F.col("outcome") == CREATED)
    decided = settled(decisions(commands, intents))
    return made, decided, executions(commands, intents, decided, accounts)


def journal(executed: DataFrame) -> DataFrame:
    """A debit and a credit for each executed payment."""
    side = lambda name, kind: F.struct(F.col(f"{name}_account_id").alias("account_id"), F.lit(kind).alias("direction"))
    return executed.where(F.col("outcome") == EXECUTED).select("intent_id", F.explode(F.array(side("source", "debit"), side("beneficiary", "credit"))).alias("x"), "amount", "currency").select("intent_id", "x.account_id", "x.direction", "amount", "currency")


def unbalanced(entries: DataFrame) -> DataFrame:
    """Intents whose debits and credits differ, in sum or in number."""
    sums = entries.groupBy("intent_id").agg(*(F.sum(F.when(F.col("direction") == d, F.col("amount")).otherwise(0)).alias(d) for d in ("debit", "credit")), F.count("*").alias("n"))
    return sums.where("debit <> credit or n % 2 = 1").select("intent_id", "debit", "credit")


def balances(accounts: DataFrame, entries: DataFrame) -> DataFrame:
    """Every account's balance after the entries."""
    moved = entries.groupBy("account_id").agg(F.sum(F.when(F.col("direction") == "credit", F.col("amount")).otherwise(-F.col("amount"))).alias("moved"))
    return accounts.join(moved, "account_id", "left").select("account_id", (F.col("balance") + F.coalesce("moved", F.lit(0))).alias("balance"))


def audit(made: DataFrame, decided: DataFrame, executed: DataFrame) -> DataFrame:
    """One event a command: seq, event_type, payload as JSON."""
    rows = [x.select("seq", F.lit(kind).alias("command"), "intent_id", "outcome") for x, kind in ((made, "create"), (decided, "decide"), (executed, "execute"))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.select("seq", F.col("outcome").alias("event_type"), F.to_json(F.struct("intent_id", "command")).alias("payload"))


def tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commands, invoices and accounts."""
    bound = lambda text, *names: spark.sql(_named(text, names), **{n: read(spark, sf_dir, n) for n in names})
    return bound(COMMANDS, "orders"), bound(INVOICES, "orders"), bound(ACCOUNTS, "customer", "supplier")


def _named(text: str, names: tuple) -> str:
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return text


def _ledger(s, d):
    commands, invoices, accounts = tables(s, d)
    return (*ledger(commands, invoices, accounts), accounts)


QUERIES = {
    "str1_creations": lambda s, d: _ledger(s, d)[0].select("seq", "intent_id", "outcome"),
    "str2_decisions": lambda s, d: _ledger(s, d)[1],
    "str3_executions": lambda s, d: _ledger(s, d)[2].select("seq", "intent_id", "outcome"),
    "str3_balances": lambda s, d: (lambda made, decided, executed, accounts: balances(accounts, journal(executed)))(*_ledger(s, d)),
    "str5_journal": lambda s, d: journal(_ledger(s, d)[2]),
    "str6_audit": lambda s, d: audit(*_ledger(s, d)[:3]),
}

_LEDGER = f"""
WITH RECURSIVE cmd AS ({COMMANDS}), inv AS ({INVOICES}), acc AS ({ACCOUNTS}),
mk AS (SELECT c.*, s.currency AS sc, b.currency AS bc,
  CASE WHEN c.intent_id IS NULL THEN 'missing_intent_id' WHEN c.amount IS NULL OR c.amount <= 0 THEN 'invalid_amount' WHEN c.currency IS NULL OR c.currency NOT IN ('usd', 'eur', 'gbp') THEN 'unsupported_currency'
       WHEN i.currency IS NULL THEN 'unknown_invoice' WHEN i.currency <> c.currency THEN 'currency_mismatch' WHEN s.currency IS NULL OR b.currency IS NULL THEN 'unknown_account' END AS fault
  FROM cmd c LEFT JOIN inv i USING (invoice_id) LEFT JOIN acc s ON s.account_id = source_account_id LEFT JOIN acc b ON b.account_id = beneficiary_account_id WHERE command = 'create'),
made AS (SELECT *, CASE WHEN fault IS NOT NULL THEN fault WHEN row_number() OVER (PARTITION BY intent_id, fault ORDER BY seq) = 1 THEN 'payment_intent_created' ELSE 'duplicate_intent' END AS outcome FROM mk),
intents AS (SELECT * FROM made WHERE outcome = 'payment_intent_created'),
dk AS (SELECT c.seq, c.intent_id, c.decision, CASE WHEN c.decision IS NULL OR c.decision NOT IN ('permit', 'block') THEN 'invalid_decision' WHEN i.seq IS NULL OR i.seq >= c.seq THEN 'unknown_intent' END AS fault
  FROM cmd c LEFT JOIN intents i USING (intent_id) WHERE c.command = 'decide'),
decided AS (SELECT seq, intent_id, CASE WHEN fault IS NOT NULL THEN fault WHEN row_number() OVER (PARTITION BY intent_id, fault ORDER BY seq) > 1 THEN 'gate_decision_already_recorded' WHEN decision = 'permit' THEN 'permitted' ELSE 'blocked' END AS outcome FROM dk),
ex AS (SELECT c.seq, c.intent_id, i.source_account_id, i.beneficiary_account_id, i.amount, i.currency,
  CASE WHEN i.seq IS NULL OR i.seq >= c.seq THEN 'unknown_intent' WHEN p.seq IS NULL OR p.seq >= c.seq THEN 'execution_rejected_not_permitted' WHEN i.sc <> i.currency OR i.bc <> i.currency THEN 'currency_mismatch' END AS fault
  FROM cmd c LEFT JOIN intents i USING (intent_id) LEFT JOIN (SELECT * FROM decided WHERE outcome = 'permitted') p USING (intent_id) WHERE c.command = 'execute'),
tries AS (SELECT *, row_number() OVER (PARTITION BY intent_id, fault ORDER BY seq) AS try FROM ex),
req AS (SELECT *, row_number() OVER (PARTITION BY source_account_id ORDER BY seq) AS n FROM tries WHERE fault IS NULL AND try = 1),
fold AS (SELECT account_id, cast(0 AS BIGINT) AS n, balance AS rest, cast(NULL AS STRING) AS intent_id, false AS paid FROM acc
  UNION ALL SELECT f.account_id, r.n, CASE WHEN r.amount <= f.rest THEN f.rest - r.amount ELSE f.rest END, r.intent_id, r.amount <= f.rest FROM fold f JOIN req r ON r.source_account_id = f.account_id AND r.n = f.n + 1),
executed AS (SELECT t.seq, t.intent_id, CASE WHEN fault IS NOT NULL THEN fault WHEN NOT f.paid THEN 'insufficient_funds' WHEN try = 1 THEN 'payment_executed' ELSE 'duplicate_execution_rejected' END AS outcome,
  source_account_id, beneficiary_account_id, amount, currency FROM tries t LEFT JOIN fold f ON f.intent_id = t.intent_id),
entries AS (SELECT intent_id, source_account_id AS account_id, 'debit' AS direction, amount, currency FROM executed WHERE outcome = 'payment_executed'
  UNION ALL SELECT intent_id, beneficiary_account_id, 'credit', amount, currency FROM executed WHERE outcome = 'payment_executed')
"""
SQL = {
    "str1_creations": _LEDGER + "SELECT seq, intent_id, outcome FROM made",
    "str2_decisions": _LEDGER + "SELECT * FROM decided",
    "str3_executions": _LEDGER + "SELECT seq, intent_id, outcome FROM executed",
    "str3_balances": _LEDGER + "SELECT a.account_id, CAST(any_value(balance) + coalesce(sum(CASE direction WHEN 'credit' THEN amount ELSE -amount END), 0) AS BIGINT) AS balance FROM acc a LEFT JOIN entries USING (account_id) GROUP BY 1",
    "str5_journal": _LEDGER + "SELECT * FROM entries",
    "str6_audit": _LEDGER + """SELECT seq, outcome AS event_type, '{"intent_id":"' || intent_id || '","command":"' || c || '"}' AS payload FROM (SELECT seq, intent_id, outcome, 'create' AS c FROM made UNION ALL SELECT seq, intent_id, outcome, 'decide' FROM decided UNION ALL SELECT seq, intent_id, outcome, 'execute' FROM executed)""",
}
