"""Payment intents over a stream of commands, with keyed state.

Commands first meet the static invoices and accounts. Two stateful steps follow. The first is keyed by intent: it creates
an intent once, records one decision, and lets execute commands of a permitted intent pass as requests. The second is
keyed by source account and holds its balance, loaded from the accounts as initial state, and which intents it has paid;
a request is executed once and only within the balance. Both states lie in RocksDB beside the query's checkpoint, so a
restarted query goes on where it stopped and repeats no payment.

Every command gives one row with its outcome: the rows are the audit trail, and those executed give the journal. Within a
micro-batch commands count in order of seq; across batches, in order of arrival. Over commands that arrive in order of
seq, the outcomes equal those of `ledgerlens.operators.payments`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.payments import AGAIN, CREATED, DECISIONS, DUPLICATE, EXECUTED, MISMATCH, NO_FUNDS, NOT_PERMITTED, UNKNOWN, checked

COMMAND_SCHEMA = "seq long, command string, intent_id string, invoice_id string, source_account_id string, beneficiary_account_id string, amount long, currency string, decision string"
REQUEST = "requested"
_INTENT = "status string, source_account_id string, beneficiary_account_id string, amount long, currency string, same_currency boolean"
_OUT = "seq long, intent_id string, outcome string, source_account_id string, beneficiary_account_id string, amount long, currency string"
#: The state store that keyed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[dict]:
    yield from pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object).to_dict("records")


def _given(value):
    return None if value is None or value is pd.NA or value != value else value


class Intents(StatefulProcessor):
    """One intent's status and terms."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.intent = handle.getValueState("intent", _INTENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.intent.get()) if self.intent.exists() else None
        before, out = list(now) if now else None, []
        for r in _in_order(rows):
            terms = now[1:5] if now else [None] * 4
            if r["command"] == "create":
                terms = [_given(r[k]) for k in ("source_account_id", "beneficiary_account_id", "amount", "currency")]
                outcome = _given(r["fault"]) or ("duplicate_intent" if now else CREATED)
                if outcome == CREATED:
                    now = ["proposed", *terms[:2], int(terms[2]), terms[3], bool(r["same_currency"])]
            elif r["command"] == "decide":
                decision = DECISIONS.get(_given(r["decision"]))
                outcome = "invalid_decision" if not decision else UNKNOWN if not now else decision if now[0] == "proposed" else AGAIN
                if outcome == decision:
                    now[0] = decision
            else:
                outcome = UNKNOWN if not now else NOT_PERMITTED if now[0] != DECISIONS["permit"] else REQUEST if now[5] else MISMATCH
            out.append((int(r["seq"]), _given(r["intent_id"]), outcome, *terms))
        if now and now != before:
            self.intent.update(tuple(now))
        yield _frame(out)

    def close(self) -> None:
        pass


class Accounts(StatefulProcessor):
    """One account's balance and the intents that it has paid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance long")
        self.paid = handle.getMapState("paid", "intent_id string", "seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.balance.update((int(initialState["balance"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        left = self.balance.get()[0] if self.balance.exists() else 0
        before, out = left, []
        for r in _in_order(rows):
            outcome = r["outcome"]
            if outcome == REQUEST:
                intent, amount = (r["intent_id"],), int(r["amount"])
                outcome = DUPLICATE if self.paid.containsKey(intent) else NO_FUNDS if amount > left else EXECUTED
                if outcome == EXECUTED:
                    left -= amount
                    self.paid.updateValue(intent, (int(r["seq"]),))
            out.append((int(r["seq"]), _given(r["intent_id"]), outcome, *(_given(r[k]) for k in ("source_account_id", "beneficiary_account_id", "amount", "currency"))))
        if left != before:
            self.balance.update((left,))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])
    return frame.astype({"amount": "Int64"})


def outcomes(commands: DataFrame, invoices: DataFrame, accounts: DataFrame) -> DataFrame:
    """A stream of one row a command: seq, intent_id, outcome and, where known, the payment's terms. commands: a stream of COMMAND_SCHEMA."""
    spark = commands.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    keyed = checked(commands, invoices, accounts).withColumn("key", F.coalesce("intent_id", F.concat(F.lit("?"), F.col("seq").cast("string"))))
    stepped = keyed.groupBy("key").transformWithStateInPandas(Intents(), _OUT, "Append", "None")
    # rows that ask for no money need no account's state: they are dealt by their own number
    account = F.when(F.col("outcome") == REQUEST, F.col("source_account_id")).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    opening = accounts.select(F.col("account_id").alias("key"), "balance").groupBy("key")
    return stepped.withColumn("key", account).groupBy("key").transformWithStateInPandas(Accounts(), _OUT, "Append", "None", initialState=opening)


def write_outcomes(commands: DataFrame, invoices: DataFrame, accounts: DataFrame, folder: str, checkpoint: str):
    """Start the query that appends outcomes as Parquet to folder, over what is there now."""
    return outcomes(commands, invoices, accounts).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
