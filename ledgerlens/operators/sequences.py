"""Ordered operators over runs of steps, and streaming-like state taken in batch.

Windows are partitioned by run; what a run needs of its own past comes from running aggregates, without collecting it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.rates import rate
from ledgerlens.sources.tables import STEPS, read, steps

TOOLS = {"read_email": "email", "read_invoice": "invoice", "get_vendor_record": "vendor", "search_memory": "memory"}


def with_repeats(rows: DataFrame) -> DataFrame:
    """repeat: the last identical call of the run succeeded and wasn't stale."""
    same = Window.partitionBy("run_id", "action", "args").orderBy("step")
    return rows.withColumn("repeat", F.coalesce(F.lag(F.col("success") & ~F.col("stale")).over(same), F.lit(False)) & (F.col("action") != "finish"))


def until_first(rows: DataFrame, action: str) -> DataFrame:
    """Steps up to the first terminal one, it included."""
    before = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("over", F.coalesce(F.max(F.col("action") == action).over(before), F.lit(False))).where(~F.col("over")).drop("over")


def _given(rows: DataFrame, column: str, default: Column) -> Column:
    return F.coalesce(F.col(column), default) if column in rows.columns else default


def with_seen(rows: DataFrame) -> DataFrame:
    """For each source whether it was prefetched or the run has seen it before the step; premature marks a terminal step without all needed.

    Memory is needed where history_required says so. Rows without the columns history_required and prefetched_sources need and have none.
    """
    before = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    history, prefetched = _given(rows, "history_required", F.lit(False)), _given(rows, "prefetched_sources", F.array().cast("array<string>"))
    seen = {s: (F.coalesce(F.max((F.col("action") == tool) & F.col("success")).over(before), F.lit(False)) | F.array_contains(prefetched, s)).alias(f"seen_{s}") for tool, s in TOOLS.items()}
    marked = rows.select("*", *seen.values())
    complete = F.col("seen_email") & F.col("seen_invoice") & F.col("seen_vendor") & (F.col("seen_memory") | ~history)
    return marked.withColumn("premature", (F.col("action") == "finish") & ~complete)


def trajectory_rates(rows: DataFrame) -> DataFrame:
    """Rates over the steps up to the first terminal one. A tool call is unnecessary if it repeats, or its source isn't needed or was seen."""
    marked = with_seen(until_first(with_repeats(rows), "finish"))
    tool, lookup, end = F.col("action") != "finish", F.col("action") == "get_vendor_record", F.col("action") == "finish"
    again = (F.col("action") == "search_memory") & ~_given(rows, "history_required", F.lit(False))
    for name, source in TOOLS.items():
        again = again | ((F.col("action") == name) & F.col(f"seen_{source}"))
    needless = tool & (F.col("repeat") | again)
    c = marked.agg(F.count_if(tool).alias("tool_calls"), F.count_if(F.col("repeat")).alias("repeats"), F.count_if(lookup).alias("lookups"), F.count_if(lookup & F.col("repeat")).alias("repeated_lookups"), F.count_if(needless).alias("unnecessary"), F.count_if(end).alias("terminals"), F.count_if(F.col("premature")).alias("premature"))
    r = lambda a, b, name: rate(F.col(a), F.col(b)).alias(name)
    return c.select("*", r("repeats", "tool_calls", "repeat_rate"), r("repeated_lookups", "lookups", "repeated_lookup_rate"), r("unnecessary", "tool_calls", "unnecessary_rate"), r("premature", "terminals", "premature_rate"))


def first_rows(rows: DataFrame) -> DataFrame:
    """The first successful step of each run."""
    return rows.where("success").groupBy("run_id").agg(F.min_by(F.struct("step", "action"), "step").alias("x")).select("run_id", "x.*")


def last_result(rows: DataFrame) -> DataFrame:
    """The last successful result of each tool in each run."""
    return rows.where("success and action <> 'finish'").groupBy("run_id", "action").agg(F.max("step").alias("step"), F.max_by("args", "step").alias("args"))


def frozen_score(rows: DataFrame) -> DataFrame:
    """The last score of each run, frozen at its first routing reading (a finish step)."""
    bound = rows.where("action = 'finish'").groupBy("run_id").agg(F.min("step").alias("bound"))
    return rows.join(bound, "run_id", "left").where("bound is null or step <= bound").groupBy("run_id").agg(F.max_by("score", "step").alias("score"))


def gap_free(rows: DataFrame) -> DataFrame:
    """Runs whose step numbers have a gap or a repetition; none if all is well."""
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("step").alias("distinct_steps"), F.max("step").alias("last_step")).where("n <> distinct_steps or last_step <> n - 1")


def canonical(rows: DataFrame) -> Column:
    """The event as canonical JSON: all columns but run_id and audit_hash, keys sorted, no blanks, times in ISO form."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for events in batches:
            yield pa.array([json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda x: x.isoformat()) for e in events.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(F.struct(*[c for c in rows.columns if c not in ("run_id", "audit_hash")]))


def hash_chain(rows: DataFrame, event: Column | None = None, seed: str = "") -> DataFrame:
    """h_i = sha256(h_{i-1} then the event) over all events of a run by step, from h_0 = seed. The last hash of each run; a task holds one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, begun, schema = None, seed, False, None
        for batch in batches:
            schema, ids, hashes = batch.schema, [], []
            for run_id, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if begun and run_id != now:
                    ids.append(now)
                    hashes.append(h)
                if not begun or run_id != now:
                    now, h, begun = run_id, seed, True
                h = hashlib.sha256((h + e).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(hashes, pa.string())], names=["run_id", "hash"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([h], pa.string())], names=["run_id", "hash"])

    events = rows.select("run_id", "step", (F.concat_ws(":", "step", "action", "args") if event is None else event).alias("e"))
    ordered = events.repartition("run_id").sortWithinPartitions("run_id", "step", "e").select("run_id", "e")
    return ordered.mapInArrow(run, f"run_id {rows.schema['run_id'].dataType.simpleString()}, hash string")


def reference_chain(rows: DataFrame) -> DataFrame:
    """The chain of the reference's trace contract: over canonical JSON, from 64 zeros."""
    return hash_chain(rows, canonical(rows), "0" * 64)


def state_at(rows: DataFrame) -> DataFrame:
    """The last known argument and success at every step."""
    upto = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("action") == "get_vendor_record", F.col("args"))
    return rows.select("run_id", "step", F.last(known, ignorenulls=True).over(upto).alias("vendor_args"), F.last(F.when(F.col("success"), F.col("score")), ignorenulls=True).over(upto).alias("score"))


def sections(rows: DataFrame) -> DataFrame:
    """Last arguments and count by action, a column each."""
    names = [*TOOLS, "finish"]
    return rows.groupBy("run_id").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in names], *[F.max_by("args", F.when(F.col("action") == a, F.col("step"))).alias(f"last_{a}") for a in names])


def loops(rows: DataFrame) -> DataFrame:
    """The first step of each run that repeats a read already made; terminal steps are no reads."""
    nth = F.row_number().over(Window.partitionBy("run_id", "action", "args").orderBy("step"))
    return rows.where("action <> 'finish'").withColumn("nth", nth).where("nth > 1").groupBy("run_id").agg(F.min("step").alias("stop_at"))


def routing_decisions(rows: DataFrame, alarm: float, verify: float) -> DataFrame:
    """run_id, step, score, decision of each run's one routing decision: at the first step with email, invoice and vendor record in context.

    alarm from the one threshold on and for scores that are no number in [0, 1], verify from the other, else clear. Readings before and after it only monitor.
    """
    ready = with_seen(rows).where("seen_email and seen_invoice and seen_vendor")
    first = ready.groupBy("run_id").agg(F.min_by(F.struct("step", "score"), "step").alias("x")).select("run_id", "x.*")
    valid = F.coalesce(F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False))
    return first.withColumn("decision", F.when(~valid | (F.col("score") >= alarm), "alarm").when(F.col("score") >= verify, "verify").otherwise("clear"))


def latch(rows: DataFrame, alarm: float, verify: float) -> DataFrame:
    """Every run: its decision (NULL if it never had all sources), and the steps from it on, which the second agent takes after an alarm or in verify mode."""
    decided = routing_decisions(rows, alarm, verify).select("run_id", F.col("step").alias("since"), "decision")
    second = F.count_if((F.col("step") >= F.col("since")) & F.col("decision").isin("alarm", "verify"))
    return rows.select("run_id", "step").join(decided, "run_id", "left").groupBy("run_id", "since", "decision").agg(second.alias("second_agent_steps"))


def failures_in_window(rows: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Failed steps that have at least `limit` failures of their run in the last `seconds` (a failure exactly so old has expired)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy("run_id").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.where(~F.col("success")).withColumn("us", us).withColumn("fails", F.count("*").over(span)).where(F.col("fails") >= limit).groupBy("run_id").agg(F.count("*").alias("locked"), F.max("fails").alias("most"))


def as_of(rows: DataFrame) -> DataFrame:
    """For each run's first alarm: the last untrusted step at or before it and the last trusted lookup after that."""
    onset = rows.where("score >= 0.97").groupBy("run_id").agg(F.min("step").alias("onset"))
    bounded = rows.join(onset, "run_id")
    source = bounded.where("action = 'read_email' and step <= onset").groupBy("run_id").agg(F.max("step").alias("source_step"))
    lookup = rows.join(source, "run_id").where("action = 'get_vendor_record' and success and step > source_step").groupBy("run_id").agg(F.max_by(F.struct("step", "args"), "step").alias("x")).select("run_id", F.col("x.step").alias("lookup_step"), F.col("x.args").alias("lookup_args"))
    return onset.join(source, "run_id", "left").join(lookup, "run_id", "left")


def turns(spark, sf_dir):
    """Concatenated event stores: each conversation's system turns before the others, numbered anew."""
    rows = read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "system", 0).otherwise(1), "turn")
    return rows.select("conv_id", "turn", (F.row_number().over(order) - 1).alias("sequence"))


def evidence_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy by the set of sources seen, and overall."""
    marked = with_seen(rows)
    key = F.concat_ws("+", *[F.when(F.col(f"seen_{s}"), F.lit(s)) for s in TOOLS.values()])
    hits = marked.select(F.when(key == "", "none").otherwise(key).alias("evidence"), "success")
    return hits.rollup("evidence").agg(F.count_if("success").alias("correct"), F.count("*").alias("n")).select(F.coalesce("evidence", F.lit("overall")).alias("evidence"), "correct", "n", F.round(F.col("correct") / F.col("n"), 4).alias("rate"))


def memory_decisions(rows: DataFrame) -> DataFrame:
    need, asked = F.col("k") % 3 == 0, F.col("action") == "search_memory"
    c = rows.agg(F.count_if(need & asked).alias("tp"), F.count_if(~need & asked).alias("fp"), F.count_if(need & ~asked).alias("fn"), F.count_if(~need).alias("negatives"))
    r = lambda a, b: F.round(rate(a, b), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(fp, F.col("negatives")).alias("unnecessary"))


def trajectories(spark, sf_dir):
    """Steps with what a run needs and what it was given; a third of the runs need history."""
    prefetched = F.when(F.col("run_id") % 4 == 0, F.array(F.lit("memory"))).when(F.col("run_id") % 7 == 0, F.array(F.lit("email")))
    return steps(spark, sf_dir).withColumns({"history_required": F.col("run_id") % 3 == 0, "prefetched_sources": prefetched})


QUERIES = {
    "win1_repeated_calls": lambda s, d: with_repeats(steps(s, d)).groupBy("run_id").agg(F.count_if("repeat").alias("repeats")),
    "win2_first_success": lambda s, d: first_rows(steps(s, d)),
    "win3_premature": lambda s, d: with_seen(until_first(trajectories(s, d), "finish")).where("premature").select("run_id", "step"),
    "win4_last_result": lambda s, d: last_result(steps(s, d)),
    "win5_frozen_score": lambda s, d: frozen_score(steps(s, d)),
    "win11_sequence_gaps": lambda s, d: gap_free(steps(s, d)),
    "win12_merged_turns": turns,
    "win13_hash_chain": lambda s, d: reference_chain(steps(s, d)),
    "win15_state_at": lambda s, d: state_at(steps(s, d)),
    "win16_sections": lambda s, d: sections(steps(s, d)),
    "win21_loops": lambda s, d: loops(steps(s, d)),
    "agg25_trajectory_rates": lambda s, d: trajectory_rates(trajectories(s, d)),
    "agg26_evidence_accuracy": lambda s, d: evidence_accuracy(steps(s, d)),
    "agg27_memory_decisions": lambda s, d: memory_decisions(steps(s, d)),
    "str9_latch": lambda s, d: latch(steps(s, d), 0.95, 0.8),
    "str10_first_alarm": lambda s, d: routing_decisions(steps(s, d), 0.95, 0.8),
    "str13_failure_window": lambda s, d: failures_in_window(steps(s, d), 86_400, 3),
    "j23_as_of": lambda s, d: as_of(steps(s, d)),
}

_T = f"WITH t AS ({STEPS}) "
_SEEN = ", ".join(f"coalesce(bool_or(action = '{a}' AND success) OVER w, false) AS seen_{s}" for a, s in TOOLS.items())
_W = "WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_REP = ", r AS (SELECT *, action <> 'finish' AND coalesce(lag(success AND NOT stale) OVER (PARTITION BY run_id, action, args ORDER BY step), false) AS repeat FROM t)"
_GIVEN = {"memory": "run_id % 4 = 0", "email": "run_id % 4 <> 0 AND run_id % 7 = 0"}
_HAD = ", ".join(f"coalesce(bool_or(action = '{a}' AND success) OVER w, false) OR ({_GIVEN.get(s, 'false')}) AS seen_{s}" for a, s in TOOLS.items())
_CUT = ", u AS (SELECT * FROM (SELECT *, coalesce(bool_or(action = 'finish') OVER w, false) AS done FROM r " + _W + f") WHERE NOT done), m AS (SELECT *, {_HAD} FROM u {_W}), p AS (SELECT *, action = 'finish' AND NOT (seen_email AND seen_invoice AND seen_vendor AND (seen_memory OR run_id % 3 <> 0)) AS premature FROM m) "
_DECIDED = f", m AS (SELECT *, {_SEEN} FROM t {_W}), d AS (SELECT run_id, step, score, CASE WHEN score >= 0.95 THEN 'alarm' WHEN score >= 0.8 THEN 'verify' ELSE 'clear' END AS decision FROM m WHERE seen_email AND seen_invoice AND seen_vendor QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step) = 1) "
SQL = {
    "win1_repeated_calls": _T + _REP + " SELECT run_id, count(*) FILTER (repeat) AS repeats FROM r GROUP BY 1",
    "win2_first_success": _T + "SELECT run_id, step, action FROM t WHERE success QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step) = 1",
    "win3_premature": _T + _REP + _CUT + "SELECT run_id, step FROM p WHERE premature",
    "win4_last_result": _T + "SELECT run_id, action, step, args FROM t WHERE success AND action <> 'finish' QUALIFY row_number() OVER (PARTITION BY run_id, action ORDER BY step DESC) = 1",
    "win5_frozen_score": _T + "SELECT run_id, score FROM t a WHERE step <= coalesce((SELECT min(step) FROM t b WHERE b.run_id = a.run_id AND action = 'finish'), 9223372036854775807) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) = 1",
    "win11_sequence_gaps": _T + "SELECT run_id, count(*) AS n, count(DISTINCT step) AS distinct_steps, max(step) AS last_step FROM t GROUP BY 1 HAVING n <> distinct_steps OR last_step <> n - 1",
    "win12_merged_turns": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'system', turn) - 1 AS INT) AS sequence FROM conversations",
    "win15_state_at": _T + "SELECT run_id, step, last_value(CASE WHEN action = 'get_vendor_record' THEN args END IGNORE NULLS) OVER w AS vendor_args, last_value(CASE WHEN success THEN score END IGNORE NULLS) OVER w AS score FROM t WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "win16_sections": _T + "SELECT run_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}, arg_max(args, step) FILTER (action = '{a}') AS last_{a}" for a in [*TOOLS, "finish"]) + " FROM t GROUP BY 1",
    "win21_loops": _T + "SELECT run_id, min(step) AS stop_at FROM (SELECT run_id, step FROM t WHERE action <> 'finish' QUALIFY row_number() OVER (PARTITION BY run_id, action, args ORDER BY step) > 1) GROUP BY 1",
    "agg25_trajectory_rates": _T + _REP + _CUT + """, c AS (SELECT count(*) FILTER (action <> 'finish') AS tool_calls, count(*) FILTER (repeat) AS repeats, count(*) FILTER (action = 'get_vendor_record') AS lookups, count(*) FILTER (action = 'get_vendor_record' AND repeat) AS repeated_lookups,
        count(*) FILTER (action <> 'finish' AND (repeat OR (action = 'search_memory' AND (run_id % 3 <> 0 OR seen_memory)) OR (action = 'read_email' AND seen_email) OR (action = 'read_invoice' AND seen_invoice) OR (action = 'get_vendor_record' AND seen_vendor))) AS unnecessary, count(*) FILTER (action = 'finish') AS terminals, count(*) FILTER (premature) AS premature FROM p)
        SELECT *, repeats / nullif(tool_calls, 0) AS repeat_rate, repeated_lookups / nullif(lookups, 0) AS repeated_lookup_rate, unnecessary / nullif(tool_calls, 0) AS unnecessary_rate, premature / nullif(terminals, 0) AS premature_rate FROM c""",
    "agg26_evidence_accuracy": _T + f""", m AS (SELECT *, {_SEEN} FROM t {_W}), k AS (SELECT concat_ws('+', CASE WHEN seen_email THEN 'email' END, CASE WHEN seen_invoice THEN 'invoice' END, CASE WHEN seen_vendor THEN 'vendor' END, CASE WHEN seen_memory THEN 'memory' END) AS e, success FROM m)
        SELECT coalesce(e, 'overall') AS evidence, count(*) FILTER (success) AS correct, count(*) AS n, round(count(*) FILTER (success) / count(*), 4) AS rate FROM (SELECT CASE WHEN e = '' THEN 'none' ELSE e END AS e, success FROM k) GROUP BY ROLLUP (e)""",
    "agg27_memory_decisions": _T + """, c AS (SELECT count(*) FILTER (n AND a) AS tp, count(*) FILTER (NOT n AND a) AS fp, count(*) FILTER (n AND NOT a) AS fn, count(*) FILTER (NOT n) AS negatives FROM (SELECT k % 3 = 0 AS n, action = 'search_memory' AS a FROM t))
        SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(negatives, 0), 4) AS unnecessary FROM c""",
    "str9_latch": _T + _DECIDED + "SELECT t.run_id, d.step AS since, decision, count(*) FILTER (t.step >= d.step AND decision <> 'clear') AS second_agent_steps FROM t LEFT JOIN d USING (run_id) GROUP BY ALL",
    "str10_first_alarm": _T + _DECIDED + "SELECT * FROM d",
    "str13_failure_window": _T + "SELECT run_id, count(*) AS locked, max(fails) AS most FROM (SELECT run_id, count(*) OVER (PARTITION BY run_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS fails FROM t WHERE NOT success) WHERE fails >= 3 GROUP BY 1",
    "j23_as_of": _T + """, o AS (SELECT run_id, min(step) AS onset FROM t WHERE score >= 0.97 GROUP BY 1), s AS (SELECT run_id, max(step) AS source_step FROM t JOIN o USING (run_id) WHERE action = 'read_email' AND step <= onset GROUP BY 1),
        l AS (SELECT run_id, max(step) AS lookup_step, arg_max(args, step) AS lookup_args FROM t JOIN s USING (run_id) WHERE action = 'get_vendor_record' AND success AND step > source_step GROUP BY 1)
        SELECT run_id, onset, source_step, lookup_step, lookup_args FROM o LEFT JOIN s USING (run_id) LEFT JOIN l USING (run_id)""",
}
