"""Checks of a corpus as tables of findings: uses, conflicts, references, leaks, partitions, expectations and epochs.

A check gives rows of findings or one row with its name, whether it holds and how many rows break it; none collects ids to
the driver. Sets are compared by one full outer join of their distinct keys.

Defined results. NULL keys take no part in sets and uses; NULL texts have no hits. A check over no rows holds. Repeated rows
count once where sets are meant, and each where rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.corpus import split_of
from ledgerlens.sources.tables import STEPS, read, steps


def first_uses(uses: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's first use in order, of equals the least value, and the number of uses."""
    return uses.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(order, value)).alias(value), F.count("*").alias("uses"))


def conflicting(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys whose rows differ in the columns, with the number of different ones."""
    return rows.where(F.col(key).isNotNull()).select(key, *columns).distinct().groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")


def referenced(texts: DataFrame, place: str, text: str, pattern: str, known: DataFrame, key: str) -> DataFrame:
    """key, place of every known key that a text names; pattern: what keys look like."""
    named = texts.select(F.col(place).alias("place"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias(key))
    return named.join(known.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi").distinct()


def compared_sets(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: keys only in one, only in the other, in both; whether the sets are equal and whether they are disjoint."""
    a, b = (x.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(side, F.lit(True)) for x, side in ((one, "a"), (other, "b")))
    c = a.join(b, key, "full_outer").agg(F.count_if(F.col("b").isNull()).alias("only_one"), F.count_if(F.col("a").isNull()).alias("only_other"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return c.select("*", ((F.col("only_one") == 0) & (F.col("only_other") == 0)).alias("equal"), (F.col("both") == 0).alias("disjoint"))


def leak_hits(text: Column, tokens: list[str], words: str, rules: dict[str, str]) -> Column:
    """Hits in a text that a reader must not see: tokens as they are, the first class word, and named patterns."""
    word = F.regexp_extract(text, words, 0)
    found = [F.when(text.contains(t), F.lit(f"label_token:{t}")) for t in tokens]
    found.append(F.when(word != "", F.concat(F.lit("class_word:"), word)))
    found += [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules.items()]
    return F.coalesce(F.array_compact(F.array(*found)), F.array().cast("array<string>"))


def own_token_leaks(rows: DataFrame, key: str, text: str, tokens: str) -> DataFrame:
    """key, token of every row whose text holds one of its own evaluation tokens. tokens: a column of arrays."""
    return rows.select(key, text, F.explode(F.array_distinct(tokens)).alias("token")).where((F.col("token") != "") & F.col(text).contains(F.col("token"))).select(key, "token").distinct()


def sharing_patterns(rows: DataFrame, key: str, partition: str) -> DataFrame:
    """How many keys stand in which set of partitions. Partitions are few."""
    sets = rows.where(F.col(key).isNotNull() & F.col(partition).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(partition)), "+").alias("partitions"))
    return sets.groupBy("partitions").agg(F.count("*").alias("n"))


def content_ids(memories: DataFrame, content: str, order: str) -> DataFrame:
    """memories with memory_id from their content, and accepted: the first of each id; later ones are duplicates."""
    named = memories.withColumn("memory_id", F.concat(F.lit("MEM-"), F.substring(F.sha2(content, 256), 1, 16)))
    first = named.groupBy("memory_id").agg(F.min(order).alias("__first"))
    return named.join(first, "memory_id").withColumn("accepted", F.col(order) == F.col("__first")).drop("__first")


def unexplained(found: DataFrame, registered: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """found with state: registered, excluded (reviewed) or unexplained."""
    mark = lambda x, name: x.select(key).distinct().withColumn(name, F.lit(True))
    both = found.select(key).distinct().join(mark(registered, "r"), key, "left").join(mark(excluded, "e"), key, "left")
    return both.select(key, F.when(F.col("r"), "registered").when(F.col("e"), "excluded").otherwise("unexplained").alias("state"))


def expectations(rows: DataFrame, rules: dict[str, str], unique: list[str]) -> DataFrame:
    """name, ok, bad of each rule (an SQL condition on a row; NULL breaks it) and of the uniqueness of columns. One pass for all rules."""
    counts = rows.agg(*(F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())), F.count("*").alias("n"))
    found = counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"r{i}").alias("bad")) for i, name in enumerate(rules)))).alias("x")).select("x.*")
    for column in unique:
        repeated = rows.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("bad"))
        found = found.unionByName(repeated.select(F.lit(f"unique {column}").alias("name"), "bad"))
    return found.select("name", (F.col("bad") == 0).alias("ok"), "bad")


def shares(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and their share, by value."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(*by, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def epoch_statistics(pool: DataFrame, epoch: DataFrame) -> DataFrame:
    """One row: items, actions of the pool that the epoch lacks, most repeats of an item, and least, mean, most items of a document, those without any included. Columns: sample_id, document, action."""
    items = epoch.groupBy("sample_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("c").alias("most_repeats"))
    lacking = pool.select("action").distinct().join(epoch.select("action").distinct(), "action", "left_anti").agg(F.count("*").alias("missing_actions"))
    documents = pool.select("document").distinct().join(epoch.groupBy("document").agg(F.count("*").alias("c")), "document", "left").select(F.coalesce("c", F.lit(0)).alias("c"))
    spread = documents.agg(F.count("*").alias("documents"), F.min("c").alias("least"), F.round(F.avg("c"), 3).alias("mean"), F.max("c").alias("most"))
    return items.join(F.broadcast(lacking)).join(F.broadcast(spread))


def epoch_faults(pool: DataFrame, epoch: DataFrame, capped: str, cap: float, most_over_mean: float) -> DataFrame:
    """The checks that an epoch breaks: share of the capped action, missing actions, repeated items, and documents drawn too often or never."""
    over = epoch.agg((F.count_if(F.col("action") == capped) > F.floor(F.count("*") * cap)).alias("over"))
    s = epoch_statistics(pool, epoch).join(F.broadcast(over))
    checks = {"action over its cap": F.col("over"), "action missing": F.col("missing_actions") > 0, "item repeated": F.col("most_repeats") > 1, "document oversampled": F.col("most") > F.col("mean") * most_over_mean, "document absent": F.col("least") < 1}
    return s.select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("fault"))


def _labelled(s, d) -> DataFrame:
    return read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left").withColumn("split", split_of(F.col("doc_id")))


def _items(s, d) -> tuple[DataFrame, DataFrame]:
    """Steps as items, a document for each run; the epoch is made of the items of score 0.4 or more."""
    rows = steps(s, d).select(F.col("event_id").alias("sample_id"), F.col("run_id").alias("document"), "action", "score")
    return rows, rows.where("score >= 0.4")


RULES = {"has text": "text is not null and text <> ''", "known language": "lang in ('en', 'de', 'fr', 'es')", "counted": "n_chars = length(text)", "labelled": "quality is not null", "not toxic": "toxic = 0"}
TOKENS, WORDS, PATTERNS = ["attack", "license", "password"], r"\b(?:benign|malicious|the)\b", {"path_marker": r"/[a-z]+/[a-z]+", "long_number": r"[0-9]{12}"}

QUERIES = {
    "set2_first_uses": lambda s, d: first_uses(read(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderpriority"),
    "set3_distinct_ids": lambda s, d: read(s, d, "orders").select("o_custkey").where("o_custkey is not null").distinct(),
    "set4_conflicting": lambda s, d: conflicting(read(s, d, "orders"), "o_custkey", "o_orderstatus"),
    "set5_referenced": lambda s, d: referenced(read(s, d, "events").select("event_id", "props"), "event_id", "props", "[0-9]+", read(s, d, "supplier").select(F.col("s_suppkey").alias("id")), "id"),
    "set7_expectations": lambda s, d: expectations(_labelled(s, d), RULES, ["doc_id", "text"]),
    "set8_compared_ids": lambda s, d: compared_sets(read(s, d, "documents"), read(s, d, "labels"), "doc_id"),
    "set9_leak_hits": lambda s, d: read(s, d, "documents").select("doc_id", F.explode(leak_hits(F.col("text"), TOKENS, WORDS, PATTERNS)).alias("hit")),
    "set11_sharing": lambda s, d: sharing_patterns(read(s, d, "orders").withColumn("split", split_of(F.col("o_orderkey"))), "o_custkey", "split"),
    "set14_content_ids": lambda s, d: content_ids(read(s, d, "conversations").withColumn("n", F.col("conv_id") * 1000 + F.col("turn")), "text", "n").select("n", "memory_id", "accepted"),
    "set16_unexplained": lambda s, d: unexplained(read(s, d, "orders").select(F.col("o_custkey").alias("id")), read(s, d, "supplier").select(F.col("s_suppkey").alias("id")), read(s, d, "events").select(F.col("user_id").alias("id")), "id"),
    "set17_own_tokens": lambda s, d: own_token_leaks(read(s, d, "documents").withColumn("tokens", F.array("lang", "source", F.col("doc_id").cast("string"))), "doc_id", "text", "tokens"),
    "set19_disallowed": lambda s, d: read(s, d, "events").where(~F.coalesce(F.col("event_type").isin("view", "click", "signup"), F.lit(False))).select("event_id", "event_type"),
    "agg35_shares": lambda s, d: shares(read(s, d, "documents"), "source"),
    "agg36_nested_shares": lambda s, d: shares(read(s, d, "documents").withColumn("split", split_of(F.col("doc_id"))), "split", "lang", "source"),
    "agg32_epoch_statistics": lambda s, d: epoch_statistics(*_items(s, d)),
    "agg33_epoch_faults": lambda s, d: epoch_faults(*_items(s, d), "finish", 0.1, 1.2),
}

_SPLIT = "CASE WHEN ('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::UBIGINT % 10 < 8 THEN 'fit' WHEN ('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8))::UBIGINT % 10 = 8 THEN 'select' ELSE 'evaluate' END"


def _items_sql() -> str:
    return f"WITH p AS (SELECT event_id AS sample_id, run_id AS document, action, score FROM ({STEPS}) x), e AS (SELECT * FROM p WHERE score >= 0.4::DOUBLE), c AS (SELECT count(e.sample_id) AS c FROM (SELECT DISTINCT document FROM p) d LEFT JOIN e USING (document) GROUP BY document), st AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM e GROUP BY sample_id)) AS most_repeats, (SELECT count(DISTINCT action) FROM p WHERE action NOT IN (SELECT action FROM e)) AS missing_actions, count(*) AS documents, min(c) AS least, round(avg(c), 3) AS mean, max(c) AS most FROM c) "


SQL = {
    "set2_first_uses": "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) AS o_orderpriority, count(*) AS uses FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1",
    "set3_distinct_ids": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL",
    "set4_conflicting": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    "set5_referenced": "SELECT DISTINCT event_id AS place, id FROM (SELECT event_id, unnest(regexp_extract_all(props, '[0-9]+')) AS id FROM events) SEMI JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier) USING (id)",
    "set7_expectations": "WITH r AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) SELECT name, bad = 0 AS ok, bad FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (({rule}) IS NOT TRUE) AS bad FROM r" for name, rule in RULES.items()) + " UNION ALL SELECT 'unique doc_id', count(doc_id) - count(DISTINCT doc_id) FROM r UNION ALL SELECT 'unique text', count(text) - count(DISTINCT text) FROM r)",
    "set8_compared_ids": "WITH c AS (SELECT count(*) FILTER (b IS NULL) AS only_one, count(*) FILTER (a IS NULL) AS only_other, count(*) FILTER (a = b) AS \"both\" FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b) SELECT *, only_one = 0 AND only_other = 0 AS equal, \"both\" = 0 AS disjoint FROM c",
    "set9_leak_hits": " UNION ALL ".join([*(f"SELECT doc_id, 'label_token:{t}' AS hit FROM documents WHERE contains(text, '{t}')" for t in TOKENS), f"SELECT doc_id, 'class_word:' || regexp_extract(text, '{WORDS}') FROM documents WHERE regexp_matches(text, '{WORDS}')", *(f"SELECT doc_id, '{n}' FROM documents WHERE regexp_matches(text, '{p}')" for n, p in PATTERNS.items())]),
    "set11_sharing": f"SELECT partitions, count(*) AS n FROM (SELECT o_custkey, string_agg(DISTINCT s, '+' ORDER BY s) AS partitions FROM (SELECT o_custkey, {_SPLIT.format('o_orderkey')} AS s FROM orders) GROUP BY 1) GROUP BY 1",
    "set14_content_ids": "WITH m AS (SELECT conv_id * 1000 + turn AS n, 'MEM-' || substr(sha256(text), 1, 16) AS memory_id FROM conversations) SELECT n, memory_id, n = min(n) OVER (PARTITION BY memory_id) AS accepted FROM m",
    "set16_unexplained": "SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN 'registered' WHEN o_custkey IN (SELECT user_id FROM events) THEN 'excluded' ELSE 'unexplained' END AS state FROM orders",
    "set17_own_tokens": "SELECT DISTINCT doc_id, token FROM (SELECT doc_id, text, unnest([lang, source, CAST(doc_id AS VARCHAR)]) AS token FROM documents) WHERE token <> '' AND contains(text, token)",
    "set19_disallowed": "SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'signup')",
    "agg35_shares": "SELECT source, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1",
    "agg36_nested_shares": f"SELECT {_SPLIT.format('doc_id')} AS split, lang, source, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY ALL",
    "agg32_epoch_statistics": _items_sql() + "SELECT * FROM st",
    "agg33_epoch_faults": _items_sql() + "SELECT fault FROM (SELECT unnest([CASE WHEN (SELECT count(*) FROM e WHERE action = 'finish') > floor(n * 0.1::DOUBLE) THEN 'action over its cap' END, CASE WHEN missing_actions > 0 THEN 'action missing' END, CASE WHEN most_repeats > 1 THEN 'item repeated' END, CASE WHEN most > mean * 1.2::DOUBLE THEN 'document oversampled' END, CASE WHEN least < 1 THEN 'document absent' END]) AS fault FROM st) WHERE fault IS NOT NULL",
}
