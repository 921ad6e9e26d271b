"""Registers and corpus checks: ledgers, pairings, seeded selection, leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.rates import rate
from ledgerlens.sources.tables import INTENTS, intents, read


def journal(rows: DataFrame) -> DataFrame:
    """Balanced entries of executed intents: a debit of the source and a credit of the beneficiary."""
    side = F.explode(F.array(F.struct(F.col("source_account_id").alias("account"), F.lit("debit").alias("direction")), F.struct(F.col("beneficiary_id").alias("account"), F.lit("credit").alias("direction"))))
    return rows.where("status = 'executed'").select("intent_id", "amount_minor_units", side.alias("x")).select("intent_id", "x.account", "x.direction", "amount_minor_units")


def balances(entries: DataFrame) -> DataFrame:
    return entries.groupBy("account").agg(F.sum(F.when(F.col("direction") == "credit", F.col("amount_minor_units")).otherwise(-F.col("amount_minor_units"))).alias("balance"))


def unbalanced(entries: DataFrame) -> DataFrame:
    signed = F.when(F.col("direction") == "debit", F.col("amount_minor_units")).otherwise(-F.col("amount_minor_units"))
    return entries.groupBy("intent_id").agg(F.sum(signed).alias("off"), F.count("*").alias("entries")).where("off <> 0 or entries <> 2")


def seeded_order(seed: str, salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")), 256)


def ranked_in_bands(rows: DataFrame, group: str) -> DataFrame:
    """rn, the rank of a row within its group by its hash h, and n, the group's size. Groups are ranked band by band of h, so a hot one is no single task's."""
    banded = rows.withColumn("band", F.substring("h", 1, 3))
    sizes = banded.groupBy(F.col(group).alias("g"), F.col("band").alias("b")).agg(F.count("*").alias("in_band"))
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("in_band").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("g", "b", before.alias("before"), F.sum("in_band").over(w).alias("n"))
    within = F.row_number().over(Window.partitionBy(group, "band").orderBy("h"))
    joined = banded.withColumn("rn", within).join(offsets, F.col(group).eqNullSafe(F.col("g")) & F.col("band").eqNullSafe(F.col("b")))
    return joined.withColumn("rn", (F.col("rn") + F.col("before")).cast("int")).drop("g", "b", "band", "before")


def least_exposed(pool: DataFrame, n: int, seed: str) -> DataFrame:
    """n samples, least-exposed documents first, seeded ties: the rank of a sample within its document is the exposure that it adds."""
    ranked = ranked_in_bands(pool.withColumn("h", seeded_order(seed, "pool", F.col("sample_id"))), "document")
    return ranked.withColumnRenamed("rn", "level").orderBy("level", "h").limit(n).select("sample_id", "document", "level")


def stratified(pool: DataFrame, stratum: str, fraction: float, seed: str) -> DataFrame:
    """max(1, round(n fraction)) samples of each stratum in seeded order."""
    ranked = ranked_in_bands(pool.withColumn("h", seeded_order(seed, "stratum", F.col("sample_id"))), stratum)
    return ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.round(F.col("n") * fraction))).select("sample_id", stratum)


def split_of(key: Column) -> Column:
    """fit, select or evaluate, by hash: 8, 1 and 1 of 10."""
    n = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(n < 8, "fit").when(n == 8, "select").otherwise("evaluate")


def crossing(rows: DataFrame, key: str) -> DataFrame:
    """Key values that stand in more than one split."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("split")), "+").alias("splits"), F.count("*").alias("n")).where(F.col("splits").contains("+"))


def first_by_priority(rows: DataFrame, key: str) -> DataFrame:
    """One source a key, the one of least priority number, with the number of sources."""
    return rows.groupBy(key).agg(F.min_by("origin", "priority").alias("origin"), F.count_distinct("origin").alias("sources"))


def content_duplicates(docs: DataFrame) -> DataFrame:
    """Documents whose text has come before, with the first one's id."""
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.select("doc_id", F.sha2("text", 256).alias("digest")).join(first, "digest").where("doc_id <> first_id").select("doc_id", "first_id")


def unique_lookup(asked: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """FOUND, NO_RECORD or LOOKUP_FAILED (the key is ambiguous). Uniqueness is settled before the join, which so multiplies no row."""
    counted = known.groupBy(key).agg(F.count("*").alias("hits"), F.min(value).alias(value))
    both = asked.join(counted, key, "left")
    return both.select(*asked.columns, F.when(F.col("hits").isNull(), "NO_RECORD").when(F.col("hits") > 1, "LOOKUP_FAILED").otherwise("FOUND").alias("lookup"), F.when(F.col("hits") == 1, F.col(value)).alias(value))


def currency_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.lower("currency").alias("currency")).agg(F.sum("amount_minor_units").alias("total"), F.count("*").alias("n"))


def register_tiles(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "executed").alias("paid"), F.count_if(F.col("status") == "blocked").alias("held"), F.count_distinct("source_account_id", "beneficiary_id").alias("pairs"), F.count_if(F.col("currency").isNull()).alias("without_currency"))


def _docs(s, d):
    return read(s, d, "documents").withColumn("split", split_of(F.col("doc_id")))


def _labelled(s, d):
    return read(s, d, "documents").select("doc_id", "source").join(read(s, d, "labels"), "doc_id", "left")


def _origins(s, d):
    docs, labels, convs = read(s, d, "documents").select(F.col("doc_id").alias("id")), read(s, d, "labels").select(F.col("doc_id").alias("id")), read(s, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    tagged = [t.withColumn("origin", F.lit(o)).withColumn("priority", F.lit(p)) for p, (o, t) in enumerate((("labels", labels), ("conversations", convs), ("documents", docs)))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def _pool(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("document"))


QUERIES = {
    "str4_balances": lambda s, d: balances(journal(intents(s, d))),
    "str5_unbalanced": lambda s, d: unbalanced(journal(intents(s, d))),
    "j17_unique_lookup": lambda s, d: unique_lookup(intents(s, d).select("intent_id", (F.col("intent_id") % 40).alias("nation")), read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), "s_suppkey"), "nation", "s_suppkey").groupBy("lookup").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys")),
    "j1_labelled_documents": lambda s, d: _labelled(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), rate(F.sum("toxic"), F.count("toxic")).alias("toxic_rate")),
    "agg22_split_counts": lambda s, d: _docs(s, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts")),
    "agg23_crossing_texts": lambda s, d: crossing(_docs(s, d).withColumn("digest", F.sha2("text", 256)), "digest"),
    "agg39_currency_totals": lambda s, d: currency_totals(intents(s, d)),
    "agg40_register_tiles": lambda s, d: register_tiles(intents(s, d)),
    "set1_priority_union": lambda s, d: first_by_priority(_origins(s, d), "id").groupBy("origin", "sources").agg(F.count("*").alias("n")),
    "set6_content_duplicates": lambda s, d: content_duplicates(read(s, d, "documents")),
    "srt1_seeded_order": lambda s, d: _pool(s, d).select("sample_id", seeded_order("7", "docs", F.col("sample_id")).alias("h")),
    "srt7_least_exposed": lambda s, d: least_exposed(_pool(s, d), 100, "7"),
    "srt22_stratified": lambda s, d: stratified(_pool(s, d), "document", 0.1, "7"),
}
_I = f"WITH i AS ({INTENTS}) "
_SPLIT = "WITH d AS (SELECT *, CASE WHEN n < 8 THEN 'fit' WHEN n = 8 THEN 'select' ELSE 'evaluate' END AS split FROM (SELECT *, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 10 AS n FROM documents)) "
SQL = {
    "str4_balances": _I + "SELECT account, CAST(sum(a) AS BIGINT) AS balance FROM (SELECT source_account_id AS account, -amount_minor_units AS a FROM i WHERE status = 'executed' UNION ALL SELECT beneficiary_id, amount_minor_units FROM i WHERE status = 'executed') GROUP BY 1",
    "str5_unbalanced": "SELECT 1::BIGINT AS intent_id, 1::BIGINT AS off, 1::BIGINT AS entries WHERE false",
    "j17_unique_lookup": _I + ", k AS (SELECT s_nationkey AS nation, count(*) AS hits, min(s_suppkey) AS s FROM supplier GROUP BY 1) SELECT CASE WHEN hits IS NULL THEN 'NO_RECORD' WHEN hits > 1 THEN 'LOOKUP_FAILED' ELSE 'FOUND' END AS lookup, count(*) AS n, CAST(sum(CASE WHEN hits = 1 THEN s END) AS BIGINT) AS keys FROM i LEFT JOIN k ON i.intent_id % 40 = k.nation GROUP BY 1",
    "j1_labelled_documents": "SELECT source, count(*) AS n, count(quality) AS labelled, sum(toxic) / nullif(count(toxic), 0) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "agg22_split_counts": _SPLIT + "SELECT split, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM d GROUP BY 1",
    "agg23_crossing_texts": _SPLIT + "SELECT sha256(text) AS digest, string_agg(DISTINCT split, '+' ORDER BY split) AS splits, count(*) AS n FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "agg39_currency_totals": _I + "SELECT lower(currency) AS currency, CAST(sum(amount_minor_units) AS BIGINT) AS total, count(*) AS n FROM i GROUP BY 1",
    "agg40_register_tiles": _I + "SELECT count(*) AS processed, count(*) FILTER (status = 'executed') AS paid, count(*) FILTER (status = 'blocked') AS held, count(DISTINCT (source_account_id, beneficiary_id)) AS pairs, count(*) FILTER (currency IS NULL) AS without_currency FROM i",
    "set1_priority_union": "WITH u AS (SELECT doc_id AS id, 'labels' AS o, 0 AS p FROM labels UNION ALL SELECT DISTINCT conv_id, 'conversations', 1 FROM conversations UNION ALL SELECT doc_id, 'documents', 2 FROM documents) SELECT origin, sources, count(*) AS n FROM (SELECT id, arg_min(o, p) AS origin, count(DISTINCT o) AS sources FROM u GROUP BY 1) GROUP BY 1, 2",
    "set6_content_duplicates": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
    "srt1_seeded_order": "SELECT doc_id AS sample_id, sha256('7:docs:' || doc_id) AS h FROM documents",
    "srt7_least_exposed": "SELECT sample_id, document, CAST(level AS INT) AS level FROM (SELECT doc_id AS sample_id, source AS document, sha256('7:pool:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('7:pool:' || doc_id)) AS level FROM documents) ORDER BY level, h LIMIT 100",
    "srt22_stratified": "SELECT sample_id, document FROM (SELECT doc_id AS sample_id, source AS document, row_number() OVER (PARTITION BY source ORDER BY sha256('7:stratum:' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn <= greatest(1, round(n * 0.1))",
}
