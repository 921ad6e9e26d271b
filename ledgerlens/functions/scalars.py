"""Scalar functions over text, amounts, vectors and costs, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.tables import INTENTS, intents, read

#: Company suffix words that say nothing about who a vendor is (fixed values).
SUFFIXES = ["INC", "LLC", "LTD", "CO", "CORP", "CORPORATION", "COMPANY", "LIMITED", "THE", "GMBH", "PLC", "LLP", "SA", "AG", "INCORPORATED", "LP", "PTY", "BV", "NV", "SRL", "SPA"]


def strict_minor_units(text: Column) -> Column:
    """Minor units of `1,234.56`, `$ 17` or `USD 17.00`; NULL for anything ambiguous, negative or nought."""
    s = F.regexp_replace(text, r"[A-Za-z$€£¥\s:*]", "")
    minor = (F.regexp_replace(s, ",", "").try_cast("decimal(20,2)") * 100).cast("bigint")
    return F.when(s.rlike(r"^(\d{1,3}(,\d{3})+|\d+)(\.\d{1,2})?$") & (minor > 0), minor)


def vendor_key(name: Column) -> Column:
    words = F.split(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "), " ")
    return F.coalesce(F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(SUFFIXES)), " "), F.lit(""))


def bare(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def amount_band(minor: Column) -> Column:
    return F.when(minor.isNull(), "missing_or_unparseable").when(minor < 10_000, "under_100").when(minor < 100_000, "100_to_1k").when(minor < 1_000_000, "1k_to_10k").when(minor < 10_000_000, "10k_to_100k").otherwise("over_100k")


def word_band(n: Column) -> Column:
    return F.when(n < 150, "short").when(n < 400, "medium").when(n < 800, "long").otherwise("very_long")


def item_band(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 3, "1_to_3").when(n <= 9, "4_to_9").otherwise("10_plus")


def number_format(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text.rlike("^[0-9]+$"), "numeric_only").when(text.rlike("[A-Za-z]") & text.rlike("[0-9]"), "alphanumeric").when(text.contains("-"), "hyphenated").otherwise("other")


def iban_valid(text: Column) -> Column:
    """Mod-97, digit by digit; NULL if not of an IBAN's shape."""
    s = F.upper(F.regexp_replace(text, r"\s", ""))
    moved = F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda n, c: (F.when(c.between("0", "9"), n * 10 + value(c)).otherwise(n * 100 + value(c)) % 97).cast("int"))
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1)


def account_id(salt: str, population: str, key: Column, role: str) -> Column:
    return F.concat(F.lit("SIM-ACCT-"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}:{population}:"), key.cast("string"), F.lit(f":{role}")), 256), 1, 12)))


def largest_remainder(weights: DataFrame, total: int, key: str, weight: str) -> DataFrame:
    """Whole shares of total in proportion to the weights; remainders by size, then key. Sums to total exactly."""
    quota = F.lit(total).cast("decimal(38,0)") * F.col(weight)
    whole = F.sum(F.col(weight)).over(Window.partitionBy())
    parts = weights.withColumn("__w", whole).withColumn("__q", quota).withColumn("__floor", F.expr("cast(__q div __w as bigint)")).withColumn("__rest", F.col("__q") % F.col("__w"))
    left = F.lit(total) - F.sum("__floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), key))
    return parts.select(key, (F.col("__floor") + (place <= left).cast("int")).alias("share"))


def economics(rows: DataFrame) -> DataFrame:
    """rows with the costs of running workflows at an API and on hardware of one's own; NULL where nothing is avoided or a workflow costs nothing.

    Columns: workflows (a month), input_tokens and output_tokens (a workflow), usd_in and usd_out (a million tokens), hardware, opex (a month), months, seconds (a workflow).
    """
    c = F.col
    cost = c("input_tokens") / 1e6 * c("usd_in") + c("output_tokens") / 1e6 * c("usd_out")
    needed = c("hardware") / c("months") + c("opex")
    avoided = c("workflows") * c("cost") - c("opex")
    workflows = F.when(c("cost") > 0, c("needed_savings") / c("cost"))
    costed = rows.withColumn("cost", cost).withColumns({"needed_savings": needed, "avoided": avoided})
    return costed.withColumns({"break_even_months": F.when(c("avoided") > 0, c("hardware") / c("avoided")), "required_workflows": workflows, "least_workflows": F.ceil(workflows - 1e-9), "net_savings": c("months") * c("avoided") - c("hardware"), "serial_hours": c("workflows") * c("seconds") / 3600})


def _amounts(s, d):
    n = F.col("intent_id") % 6
    major = (F.col("amount_minor_units") / 100).cast("decimal(20,2)")
    text = F.when(n == 0, F.format_number(major, 2)).when(n == 1, F.concat(F.lit("$ "), major.cast("string"))).when(n == 2, F.concat(F.lit("("), major.cast("string"), F.lit(")"))).when(n == 3, F.concat(F.lit("-"), major.cast("string"))).when(n == 4, F.concat(F.lit("USD "), major.cast("string")))
    return intents(s, d).select("intent_id", text.alias("t"))


#: Workloads of customers: their orders are the workflows, prices stand for tokens.
WORKLOADS = """
SELECT o_custkey, count(*) AS workflows, avg(o_totalprice) AS input_tokens, 500.0 + o_custkey % 300 AS output_tokens, o_custkey % 4 * 0.75 AS usd_in, o_custkey % 3 * 5.0 AS usd_out, 1.0 + o_custkey % 10 AS hardware, o_custkey % 5 * 0.125 AS opex, 12 AS months, 30.0 + o_custkey % 60 AS seconds
FROM orders GROUP BY o_custkey
"""
_ECONOMICS = ["cost", "needed_savings", "avoided", "break_even_months", "required_workflows", "net_savings", "serial_hours"]


def _economics(s, d):
    loads = s.sql(WORKLOADS.replace("FROM orders", "FROM {orders}"), orders=read(s, d, "orders"))
    floats = loads.select("o_custkey", *(F.col(c).cast("double").alias(c) for c in loads.columns[1:]))
    return economics(floats).select("o_custkey", "least_workflows", *(F.round(c, 6).alias(c) for c in _ECONOMICS))


def _ibans(s, d):
    """German account numbers of suppliers with their check digits, some wrong, some spaced or in lower case, some no IBANs."""
    key = F.col("s_suppkey")
    bban = F.lpad(key.cast("string"), 18, "0")
    check = 98 - F.concat(bban, F.lit("131400")).cast("decimal(38,0)") % 97
    text = F.concat(F.lit("DE"), F.lpad((check + F.when(key % 5 == 1, 1).otherwise(0)).cast("string"), 2, "0"), bban)
    text = F.when(key % 5 == 2, F.lower(F.regexp_replace(text, "(.{4})", "$1 "))).when(key % 5 == 3, F.substring(text, 1, 12)).otherwise(text)
    return read(s, d, "supplier").select("s_suppkey", text.alias("t"))


def _words(s, d):
    return read(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[ \n]"), lambda w: w != "")).alias("n"))


QUERIES = {
    "fn1_strict_amounts": lambda s, d: _amounts(s, d).select("intent_id", strict_minor_units(F.col("t")).alias("minor")),
    "fn8_iban": lambda s, d: _ibans(s, d).select("s_suppkey", iban_valid(F.col("t")).alias("valid")),
    "fn10_vendor_key": lambda s, d: read(s, d, "supplier").select("s_suppkey", vendor_key(F.concat(F.lit("The "), F.col("s_name"), F.lit(", Inc."))).alias("vendor_key")),
    "fn12_bare": lambda s, d: read(s, d, "customer").select("c_custkey", bare(F.col("c_name")).alias("bare")),
    "fn21_amount_bands": lambda s, d: intents(s, d).groupBy(amount_band(F.when(F.col("intent_id") % 9 != 0, F.col("amount_minor_units"))).alias("band")).agg(F.count("*").alias("n")),
    "fn22_word_bands": lambda s, d: _words(s, d).groupBy(word_band(F.col("n")).alias("band")).agg(F.count("*").alias("n")),
    "fn23_item_bands": lambda s, d: read(s, d, "lineitem").groupBy("l_orderkey").count().groupBy(item_band(F.col("count")).alias("band")).agg(F.count("*").alias("n")),
    "fn27_number_formats": lambda s, d: read(s, d, "part").groupBy(number_format(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.lit("a-b"))).alias("format")).agg(F.count("*").alias("n")),
    "fn35_sha256": lambda s, d: read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")),
    "fn37_squeezed": lambda s, d: read(s, d, "documents").select("doc_id", F.length(squeezed(F.col("text"))).alias("n")),
    "fn43_break_even": _economics,
    "fn56_account_ids": lambda s, d: read(s, d, "supplier").select("s_suppkey", account_id("v1", "train", F.col("s_suppkey"), "vendor").alias("account_id")),
    "win9_apportionment": lambda s, d: largest_remainder(read(s, d, "lineitem").groupBy("l_returnflag").count(), 1000, "l_returnflag", "count"),
}
SQL = {
    "fn1_strict_amounts": f"WITH i AS ({INTENTS}) SELECT intent_id, CASE WHEN intent_id % 6 IN (0, 1, 4) AND amount_minor_units > 0 THEN amount_minor_units END AS minor FROM i",
    "fn8_iban": "WITH b AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 18, '0') AS n FROM supplier), c AS (SELECT *, 98 - CAST(n || '131400' AS HUGEINT) % 97 + CASE WHEN s_suppkey % 5 = 1 THEN 1 ELSE 0 END AS d FROM b) SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 3 THEN CAST(n || '1314' || lpad(CAST(d AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 END AS valid FROM c",
    "fn43_break_even": f"WITH w AS (SELECT o_custkey, CAST(workflows AS DOUBLE) AS w, input_tokens::DOUBLE / 1e6 * usd_in::DOUBLE + output_tokens::DOUBLE / 1e6 * usd_out::DOUBLE AS cost, hardware::DOUBLE AS h, opex::DOUBLE AS o, seconds::DOUBLE AS s FROM ({WORKLOADS})), a AS (SELECT *, w * cost - o AS avoided, h / 12 + o AS needed FROM w) SELECT o_custkey, CAST(ceil(CASE WHEN cost > 0 THEN needed / cost END - 1e-9) AS BIGINT) AS least_workflows, round(cost, 6) AS cost, round(needed, 6) AS needed_savings, round(avoided, 6) AS avoided, round(CASE WHEN avoided > 0 THEN h / avoided END, 6) AS break_even_months, round(CASE WHEN cost > 0 THEN needed / cost END, 6) AS required_workflows, round(12 * avoided - h, 6) AS net_savings, round(w * s / 3600, 6) AS serial_hours FROM a",
    "fn10_vendor_key": "SELECT s_suppkey, 'SUPPLIER ' || split_part(s_name, '#', 2) AS vendor_key FROM supplier",
    "fn12_bare": "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS bare FROM customer",
    "fn21_amount_bands": f"WITH i AS ({INTENTS}) SELECT CASE WHEN intent_id % 9 = 0 THEN 'missing_or_unparseable' WHEN amount_minor_units < 10000 THEN 'under_100' WHEN amount_minor_units < 100000 THEN '100_to_1k' WHEN amount_minor_units < 1000000 THEN '1k_to_10k' WHEN amount_minor_units < 10000000 THEN '10k_to_100k' ELSE 'over_100k' END AS band, count(*) AS n FROM i GROUP BY 1",
    "fn22_word_bands": "SELECT CASE WHEN n < 150 THEN 'short' WHEN n < 400 THEN 'medium' WHEN n < 800 THEN 'long' ELSE 'very_long' END AS band, count(*) AS n FROM (SELECT len(regexp_extract_all(text, '[^ \\n]+')) AS n FROM documents) GROUP BY 1",
    "fn23_item_bands": "SELECT CASE WHEN c = 0 THEN 'none' WHEN c <= 3 THEN '1_to_3' WHEN c <= 9 THEN '4_to_9' ELSE '10_plus' END AS band, count(*) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
    "fn27_number_formats": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'numeric_only' WHEN 1 THEN 'alphanumeric' ELSE 'hyphenated' END AS format, count(*) AS n FROM part GROUP BY 1",
    "fn35_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "fn37_squeezed": "SELECT doc_id, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS INT) AS n FROM documents",
    "fn56_account_ids": "SELECT s_suppkey, 'SIM-ACCT-' || upper(substr(sha256('v1:train:' || s_suppkey || ':vendor'), 1, 12)) AS account_id FROM supplier",
    "win9_apportionment": "WITH c AS (SELECT l_returnflag, count(*)::HUGEINT AS w, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1), q AS (SELECT l_returnflag, CAST(1000 * w // t AS BIGINT) AS f, 1000 * w % t AS r FROM c) SELECT l_returnflag, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, l_returnflag) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM q",
}
