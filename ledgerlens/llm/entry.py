"""Queries over the training-data operators, with production parameters, and their SQL twins for DuckDB."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import centroids, codebooks, decontaminate, grouping_packing, language_id, line_dedup, packing, pseudonyms, simhash, substring_dedup, token_output, topk, url_filter
from ledgerlens.llm.common import read_table, shared_dir

TOKENIZER = "word_bpe_49k.json"

#: A deployment passes a secret of its own.
PSEUDONYM_KEY = b"ledgerlens example key"

#: Another key gives another order of training.
TRAINING_ORDER_KEY = b"epoch 1"

#: Host and path of each rule, with its verdict.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        decontaminate.hit_words("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated("hits").alias("contaminated"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predict = language_id.predictor(spark, language_id.fit(docs.where(~language_id.held_out())))
    return docs.select("doc_id", language_id.held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TRAINING_ORDER_KEY, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_substrings(read_table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"), into="removed")
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.transform("found", lambda x: x["kind"]).alias("kinds"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, max_bits=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codebooks.encoded(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read_table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping_packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""

OP2_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
urls AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST, length(r.h) DESC) AS n
         FROM urls u LEFT JOIN parts r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER.format("text"))} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
patterns AS (SELECT DISTINCT item, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS p
             FROM items, unnest(range(1, greatest(2, len(ws) - 11))) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM patterns),
hits AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS p FROM docs, unnest(range(1, len(ws) + 1)) t(i), sizes WHERE i + k - 1 <= len(ws)) JOIN patterns USING (k, p)),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.s, '')) AS items_sha256, coalesce(w.n, 0) > 0 AND 20 * coalesce(w.n, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN words w USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""

OP7_SQL = """
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS p FROM docs, unnest(range(1, greatest(1, len(ws) - 11))) t(i)),
first AS (SELECT p, min(doc_id) AS m FROM windows GROUP BY p),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT w.doc_id, unnest(range(i, i + 13)) AS k FROM windows w JOIN first f ON w.p = f.p AND f.m < w.doc_id)),
words AS (SELECT doc_id, k, ws[k] AS w FROM docs, unnest(range(1, len(ws) + 1)) t(k)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _floor_mean(x: str) -> str:
    return f"CAST((sum({x}) - ((sum({x}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _op11_sql(parts: int = 16, entries: int = 64, width: int = 4, rounds: int = 2) -> str:
    at = range(width)
    distance = " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in at)
    codes = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(({distance}) * {entries} + entry) AS k FROM p JOIN b{r} b USING (part) GROUP BY ALL)"
    steps = []
    for r in range(rounds):
        means = ", ".join(f"{_floor_mean(f'x{i}')} AS x{i}" for i in at)
        steps += [codes(r), f"m{r} AS (SELECT part, k % {entries} AS entry, {means} FROM a{r} JOIN p USING (vec_id, part) GROUP BY ALL)"]
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, {', '.join(f'coalesce(m.x{i}, b.x{i}) AS x{i}' for i in at)} FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    steps.append(codes(rounds))
    return f"""
WITH v AS (SELECT vec_id, label, {_WHOLE} AS q FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT vec_id, part, {", ".join(f"q[{width} * part + {i + 1}] AS x{i}" for i in at)} FROM v, range({parts}) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, {", ".join(f"x{i}" for i in at)} FROM p QUALIFY entry < {entries}),
{", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', k % {entries}), '' ORDER BY part) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg({" || ',' || ".join(f"x{i}" for i in at)}, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), books
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    distance = "CAST(list_sum(list_transform(list_zip(v.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, min({distance} * {k} + c) AS k FROM v, b{r} b GROUP BY vec_id)"
    steps = []
    for r in range(rounds):
        steps += [near(r), f"m{r} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT c, i, {_floor_mean('x')} AS x FROM (SELECT k % {k} AS c, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{r} JOIN v USING (vec_id)) GROUP BY ALL) GROUP BY c)"]
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN m{r} m USING (c))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS q FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k}),
{", ".join(steps)},
{near(rounds)}
SELECT vec_id, CAST(k % {k} AS INTEGER) AS cluster, k // {k} AS distance, CAST(sum(k // {k}) OVER (PARTITION BY k % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(k // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM a{rounds} JOIN b{rounds} ON c = k % {k}
"""


OP11_SQL, OP12_SQL = _op11_sql(), _op12_sql()


def queries() -> dict:
    return {x.__name__: x for x in (op1_topk, op2_url_filter, op3_decontamination, op4_packing, op5_language_id, op6_token_output, op7_substring_dedup, op8_line_dedup, op9_pseudonyms, op10_simhash, op11_vector_codes, op12_centroids, op13_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_decontamination": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op11_vector_codes": OP11_SQL, "op12_centroids": OP12_SQL}
