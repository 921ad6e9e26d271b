"""Epochs of a sampler that covers unseen samples first and spreads its draws over documents.

The rule draws one sample at a time: of the unseen ones first, always from the document drawn least so far, ties by a seeded
hash. A document's samples in hash order add one draw each, so the n-th of them is drawn at level draws + n; the order of
draws is that of level and hash, and an epoch is its first rows. No step depends on the one before it.

What was drawn is kept in a table, a folder an epoch. An epoch is written aside and renamed into place as a whole, so that
a broken run leaves nothing and a rerun of an epoch finds it done and changes nothing.

Defined results. sample_id is unique. A NULL document is a document of its own. If more is asked for than there is, the seen
samples follow the unseen ones, and an epoch has at most every sample once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.corpus import ranked_in_bands, seeded_order
from ledgerlens.sources.shared import filesystem, put_whole, settled
from ledgerlens.sources.tables import read


def _first_rows(rows: DataFrame, n, *order: str) -> DataFrame:
    """The first n rows by level and hash h, with place from 1: counts by level and band of the hash give each band its offset, and bands are ranked apart."""
    level, h = order
    banded = rows.withColumn("__band", F.substring(h, 1, 3))
    totals = banded.groupBy(level, "__band").agg(F.count("*").alias("__n"))
    offsets = totals.select(level, "__band", F.coalesce(F.sum("__n").over(Window.orderBy(level, "__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(level, "__band").orderBy(h)) + F.col("__before")
    return banded.join(offsets.where(F.col("__before") < n), [level, "__band"]).withColumn("place", place.cast("long")).where(F.col("place") <= n).drop("__band", "__before")


def _levelled(rows: DataFrame) -> DataFrame:
    """rows with level: the draws that their document has had when their turn comes. rows: document, drawn_before, h."""
    return ranked_in_bands(rows, "document").withColumn("level", F.col("drawn_before") + F.col("rn") - 1).drop("rn", "n")


def drawn(state: DataFrame, slots: int, seed: str, epoch: int) -> DataFrame:
    """sample_id and place of an epoch's samples. state: sample_id, document, exposure (draws so far)."""
    document = F.coalesce(F.concat(F.lit("="), F.col("document").cast("string")), F.lit(""))
    rows = state.select("sample_id", document.alias("document"), "exposure", seeded_order(f"{seed}:{epoch}", "gvr", F.col("sample_id")).alias("h"))
    before = rows.groupBy("document").agg(F.sum("exposure").alias("drawn_before"), F.count_if(F.col("exposure") == 0).alias("unseen"))
    rows = rows.join(before, "document")
    unseen, seen = rows.where("exposure = 0"), rows.where("exposure > 0").withColumn("drawn_before", F.col("drawn_before") + F.col("unseen"))
    n_unseen = unseen.count()
    first = _first_rows(_levelled(unseen), slots, "level", "h").select("sample_id", "place")
    if n_unseen >= slots:
        return first
    rest = _first_rows(_levelled(seen), slots - n_unseen, "level", "h")
    return first.unionByName(rest.select("sample_id", (F.col("place") + n_unseen).alias("place")))


def stepped(state: DataFrame, slots: int, seed: str, epoch: int) -> DataFrame:
    """The state after an epoch, with the place that it gave each sample, NULL for those not drawn."""
    chosen = drawn(state, slots, seed, epoch)
    return state.drop("place").join(chosen, "sample_id", "left").select("sample_id", "document", (F.col("exposure") + F.col("place").isNotNull().cast("long")).alias("exposure"), "place")


def opening(pool: DataFrame) -> DataFrame:
    return pool.select("sample_id", "document", F.lit(0).cast("long").alias("exposure"))


def run_epoch(pool: DataFrame, folder: str, epoch: int, slots: int, seed: str) -> DataFrame:
    """The state after the epoch, from the table in folder; drawn and added to the table unless it is there. Epochs run in order, from 0."""
    spark = pool.sparkSession
    place = lambda e: f"{folder}/epoch-{e:06d}"
    there = lambda e: (lambda fs, path: fs.exists(path))(*filesystem(spark, place(e)))
    if not there(epoch):
        if epoch and not there(epoch - 1):
            raise ValueError(f"epoch {epoch - 1} has not been drawn")
        put_whole(stepped(spark.read.parquet(place(epoch - 1)) if epoch else opening(pool), slots, seed, epoch), place(epoch))
    return spark.read.parquet(place(epoch))


def coverage(state: DataFrame) -> DataFrame:
    """One row: samples, drawn ever, the share, draws of this epoch, repeats among them, and the least, mean and most draws of a document."""
    documents = state.groupBy("document").agg(F.sum("exposure").alias("draws"))
    spread = documents.agg(F.count("*").alias("documents"), F.min("draws").alias("least"), F.round(F.avg("draws"), 3).alias("mean"), F.max("draws").alias("most"))
    counts = state.agg(F.count("*").alias("samples"), F.count_if(F.col("exposure") > 0).alias("seen"), F.count("place").alias("slots"), F.count_if(F.col("place").isNotNull() & (F.col("exposure") > 1)).alias("repeats"))
    share = F.round(F.col("seen") / F.when(F.col("samples") > 0, F.col("samples")), 4).alias("share")
    return counts.join(F.broadcast(spread)).select("samples", "seen", share, "slots", "repeats", "documents", "least", "mean", "most")


def _pool(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("sample_id"), F.concat("lang", F.lit("/"), (F.col("n_chars") % 50).cast("string")).alias("document"))


SLOTS, SEED = 400, "5"


def _epochs(s, d, n: int):
    state = opening(_pool(s, d))
    for e in range(n):
        state = settled(stepped(state, SLOTS, SEED, e))
    return state


QUERIES = {
    "srt6_third_epoch": lambda s, d: _epochs(s, d, 3).where("place is not null").select("sample_id", "place"),
    "str23_exposure": lambda s, d: _epochs(s, d, 3).select("sample_id", "document", "exposure"),
    "agg34_coverage": lambda s, d: coverage(_epochs(s, d, 3)),
}


def _sql(epochs: int) -> str:
    steps = ["s0 AS MATERIALIZED (SELECT doc_id AS sample_id, lang || '/' || n_chars % 50 AS document, CAST(0 AS BIGINT) AS exposure, CAST(NULL AS BIGINT) AS place FROM documents)"]
    for e in range(epochs):
        steps.append(f"""h{e} AS (SELECT *, sha256('{SEED}:{e}:gvr:' || sample_id) AS h, exposure > 0 AS seen, sum(exposure) OVER (PARTITION BY document) AS had, count(*) FILTER (exposure = 0) OVER (PARTITION BY document) AS fresh FROM s{e}),
l{e} AS (SELECT *, had + CASE WHEN seen THEN fresh ELSE 0 END + row_number() OVER (PARTITION BY document, seen ORDER BY h) - 1 AS level FROM h{e}),
p{e} AS (SELECT *, row_number() OVER (ORDER BY seen, level, h) AS turn FROM l{e}),
s{e + 1} AS MATERIALIZED (SELECT sample_id, document, CAST(exposure + CASE WHEN turn <= {SLOTS} THEN 1 ELSE 0 END AS BIGINT) AS exposure, CASE WHEN turn <= {SLOTS} THEN turn END AS place FROM p{e})""")
    return "WITH " + ",\n".join(steps) + " "


SQL = {
    "srt6_third_epoch": _sql(3) + "SELECT sample_id, place FROM s3 WHERE place IS NOT NULL",
    "str23_exposure": _sql(3) + "SELECT sample_id, document, exposure FROM s3",
    "agg34_coverage": _sql(3) + ", d AS (SELECT document, sum(exposure) AS draws FROM s3 GROUP BY 1) SELECT count(*) AS samples, count(*) FILTER (exposure > 0) AS seen, round(count(*) FILTER (exposure > 0)::DOUBLE / count(*), 4) AS share, count(place) AS slots, count(*) FILTER (place IS NOT NULL AND exposure > 1) AS repeats, (SELECT count(*) FROM d) AS documents, (SELECT CAST(min(draws) AS BIGINT) FROM d) AS least, (SELECT round(avg(draws), 3) FROM d) AS mean, (SELECT CAST(max(draws) AS BIGINT) FROM d) AS most FROM s3",
}
