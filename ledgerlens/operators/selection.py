"""Selection of documents under quotas and isolation, by rounds over the whole pool.

A greedy pass keeps a row if no kept row shares its cluster or its vendor. The same rows come from rounds: in each, every
row that stands first in its cluster and in its vendor is kept, and rows that share either with one go. Rounds grow with the
logarithm of the pool in a seeded order; only their number and counts reach the driver.

A quota takes the first rows of such a pass. The representative fill takes turns between two queues so that a share stays at
its rate in the pool. Of each queue as many open rows as are still wanted are laid out in the order of their turns; up to
the first that shares a key with an earlier one all are certain and are taken, and the next round starts without the rows
that conflict with them.

Novelty ranks a row by its feature values that no chosen row has; a pick that is new in nothing ends that, and what is left
goes by isolation alone.

Defined results. Rows with one doc_id count once. A NULL cluster, vendor or feature is a value like any other; a NULL flag is
false, a NULL score least. A pool too small gives fewer rows than asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.corpus import seeded_order
from ledgerlens.sources.shared import settled
from ledgerlens.sources.tables import read

KEYS = ("cluster_id", "vendor_key")


def without(pool: DataFrame, chosen: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """pool without the rows that share a key with a chosen one."""
    for k in keys if chosen is not None else ():
        pool = pool.join(chosen.select(F.col(k).alias("__k")).distinct(), F.col(k).eqNullSafe(F.col("__k")), "left_anti")
    return pool


def isolated(pool: DataFrame, rank: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows that a greedy pass in order of rank keeps, no two with a key in common; __rank is added. rank: without ties between documents."""
    left, kept = settled(pool.dropDuplicates(["doc_id"]).withColumn("__rank", rank)), None
    while True:
        first = left
        for i, k in enumerate(keys):
            least = left.groupBy(F.col(k).alias(f"__k{i}")).agg(F.min("__rank").alias(f"__m{i}"))
            first = first.join(least, F.col(k).eqNullSafe(F.col(f"__k{i}")) & (F.col("__rank") == F.col(f"__m{i}"))).drop(f"__k{i}", f"__m{i}")
        won = settled(first)
        kept = won if kept is None else kept.unionByName(won)
        if not keys or won.isEmpty():
            return kept
        left = settled(without(left, won, keys))


def _rank(seed: str) -> Column:
    return F.struct(seeded_order(seed, "global", F.col("doc_id")), F.col("doc_id"))


def quota(pool: DataFrame, chosen: DataFrame | None, rule: str, cap: int, rank: Column) -> DataFrame:
    """The rows that fit the rule and are kept next, until `cap` of all chosen fit it."""
    fits = F.coalesce(F.expr(rule), F.lit(False))
    need = cap - (chosen.where(fits).count() if chosen is not None else 0)
    return isolated(without(pool.where(fits), chosen, KEYS), rank).orderBy("__rank").limit(max(0, need))


def _turns(size: int, flagged: int, rate: float, wanted: int, open_flagged: int, open_other: int) -> list[tuple[bool, int, int]]:
    """(flag, place in its queue, slot) of the next turns: flagged while their share lies below the rate, the other queue where one is empty."""
    out, places, left = [], {True: 0, False: 0}, {True: open_flagged, False: open_other}
    for slot in range(wanted):
        turn = flagged / max(1, size) < rate
        turn = turn if left[turn] else not turn
        if not left[turn]:
            break
        places[turn], left[turn], size, flagged = places[turn] + 1, left[turn] - 1, size + 1, flagged + turn
        out.append((turn, places[turn], slot))
    return out


def representative_fill(pool: DataFrame, chosen: DataFrame, total: int, flag: str, rank: Column) -> DataFrame:
    """Rows that bring the chosen to `total`, isolated from them and each other, with the flag at its rate in the pool."""
    spark, flagged = pool.sparkSession, F.coalesce(F.col(flag), F.lit(False))
    pool = settled(pool.dropDuplicates(["doc_id"]).withColumn("__rank", rank).withColumn("__flag", flagged))
    rate = pool.agg(F.avg(F.col("__flag").cast("int"))).first()[0] or 0.0
    size, n_flagged = chosen.agg(F.count("*"), F.count_if(flagged)).first()
    open_, taken = settled(without(pool, chosen, KEYS)), pool.limit(0)
    while size < total:
        heads = [open_.where(F.col("__flag") == b).orderBy("__rank").limit(total - size) for b in (True, False)]
        heads = settled(heads[0].unionByName(heads[1]).withColumn("__place", F.row_number().over(Window.partitionBy("__flag").orderBy("__rank"))))
        counts = heads.agg(F.count_if("__flag"), F.count_if(~F.col("__flag"))).first()
        turns = _turns(size, n_flagged, rate, total - size, *counts)
        if not turns:
            break
        laid = heads.join(spark.createDataFrame(turns, "__flag boolean, __place int, __slot int"), ["__flag", "__place"])
        clash = F.lit(False)
        for k in KEYS:
            clash = clash | (F.min("__slot").over(Window.partitionBy(k)) < F.col("__slot"))
        laid = laid.withColumn("__clash", clash)
        cut = laid.agg(F.min(F.when(F.col("__clash"), F.col("__slot")))).first()[0]
        won = settled(laid.where(F.lit(True) if cut is None else F.col("__slot") < cut).select(*pool.columns))
        n, f = won.agg(F.count("*"), F.count_if("__flag")).first()
        size, n_flagged, taken, open_ = size + n, n_flagged + f, taken.unionByName(won), settled(without(open_, won, KEYS))
    return taken.drop("__flag")


def select_documents(pool: DataFrame, quotas: list[tuple[str, str, int]], total: int, flag: str, seed: str) -> DataFrame:
    """doc_id and phase of the chosen: each quota (name, rule, cap) in turn, then the representative fill. pool: doc_id, cluster_id, vendor_key and what rules read."""
    rank, chosen = _rank(seed), None
    for name, rule, cap in quotas:
        new = settled(quota(pool, chosen, rule, cap, rank).drop("__rank").withColumn("phase", F.lit(name)))
        chosen = new if chosen is None else chosen.unionByName(new)
    chosen = pool.limit(0).withColumn("phase", F.lit("")) if chosen is None else chosen
    fill = representative_fill(pool, chosen, total, flag, rank).drop("__rank").withColumn("phase", F.lit("representative_fill"))
    return chosen.unionByName(fill).select("doc_id", "phase")


def novel(pool: DataFrame, total: int, features: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """doc_id and pick (from 1) of `total` documents: the newest in features first, then the highest score, then the smallest id.

    Isolated by cluster and vendor; when no such row is left by vendor only, and then not at all. pool: doc_id, score, cluster_id, vendor_key and the features.
    excluded: documents, clusters and vendors of earlier corpora. Each pick that is new takes a job; there are at most as many as feature values and as `total`.
    """
    spark = pool.sparkSession
    left = settled(without(pool.dropDuplicates(["doc_id"]), excluded, ("doc_id", *KEYS)).withColumn("score", F.coalesce("score", F.lit(float("-inf")))))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    marked = ["doc_id", *KEYS, *features]
    left = settled(left.withColumns({f"__{c}": text(c) for c in marked}))
    taken: dict[str, set] = {c: set() for c in marked}
    order = F.struct((-F.col("score")).alias("s"), "doc_id")
    picks: list = []

    def take(rows) -> None:
        for r in rows:
            picks.append(r["doc_id"])
            for c in marked:
                taken[c].add(r[f"__{c}"])

    for keys in (KEYS, KEYS[1:], ()):
        while len(picks) < total:
            newness = sum((F.when(F.col(f"__{f}").isin(list(taken[f])), 0).otherwise(1) for f in features), F.lit(0))
            open_ = left
            for c in ("doc_id", *keys):
                open_ = open_.where(~F.col(f"__{c}").isin(list(taken[c])))
            best = open_.select("*", newness.alias("__new")).orderBy(F.desc("__new"), F.desc("score"), "doc_id").first()
            if best is None:
                break
            if best["__new"]:
                take([best])
            else:
                take(isolated(open_, order, keys).orderBy("__rank").limit(total - len(picks)).collect())
    return spark.createDataFrame([(p, i) for i, p in enumerate(picks, 1)], f"doc_id {left.schema['doc_id'].dataType.simpleString()}, pick int")


def pool(spark, sf_dir: str) -> DataFrame:
    """Documents with the clusters, vendors and traits that selection reads."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.col("n_chars") % 173).alias("cluster_id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 61).cast("string")).alias("vendor_key"), "lang", "source", F.col("text").rlike("[0-9]{6}").alias("has_number"), (F.size(F.split("text", "\n")) >= 10).alias("many_lines"), (F.col("n_chars") > 3000).alias("long"), (F.col("n_chars") % 7 > 2).alias("complete"), (F.col("n_chars") % 13).cast("double").alias("score"))


QUOTAS = [("rare", "has_number", 12), ("many_lines", "many_lines", 20), ("long", "long", 30)]

QUERIES = {
    "srt2_isolated": lambda s, d: isolated(pool(s, d), _rank("7")).select("doc_id"),
    "srt2_quota_selection": lambda s, d: select_documents(pool(s, d), QUOTAS, 60, "complete", "7"),
    "srt9_novel_documents": lambda s, d: novel(pool(s, d), 20, ["lang", "source", "has_number", "many_lines", "long", "complete"]),
    "srt23_novel_beside_prior": lambda s, d: novel(pool(s, d), 60, ["lang", "source", "has_number", "many_lines", "long", "complete"], novel(pool(s, d), 20, ["lang", "source", "has_number", "many_lines", "long", "complete"]).join(pool(s, d), "doc_id")),
}

_POOL = "SELECT doc_id, n_chars % 173 AS c, source || '/' || doc_id % 61 AS v, lang, source, regexp_matches(text, '[0-9]{6}') AS has_number, len(string_split(text, chr(10))) >= 10 AS many_lines, n_chars > 3000 AS long, n_chars % 7 > 2 AS complete, n_chars % 13 AS score FROM documents"
SQL = {
    "srt2_isolated": f"""
WITH RECURSIVE p AS ({_POOL}), r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('7:global:' || doc_id), doc_id) AS n FROM p),
pass AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS cs, CAST([] AS VARCHAR[]) AS vs, CAST(NULL AS BIGINT) AS doc_id
  UNION ALL SELECT r.n, CASE WHEN ok THEN list_append(cs, c) ELSE cs END, CASE WHEN ok THEN list_append(vs, v) ELSE vs END, CASE WHEN ok THEN r.doc_id END
  FROM (SELECT r.*, pass.cs, pass.vs, NOT list_contains(cs, c) AND NOT list_contains(vs, v) AS ok FROM pass JOIN r ON r.n = pass.n + 1) r)
SELECT doc_id FROM pass WHERE doc_id IS NOT NULL
""",
}
