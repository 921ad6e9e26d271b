"""Plain Lloyd clustering of vectors in integers.

Components become floor(scale * x). Each round broadcasts the centroids (k rows of `dims` integers, both parameters);
tasks compute the integer squared differences to every centroid, take the lowest index of the least, and sum the vectors
of each cluster. A partition gives at most k rows of sums, which merge by groupBy; only the k merged means reach the
driver. Every round reads the table anew, so nothing is kept on disk and a lost executor costs its own tasks only. The
table must give the same rows each time.

Defined results. Rows whose vector is null, has another number of components than `dims`, or holds a null or non-finite
component take no part. Quantised components are held to +-2^27, so that squared distances fit a long at 64 components.
Rows with null id are clustered but are no starting centroid; repeated rows count each time, and of rows with one id those
with the smaller vector start first. With fewer rows than k there are fewer centroids; an empty table has no rows. A sum
beyond a long is null. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.topk import finite

K = 40
DIMS = 64
ROUNDS = 5
SCALE = 256.0
HELD = 1 << 27
CHUNK = 1024
LONG = (1 << 63) - 1


def quantised(values: np.ndarray, scale: float = SCALE, held: int = HELD) -> np.ndarray:
    return np.clip(np.floor(scale * values), -held, held).astype(np.int64)


def kept(table: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    """vec_id and v, the rows that take part."""
    v = F.col(f"`{vector}`")
    return table.where((F.size(v) == dims) & finite(v)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def starting_centroids(rows: DataFrame, k: int, seed: int, scale: float) -> np.ndarray:
    """The vectors of the k ids with the smallest SHA-256 of `seed:id`."""
    first = rows.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(k)
    return quantised(np.array([r["v"] for r in first.select("v").collect()], float), scale)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest centroid, the lowest of equals, and its squared distance."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    narrow = np.int32 if x.shape[1] * (2 * most) ** 2 < 1 << 31 else np.int64
    x, centroids = x.astype(narrow), centroids.astype(narrow)
    step = max(1, min(CHUNK, (1 << 22) // max(1, len(centroids))))
    at, least = [], []
    for a in range(0, len(x), step):
        part = x[a : a + step]
        distances = np.empty((len(centroids), len(part)), np.int64)
        for c, centroid in enumerate(centroids):
            apart = part - centroid
            distances[c] = np.einsum("ij,ij->i", apart, apart)
        best = distances.argmin(axis=0)
        at.append(best)
        least.append(distances[best, np.arange(len(part))])
    return np.concatenate(at), np.concatenate(least)


def _vectors(batches: Iterator[pd.DataFrame], scale: float) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch, quantised(np.stack(batch["v"].to_numpy()), scale)


def _sums(centroids, scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = centroids.value
        sums, counts = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for _, x in _vectors(batches, scale):
            at, _ = nearest(x, now)
            order = np.argsort(at, kind="stable")
            found, first = np.unique(at[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(at, minlength=len(now))
        used = np.flatnonzero(counts)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": counts[used], "sums": list(sums[used])})

    return run


def _assigned(centroids, scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, x in _vectors(batches, scale):
            at, distance = nearest(x, centroids.value)
            yield pd.DataFrame({"id": batch["id"], "no_id": batch["no_id"], "cluster": at.astype(np.int32), "distance": distance})

    return run


def moved(rows: DataFrame, centroids: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    sums = rows.select("v").mapInPandas(_sums(shared, scale), "cluster int, n long, sums array<long>")
    merged = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in merged.collect():
        new[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    shared.destroy()
    return new


def fitted(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 2, scale: float = SCALE) -> np.ndarray:
    """Centroids after the rounds, which end early if none moves. rows: as from kept()."""
    centroids = starting_centroids(rows, k, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(rows, centroids, scale)
        if (before == centroids).all():
            break
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, scale: float = SCALE) -> DataFrame:
    """vec_id, cluster and squared distance of every row. rows: as from kept()."""
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    ids = rows.select(F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("no_id"), "v")  # pandas has no long with nulls
    found = ids.mapInPandas(_assigned(shared, scale), "id long, no_id boolean, cluster int, distance long")
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "cluster", "distance")


def clustered(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: int = 2, scale: float = SCALE) -> DataFrame:
    """One row a vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    rows = kept(table, id_col, vector, dims)
    centroids = fitted(rows, k, rounds, seed, scale)
    found = assigned(rows, centroids, scale)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    held = lambda n: n if n <= LONG else None
    of = [(c, held(sums.get(c, 0)), held(whole), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), x) for c, x in enumerate(centroids.tolist())]
    about = rows.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
