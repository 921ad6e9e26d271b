"""Vector code compression: product codebooks by Yinyang Lloyd in integers.

Components become floor(scale * x); a vector is cut into equal parts, and each part position has a codebook of at most 256
entries. Lloyd rounds assign every part to its nearest entry and move the entries to the floor of the mean of their parts.

The entries of a codebook are clustered into groups once. A vector part carries one lower bound a group: no entry of the
group but its own is nearer. After a round the bound falls by the group's largest drift, and only groups whose bound no
longer exceeds the exact distance to the own entry are scanned. Scans compare integer distances, ties going to the lower
index, so that codes equal those of plain Lloyd. Bounds are kept as the upper 16 bits of a 32-bit float, which rounds
down, and every comparison leaves a margin for rounding.

A round writes a table in the shared folder: vectors, codes, bounds, and one row of sums a partition; the sums merge by
groupBy, and parts x entries x width integers reach the driver. The table before is dropped then, so a lost executor costs
no finished round.

Defined results. Rows whose vector is null, empty or holds a null or non-finite component are dropped. So are vectors whose
number of components is no multiple of `parts`, or differs from that of the smallest kept id. Quantised components are
held to +-2^27. Rows with null id get codes but start no entry; repeated rows count each time, and of rows with one id the
smaller vector starts first. With fewer rows than entries the codebooks are smaller; an empty table has no rows. Nulls in
the label are one label. A sum beyond a long is null. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.centroids import LONG, SCALE, quantised
from ledgerlens.llm.common import Tables
from ledgerlens.llm.topk import finite

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Entries a group, as the method's authors advise.
GROUP_ENTRIES = 10
CHUNK = 2048
#: Labels whose sums are broadcast; sums of more are joined by a shuffle.
MAX_BROADCAST_LABELS = 100_000
_FAR = np.iinfo(np.int64).max
_DOWN, _UP = 1 - 1e-6, 1 + 1e-9


def packed_bounds(bounds: np.ndarray) -> np.ndarray:
    """Non-negative bounds as 16-bit integers that stand for at most as much."""
    return (np.minimum(bounds * _DOWN, 3e38).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def unpacked_bounds(packed: np.ndarray) -> np.ndarray:
    return (packed.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def entry_groups(entries: np.ndarray, n: int) -> np.ndarray:
    """A group for each entry of one codebook, by a few Lloyd rounds from evenly spaced entries."""
    centres = entries[np.linspace(0, len(entries) - 1, n).astype(int)].astype(float)
    for _ in range(5):
        of = ((entries[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for g in np.unique(of):
            centres[g] = entries[of == g].mean(0)
    return of


class Books:
    """Codebooks (parts, entries, width), the groups of their entries, and how far each group drifted in the last round."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray | None = None, drift: np.ndarray | None = None):
        self.entries = entries
        self.n_groups = max(1, entries.shape[1] // GROUP_ENTRIES)
        self.groups = np.stack([entry_groups(x, self.n_groups) for x in entries]) if groups is None else groups
        self.members = [[np.flatnonzero(of == g) for g in range(self.n_groups)] for of in self.groups]
        self.drift = drift

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """The books whose used entries are the floors of their parts' means."""
        new = self.entries.copy()
        used = counts > 0
        new[used] = sums[used] // counts[used][:, None]
        drift = np.sqrt(((new - self.entries) ** 2).sum(-1).astype(float)) * _UP
        most = np.stack([[drift[p, m].max(initial=0.0) for m in of] for p, of in enumerate(self.members)])
        return Books(new, self.groups, most)

    def _assign_part(self, p: int, x: np.ndarray, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, squared distance and bounds of part p of each row; without own codes every group is scanned."""
        entries, rows = self.entries[p], len(x)
        if own is None:
            best, least = np.full(rows, len(entries)), np.full(rows, _FAR)
            lower = np.full((rows, self.n_groups), -1.0)
        else:
            apart = x - entries[own]
            best, least = own.astype(np.int64), (apart * apart).sum(1)
            lower = np.maximum(bounds - self.drift[p], 0.0)
        open_ = lower <= np.sqrt(least.astype(float))[:, None] * _UP
        was, own_least = best.copy(), least.copy()
        scanned = []
        for g, members in enumerate(self.members[p]):
            at = np.flatnonzero(open_[:, g]) if len(members) else []
            if not len(at):
                continue
            apart = x[at][:, None, :] - entries[members]
            distances = np.einsum("ijk,ijk->ij", apart, apart)
            j = distances.argmin(1)
            here = np.arange(len(at))
            first, index = distances[here, j], members[j]
            distances[here, j] = _FAR
            scanned.append((g, at, first, index, distances.min(1)))
            better = (first < least[at]) | ((first == least[at]) & (index < best[at]))
            best[at[better]], least[at[better]] = index[better], first[better]
        if own is not None:  # an entry that is no longer a row's own now counts for its group
            left = np.flatnonzero(best != was)
            group = self.groups[p][was[left]]
            lower[left, group] = np.minimum(lower[left, group], np.sqrt(own_least[left].astype(float)))
        for g, at, first, index, second in scanned:
            lower[at, g] = np.sqrt(np.where(index == best[at], second, first).astype(float))
        return best, least, lower

    def assign(self, x: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows, parts), errors and bounds (rows, parts, groups) of vectors (rows, parts, width)."""
        found = [self._assign_part(p, x[:, p], None if codes is None else codes[:, p], None if bounds is None else bounds[:, p]) for p in range(x.shape[1])]
        return np.stack([f[0] for f in found], 1), np.sum([f[1] for f in found], 0), np.stack([f[2] for f in found], 1)

    def sums(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(parts, entries, width + 1): the sums of each entry's parts, and their number. Exact: a chunk's sums lie below 2^53."""
        parts, n, width = self.entries.shape
        slots = (codes + np.arange(parts) * n).ravel()
        columns = [np.bincount(slots, x[:, :, w].ravel(), parts * n) for w in range(width)] + [np.bincount(slots, minlength=parts * n)]
        return np.stack(columns, 1).astype(np.int64).reshape(parts, n, width + 1)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _from_binary(column: pa.Array, kind: type, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _round(books, scale: float, label: pa.DataType, first: bool, last: bool):
    """Assigns a partition's vectors; rows of vec_id, label, x, code, bounds, error, and but for the last round one row of sums."""
    names = ["vec_id", "label", "x", "code", "bounds", "error", "sums"]
    kinds = [pa.int64(), label, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = books.value
        parts, _, width = now.entries.shape
        total = 0
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                n, values = batch.num_rows, batch.column(2).flatten().to_numpy(zero_copy_only=False)
                x = (quantised(values, scale) if first else values.astype(np.int64)).reshape(n, parts, width)
                codes, bounds = (None, None) if first else (_from_binary(batch.column(3), np.uint8, (parts,)), unpacked_bounds(_from_binary(batch.column(4), np.uint16, (parts, now.n_groups))))
                codes, errors, bounds = now.assign(x, codes, bounds)
                out = [batch.column(0), batch.column(1).cast(label), None, _binary(codes.astype(np.uint8)), None, pa.array(errors), None]
                if not last:
                    total = total + now.sums(x, codes)
                    out[2] = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, parts * width), pa.int32()), pa.array(x.ravel().astype(np.int32)))
                    out[4] = _binary(packed_bounds(bounds))
                yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(out, kinds)], names=names)
        if not last and not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:6]), pa.array([total.ravel().tolist()], kinds[6])], names=names)

    return run


def kept(table: DataFrame, id_col: str, vector: str, label: str | None, parts: int) -> DataFrame:
    """vec_id, label, v: the rows that get a code."""
    v = F.col(f"`{vector}`")
    rows = table.where(finite(v) & (F.size(v) > 0) & (F.size(v) % parts == 0)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"), v.cast("array<double>").alias("v"))
    size = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def encoded(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows of vec_id, label, code (binary, a byte a part), error and label_error, and the codebooks (parts, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark, rows = table.sparkSession, kept(table, id_col, vector, label, parts)
    first = rows.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    label_type = rows.schema["label"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id long, label {label_type}, code binary, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    start = quantised(np.array([r["v"] for r in first], float), scale)
    books = Books(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    arrow_label = rows.select("label").limit(0).toArrow().schema.field(0).type
    tables, source = Tables(spark), rows
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(books)
        worked = source.mapInArrow(_round(shared, scale, arrow_label, step == 0, step == rounds), f"vec_id long, label {label_type}, x array<int>, code binary, bounds binary, error long, sums array<long>")
        if step == rounds:
            worked = worked.select("vec_id", "label", "code", "error")
        now = tables.store(f"codes{step}", worked)
        shared.destroy()
        if step:
            tables.drop(f"codes{step - 1}")
        if step < rounds:
            merged = now.where("sums is not null").select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            sums = np.zeros(books.entries.size // books.entries.shape[2] * (books.entries.shape[2] + 1), object)
            for r in merged.collect():
                sums[r["at"]] = int(r["s"])
            sums = sums.reshape(*books.entries.shape[:2], -1)
            counts = sums[..., -1].astype(np.int64)
            books = books.moved(sums[..., :-1], counts)
            source = now.where("sums is null").select("vec_id", "label", "x", "code", "bounds")
    errors = tables.store("labels", now.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(F.col("label").alias("of"), F.when(F.col("s") <= LONG, F.col("s")).cast("long").alias("label_error")))
    if errors.count() <= MAX_BROADCAST_LABELS:
        errors = F.broadcast(errors)
    return now.join(errors, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books.entries
