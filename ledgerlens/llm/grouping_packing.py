"""Packing of documents into as few sequences as can be, by a grouping genetic algorithm on islands.

Documents are tokenised where they lie. One longer than a sequence is cut into pieces of a whole sequence, each a sequence
of its own, and a rest; the rests and the shorter documents are the items to pack. Items get dense numbers and are dealt
by them into blocks of `block` items, so no block grows with a key, a document or the table.

A solution of a block says which bin each item lies in, items in descending order of size. Each island (a row of a table,
worked by any task) starts from best-fit packings of its own noisy orders of size, from nearly sorted to loosely sorted. A
generation crosses two parents: some whole well-filled bins of the one are injected into the other, the other's bins that
hold one of their items are removed, and the documents that this displaces are best-fitted, largest first, together with
those of the least-filled bins. The child takes the place of its worse parent if it is better: fewer bins, then more
uneven filling (sum of squares). After an epoch the islands' elites, in a table, go to the island itself and to the next
one in the ring. A block whose best solution meets the lower bound is optimal and rests; epochs end when all rest, or
after `epochs`. The best solution of a block then meets its items, again one block at a time.

Defined results. Null and empty texts are one token, the separator. Rows with one id are packed one by one. A document of a
multiple of the length has whole pieces only. Extra columns play no part. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tables, slices
from ledgerlens.llm.packing import PIECE, words_of
from ledgerlens.llm.token_output import numbered

LENGTH = 2048
SEPARATOR = 0
BLOCK = 8192
ISLANDS = 3
POPULATION = 4
GENERATIONS = 8
EPOCHS = 3
ELITES = 2
#: A bin filled to this share may be injected.
WELL_FILLED = 0.98
#: Least and largest share of such bins that a child gets, and of the other parent's bins, the least filled, that are emptied.
INJECTED = (0.05, 0.5)
EMPTIED = (0.02, 0.3)
WHOLE = 1 << 62
#: Tasks of an epoch at most; each works one island or more.
MAX_TASKS = 20_000
SEED = 13


class OpenBins:
    """Bins by free space, for best fit: the tightest bin that holds an item, by the lowest set bit of an integer."""

    def __init__(self, length: int, free: list[int]):
        self.length, self.by_free, self.mask, self.n = length, [[] for _ in range(length + 1)], 0, len(free)
        for b, f in enumerate(free):
            self.put(b, f)

    def put(self, b: int, free: int) -> None:
        if free:
            self.by_free[free].append(b)
            self.mask |= 1 << free

    def best_fit(self, size: int) -> int:
        """The bin that takes the item; a new one if none holds it."""
        above = self.mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask &= ~(1 << free)
        else:
            b, free, self.n = self.n, self.length, self.n + 1
        self.put(b, free - size)
        return b


def lower_bound(sizes: np.ndarray, length: int) -> int:
    """Bins that any packing needs: for every threshold t, items over length - t stand alone, those over half no two together, and the room left takes the rest of at least t."""
    sums = np.cumsum(np.bincount(sizes, np.arange(length + 1)[sizes], minlength=length + 1))
    counts = np.cumsum(np.bincount(sizes, minlength=length + 1))
    t = np.arange(0, length // 2 + 1)
    alone = counts[length] - counts[length - t]
    half = counts[length - t] - counts[length // 2]
    room = half * length - (sums[length - t] - sums[length // 2])
    small = sums[length // 2] - np.where(t > 0, sums[np.maximum(t - 1, 0)], 0)
    return int(np.max(alone + half + np.maximum(0, np.ceil((small - room) / length)))) if len(sizes) else 0


def fills(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def value(bins: np.ndarray, sizes: np.ndarray) -> tuple[int, float]:
    """Ascending: better first."""
    filled = fills(bins, sizes)
    return len(filled), -float((filled * filled).sum())


def best_fitted(order: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item when the items are best-fitted in an order."""
    room, bins, of = OpenBins(length, []), np.empty(len(sizes), np.int64), sizes.tolist()
    bins[order] = [room.best_fit(of[i]) for i in order.tolist()]
    return bins


def crossed(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """The child that gets well-filled bins of `one` and keeps those of `other` that share no item with them."""
    filled = fills(one, sizes)
    good = np.flatnonzero(filled >= min(WELL_FILLED * length, filled.max()))
    injected = np.zeros(len(filled), bool)
    injected[rng.choice(good, max(1, int(len(good) * rng.uniform(*INJECTED))), replace=False)] = True
    given = injected[one]
    kept = np.bincount(other[given], minlength=other.max() + 1) == 0
    weak = fills(other, sizes) + rng.uniform(0, 1, len(kept))
    kept[np.argsort(weak)[: max(1, int(len(weak) * rng.uniform(*EMPTIED)))]] = False
    stays = kept[other] & ~given
    label = np.full(len(sizes), -1)
    label[given] = one[given]
    label[stays] = len(filled) + other[stays]
    placed = np.flatnonzero(label >= 0)
    child = np.full(len(sizes), -1)
    _, child[placed] = np.unique(label[placed], return_inverse=True)
    room = OpenBins(length, (length - fills(child[placed], sizes[placed])).tolist())
    displaced = np.flatnonzero(label < 0)  # in descending order of size, as all items are
    child[displaced] = [room.best_fit(s) for s in sizes[displaced].tolist()]
    return child


def evolved(sizes: np.ndarray, elites: list[np.ndarray], rng: np.random.Generator, length: int, population: int, generations: int) -> list[np.ndarray]:
    """The solutions of an island after its generations, best first. sizes: in descending order."""
    least, found = lower_bound(sizes, length), list(elites)
    while len(found) < max(2, population):
        noise = 2.0 ** -(1 + len(found))
        found.append(best_fitted(np.argsort(-(sizes * (1 + noise * rng.standard_normal(len(sizes)))), kind="stable"), sizes, length))
    ranked = sorted(((value(x, sizes), i, x) for i, x in enumerate(found)), key=lambda y: y[:2])
    for step in range(generations):
        if ranked[0][0][0] == least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossed(ranked[a][2], ranked[b][2], sizes, length, rng)
        worth = value(child, sizes)
        worse = max(a, b)
        if worth < ranked[worse][0] and worth not in [x[0] for x in ranked]:
            ranked = sorted([*ranked[:worse], *ranked[worse + 1 :], (worth, len(found) + step, child)], key=lambda y: y[:2])
    return [x for *_, x in ranked]


def _pieces(tokenizer: str, length: int):
    """Batches (id, text) to pieces, numbered by kind (whole or not) from partition * 2^40."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = words_of(tokenizer), TaskContext.get().partitionId() << 40
        seen = [0, 0]
        for batch in (x for whole in batches for x in slices(whole, 1, PIECE)):
            rows, (found, at) = [], words.tokens(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:]):
                ids = np.append(found[a:b], SEPARATOR).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    whole = len(part) == length
                    rows.append((first + seen[whole], whole, doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                    seen[whole] += 1
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sequence_id", "whole", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """sequence_id (a number, see above), whole, doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, length), "sequence_id long, whole boolean, doc_id long, piece int, start long, length long, ids_crc32 long")


def _islands(length: int, population: int, generations: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                sizes = np.asarray(r.sizes, np.int64)
                elites = [np.frombuffer(x, np.int32).astype(np.int64) for x in r.elites]
                rng = np.random.default_rng([seed, r.block, r.island, r.epoch])
                best = evolved(sizes, elites, rng, length, population, generations)[:ELITES]
                out += [(r.block, r.island, rank, *value(x, sizes), lower_bound(sizes, length), x.astype(np.int32).tobytes()) for rank, x in enumerate(best)]
            yield pd.DataFrame(out, columns=["block", "island", "rank", "n_bins", "unevenness", "least", "bins"])

    return run


def packed_blocks(blocks: DataFrame, tables: Tables, length: int = LENGTH, islands: int = ISLANDS, population: int = POPULATION, generations: int = GENERATIONS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """block and bins (binary, 32 bits an item) of every block's best solution. blocks: block, sizes (descending)."""
    schema = "block long, island int, rank int, n_bins long, unevenness double, least long, bins binary"
    ring = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    todo, done = blocks.select("block", "sizes", ring, F.expr("cast(array() AS array<binary>)").alias("elites")), None
    n = min(MAX_TASKS, max(1, islands * blocks.count()))
    for epoch in range(epochs):
        tasks = todo.withColumn("epoch", F.lit(epoch)).repartition(n, "block", "island")
        found = tables.store(f"elites{epoch}", tasks.mapInPandas(_islands(length, population, generations, seed), schema))
        worth = F.struct("n_bins", "unevenness", "island", "rank")
        best = found.groupBy("block").agg(F.min_by("bins", worth).alias("bins"), F.min("n_bins").alias("n_bins"), F.min("least").alias("least"))
        last = epoch == epochs - 1
        over = (best if last else best.where("n_bins = least")).select("block", "bins")
        done = over if done is None else done.unionByName(over)
        if last:
            break
        open_ = best.where("n_bins > least").select("block")
        if open_.isEmpty():
            break
        sent = found.select("block", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"), "bins", "n_bins", "unevenness")
        order = F.array_sort(F.collect_set(F.struct("n_bins", "unevenness", "bins")))
        came = sent.join(open_, "block", "left_semi").groupBy("block", "island").agg(F.slice(order, 1, max(2, population // 2))["bins"].alias("elites"))
        todo = tables.store(f"todo{epoch}", came.join(blocks, "block").select("block", "sizes", "island", "elites"))
    return done


def _placed(length: int):
    """The items of one block and its solution to rows of pieces."""

    def run(key: tuple, items: pa.Table, solution: pa.Table) -> pa.Table:
        sizes, numbers = items.column("length").to_numpy(), items.column("number").to_numpy()
        order = np.lexsort((numbers, -sizes))
        bins = np.frombuffer(solution.column("bins")[0].as_py(), np.int32).astype(np.int64)
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, bins[1:] != bins[:-1]]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        rows = items.take(pa.array(order)).select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return rows.append_column("sequence_id", pa.array(key[0].as_py() << 24 | bins)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK, **evolution: int) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. evolution: see packed_blocks()."""
    tables = Tables(docs.sparkSession)
    every = tables.store("pieces", pieces(docs, tokenizer, id_col, text, length))
    items = numbered(every.where("not whole")).withColumn("block", F.expr(f"number div {block}"))
    sizes = items.groupBy("block").agg(F.sort_array(F.collect_list("length"), asc=False).alias("sizes"))
    best = packed_blocks(tables.store("blocks", sizes), tables, length, **evolution)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    columns = [F.col(x.split()[0]) for x in schema.split(", ")]
    placed = items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_placed(length), schema)
    whole = every.where("whole").withColumns({"sequence_id": F.col("sequence_id") + F.lit(WHOLE), "offset": F.lit(0).cast("long")})
    return placed.unionByName(whole.select(*columns))
