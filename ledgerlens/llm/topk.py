"""Exact top-k search over a bit-sliced index.

Rows are dealt into blocks. A block's index holds, for every attribute and bit, a bitmap over its rows (the slices of the
quantised attribute less the block's least value). A query adds, for every attribute, the slices shifted by the set bits
of the weight, complemented where the weight is negative; the additions are carry-save adders over bitmaps, so a word
adds 64 rows at once. The sum's slices are then read from the most significant downward to select the k best rows; rows
that tie at the boundary are resolved exactly, by id. Chosen rows' scores are computed directly.

Blocks and query chunks of bounded size meet in cells, each a task's work; a cell returns k rows a query, and the best k
of all blocks follow from a ranking by query.

Defined results. Rows with null id, null vector or a null or non-finite component take no part. Components are held to
+-2^61 after quantisation; a score beyond a long wraps. Rows equal in id and vector count once; a query meets every row
of the same number of components but those with its own id. Ties go to the smaller id. Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
BLOCK_ROWS = 32_768
CHUNK_QUERIES = 512
_LIMIT = float(2**61)


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x.cast("double"), F.lit(-_LIMIT)), F.lit(_LIMIT))))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def packed(flags: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as 64-bit words, rows padded with zeros."""
    rows = flags.shape[-1]
    wide = np.zeros((*flags.shape[:-1], -(-rows // 64) * 64), bool)
    wide[..., :rows] = flags
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


class BitSlices:
    """The bit-sliced index of a block of vectors, in ascending order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        least = int(vectors.min()) if vectors.size else 0
        above = (vectors - least).astype(np.uint64)
        width = max(1, int(above.max()).bit_length() if above.size else 1)
        self.slices = np.stack([packed(((above >> np.uint64(b)) & np.uint64(1)).astype(bool).T) for b in range(width)], axis=1)  # attribute, bit, words
        self.all = packed(np.ones(len(ids), bool))

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score (up to a constant), least significant first."""
        columns: dict[int, list[np.ndarray]] = {}
        size = np.array([abs(int(w)) for w in weights], object)
        for t in range(max((int(w).bit_length() for w in size), default=0)):
            on = np.array([bool(int(w) >> t & 1) for w in size])
            if on.any():
                part = self.slices[on] ^ np.where(weights[on] < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None, None]
                for b in range(part.shape[1]):
                    columns.setdefault(t + b, []).append(part[:, b])
        out, k = [], 0
        while columns:
            stack = np.concatenate(columns.pop(k)) if k in columns else np.zeros((0, len(self.all)), np.uint64)
            while len(stack) > 1:
                if len(stack) == 2:
                    carry, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
                else:
                    n = len(stack) // 3
                    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                    half = a ^ b
                    carry, stack = (a & b) | (c & half), np.concatenate([half ^ c, stack[3 * n :]])
                columns.setdefault(k + 1, []).append(carry)
            out.append(stack[0] if len(stack) else np.zeros_like(self.all))
            k += 1
        return out

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's k best rows for a query, its own id left out."""
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
        own = np.zeros(len(self.ids), bool)
        own[a:b] = True
        open_, sure = self.all & ~packed(own), np.zeros_like(self.all)
        n_sure = 0
        for bitmap in reversed(self.sums(weights)):
            high = open_ & bitmap
            n = int(np.bitwise_count(high).sum())
            if n_sure + n > k:
                open_ = high
            else:
                sure, open_, n_sure = sure | high, open_ & ~bitmap, n_sure + n
                if n_sure == k:
                    break
        rows = self._rows(sure)
        if n_sure < k:  # the rest tie: the smallest ids
            rows = np.concatenate([rows, self._rows(open_)[: k - n_sure]])
        return self.ids[rows], self.vectors[rows] @ weights

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(self.ids)])


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, tags = table.column("vec_id").to_numpy(), table.column("tag").to_numpy()
        vectors = table.column("q").combine_chunks().values.to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        order = order[~asks[order]]
        index = BitSlices(ids[order], vectors[order])
        parts = [(i, *index.top(int(ids[i]), vectors[i], k)) for i in np.flatnonzero(asks)] if len(order) else []
        n = [len(x[1]) for x in parts]
        column = lambda i, kind: pa.array(np.concatenate([x[i] for x in parts]) if parts else [], kind)
        return pa.table([pa.array(np.repeat([ids[x[0]] for x in parts], n), pa.int64()), pa.array(np.repeat([tags[x[0]] for x in parts], n), pa.int64()), column(1, pa.int64()), column(2, pa.int64())], names=["query_id", "tag", "vec_id", "score"])

    return run


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = 64.0, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for each row that is_query (on id_col) selects."""
    rows = table.where(F.col(f"`{id_col}`").isNotNull() & finite(F.col(f"`{vector}`"))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), is_query.alias("asks"), quantised(F.col(f"`{vector}`"), scale).alias("q")).where(F.size("q") > 0)
    rows = rows.distinct().withColumn("tag", F.xxhash64("vec_id", "q")).withColumn("dim", F.size("q"))
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-asked // chunk_queries))
    spread = lambda name, parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    index = rows.select("dim", "vec_id", "tag", "q", F.lit(False).alias("asks"), F.pmod("tag", F.lit(blocks)).cast("int").alias("block"), spread("chunk", chunks))
    queries = rows.where("asks").select("dim", "vec_id", "tag", "q", "asks", spread("block", blocks), F.pmod("tag", F.lit(chunks)).cast("int").alias("chunk"))
    found = index.unionByName(queries).groupBy("dim", "block", "chunk").applyInArrow(_cell(k), "query_id long, tag long, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
