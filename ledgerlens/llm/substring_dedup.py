"""Substring deduplication by seed and extend.

Seeds. Every run of `window` words holds window - SEED_WORDS + 1 seeds (runs of SEED_WORDS words); the leftmost one with
the least hash is its anchor, so two documents that share such a run share its anchor at the same place in it. Anchors
of one document only, most of them, are dropped by a least and a greatest id that Spark combines before the shuffle.

Extension. A document that joins others on an anchor extends it both ways, to every run of `window` words that has this
anchor. A run is known by 96 bits of hash and joined with the least id in which it starts; copies that meet are never
paired with each other, so a passage in a third of all documents costs one row a copy. Runs that also start in a
document with a smaller id are repeats; overlapping ones merge into maximal repeats, whose words are removed, so the
first document keeps its own.

Texts are hashed whole once, for the anchors; afterwards only runs beside shared anchors are, and the last step marks
words by their positions. Each step ends in a table in the shared folder, dropped after its last reader. No group of
copies is gathered: hot anchors and runs are counted before the shuffle and joined by joins that Spark can split.

Defined results. Null and empty texts have no words; an empty table gives no rows. Texts of any length are worked whole.
Rows with null id are returned unchanged and repeat nothing. Rows with one id never repeat each other; each is judged by
itself (their texts are told apart by 32 bits of hash). Repeated rows are returned as often as they come. Runs are judged
on the input. Texts of fewer words than the window stay whole. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tables, slices, utf8

WINDOW = 13
#: Longer seeds are shared by chance less often, which keeps the extension small as the corpus grows; shorter ones are fewer.
SEED_WORDS = 7
CACHED_WORDS = 200_000
#: Texts are worked in pieces of about so many bytes, which bounds the arrays beside them.
PIECE_BYTES = 4 << 20
_POWERS = [np.array([pow(m, i, 2**64) for i in range(1024)], np.uint64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(total: np.ndarray) -> np.ndarray:
    total ^= total >> np.uint64(32)
    total *= _SPREAD
    return total ^ (total >> np.uint64(29))


def hashed(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each row's begin (one more for the end)."""
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
    return np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1])), starts


def runs_at(x: np.ndarray, at: np.ndarray, size: int, powers: np.ndarray) -> np.ndarray:
    """A hash of the run of `size` words that starts at each given place."""
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total += x[at + i] * powers[i]
    return _mixed(total)


def anchors(x: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every row's anchors, in order: owner (row), hash, first (the first window that has it, by its word in the row), count (of its windows)."""
    n, size = len(x) - window + 1, min(SEED_WORDS, window)
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    seeds, at = runs_at(x, np.arange(len(x) - size + 1), size, _POWERS[0]), np.arange(n)
    least, place = seeds[:n].copy(), at.copy()
    for i in range(1, window - size + 1):
        less = seeds[i : i + n] < least
        np.copyto(least, seeds[i : i + n], where=less)
        np.copyto(place, at + i, where=less)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    keep = np.flatnonzero(at + window <= starts[row + 1])
    place, row = place[keep], row[keep]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))) if len(keep) else keep
    count = np.diff(np.concatenate((new, [len(keep)])))
    return row[new], least[keep][new].view(np.int64), keep[new] - starts[row[new]], count


def _anchor_rows(window: int):
    """From doc_id and text: anchor, doc_id and windows (first * window + count) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, 1, PIECE_BYTES):
                owner, anchor, first, count = anchors(*hashed([t.split() for t in utf8(part.column(1))], cache), window)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(pa.array(owner)), pa.array(first * window + count)], names=["anchor", "doc_id", "windows"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every member of a column of lists; null lists have none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def _tags(texts: list[bytes | None]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(t or b"") for t in texts), np.int64, len(texts))


def _run_rows(window: int):
    """From doc_id, text and the windows of its shared anchors: run and check (hashes), doc_id and place of each such window.

    The place is its first word's position in the upper 32 bits and the text's tag in the lower ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for part in slices(batch, 1, PIECE_BYTES):
                texts = utf8(part.column(1))
                x, starts = hashed([t.split() for t in texts], cache)
                row, packed = _flat(part.column(2))
                first, count = packed // window, packed % window
                row = np.repeat(row, count)
                first = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))
                # Rows of one id share their anchors' list: what lies beyond this row isn't its own.
                inside = first + window <= np.diff(starts)[row]
                row, first = row[inside], first[inside]
                at = first + starts[row]
                out = [
                    pa.array(runs_at(x, at, window, _POWERS[0]).view(np.int64)),
                    pa.array((runs_at(x, at, window, _POWERS[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    part.column(0).take(pa.array(row)),
                    pa.array(first << 32 | _tags(texts)[row]),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["run", "check", "doc_id", "place"])

    return run


def _removal_rows(window: int, with_text: bool):
    """From doc_id, text and the places of its repeated runs: what is removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PIECE_BYTES):
                texts = utf8(part.column(1))
                words = [(t or b"").split() for t in texts]
                row, place = _flat(part.column(2))
                own = (place & 0xFFFFFFFF) == _tags(texts)[row]
                row, first = row[own], place[own] >> 32
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                removed, kept, spans = [], [], []
                for i, (of, a, b) in enumerate(zip(words, edges, edges[1:])):
                    if a == b:
                        removed.append(0), kept.append(b" ".join(of)), spans.append([])
                        continue
                    step = np.zeros(len(of) + 1, np.int64)
                    np.add.at(step, first[a:b], 1)
                    np.add.at(step, first[a:b] + window, -1)
                    off = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], off, [False])).astype(np.int8))).reshape(-1, 2).tolist()
                    removed.append(int(off.sum()))
                    kept.append(b" ".join(chain.from_iterable(of[c:d] for c, d in zip([0, *(e[1] for e in edge)], [*(e[0] for e in edge), len(of)]))))
                    spans.append([{"first": c, "last": d - 1} for c, d in edge])
                out = [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                out.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))))
                if with_text:
                    out.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "kept_text"][: len(out)])

    return run


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_sha256, repeats (maximal ranges of removed words) and, if asked for, kept_text."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known, tables = docs.where("doc_id is not null and text is not null"), Tables(docs.sparkSession)
    least, most = F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")

    seeds = tables.store("seeds", known.mapInArrow(_anchor_rows(window), "anchor long, doc_id long, windows long"))
    shared = tables.store("shared", seeds.groupBy("anchor").agg(least, most).where("first_id < last_id").select("anchor"))
    joined = tables.store("joined", seeds.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("windows").alias("windows")))
    tables.drop("seeds", "shared")

    extended = known.join(joined, "doc_id").select("doc_id", "text", "windows").mapInArrow(_run_rows(window), "run long, check int, doc_id long, place long")
    extended = tables.store("extended", extended)
    tables.drop("joined")
    first = tables.store("first", extended.groupBy("run", "check").agg(least, most).where("first_id < last_id").select("run", "check", "first_id"))
    repeats = extended.join(first, ["run", "check"]).where("first_id < doc_id").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    repeats = tables.store("repeats", repeats)
    tables.drop("extended", "first")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:long,last:long>>" + ", kept_text string" * with_text
    return docs.join(repeats, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(_removal_rows(window, with_text), schema)
