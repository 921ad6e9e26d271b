"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has bit i set if it is set in over half of the 64-bit hashes of its word shingles. Rows with one
fingerprint form a class, which its smallest id stands for, so exact copies cost one row. Two fingerprints that differ
in at most `max_bits` bits agree in at least `blocks` - max_bits of `blocks` blocks (the distances to the reference
fingerprint zero and to those with a single bit of a block tell that block), so classes meet under each choice of so
many blocks. Where they meet, a table holds their Hamming distances to PIVOTS reference fingerprints: by the triangle
inequality a pair whose distances to some pivot differ by more than max_bits can't be near. Surviving pairs are verified.

A meeting place with more than `chunk` classes is dealt into chunks, and each pair of chunks is a task's work of its
own, so no group is gathered whole and none is cut short. A task returns links from each found component to its smallest
member, not pairs.

Defined results. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with null id get
a component if others of their class have an id, else null. Repeated rows are kept. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, utf8
from ledgerlens.llm.components import components

SEED = 42
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 32, np.uint64)
CHUNK = 2048
#: Up to this size groups are compared offset by offset, all groups of a batch at once.
SMALL = 24
PIECE = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of `size` words (of all words, if fewer), in pieces."""
    for at in range(0, max(1, len(words) - size + 1) if words else 0, PIECE):
        part = words[at : at + PIECE + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[: len(part) - size].tolist()] if len(part) > size else [0]
        stops = (ends[min(size, len(part)) - 1 :] - 1).tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set. Bytes of a word count up to 255 without a carry, so rows are added in blocks."""
    total = np.zeros((8, 8), np.int64)
    for i in range(8):
        lanes = (hashes >> np.uint64(i)) & _LANES
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
        total[:, i] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total.ravel()


def fingerprint(text: bytes, size: int) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text.translate(_LOWER).split(), size):
        total += votes(hashes)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint_column(size: int):
    """A column function: text to fingerprint, as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t or b"", size) for t in utf8(texts)], np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(run, "bigint").asNondeterministic()


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def bounds(blocks: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each block."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def meeting_places(classes: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """A row for each class and choice of blocks: place, fp, rep."""
    parts = bounds(blocks)

    def key(n: int, chosen: tuple[int, ...]):
        value = F.lit(n).cast("long")
        for i in chosen:
            at, width = parts[i]
            value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return value

    keys = [key(n, chosen) for n, chosen in enumerate(combinations(range(blocks), blocks - max_bits))]
    return classes.select(F.explode(F.array(*keys)).alias("place"), "fp", "rep")


def near(one: np.ndarray, other: np.ndarray, table_one: np.ndarray, table_other: np.ndarray, max_bits: int) -> np.ndarray:
    """Flags of the pairs that pass the pivot tables and the count of differing bits."""
    kept = np.flatnonzero((np.abs(table_one - table_other) <= max_bits).all(axis=-1))
    flags = np.zeros(np.broadcast_shapes(one.shape, other.shape), bool)
    a, b = np.broadcast_arrays(one, other)
    flags[kept] = np.bitwise_count(a[kept] ^ b[kept]) <= max_bits
    return flags


def _group_links(fps: np.ndarray, table: np.ndarray, reps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (smallest, member) of the components within one group; every row is compared with rows not yet reached only."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        found, queue = [int(left[0])], [int(left[0])]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(fps[i], fps[left], table[i], table[left], max_bits)
            new = left[hit].tolist()
            left = left[~hit]
            found += new
            queue += new
        if len(found) > 1:
            ids = reps[found]
            least = int(ids.min())
            out += [(least, int(x)) for x in ids if x != least]
    return out


def _link_rows(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cells: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
            edges = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(axis=1), [True])))
            sizes = np.diff(edges)
            group, size_of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes)
            a_out, b_out = [], []
            for step in range(1, min(SMALL, int(sizes.max())) if len(sizes) else 0):
                i = np.flatnonzero((group[:-step] == group[step:]) & (size_of[:-step] <= SMALL))
                i = i[near(fps[i], fps[i + step], table[i], table[i + step], max_bits)]
                a_out.append(reps[i])
                b_out.append(reps[i + step])
            more = [x for g in np.flatnonzero(sizes > SMALL) for x in _group_links(fps[edges[g] : edges[g + 1]], table[edges[g] : edges[g + 1]], reps[edges[g] : edges[g + 1]], max_bits)]
            a = np.concatenate([*a_out, np.array([x[0] for x in more], np.int64)])
            b = np.concatenate([*b_out, np.array([x[1] for x in more], np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1), batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            last = np.flatnonzero((held[0] != held[0][-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield links(*held)

    return run


def links(classes: DataFrame, max_bits: int, blocks: int, chunk: int = CHUNK) -> DataFrame:
    """classes: fp, rep, one row a fingerprint. Returns a, b: links of representatives with the components that near pairs make."""
    rows = meeting_places(classes, max_bits, blocks)
    crowded = rows.groupBy("place").count().where(F.col("count") > chunk).select("place", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = rows.join(crowded, "place", "left").select("place", F.coalesce(mine, F.lit(0)).alias("mine"), other.alias("other"), "fp", "rep")
    cells = dealt.select("place", F.least("mine", "other").cast("long").alias("i"), F.greatest("mine", "other").cast("long").alias("j"), "fp", "rep")
    return cells.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j").mapInArrow(_link_rows(max_bits), "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """One row a row of docs: doc_id, fp (signed long), component_id (the smallest id reached over links of at most max_bits bits)."""
    marked = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint_column(size)(F.col(f"`{text}`")).alias("fp")))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes.where("rep is not null"), max_bits, blocks))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without those whose group has a smaller id, with docs' own columns. Of rows with one id, one stays if their group's smallest id is theirs; rows with null id stay."""
    groups = near_duplicates(docs, id_col, text, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(groups, F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left_anti")
    once = left.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col])
    return once.unionByName(left.where(F.col(f"`{id_col}`").isNull()))
