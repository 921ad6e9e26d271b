"""SimHash near-duplicates by word shingles, whose similarity is verified.

A text's set is the 64-bit hashes of its word shingles; texts with one set form a class, known by a hash of the set.
Beside the fingerprint over all shingles, as in `simhash`, a class has PLACES fingerprints over small samples: under each
of as many orders, the SimHash of the three first shingles. Two sets of Jaccard similarity s share a sample with
probability s^3 about, so classes of similarity 0.8 miss each other on all samples once in a thousand, more similar ones
hardly ever, whatever the length of the texts.

Classes meet on equal samples. A pair is discarded if a coordinate of its pivot table (the Hamming distances of the
fingerprints over all shingles to the reference fingerprints) differs by more than MAX_BITS, or the fingerprints do;
all survivors are verified on their sets: Jaccard similarity of at least P / Q.

As in line_dedup, each class is first verified against the first and the last of the place, the links are joined into
groups, and only classes of different groups are compared pair by pair.

Defined results. Null, empty and blank texts have one set, the empty one. Texts of fewer words than a shingle have one
shingle; texts of any length are worked whole. Of a group's rows the one with the smallest id stays, of several texts
under that id one. Different texts under one id are judged apart. Rows with null id stay and take no part. An empty
table gives an empty one. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tables, unused, utf8
from ledgerlens.llm.components import components
from ledgerlens.llm.simhash import _LOWER, PIVOTS, SEED, near, shingle_hashes, votes

#: The least similarity, as a fraction.
P, Q = 4, 5
PLACES, SAMPLE = 10, 3
#: At similarity 0.8 ten bits differ on average, so many or more once in a thousand.
MAX_BITS = 20
CACHED_SETS = 64
_ORDERS = np.random.default_rng(65).integers(0, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
MARK = "struct<key:bigint,n:bigint,fp:bigint,places:array<bigint>>"
MARK_TYPE = pa.struct([("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("places", pa.list_(pa.int64()))])


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    parts = list(shingle_hashes((text or b"").translate(_LOWER).split(), size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (P + Q) >= P * (len(a) + len(b))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some hashes, as a number."""
    return int(np.packbits(2 * votes(hashes) > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def sample_places(hashes: np.ndarray) -> list[int]:
    """A place for each order: a hash of the SimHash of its first shingles."""
    out = []
    for i, factor in enumerate(_ORDERS):
        ordered = hashes * factor
        ordered ^= ordered >> np.uint64(32)
        first = np.sort(ordered if len(ordered) <= SAMPLE else np.partition(ordered, SAMPLE - 1)[:SAMPLE]).tolist()
        x, y, z = first if len(first) == SAMPLE else [*(first * 2)[:2], 0]  # one shingle stands for itself, of two the bits that both have
        out.append(xxhash.xxh64_intdigest(((x & y) | (x & z) | (y & z)).to_bytes(8, "little"), i))
    return out


def mark_column(size: int):
    """A column function: text to the key and size of its set, fingerprint and places."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [shingle_set(t, size) for t in utf8(texts)]
            longs = lambda values: pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            places = [sample_places(s) if len(s) else [] for s in sets]
            offsets = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            yield pa.StructArray.from_arrays([longs([set_key(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), longs([majority(s) for s in sets]), pa.ListArray.from_arrays(offsets, longs([x for p in places for x in p]))], fields=list(MARK_TYPE))

    return F.arrow_udf(run, MARK).asNondeterministic()


def surviving(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes, pivot tables and fingerprints don't rule out. classes: key, n, fp."""
    one, two = (classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("fp").alias(f"fp_{k}")) for k in "ab")
    sized = pairs.join(one, "a").join(two, "b").where(Q * F.least("n_a", "n_b") >= P * F.greatest("n_a", "n_b")).select("a", "b", "fp_a", "fp_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3))
            tables = [np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8) for x in (one, two)]
            yield batch.select(["a", "b"]).filter(pa.array(near(one, two, *tables, MAX_BITS), pa.bool_()))

    return sized.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough. texts: key, text."""
    one, two = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def set_of(key: int, text: bytes) -> np.ndarray:
            if key not in sets:
                if len(sets) >= CACHED_SETS:
                    sets.clear()
                sets[key] = shingle_set(text, size)
            return sets[key]

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            good = [alike(set_of(x, s), set_of(y, t)) for x, y, s, t in zip(a, b, utf8(batch.column(2)), utf8(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], names=["a", "b"])

    return surviving(pairs, classes).join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, size: int, tables: Tables) -> DataFrame:
    """node, component: the group of every class that is similar to another. rows: key, n, fp, places, text, kept in a table."""
    classes = tables.store("classes", rows.select("key", "n", "fp", "places").dropDuplicates(["key"]))
    places = classes.select(F.explode("places").alias("place"), "key").distinct().repartition("place")
    ends = places.groupBy("place").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    met = tables.store("met", places.join(ends.hint("shuffle_hash"), "place"))
    texts = tables.store("texts", rows.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
    star = tables.store("star", met.select(F.explode(F.array("first", "last")).alias("x"), "key").where("x <> key").select(F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct())
    links = tables.store("links", verified(star, classes, texts, size))
    named = met.join(components(links), F.col("key") == F.col("node"), "left").select("place", "key", F.coalesce("component", "key").alias("component"))
    apart = named.groupBy("place").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("place")
    open_ = tables.store("open", named.join(apart, "place"))
    one, two = (open_.select("place", F.col("key").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab")
    rest = one.join(two, "place").where("a < b and c_a <> c_b").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    more = tables.store("more", verified(rest, classes, texts, size))
    tables.drop("met", "texts", "star", "open", "classes")
    out = tables.store("groups", components(links.unionByName(more)))
    tables.drop("links", "more")
    return out


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of smaller id in their group, with docs' own columns."""
    tables = Tables(docs.sparkSession)
    mark, found_id, found_key = (unused(docs, x) for x in ("__mark", "__id", "__kept"))
    marked = tables.store("marked", docs.withColumn(mark, mark_column(size)(F.col(f"`{text}`"))))
    id_ = F.col(f"`{id_col}`").cast("long")
    rows = marked.where(id_.isNotNull()).select(id_.alias("id"), f"{mark}.*", F.col(f"`{text}`").alias("text"))
    found = groups(rows.select("key", "n", "fp", "places", "text"), size, tables)
    ids = rows.groupBy("key").agg(F.min("id").alias("id"))
    grouped = ids.join(found, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("component", "key")).agg(F.min(F.struct("id", "key")).alias("x"))
    kept = tables.store("kept", grouped.select(F.col("x.id").alias(found_id), F.col("x.key").alias(found_key)))
    tables.drop("groups")
    left = marked.join(kept, (id_ == F.col(found_id)) & (F.col(f"{mark}.key") == F.col(found_key)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = left.groupBy(found_id, found_key).agg(F.min(F.struct(*columns)).alias("x")).select("x.*")
    return once.unionByName(marked.where(id_.isNull()).select(*columns))
