"""Vector codes, centroid clustering and best-fit packing against brute force, on small and odd tables."""

import gc
import random
import traceback
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerlens.llm.entry")
from ledgerlens.llm import centroids, codebooks, entry, grouping_packing, packing
from pyspark.sql import functions as F

TOKENIZER = entry.public_tokenizers.path(entry.TOKENIZER)
VECTORS = "vec_id long, embedding array<double>, label string, cluster string, `at` int, sums string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], VECTORS)


def plain_lloyd(x, start, rounds):
    """x, start: lists of integer tuples. Codes, squared distances and entries after plain Lloyd."""
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(books))
    books = list(start)
    for _ in range(rounds):
        of = [near(v)[1] for v in x]
        for i in set(of):
            own = [v for v, c in zip(x, of) if c == i]
            books[i] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [near(v) for v in x]
    return [i for _, i in found], [d for d, _ in found], books


def whole(vector):
    return tuple(int(np.floor(256 * v)) for v in vector)


def odd_vectors():
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(rng.choice([-1, 0, 2]), 0.3), 3) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(300 + i, rows[7][1], "a") for i in range(200)]  # a large group of equal vectors
    rows += [(7, rows[7][1], "a"), (None, rows[3][1], None), (600, None, "a"), (601, [], "a"), (602, [1.0] * 7 + [float("nan")], "a"), (603, [1.0] * 7 + [None], "a"), (604, [float("-inf")] * 8, "b"), (605, [1.0] * 4, "b")]
    return rows


@pytest.mark.parametrize("entries", [1, 3, 24, 64])
def test_codes_equal_plain_lloyd(spark, entries):
    rows = odd_vectors()
    got, books = codebooks.encoded(vectors(spark, rows).repartition(3), parts=2, entries=entries, rounds=4)
    fit = sorted(((i, whole(v), y) for i, v, y in rows if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[v[4 * p : 4 * p + 4] for _, v, _ in fit] for p in (0, 1)]
    plain = [plain_lloyd(x, x[:entries], 4) for x in parts]
    errors = [a + b for a, b in zip(plain[0][1], plain[1][1])]
    by_label = defaultdict(int)
    for (_, _, y), e in zip(fit, errors):
        by_label[y] += e
    expected = sorted((str(i), (a, b), e, by_label[y]) for (i, _, y), a, b, e in zip(fit, plain[0][0], plain[1][0], errors))
    assert sorted((str(r.vec_id), tuple(r.code), r.error, r.label_error) for r in got.collect()) == expected
    assert [[tuple(x) for x in b] for b in books.tolist()] == [plain[0][2], plain[1][2]]


def test_bounds_round_down_and_prune():
    some = np.abs(np.random.default_rng(0).standard_normal(10_000)) * 10.0 ** np.arange(10_000).clip(0, 8)
    back = codebooks.unpacked_bounds(codebooks.packed_bounds(some))
    assert (back <= some).all() and (back >= some * 0.99).all()
    x = np.random.default_rng(1).integers(-300, 300, (4000, 1, 4))
    books = codebooks.Books(x[:64].transpose(1, 0, 2))
    codes, errors, bounds = books.assign(x, None, None)
    books = books.moved(*np.split(books.sums(x, codes), [4], axis=2)[:1], books.sums(x, codes)[..., 4])
    open_ = np.maximum(bounds[:, 0] - books.drift[0], 0) <= np.sqrt(((x[:, 0] - books.entries[0][codes[:, 0]]) ** 2).sum(1))[:, None]
    assert open_.mean() < 0.7  # groups are skipped
    exact = ((x[:, 0, None] - books.entries[0][None]) ** 2).sum(-1)
    assert (books.assign(x, codes, bounds)[0][:, 0] == exact.argmin(1)).all()


def test_no_codes(spark):
    got, books = codebooks.encoded(vectors(spark, odd_vectors()).where("vec_id = 600"))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error"] and codebooks.digest(books) == codebooks.digest(books)
    assert codebooks.encoded(vectors(spark, [(1, [1.0, 2.0], None)]).limit(0), parts=2)[0].count() == 0
    with pytest.raises(ValueError):
        codebooks.encoded(vectors(spark, []), entries=257)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters_equal_plain_lloyd(spark, k):
    import hashlib

    rows = odd_vectors()
    got = centroids.clustered(vectors(spark, rows).repartition(3), k=k, dims=8, rounds=3)
    fit = [(i, whole(v)) for i, v, _ in rows if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in fit if i is not None)[:k]
    of, distance, ends = plain_lloyd([v for _, v in fit], [v for _, v in start], 3)
    inertia = defaultdict(int)
    for c, d in zip(of, distance):
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in ends]
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == sorted((str(i), c, d, inertia[c], sum(distance), sha[c]) for (i, _), c, d in zip(fit, of, distance))


def test_clusters_of_odd_tables(spark):
    assert centroids.clustered(vectors(spark, odd_vectors()).limit(0), dims=8).count() == 0
    huge = centroids.clustered(vectors(spark, [(1, [1e300, -1e300], None), (2, [0.0, 0.0], None), (None, [1.0, 1.0], None)]), k=1, dims=2, rounds=2).collect()
    assert {r.cluster for r in huge} == {0} and all(r.distance > 0 for r in huge)
    ids = centroids.clustered(vectors(spark, [(2**60 + 1, [1.0], None), (None, [2.0], None)]), dims=1).collect()
    assert {r.vec_id for r in ids} == {2**60 + 1, None}


def least_bins(sizes, length):
    """The least number of bins, by first fit in every order."""

    def bins(order):
        free = []
        for s in order:
            at = next((i for i, f in enumerate(free) if f >= s), None)
            if at is None:
                free.append(length - s)
            else:
                free[at] -= s
        return len(free)

    return min(map(bins, set(permutations(sizes))))


def test_evolution_finds_the_least_number_of_bins():
    rng = random.Random(3)
    for case in range(60):
        sizes = np.array(sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 7))), reverse=True))
        best = grouping_packing.evolved(sizes, [], np.random.default_rng(case), 12, 4, 30)[0]
        n = least_bins(sizes.tolist(), 12)
        assert grouping_packing.value(best, sizes)[0] == n >= grouping_packing.lower_bound(sizes, 12)
        assert grouping_packing.fills(best, sizes).max() <= 12


def test_crossover_keeps_whole_bins_and_every_item():
    rng = np.random.default_rng(4)
    sizes = -np.sort(-rng.integers(100, 1100, 400))
    a, b = (grouping_packing.best_fitted(rng.permutation(400), sizes, 2048) for _ in range(2))
    child = grouping_packing.crossed(a, b, sizes, 2048, rng)
    assert (child >= 0).all() and grouping_packing.fills(child, sizes).max() <= 2048 and (np.bincount(child) > 0).all()
    bins = lambda x: {frozenset(np.flatnonzero(x == i)) for i in np.unique(x)}
    assert bins(child) & bins(a) and bins(child) & bins(b)


def test_generations_improve():
    sizes = -np.sort(-np.random.default_rng(0).integers(400, 1000, 1500))
    before = grouping_packing.evolved(sizes, [], np.random.default_rng(1), 2048, 4, 0)[0]
    after = grouping_packing.evolved(sizes, [], np.random.default_rng(1), 2048, 4, 16)[0]
    assert grouping_packing.value(after, sizes)[0] < grouping_packing.value(before, sizes)[0]


def check_pieces(rows, texts, length):
    words, by, bins = packing.Words(TOKENIZER), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for doc, same in texts.items():
        ids = np.append(words.ids(same[0] or ""), 0).astype("<u4")
        cuts = list(range(0, len(ids), length))
        expected = [(k, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())) for k, a in enumerate(cuts)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[doc]) == sorted(expected * len(same))
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(bins)


@pytest.mark.parametrize("length,block", [(2048, 8192), (64, 16), (1, 4), (7, 3)])
def test_pack_round_trip(spark, length, block):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "naïve", "x1,", "été"]) for _ in range(rng.randint(0, 90))), "d", 1) for i in range(60)]
    rows += [(100, None, None, 2), (101, "", None, 2), (102, "same text", None, 2), (102, "same text", None, 2), (None, "no id", None, 2), (103, "word " * 20_000, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, block int").repartition(3)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    got = grouping_packing.pack(docs, TOKENIZER, length=length, block=block).collect()
    n = check_pieces(got, texts, length)
    assert n <= 1.12 * -(-sum(r.length for r in got) // length) + 8
    assert grouping_packing.pack(docs.limit(0), TOKENIZER, length=length).count() == 0


def test_islands_send_elites(spark):
    sizes = [-np.sort(-np.random.default_rng(k).integers(400, 1000, 300)) for k in range(3)]
    from ledgerlens.llm.common import Tables

    blocks = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sizes)], "block long, sizes array<long>")
    counts = []
    for epochs in (1, 3):
        found = {r.block: np.frombuffer(r.bins, np.int32).astype(np.int64) for r in grouping_packing.packed_blocks(blocks, Tables(spark), epochs=epochs, generations=3).collect()}
        assert sorted(found) == [0, 1, 2] and all(grouping_packing.fills(found[k], s).max() <= 2048 for k, s in enumerate(sizes))
        counts.append([grouping_packing.value(found[k], s) for k, s in enumerate(sizes)])
    assert all(late <= early for early, late in zip(*counts)) and counts[0] != counts[1]


def test_words_are_learned_in_small_pieces_without_the_collector():
    words, runs = packing.words_of.__wrapped__(TOKENIZER), []
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} {k}" for i in range(k, 6000, 3)) for k in range(3)]
    whole = [words.ids(x).tolist() for x in texts]
    words.clear()
    gc.callbacks.append(count := lambda phase, _: runs.append(phase) if any(f.name == "_learn" for f in traceback.extract_stack()) else None)
    found, at = words.tokens(pa.array(texts))
    gc.callbacks.remove(count)
    assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == whole
    assert not runs and gc.isenabled()

    class Sizes:
        seen = []

        def tokens(self, texts):
            self.seen.append(sum(len(x) for x in texts.to_pylist()))
            return np.arange(len(texts)), np.arange(len(texts) + 1)

    docs = pa.RecordBatch.from_arrays([pa.array(range(96)), pa.array(["x" * (1 << 17)] * 96)], names=["doc_id", "text"])
    assert sum(len(x) for x in packing.blocks([docs], Sizes())) == 96
    assert sum(Sizes.seen) == 96 << 17 and max(Sizes.seen) <= (4 << 20) + (1 << 17)
