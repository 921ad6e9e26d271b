"""Selection by rounds and epochs against the sequential rules."""

import hashlib
import random
from collections import Counter

import pytest
from ledgerlens.operators import epochs, selection
from pyspark.sql import functions as F

POOL = "doc_id long, cluster_id int, vendor_key string, rare boolean, long boolean, complete boolean, score double, lang string, kind string"


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def make_pool(n, seed, clusters=40, vendors=50):
    rng = random.Random(seed)
    maybe = lambda p: rng.choice([None, True, False]) if rng.random() < 0.1 else rng.random() < p
    return [(i, rng.choice([None, *range(clusters)]), rng.choice([None, "hot", "hot", *map(str, range(vendors))]), maybe(0.1), maybe(0.3), maybe(0.7), rng.choice([None, 1.0, 2.0, 3.5]), rng.choice(["en", "de", None]), rng.choice("abcdef")) for i in range(n)]


class Greedy:
    """The sequential rule: one pass in rank order, used clusters and vendors kept aside."""

    def __init__(self, pool):
        self.order = sorted(pool, key=lambda p: (sha("s", "global", p[0]), p[0]))
        self.chosen, self.clusters, self.vendors = [], set(), set()

    def free(self, p):
        return p[1] not in self.clusters and p[2] not in self.vendors

    def add(self, p, phase):
        self.chosen.append((p[0], phase, p))
        self.clusters.add(p[1])
        self.vendors.add(p[2])

    def quota(self, name, column, cap):
        for p in self.order:
            if sum(bool(q[column]) for *_, q in self.chosen) >= cap:
                break
            if p[column] and self.free(p):
                self.add(p, name)

    def fill(self, total):
        rate = sum(bool(p[5]) for p in self.order) / len(self.order)
        queues = {b: [p for p in self.order if bool(p[5]) == b] for b in (True, False)}
        while len(self.chosen) < total and (queues[True] or queues[False]):
            want = sum(bool(q[5]) for *_, q in self.chosen) / max(1, len(self.chosen)) < rate
            p = (queues[want] or queues[not want]).pop(0)
            if self.free(p):
                self.add(p, "representative_fill")


@pytest.mark.parametrize("seed,total", [(1, 25), (2, 10), (3, 1000)])
def test_selection_equals_the_sequential_pass(spark, seed, total):
    pool = make_pool(220, seed)
    greedy = Greedy(pool)
    greedy.quota("rare", 3, 4)
    greedy.quota("long", 4, 7)
    greedy.fill(total)
    table = spark.createDataFrame(pool + pool[:5], POOL).repartition(3)
    got = selection.select_documents(table, [("rare", "rare", 4), ("long", "`long`", 7)], total, "complete", "s").collect()
    assert sorted((r.doc_id, r.phase) for r in got) == sorted(x[:2] for x in greedy.chosen) and len(got) > 5


def test_isolated_rows_of_odd_pools(spark):
    empty = spark.createDataFrame([], POOL)
    assert selection.isolated(empty, F.struct("doc_id")).count() == 0
    assert selection.select_documents(empty, [("rare", "rare", 4)], 5, "complete", "s").count() == 0
    chain = spark.createDataFrame([(i, i // 2, str((i + 1) // 2), None, None, None, None, None, None) for i in range(40)], POOL)  # each conflicts with the next
    assert [r.doc_id for r in selection.isolated(chain, F.struct("doc_id")).orderBy("doc_id").collect()] == list(range(0, 40, 2))


def novel_pass(pool, total, prior=()):
    seen, used_c, used_v, out = {}, set(), set(), []
    left = [p for p in pool if p[0] not in {q[0] for q in prior} and p[1] not in {q[1] for q in prior} and p[2] not in {q[2] for q in prior}]
    while left and len(out) < total:
        new = lambda p: sum(v not in seen.get(f, set()) for f, v in (("lang", p[7]), ("kind", p[8])))
        left.sort(key=lambda p: (-new(p), -(p[6] if p[6] is not None else float("-inf")), p[0]))
        pick = next((p for p in left if p[1] not in used_c and p[2] not in used_v), None) or next((p for p in left if p[2] not in used_v), None) or left[0]
        out.append(pick[0])
        used_c.add(pick[1])
        used_v.add(pick[2])
        for f, v in (("lang", pick[7]), ("kind", pick[8])):
            seen.setdefault(f, set()).add(v)
        left.remove(pick)
    return out


@pytest.mark.parametrize("n,clusters,vendors,total", [(150, 30, 40, 12), (40, 3, 9, 20), (12, 2, 2, 30)])
def test_novelty_equals_the_sequential_pass(spark, n, clusters, vendors, total):
    pool = make_pool(n, n, clusters, vendors)
    got = selection.novel(spark.createDataFrame(pool, POOL), total, ["lang", "kind"]).orderBy("pick").collect()
    assert [r.doc_id for r in got] == novel_pass(pool, total)
    if n > 100:
        prior = [p for p in pool if p[0] in {r.doc_id for r in got}]
        more = selection.novel(spark.createDataFrame(pool, POOL), 8, ["lang", "kind"], spark.createDataFrame(prior, POOL)).orderBy("pick").collect()
        assert [r.doc_id for r in more] == novel_pass(pool, 8, prior)


def epoch_pass(pool, exposure, slots, seed, epoch):
    had = Counter()
    for s, d in pool:
        had[d] += exposure[s]
    out = []
    for stage in (False, True):
        left = [(s, d) for s, d in pool if (exposure[s] > 0) == stage and s not in out]
        while left and len(out) < slots:
            left.sort(key=lambda p: (had[p[1]], sha(seed, epoch, "gvr", p[0])))
            s, d = left.pop(0)
            out.append(s)
            had[d] += 1
    for s in out:
        exposure[s] += 1
    return out


def test_epochs_equal_the_sequential_draws(spark, tmp_path):
    rng = random.Random(4)
    pool = [(i, rng.choice([None, "hot", "hot", *"abcdefgh"])) for i in range(90)]
    table, exposure = spark.createDataFrame(pool, "sample_id long, document string").repartition(4), Counter({s: 0 for s, _ in pool})
    folder = str(tmp_path / "state")
    with pytest.raises(ValueError):
        epochs.run_epoch(table, folder, 1, 40, "5")
    for e in range(4):
        state = epochs.run_epoch(table, folder, e, 40, "5")
        before = dict(exposure)
        expected = epoch_pass(pool, exposure, 40, "5", e)
        rows = state.collect()
        assert [r.sample_id for r in sorted((r for r in rows if r.place), key=lambda r: r.place)] == expected
        assert {r.sample_id: r.exposure for r in rows} == exposure
        again = epochs.run_epoch(table, folder, e, 40, "5").collect()  # a rerun finds the epoch done
        assert sorted(map(str, again)) == sorted(map(str, rows))
        covered = epochs.coverage(state).first()
        assert (covered.samples, covered.seen, covered.slots, covered.repeats) == (90, sum(v > 0 for v in exposure.values()), 40, sum(before[s] > 0 for s in expected))
    assert not [p for p in (tmp_path / "state").iterdir() if p.name.startswith("_")]


def test_an_epoch_larger_than_the_pool(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "a")], "sample_id long, document string")
    assert epochs.run_epoch(table, str(tmp_path / "s"), 0, 10, "x").where("place is not null").count() == 2
    assert epochs.coverage(epochs.opening(table.limit(0)).withColumn("place", F.lit(None).cast("long"))).first().samples == 0
