"""Checks of a corpus on small tables with gaps."""

from ledgerlens.operators import integrity
from pyspark.sql import functions as F


def rows_of(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_uses_and_conflicts(spark):
    uses = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 1, None), (None, 0, "q")], "k string, at int, v string")
    assert rows_of(integrity.first_uses(uses, "k", "at", "v"), "k", "v", "uses") == [("a", "y", "3"), ("b", "None", "1")]
    assert rows_of(integrity.conflicting(uses, "k", "v"), "k", "versions") == [("a", "3")]
    assert integrity.conflicting(uses.where("k = 'b'"), "k", "v").count() == 0


def test_references(spark):
    texts = spark.createDataFrame([("p", "see 0123abcd and 0123abcd, ffff0000"), ("q", None), ("r", "ffff0000")], "place string, text string")
    known = spark.createDataFrame([("0123abcd",), ("0123abcd",), (None,)], "id string")
    assert rows_of(integrity.referenced(texts, "place", "text", "[0-9a-f]{8}", known, "id"), "id", "place") == [("0123abcd", "p")]


def test_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert tuple(integrity.compared_sets(ids(1, 2, 2, None), ids(2, 3), "id").first()) == (1, 1, 1, False, False)
    assert tuple(integrity.compared_sets(ids(1, 1), ids(1, None), "id").first()) == (0, 0, 1, True, False)
    assert tuple(integrity.compared_sets(ids(), ids(), "id").first()) == (0, 0, 0, True, True)
    assert rows_of(integrity.unexplained(ids(1, 2, 3, 3), ids(1), ids(1, 2), "id"), "id", "state") == [("1", "registered"), ("2", "excluded"), ("3", "unexplained")]


def test_leaks(spark):
    texts = spark.createDataFrame([(1, "gold_label here, malicious /a/b"), (2, "clean"), (3, None)], "i int, t string")
    hits = texts.select("i", integrity.leak_hits(F.col("t"), ["gold_label", "x."], r"\b(?:benign|malicious)\b", {"path": "/[a-z]/[a-z]"}).alias("h")).orderBy("i").collect()
    assert [r.h for r in hits] == [["label_token:gold_label", "class_word:malicious", "path"], [], []]
    own = spark.createDataFrame([(1, "has S-1", ["S-1", "S-1", "", None]), (2, "has S-1", ["S-2"]), (3, None, ["S"])], "i int, t string, own array<string>")
    assert rows_of(integrity.own_token_leaks(own, "i", "t", "own"), "i", "token") == [("1", "S-1")]


def test_sharing_and_content_ids(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "x"), ("c", "y"), (None, "x"), ("d", None)], "k string, p string")
    assert rows_of(integrity.sharing_patterns(rows, "k", "p"), "partitions", "n") == [("x+y", "2"), ("y", "1")]
    memories = spark.createDataFrame([(2, "same"), (1, "same"), (3, "other")], "n int, c string")
    got = {r.n: (r.memory_id, r.accepted) for r in integrity.content_ids(memories, "c", "n").collect()}
    assert got[1][0] == got[2][0] != got[3][0] and got[1][0].startswith("MEM-") and len(got[1][0]) == 20 and [got[n][1] for n in (1, 2, 3)] == [True, False, True]


def test_expectations_count_unknown_as_broken(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, "a")], "i int, t string")
    got = {r.name: (r.ok, r.bad) for r in integrity.expectations(rows, {"small": "i < 3", "text": "t is not null"}, ["i"]).collect()}
    assert got == {"small": (False, 1), "text": (False, 1), "unique i": (False, 1)}
    assert all(r.ok for r in integrity.expectations(rows.limit(0), {"small": "i < 3"}, ["i"]).collect())


def test_epochs(spark):
    schema = "sample_id int, document string, action string"
    pool = spark.createDataFrame([(1, "a", "read"), (2, "a", "pay"), (3, "b", "read"), (4, "c", "ask")], schema)
    assert tuple(integrity.epoch_statistics(pool, pool).first()) == (4, 1, 0, 3, 1, 1.333, 2)
    bad = spark.createDataFrame([(1, "a", "read"), (1, "a", "read"), (2, "a", "pay"), (3, "b", "read")], schema)
    assert {r.fault for r in integrity.epoch_faults(pool, bad, "read", 0.5, 2.0).collect()} == {"action over its cap", "action missing", "item repeated", "document oversampled", "document absent"}
    assert integrity.epoch_faults(pool, pool, "read", 0.5, 2.0).count() == 0
    assert integrity.epoch_statistics(pool, pool.limit(0)).first().n == 0
    got = {r.action: (r.n, r.share) for r in integrity.shares(pool, "action").collect()}
    assert got == {"read": (2, 0.5), "pay": (1, 0.25), "ask": (1, 0.25)}
