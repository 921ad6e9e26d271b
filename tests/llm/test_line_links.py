"""Lines that meet and are similar are linked, whatever words they share."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup


def changed(made, word, n, k, new):
    """A line of n words, and the line with k of them replaced."""
    line = [word() for _ in range(n)]
    gone = set(made.sample(range(n), k))
    return " ".join(line), " ".join(new(w) if i in gone else w for i, w in enumerate(line))


def few_common_words(made):
    return changed(made, lambda: "".join(made.choices("abcdefghijklmnop", k=10)), 20, 8, lambda w: w[:-1] + "z")


def one_short_one_long(made):
    return changed(made, lambda: "".join(made.choices("abcdefghijklmnopqrstuvw", k=2)), 30, 6, lambda w: w + "x" * 30 + made.choice("abc") + w)


@pytest.mark.parametrize("pair, least", [(few_common_words, 5), (one_short_one_long, 5)])
def test_all_that_meet_are_linked(spark, pair, least):
    made = random.Random(11)
    rows = [(2 * i + k, line) for i in range(120) for k, line in enumerate(pair(made))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = {r.doc_id: set(r.places) for r in line_dedup.line_rows(table).collect()}
    met = {i for i, _ in rows if i % 2 and places[i] & places[i - 1]}
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(table).collect()}
    assert len(met) >= least and {i for i, text in left.items() if not text} == met


def test_maps_of_words_part_no_similar_lines(spark):
    made = random.Random(3)
    passage = [f"passage{i}" for i in range(40)]
    lines = []
    for _ in range(12):
        own = passage + [f"own{made.randrange(10**6)}" for _ in range(30)]
        lines += [" ".join(f"new{made.randrange(10**6)}" if made.random() < share else w for w in own) for share in (0, 0.05, 0.12, 0.2, 0.25)]
    texts = spark.createDataFrame(list(enumerate(lines)), "h1 long, norm string").withColumn("coded", line_dedup.coded(F.col("norm")))
    rows = texts.join(line_dedup.word_maps(texts), "h1").select("h1", "coded", F.length("norm").alias("chars"), F.length("coded").alias("words"), "maps").collect()
    both = spark.createDataFrame(rows).select(F.struct("*").alias("x")).crossJoin(spark.createDataFrame(rows).select(F.struct("*").alias("y"))).where("x.h1 < y.h1")
    one, two = F.col("x"), F.col("y")
    found = both.select(line_dedup.within(one["coded"], two["coded"], 0.8).alias("similar"), line_dedup.may_match(one, two, 0.8).alias("lengths"), line_dedup.may_match(one, two, 0.8, maps=True).alias("maps")).collect()
    assert all(r.maps for r in found if r.similar) and sum(r.similar for r in found) > 12
    assert sum(r.lengths for r in found) == len(found) and sum(r.maps for r in found) < len(found) / 4
