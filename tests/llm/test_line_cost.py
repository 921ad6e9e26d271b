"""A line's blocks and a text's lines are found once, in generated code."""

import random

from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_no_functions_over_arrays(spark):
    table = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert plan(line_dedup.line_rows(table)).count("lambdafunction(") <= 4  # hashes of words, all words but one


def test_a_text_is_split_once(spark):
    table = spark.createDataFrame([(1, "one two three\none two three\nfour five six\n"), (2, "seven")], "doc_id long, text string")
    left = line_dedup.deduplicated(table)
    assert plan(left).count("split(text") == 1 and {r.doc_id: r.text for r in left.collect()} == {1: "one two three\nfour five six\n", 2: "seven"}


def majority(words):
    if not words:
        return 0
    found = sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))
    return found - (1 << 64) if found >> 63 else found


def test_blocks_by_loops(spark):
    made = random.Random(5)
    rows = [(i, [made.randrange(-(1 << 63), 1 << 63) for _ in range(made.choice((1, 3, 7, 12, 30, 60)))]) for i in range(150)] + [(150, [])]
    table = spark.createDataFrame(rows, "id long, hashes array<long>")
    for n in (4, 8):
        found = {r.id: r for r in line_dedup.with_blocks(table, n, F.col("id") != 3).collect()}
        for i, hashes in rows:
            for k in range(n):
                words = sorted(h for h in hashes if (h + (1 << 63)) * n >> 64 == k)[: line_dedup.BLOCK_WORDS]
                assert i == 3 or (found[i][f"n{n}_{k}"], found[i][f"fp{n}_{k}"]) == (len(words), majority(words))


def test_single_blanks_stay_when_normalised(spark):
    texts = ["a b", "a  b", "a , b", " a", "a ", "A\tB-c", "ä  b\n c\n\n- d", "\U0001f600 x", "", " \n ", "x ́y é ٠"]
    made = random.Random(1)
    texts += ["".join(made.choices("ab1 \n\t,-äß ́\U0001f600\U00010400", k=30)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(line_dedup.normalised(F.col("t")) != F.regexp_replace(F.lower("t"), line_dedup._NOT_WORDS, " ")).count() == 0
