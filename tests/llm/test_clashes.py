"""Extra columns whose names clash with an operator's own."""

import pytest

pytest.importorskip("ledgerlens.llm.entry")
from ledgerlens.llm import common, decontaminate, line_dedup, shingles

SCHEMA = "doc_id long, text string, __id string, __GONE string, __mark string, __kept string, __hits string, id string, key string"


def rows(texts):
    return [(i, t, *(f"{c}{i}" for c in "abcdefg")) for i, t in texts]


def own(found):
    return sorted(tuple(r)[2:] for r in found.collect())


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i}" for i in range(40))
    return spark.createDataFrame(rows([(1, f"{long}\nown line one two three"), (2, f"{long}\nanother line four five six"), (3, long + "\nown line one two three"), (4, None), (5, "")]), SCHEMA)


def test_names_are_free_whatever_their_case(spark, docs):
    assert common.unused(docs, "__gone") == "__gone_" and common.unused(docs, "other") == "other"


def test_lines(docs):
    left = line_dedup.deduplicated(docs)
    assert left.columns == docs.columns and own(left) == own(docs)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[2] == "another line four five six" and texts[3] == "" and texts[4] is None


def test_near_duplicates(docs):
    left = shingles.first_of_each_group(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {1, 4} and 3 not in {r.doc_id for r in left.collect()}
    assert set(own(left)) <= set(own(docs))


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "another line four five six")], "item_id int, text string")
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 3, 4, 5} and set(own(left)) <= set(own(docs))
