"""Typed tokens, similarity and diffs on cases known by hand and at random."""

import random
from difflib import SequenceMatcher, unified_diff

import pytest
from ledgerlens.functions import text
from pyspark.sql import functions as F


def values(spark, column, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").repartition(2)
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "given,iso,ambiguous",
    [
        ("2024-02-13", "2024-02-13", False), ("13/02/2024", "2024-02-13", False), ("03/04/2024", "2024-03-04", True), ("03.03.24", "2024-03-03", False),
        ("Feb 13, 2024", "2024-02-13", False), ("13th February 2024", "2024-02-13", False), ("Sept. 1 2023", "2023-09-01", False), ("2024/1/5", "2024-01-05", False),
    ],
)
def test_dates(given, iso, ambiguous):
    found = text.dates_in(f"on {given}, late")
    assert [(f["iso"], f["ambiguous"], f["raw"], f["start"]) for f in found] == [(iso, ambiguous, given, 3)]


@pytest.mark.parametrize("given", ["2024-13-01", "32/13/2024", "1/2/3", "12/2024", "1850-01-01", "1/2/20245", "Feb 2024", ""])
def test_no_dates(given):
    assert text.dates_in(given) == []


def test_dates_do_not_overlap():
    found = text.dates_in("2024-02-13 13/02/2024 5 May 2024-06-01")
    assert [f["iso"] for f in found] == ["2024-02-13", "2024-02-13", "2024-06-01"]
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize(
    "given,amount,token",
    [
        ("1,234.56", "1234.56", None), ("$ 43,200.00", "43200.00", "$"), ("USD 17.00", "17.00", "USD"), ("1.234,56 EUR", "1234.56", "EUR"), ("1 200,00 €", "1200.00", "€"),
        ("-5.00", "-5.00", None), ("1050. 00", "1050.00", None), ("US$12", "12.00", "US$"), ("1,234", "1234.00", None), ("12,5", None, None),
    ],
)
def test_amounts(given, amount, token):
    found = text.amounts_in(f"total {given} due")
    assert [(f["amount"], f["token"]) for f in found] == ([(amount, token)] if amount else [])


def test_dates_before_amounts_before_identifiers():
    line = "Invoice INV-2024/17 of 13.02.2024 for 1,200.50 call 555-123-4567, Austin TX 78701 ref 9931"
    assert [f["iso"] for f in text.dates_in(line)] == ["2024-02-13"]
    assert [f["amount"] for f in text.amounts_in(line)] == ["1200.50"]
    assert [f["value"] for f in text.identifiers_in(line)] == ["INV-2024/17", "9931"]
    assert text.amounts_in("1 200,00 without a currency")[0]["amount"] == "200.00"  # two columns


def test_columns_of_tokens(spark):
    cases = [None, "", "on 2024-02-13 and 3 May 2023", "none " * 5000 + "2020-01-01"]
    assert [[y.iso for y in x] for x in values(spark, text.dates, cases)] == [[], [], ["2024-02-13", "2023-05-03"], ["2020-01-01"]]
    assert [len(x) for x in values(spark, text.amounts, [None, "1.00 2.00"])] == [0, 2]
    assert [[y.value for y in x] for x in values(spark, text.identifiers, ["A1 B-2", None])] == [["A1", "B-2"], []]
    assert values(spark, text.whole_date, [" 2024-02-13 ", "03/04/2024", "2024-02-13 x", None, "", "1/1/2024"]) == ["2024-02-13", None, None, None, None, "2024-01-01"]


def test_similarity_equals_the_block_ratio(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab cC1-") for _ in range(n))
    pairs = [(word(rng.randint(0, 30)), word(rng.randint(0, 30))) for _ in range(300)] + [("", ""), ("", "x"), ("  ", ""), (None, "x"), ("a" * 400 + "b", "b" + "a" * 400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", text.similarity(F.col("a"), F.col("b")).alias("s"), text.similarity(F.col("a"), F.col("b"), numeric=True).alias("n")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        if a is None:
            assert r.s is None
            continue
        for x, y, s in ((" ".join(a.split()).lower(), " ".join(b.split()).lower(), r.s), (*("".join(c for c in z.lower() if c.isalnum()) for z in (a, b)), r.n)):
            assert s == (1.0 if x == y == "" else 0.0 if "" in (x, y) else pytest.approx(SequenceMatcher(None, x, y).ratio()))


def test_names(spark):
    cases = [("ACME Ltd.", "Acme"), ("Acme Corp", "Corp Acme"), ("Acme", "Zenith"), ("Müller", "Muller"), ("", "x"), (None, "x"), ("--", "x"), ("Nordwind GmbH", "Nordwlnd GmbH")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = rows.select("i", text.names_match(F.col("a"), F.col("b")).alias("m"), text.same_name(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    assert [r.m for r in got] == [True, False, False, True, False, False, False, True]
    assert [r.s for r in got] == [True, True, False, True, False, False, False, True]


def test_line_diffs(spark):
    rng = random.Random(2)
    make = lambda: "\n".join(rng.choice(["one", "two", "three", "", "- x", "++"]) for _ in range(rng.randint(0, 25)))
    pairs = [(make(), make()) for _ in range(100)] + [("same", "same"), ("", "a"), (None, "a")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", text.line_diff(F.col("a"), F.col("b")).alias("d")).select("i", "d", text.removed_lines(F.col("d")).alias("gone"), text.added_lines(F.col("d")).alias("new")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        if a is None:
            assert r.d is None
            continue
        diff = list(unified_diff(a.splitlines(), b.splitlines(), "before", "after", lineterm=""))
        assert r.d == diff
        assert r.gone == [x[1:] for x in diff if x.startswith("-") and not x.startswith("---")]
        assert r.new == [x[1:] for x in diff if x.startswith("+") and not x.startswith("+++")]


def test_picks_need_a_margin(spark):
    rows = [("a", "x", 5.0), ("a", "x", 4.9), ("a", "y", 3.0), ("b", "x", 5.0), ("b", "y", 3.6), ("c", "x", 1.0), ("c", "y", 1.0), ("d", "x", 2.0), ("e", "x", 5.0), ("e", "y", 3.5)]
    got = {r.key: (r.value, r.rivals) for r in text.picked(spark.createDataFrame(rows, "key string, value string, score double")).collect()}
    assert got == {"a": ("x", None), "b": (None, "x|y"), "c": (None, "x|y"), "d": ("x", None), "e": ("x", None)}


def test_identifiers_read_dates_once(spark, monkeypatch):
    calls, find = [], text.dates_in
    monkeypatch.setattr(text, "dates_in", lambda t: calls.append(t) or find(t))
    line = "Invoice INV-7 of 05/06/2024 for USD 1,234.56, due 2 November 2024, CA 90210, (555) 123-4567"
    assert [x["value"] for x in text.identifiers_in(line)] == ["INV-7"] and calls == [line]
    split = "paid 12. 34 EUR for A-12 on 2024-05-06"  # offsets of amounts move, so their dates are read anew
    assert [x["value"] for x in text.identifiers_in(split)] == ["A-12"] and len(calls) == 3
    assert text.identifiers_in("no digit") == [] and len(calls) == 3


def test_finders_of_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "A-12")], "id int, t string").orderBy("id")
    assert [[x.value for x in r[0]] for r in rows.select(text.identifiers(F.col("t"))).collect()] == [[], [], ["A-12"]]
