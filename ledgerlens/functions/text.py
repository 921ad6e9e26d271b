"""Typed tokens in text, similarity of strings and line diffs, as functions of columns that work a batch at a time.

Tokens. Finders claim spans in an order: dates of four forms, then phone numbers, then amounts, then identifiers. A span that
overlaps an earlier claim of the same finder, or begins in a date, isn't taken. Offsets count characters.

Similarity is twice the matched share of both strings, where the longest common block is matched first and then what lies
on either side of it, again and again. Names agree if one contains the other or the similarity is high enough.

Defined results. NULL text has no tokens (an empty array), NULL strings have NULL similarity and NULL diffs. Two empty strings
are equal, an empty and another one have nothing in common.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher, unified_diff
from itertools import accumulate, chain
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.sources.tables import read

# Currency codes and symbols, months, and the forms of dates, phones, numbers and identifiers.
CODES = ["AUD", "BRL", "CAD", "CHF", "CNY", "CZK", "DKK", "EUR", "GBP", "HKD", "INR", "JPY", "MXN", "NOK", "NZD", "PLN", "SEK", "SGD", "USD", "ZAR"]
SYMBOLS = ["USD$", "US$", "CA$", "AU$", "NZ$", "SG$", "HK$", "MX$", "C$", "A$", "S$", "R$", "zł", "Kč", "$", "€", "£", "¥", "₹"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = r"(?P<m>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
# Forms that start with a digit look back behind it, so that the scan goes from digit to digit.
DATE_FORMS = [
    r"(?P<y>\d(?<![\d/]\d)\d{3})[/\-.](?P<m>\d{1,2})[/\-.](?P<d>\d{1,2})(?![\d/])",
    r"(?P<a>\d(?<![\d/]\d)\d?)[/\-.](?P<b>\d{1,2})[/\-.](?P<y>\d{4}|\d{2})(?![\d/])",
    rf"\b{MONTH}\.?[ \-]+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?[ \-]+(?P<y>\d{{4}})\b",
    rf"(?P<d>\d(?<!\w\d)\d?)(?:st|nd|rd|th)?[ \-]+{MONTH}\.?,?[ \-]+(?P<y>\d{{4}})\b",
]
PLAIN_NUMBER = r"\d{1,3}(?:,\d{3})+(?:[.,]\d{2})?|\d{1,3}(?:\.\d{3})+,\d{2}|\d+[.,]\d{2}|\d+"
SPACED_NUMBER = r"\d{1,3}(?:[  ]\d{3})+[.,]\d{2}"
PHONE = re.compile(r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}")
IDENTIFIER = re.compile(r"[A-Za-z0-9](?<![\w\-/][A-Za-z0-9])(?:(?<=\d)|(?=[A-Za-z0-9\-_/]*\d))[A-Za-z0-9\-_/]{0,28}(?![\w\-/])")
SPLIT_DECIMALS = re.compile(r"(?<=\d)([.,]) (?=\d{2}(?!\d))")

_DATES = [re.compile(p, re.I) for p in DATE_FORMS]
#: What every date of the first two forms holds, and of the last two: texts without are passed over.
_DATE_HINTS = [re.compile(r"[/\-.]\d{1,2}[/\-.]\d"), re.compile(f"(?:{'|'.join(MONTHS)})", re.I)]
_BLANK, _CENTS = re.compile(r"\s").search, re.compile(r"[.,]\d{2}$").search
_DIGIT, _POSTAL, _STATE = re.compile(r"\d").search, re.compile(r"\d{5}(?:-\d{4})?").fullmatch, re.compile(r"\b[A-Z]{2}\.?\s*$").search
_CODE, _SYMBOL = "|".join(CODES), "|".join(map(re.escape, SYMBOLS))


def _amount_form(number: str) -> re.Pattern:
    before = rf"(?:(?<![A-Za-z])(?P<code>{_CODE})\s?)?(?:(?<![A-Za-z])(?P<symbol>{_SYMBOL}))?\s?(?P<minus>-)?\s?"
    first = "".join(map(re.escape, sorted({x[0] for x in [*CODES, *SYMBOLS]})))  # an amount begins with one of these, a blank, a sign or a digit
    return re.compile(rf"(?=[{first}\s\-\d]){before}(?P<number>{number})(?![\d])(?:\s?(?:(?P<code_after>{_CODE})(?![A-Za-z])|(?P<symbol_after>{_SYMBOL})))?")


_AMOUNT, _PLAIN_AMOUNT = _amount_form(f"{SPACED_NUMBER}|{PLAIN_NUMBER}"), _amount_form(PLAIN_NUMBER)


def _day(form: int, m: re.Match) -> tuple[int, int, int, bool]:
    """Year, month, day, and whether day and month could be meant the other way round (then the month is taken to come first)."""
    if form != 1:
        year, month, day = m.group("y", "m", "d")
        return int(year), int(month) if month.isdigit() else MONTHS.index(month[:3].lower()) + 1, int(day), False
    year, a, b = map(int, m.group("y", "a", "b"))
    year += 2000 * (year < 100)
    return (year, b, a, False) if a > 12 else (year, a, b, a != b and b <= 12)


def dates_in(text: str) -> list[dict]:
    found: list[dict] = []
    hinted = [hint.search(text) for hint in _DATE_HINTS]
    for form, pattern in enumerate(_DATES):
        for m in pattern.finditer(text) if hinted[form // 2] else ():
            (year, month, day, ambiguous), (start, end) = _day(form, m), m.span()
            if 1900 <= year <= 2100 and 1 <= month <= 12 and 1 <= day <= 31 and not any(start < f["end"] and f["start"] < end for f in found):
                found.append({"raw": m[0], "iso": f"{year:04d}-{month:02d}-{day:02d}", "ambiguous": ambiguous, "start": start, "end": end})
    return sorted(found, key=itemgetter("start"))


def decimal_text(number: str, minus: bool = False) -> str:
    """A number with separators as 1234.56: the last separator is the decimal one if both kinds stand, or if it is alone and one or two digits follow."""
    digits = re.sub(r"[  ]", "", number)
    last = max(digits.rfind("."), digits.rfind(","))
    kinds = {c for c in digits if c in ".,"}
    is_decimal = last >= 0 and (len(kinds) == 2 or (digits.count(digits[last]) == 1 and len(digits) - last - 1 in (1, 2)))
    whole, cents = (digits[:last], digits[last + 1 :]) if is_decimal else (digits, "")
    return f"{'-' * minus}{int(re.sub('[.,]', '', whole))}.{(cents + '00')[:2]}"


def _inside(at: int, spans: list[dict]) -> bool:
    return any(s["start"] <= at < s["end"] for s in spans)


def amounts_in(text: str, dates: list[dict] | None = None) -> list[dict]:
    """Amounts with decimals, thousands separators or a symbol. A blank inside split decimals goes first, and offsets count without it."""
    text = SPLIT_DECIMALS.sub(r"\1", text)
    dates, found = dates_in(text) if dates is None else dates, []
    for whole in _AMOUNT.finditer(text):
        number, symbol, symbol_after, code, code_after = whole.group("number", "symbol", "symbol_after", "code", "code_after")
        marked = symbol or symbol_after or code or code_after
        if number.isdigit() and not (symbol or symbol_after):
            continue
        columns = not marked and _BLANK(number)  # blanks group thousands only beside a currency; else they part columns
        for m in _PLAIN_AMOUNT.finditer(text, *whole.span()) if columns else [whole]:
            number, symbol, symbol_after, end = *m.group("number", "symbol", "symbol_after"), m.end()
            start, symbol = end - len(m[0].lstrip()), symbol or symbol_after
            is_money = "," in number or _CENTS(number) or (symbol and len(number) > 1)
            if is_money and not _inside(start, dates) and not PHONE.match(text[start : end + 8]):
                found.append({"amount": decimal_text(number, bool(m["minus"])), "token": m["code"] or m["code_after"] or symbol, "raw": m[0].strip(), "start": start, "end": end})
    return found


def identifiers_in(text: str, least: int = 2) -> list[dict]:
    """Tokens with a digit that are no date, phone number, amount or postal code."""
    tokens = list(IDENTIFIER.finditer(text))
    if not tokens:
        return []
    dates, phones, found = dates_in(text), [p.span() for p in PHONE.finditer(text)], []
    amounts = amounts_in(text, None if SPLIT_DECIMALS.search(text) else dates)  # split decimals move the offsets
    priced = [(a["start"], a["end"]) for a in amounts if "." in a["raw"] or "," in a["raw"]]
    for m in tokens:
        (start, end), value = m.span(), m[0].strip("-_/")
        if len(value) < least or not _DIGIT(value) or _inside(start, dates):
            continue
        if any(a <= start and end <= b for a, b in priced) or any(a < end and start < b for a, b in phones):
            continue
        if not (_POSTAL(value) and _STATE(text[:start])):
            found.append({"value": value, "start": start, "end": end})
    return found


def _finder(find: Callable[[str], list[dict]], kind: str) -> Callable[[Column], Column]:
    arrow = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = {name: arrow[of] for name, of in (x.split(":") for x in kind.split(","))}

    def run(texts: pa.Array) -> pa.Array:
        found = [find(t) if t is not None else [] for t in texts.to_pylist()]
        flat = list(chain.from_iterable(found))
        columns = [pa.array([x[name] for x in flat], of) for name, of in fields.items()]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return lambda texts: F.arrow_udf(run, f"array<struct<{kind}>>")(texts)


dates = _finder(dates_in, "raw:string,iso:string,ambiguous:boolean,start:int,end:int")
amounts = _finder(amounts_in, "amount:string,token:string,raw:string,start:int,end:int")
identifiers = _finder(identifiers_in, "value:string,start:int,end:int")


def whole_date(text: Column) -> Column:
    """The ISO date if the trimmed text is one date and nothing else, and not ambiguous; else NULL."""
    found, trimmed = dates(F.trim(text)), F.trim(text)
    only = (F.size(found) == 1) & (found[0]["start"] == 0) & (found[0]["end"] == F.length(trimmed)) & ~found[0]["ambiguous"]
    return F.when(F.size(found) == 1, F.when(only, found[0]["iso"]))


def _pairs(score: Callable[[str, str], object], kind: str) -> Callable[[Column, Column], Column]:
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([score(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(left, right)], dtype=object)

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return lambda left, right: F.pandas_udf(run, kind)(left, right)


_ratio = _pairs(lambda a, b: SequenceMatcher(None, a, b).ratio(), "double")


def similarity(a: Column, b: Column, numeric: bool = False) -> Column:
    """Of texts in lower case with single blanks, or of their letters and digits only."""
    normal = (lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))) if numeric else (lambda c: F.lower(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))))
    a, b = normal(a), normal(b)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(_ratio(a, b))


def names_match(a: Column, b: Column, least: float = 0.6) -> Column:
    """Whether the letters and digits of one name contain the other's, or are similar enough; false if either has none."""
    a, b = (F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit("")) for c in (a, b))
    return F.when((a == "") | (b == ""), False).when(a.contains(b) | b.contains(a), True).otherwise(_ratio(a, b) >= least)


def same_name(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether the words of one name are all words of the other, or their letters and digits are similar enough."""
    words = [F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))) for c in (a, b)]
    bare = [F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b)]
    subset = (F.size(F.array_except(*words)) == 0) | (F.size(F.array_except(*words[::-1])) == 0)
    return F.when((F.size(words[0]) == 0) | (F.size(words[1]) == 0), False).when(subset, True).otherwise(_ratio(*bare) >= least)


line_diff = _pairs(lambda a, b: list(unified_diff(a.splitlines(), b.splitlines(), "before", "after", lineterm="")), "array<string>")


def removed_lines(diff: Column) -> Column:
    return F.transform(F.filter(diff, lambda x: x.startswith("-") & ~x.startswith("---")), lambda x: F.substring(x, 2, 1 << 30))


def added_lines(diff: Column) -> Column:
    return F.transform(F.filter(diff, lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30))


def picked(candidates: DataFrame, margin: float = 1.5) -> DataFrame:
    """key, value, score of each key's best candidate, if it beats every other value by the margin; else value is NULL and `rivals` has all values in reach. candidates: key, value, score."""
    best = candidates.groupBy("key", "value").agg(F.max("score").alias("score"))
    top = best.groupBy("key").agg(F.max("score").alias("top"))
    near = best.join(top, "key").where((F.col("score") == F.col("top")) | (F.col("top") - F.col("score") < margin))
    found = near.groupBy("key").agg(F.max("top").alias("score"), F.sort_array(F.collect_list(F.coalesce("value", F.lit("")))).alias("rivals"), F.count("*").alias("n"), F.first("value").alias("value"))
    return found.select("key", F.when(F.col("n") == 1, F.col("value")).alias("value"), "score", F.when(F.col("n") > 1, F.array_join("rivals", "|")).alias("rivals"))


def invoice_lines(s, d) -> DataFrame:
    """A line of text for each order: number, date in one of three forms, amount and due date."""
    date, key = F.col("o_orderdate"), F.col("o_orderkey")
    first = F.when(key % 3 == 0, F.date_format(date, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(date, "MM/dd/yyyy")).otherwise(F.date_format(date, "MMM d, yyyy"))
    line = F.concat(F.lit("Invoice INV-"), key.cast("string"), F.lit(" of "), first, F.lit(" for USD "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit(", due "), F.date_format(F.date_add(date, 30), "d MMMM yyyy"))
    return read(s, d, "orders").select("o_orderkey", line.alias("line"))


def _found(column: Callable, s, d) -> DataFrame:
    return invoice_lines(s, d).select("o_orderkey", F.posexplode(column("line")).alias("n", "x")).select("o_orderkey", "n", "x.*")


def _names(s, d) -> DataFrame:
    """Suppliers beside the customers of the same number, names cut and turned in places."""
    suppliers = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"))
    return suppliers.join(read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "Customer", "Supplier").alias("b")), "id")


def _candidates(s, d) -> DataFrame:
    return read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.round("value", 1).alias("score"))


QUERIES = {
    "fn4_amounts": lambda s, d: _found(amounts, s, d),
    "fn5_dates": lambda s, d: _found(dates, s, d),
    "fn6_whole_dates": lambda s, d: read(s, d, "orders").select("o_orderkey", whole_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("iso")),
    "fn7_identifiers": lambda s, d: _found(identifiers, s, d),
    "fn13_similarity": lambda s, d: _names(s, d).select("id", F.round(similarity(F.col("a"), F.col("b")), 9).alias("similarity")),
    "fn14_names_match": lambda s, d: _names(s, d).select("id", names_match(F.col("a"), F.col("b")).alias("match")),
    "fn15_same_name": lambda s, d: _names(s, d).select("id", same_name(F.col("a"), F.col("b")).alias("same")),
    "set18_line_diff": lambda s, d: read(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("b")).join(read(s, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("a")), "id").select("id", line_diff(F.col("a"), F.col("b")).alias("diff")).select("id", F.size(removed_lines(F.col("diff"))).alias("removed"), F.size(added_lines(F.col("diff"))).alias("added"), F.sha2(F.array_join("diff", "\n"), 256).alias("diff_sha256")),
    "srt18_picked": lambda s, d: picked(_candidates(s, d)),
}

_LINES = """WITH p AS (SELECT o_orderkey, 'Invoice INV-' || o_orderkey || ' of ' AS a, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END AS first,
 'USD ' || format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE) AS amount, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS plain, o_orderdate AS d, o_orderdate + INTERVAL 30 DAY AS due FROM orders),
q AS (SELECT *, length(a) AS first_at, length(a) + length(first) + 5 AS amount_at, length(a) + length(first) + 5 + length(amount) + 6 AS due_at, strftime(due, '%-d %B %Y') AS second FROM p) """
SQL = {
    "fn4_amounts": _LINES + """SELECT o_orderkey, 0 AS n, plain AS amount, 'USD' AS token, amount AS raw, CAST(amount_at AS INT) AS start, CAST(amount_at + length(amount) AS INT) AS "end" FROM q""",
    "fn5_dates": _LINES + """SELECT o_orderkey, 0 AS n, first AS raw, strftime(d, '%Y-%m-%d') AS iso, o_orderkey % 3 = 1 AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous, CAST(first_at AS INT) AS start, CAST(first_at + length(first) AS INT) AS "end" FROM q
 UNION ALL SELECT o_orderkey, 1, second, strftime(due, '%Y-%m-%d'), false, due_at, due_at + length(second) FROM q""",
    "fn7_identifiers": _LINES + """SELECT o_orderkey, 0 AS n, 'INV-' || o_orderkey AS value, CAST(8 AS INT) AS start, CAST(first_at - 4 AS INT) AS "end" FROM q""",
    "fn6_whole_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "srt18_picked": "WITH b AS (SELECT user_id AS key, event_type AS value, max(round(value, 1)) AS score FROM events GROUP BY ALL), t AS (SELECT key, max(score) AS top FROM b GROUP BY 1), n AS (SELECT * FROM b JOIN t USING (key) WHERE score = top OR top - score < 1.5::DOUBLE) SELECT key, CASE WHEN count(*) = 1 THEN any_value(value) END AS value, max(top) AS score, CASE WHEN count(*) > 1 THEN string_agg(value, '|' ORDER BY value) END AS rivals FROM n GROUP BY 1",
}
