"""Format-preserving pseudonyms for personal data.

Numbers and dates are found by pattern, validated, and replaced by a keyed Feistel permutation within their own format,
so equal values get equal pseudonyms in every document, different values different ones, and a pseudonym passes the same
validation. Separators, letter case, length and the width of each number stay as they are.

- card: 13 to 19 digits, with blanks or hyphens between groups, valid by Luhn's check digit, which is computed anew
- iban: two letters, two check digits (mod 97, computed anew), 11 to 30 letters and digits
- ssn: ddd-dd-dddd with allowed area, group and serial
- phone: international (+, 10 to 15 digits in any groups, the country code stays) or ten digits in groups
- ip: four numbers up to 255
- date: year-month-day, or day, month (either order) and year with `/`, `.` or `-`; permuted within the years up to 1899, 1900 to 2099, or from 2100 on, and among the dates that are read in the same way: both numbers up to 12, the first over 12, or the second over 12
- email: letters and digits of the local part; the domain stays

Defined results. Null text stays null, text without a find stays as it is. Overlapping finds: the leftmost, then the kind
listed first. A card, IBAN or phone that number groups or capitals follow ends at the last group's end that makes it valid. A date that fits both orders
stays one that does. Repeated rows are treated alike, texts of any length are worked whole, an empty table gives an
empty one. Extra columns are kept; one named like `into` is replaced. A key of over 64 bytes is hashed to 64.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from calendar import isleap, monthrange
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FOUND = "struct<text:string,found:array<struct<kind:string,start:int,end:int>>>"
FOUND_TYPE = pa.struct([("text", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
#: Dates are permuted within these years: from one to the next.
YEARS = [1, 1900, 2100, 10_000]
#: Country calling codes of one and of two digits; all others have three (fixed values).
ONE_DIGIT_CODES = {"1", "7"}
TWO_DIGIT_CODES = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.|-[0-9]{1,2}-)[0-9]{4})(?![\w/-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.+])[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
    "phone": r"(?<![\w+])(?:\+[0-9](?:[ .-]?(?:[0-9]|\([0-9]{1,4}\))){6,14}|(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?)(?!\w)",
}
_BY_KIND = {k: re.compile(p, re.ASCII) for k, p in _PATTERNS.items()}
_AT = re.compile(r"@[A-Za-z0-9]", re.ASCII)
_NUMBER = re.compile(r"(?<![\w])(?:[A-Z]{2}(?=[0-9]{2}[ A-Z0-9])|\+?\(?[0-9])", re.ASCII)
#: Kinds whose pattern may run into what follows, and the characters they have at least.
_LEAST = {"iban": 15, "card": 13, "phone": 10}
#: Every find holds one of these.
_HINT = re.compile(r"[0-9@]", re.ASCII)


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next square of a power of two, walked until the value falls in range again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            mixed = hashlib.blake2b(right.to_bytes((half + 7) // 8, "little"), key=key, digest_size=(half + 7) // 8, person=f"{kind}{r}".encode()[:16], salt=size.to_bytes(64, "little")[:16]).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "little") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_digits(digits: str, key: bytes, kind: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, kind)).zfill(len(digits)) if digits else ""


def permute_letters(letters: str, key: bytes, kind: str) -> str:
    """A permutation of lower-case strings of one length."""
    value = 0
    for c in letters:
        value = value * 26 + ord(c) - 97
    value, out = permute(value, 26 ** len(letters), key, kind), []
    for _ in letters:
        value, x = divmod(value, 26)
        out.append(_LETTERS[x])
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def poured(template: str, digits: str) -> str:
    """The digits in the places of the template's digits."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in template)


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str, key: bytes) -> str | None:
    d = _only_digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or not d.strip("0"):
        return None
    payload = permute_digits(d[:-1], key, "card")
    return poured(s, payload + luhn_digit(payload))


def _mixed(s: str, key: bytes, kind: str) -> str:
    """Letters and digits permuted among themselves, letter case as it was."""
    letters = iter(permute_letters("".join(c for c in s.lower() if c.isascii() and c.isalpha()), key, kind + "L"))
    digits = iter(permute_digits(_only_digits(s), key, kind + "D"))
    return "".join((next(letters).upper() if c.isupper() else next(letters)) if c.isalpha() else next(digits) if c.isdigit() else c for c in s)


def _iban(s: str, key: bytes) -> str | None:
    plain = s.replace(" ", "")
    country, account = plain[:2], plain[4:]
    if not 11 <= len(account) <= 30 or iban_check(country, account) != plain[2:4]:
        return None
    account = _mixed(account, key, "iban")
    out = iter(country + iban_check(country, account) + account)
    return "".join(c if c == " " else next(out) for c in s)


def _ssn(s: str, key: bytes) -> str | None:
    areas = 898  # 001 to 899 without 666
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    value = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999, key, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(s: str, key: bytes) -> str | None:
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|", s)[0]
    if s[0] == "+" and not code:
        code = s[: 2 if s[1] in ONE_DIGIT_CODES else 3 if s[1:3] in TWO_DIGIT_CODES else 4]
    national = s[len(code) :]
    d = _only_digits(national)
    if s[0] == "+":
        if not 10 <= len(_only_digits(s)) <= 15 or len(d) < 7:
            return None
    elif not re.fullmatch(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}", s):
        return None
    return code + poured(national, permute_digits(d, key, "phone"))


def _ip(s: str, key: bytes) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    value, sizes = 0, []
    for x in parts:
        least, size = ((0, 10), (10, 90), (100, 156))[len(str(x)) - 1]
        value = value * size + x - least
        sizes.append((least, size))
    size = 1
    for _, n in sizes:
        size *= n
    value, out = permute(value, size, key, "ip" + "".join(str(len(str(x))) for x in parts)), []
    for least, n in reversed(sizes):
        value, x = divmod(value, n)
        out.append(str(least + x))
    return ".".join(reversed(out))


def _reading(a: int, b: int, leap: bool) -> str | None:
    """How two numbers are read: as day and month or month and day alike, as day first, as month first, or not at all."""
    days = lambda month: monthrange(2024 if leap else 2023, month)[1]
    if not 1 <= min(a, b) <= 12 or max(a, b) > 31:
        return None
    if max(a, b) <= 12:
        return "both"
    return ("day" if a > 12 else "month") if max(a, b) <= days(min(a, b)) else None


@cache
def _pairs(width_a: int, width_b: int, reading: str, leap: bool) -> list[tuple[int, int]]:
    """The pairs of numbers of these widths that are read so, in a leap year or another."""
    upto = lambda width: range(1, 10 if width == 1 else 32)
    return [(a, b) for a in upto(width_a) for b in upto(width_b) if _reading(a, b, leap) == reading]


@cache
def _before(width_a: int, width_b: int, reading: str, first: int, end: int) -> list[int]:
    """How many such dates lie before each year from first to end."""
    return [0, *accumulate(len(_pairs(width_a, width_b, reading, isleap(y))) for y in range(first, end))]


def _date(s: str, key: bytes) -> str | None:
    a, b, c = re.findall(r"[0-9]+", s)
    if len(a) == 4:  # month first, as year-month-day is
        sep, year, x, y = s[4], a, b, c
    else:
        sep, x, y, year = s[len(a)], a, b, c
    n, leap = int(year), isleap(int(year))
    reading = _reading(int(x), int(y), leap)
    if not n or not reading or len(a) == 4 and reading == "day":
        return None
    at = bisect_right(YEARS, n) - 1
    before = _before(len(x), len(y), reading, YEARS[at], YEARS[at + 1])
    value = before[n - YEARS[at]] + _pairs(len(x), len(y), reading, leap).index((int(x), int(y)))
    value = permute(value, before[-1], key, f"d{reading}{len(x)}{len(y)}{at}{int(len(a) == 4)}")
    n = bisect_right(before, value) - 1
    p, q = _pairs(len(x), len(y), reading, isleap(YEARS[at] + n))[value - before[n]]
    new = f"{p:0{len(x)}d}", f"{q:0{len(y)}d}", f"{YEARS[at] + n:04d}"
    return sep.join([new[2], *new[:2]] if len(a) == 4 else new)


def _email(s: str, key: bytes) -> str | None:
    local, _, domain = s.partition("@")
    return f"{_mixed(local, key, 'email')}@{domain}"


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _candidates(text: str) -> list[int]:
    """Where a find may begin: at a number, or at the start of the local part before an @."""
    places = {m.start() for m in _NUMBER.finditer(text)}
    for m in _AT.finditer(text):
        a = m.start()
        while a > 0 and m.start() - a < 64 and text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
            a -= 1
        while a < m.start() and not text[a].isalnum():
            a += 1
        places.add(a)
    return sorted(places)


def replaced(text: str, key: bytes, seen: dict | None = None) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and where each stood in it (kind, start, end)."""
    out, found, at = [], [], 0
    seen = {} if seen is None else seen
    for place in _candidates(text):
        if place < at:
            continue
        for kind, pattern in _BY_KIND.items():
            m = pattern.match(text, place)
            values = [m[0]] if m else []
            if m and kind in _LEAST:  # more groups may follow with a blank between: the longest valid beginning
                values = [text[place:n] for n in range(m.end(), place + _LEAST[kind] - 1, -1) if n == m.end() or text[n - 1].isalnum() and not text[n].isalnum()]
            for value in values:
                if (kind, value) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[kind, value] = KINDS[kind](value, key)
                if (new := seen[kind, value]) is not None:
                    break
            else:
                continue
            found.append({"kind": kind, "start": place, "end": place + len(value)})
            out += [text[at:place], new]
            at = place + len(value)
            break
    return "".join([*out, text[at:]]), found


def pseudonymiser(key: bytes):
    """A column function: text to struct<text, found>."""

    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict = {}
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                new, found = (text, []) if text is None or not _HINT.search(text) else replaced(text, key, seen)
                out.append({"text": new, "found": found})
            yield pa.array(out, FOUND_TYPE)

    return F.arrow_udf(run, FOUND).asNondeterministic()


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", into: str = "found") -> DataFrame:
    """docs with the text replaced and a column `into`: kind, start and end of each value in the text as it was."""
    both = docs.withColumn("__new", pseudonymiser(key)(F.col(f"`{text}`")))
    return both.withColumn(text, F.col("__new.text")).withColumn(into, F.col("__new.found")).drop("__new")
