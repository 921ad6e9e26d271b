"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark passages.

Both sides are normalised alike: A-Z become a-z, every byte that is not a digit, an ASCII letter or part of a
non-ASCII character becomes a blank. The replacement keeps each byte in its place, so a hit maps back to the original
text. A passage of `window` words is a pattern; an item with fewer words, but not none, is one pattern. Each text is
scanned once for all patterns.

Defined results. Null text and empty text have no words and no hits. Items with null id or no words take no part;
repeated items count once. Ties and repeated documents: each row is judged by itself. Texts of any length
are scanned whole, an empty table gives an empty one. Extra columns are kept; one named like `into` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import unused, utf8

WINDOW = 13
#: Patterns of so many characters at most are broadcast at once; further items get passes of their own.
MAX_PATTERN_CHARS = 64 << 20

_KEPT = [*range(48, 58), *range(97, 123), *range(128, 256)]
NORMALISE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))

HIT = "struct<n_words:bigint,words:array<struct<first:int,last:int>>,items:array<string>>"
SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
HIT_TYPE = pa.struct([("n_words", pa.int64()), ("words", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
OFFSETS = "array<struct<start:int,end:int>>"
OFFSETS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


def patterns_of(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern, with a blank at either end, to its number of words and the items that hold it."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            held = found.setdefault(" " + b" ".join(part).decode() + " ", (len(part), []))[1]
            if item not in held:
                held.append(item)
    return found


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Sorted, overlapping or touching word ranges (last included) joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


def _scanner(held):
    """A column function of (text, hits so far) for the patterns in the broadcast `held`."""

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, value in held.value.items():
            automaton.add_word(pattern, value)
        automaton.make_automaton()
        for texts, before in batches:
            out = []
            for text, prior in zip(utf8(texts), before.to_pylist()):
                words = words_of(text or b"")
                spans, items, ends = [], set(), None
                if words and held.value:
                    for at, (n, owners) in automaton.iter(f" {b' '.join(words).decode()} "):
                        if ends is None:
                            ends = np.cumsum([len(w.decode()) + 1 for w in words])
                        last = int(np.searchsorted(ends, at))
                        spans.append((last - n + 1, last))
                        items.update(owners)
                if prior:
                    spans += [(x["first"], x["last"]) for x in prior["words"]]
                    items.update(prior["items"])
                out.append({"n_words": len(words), "words": merged(spans), "items": sorted(items)})
            yield pa.array(out, HIT_TYPE)

    return F.arrow_udf(scan, HIT).asNondeterministic()


def _offsets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Character ranges of the original text (end excluded) for word ranges."""
    for texts, hits in batches:
        out = []
        for text, words in zip(utf8(texts), hits.to_pylist()):
            if not words:
                out.append([])
                continue
            blank = np.frombuffer(text.translate(NORMALISE), np.uint8) == 32
            edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
            starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
            out.append([{"start": int(chars[starts[w["first"]]]), "end": int(chars[stops[w["last"]]])} for w in words])
        yield pa.array(out, OFFSETS_TYPE)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "hits", max_pattern_chars: int = MAX_PATTERN_CHARS) -> DataFrame:
    """docs with a struct column `into`: n_words, words (merged ranges of hit words), items (ids of items with a hit).

    The benchmark's passages travel to every task. Their size is counted first: a set beyond max_pattern_chars is dealt
    into groups by a hash of the item, each scanned in a pass of its own that adds to the hits so far.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] * window
    groups = max(1, -(-chars // max_pattern_chars))
    out, hits = docs, F.lit(None).cast(HIT)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g).select("i", F.encode("t", "utf-8")).collect()
        held = spark.sparkContext.broadcast(patterns_of(sorted((r[0], bytes(r[1])) for r in rows), window))
        out = out.withColumn(into, _scanner(held)(F.col(text), hits))
        hits = F.col(into)
    return out


def hit_words(hits: Column | str) -> Column:
    """Number of hit words."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    return F.aggregate(hits["words"], F.lit(0).cast("long"), lambda n, w: n + (w["last"] - w["first"] + 1).cast("long"))


def is_contaminated(hits: Column | str) -> Column:
    """At least one word in twenty lies in a benchmark passage."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    return (hit_words(hits) > 0) & (hit_words(hits) * 20 >= hits["n_words"])


def hit_spans(text: Column | str, hits: Column | str) -> Column:
    """The hit words' character ranges in the original text."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    return F.arrow_udf(_offsets, OFFSETS)(text, hits["words"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with docs' own columns."""
    judged = contamination(docs, benchmark, into=(into := unused(docs, "__hits")), **options)
    return judged.where(~is_contaminated(into)).select(*[F.col(f"`{c}`") for c in docs.columns])
