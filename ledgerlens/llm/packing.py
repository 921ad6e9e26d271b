"""Order-preserving packing of token sequences by dynamic programming.

Documents are tokenised where they lie and packed in the order of their partition; no row is shuffled. A cut may fall at
a document's end, at a sentence's end or, where a sentence is longer than `stride`, at a fixed stride inside it. The
programme chooses the cuts that minimise padding plus a penalty for each cut inside a document: with p(c) the tokens
before cut c, best(j) = penalty(j) + length - p(j) + min over i of best(i) + p(i), where p(j) - p(i) <= length. The
minimum over the sliding range of i is kept in a monotone queue, so each cut costs constant time.

Documents are worked in blocks of about `block` tokens, which bounds memory and adds one part-filled sequence a block.

Defined results. Null and empty texts are one token, the separator. Rows with one id are packed one by one. Every token
lies in exactly one piece; pieces of a sequence leave no gap. Extra columns play no part. An empty table has no pieces.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices

LENGTH = 2048
SEPARATOR = 1
SENTENCE_PENALTY = 4
STRIDE_PENALTY = 32
STRIDE = 128
BLOCK = 1 << 20
CACHED_WORDS = 1_400_000
WORDS_TOGETHER = 50
#: Bytes of text whose words are looked up together.
PIECE = 4 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, sequence_tokens long"


#: What the tokenizer takes apart in any case: runs of letters, single digits, runs of other signs.
_ASCII_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall
_WORD = re.compile(r"[^\W\d_]+").fullmatch
_LETTERS_THEN_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the search for cycles, which words and tuples of ids don't form: it would go through them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Words(dict):
    """Token ids by chunk of text without blank or line feed: the tokenizer drops white space and never joins across it.

    With a tokenizer that lower-cases and takes letters, digits and other signs apart, chunks are made of the ids of
    their parts, so that a word costs one encoding whatever its capitals and the signs after it. Chunks with apostrophes,
    letters that change in number when normalised or lower-cased, signs inside non-ASCII text, or an added token of the
    vocabulary (matched in the raw text) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", x) for x in added):
            raise ValueError("the tokenizer has an added token with white space, which chunks would part")
        self.has_added = re.compile("|".join(map(re.escape, added))).search if added else lambda chunk: None
        self.numbers = list(range(max(self.tokenizer.get_vocab().values()) + 1))  # one object for each id
        self.takes_apart = all(self._encoded(x) == self._encoded(y) + self._encoded(z) for x, y, z in (("Word,", "word", ","), ("word1", "word", "1"), ("12", "1", "2"), ("1a", "1", "a"), ("Ab.)", "ab", ".)"), ("(été", "(", "été")))

    def _encoded(self, chunk: str) -> tuple[int, ...]:
        return tuple(map(self.numbers.__getitem__, self.tokenizer.encode(chunk, add_special_tokens=False).ids))

    def _parts(self, chunk: str) -> list[str] | tuple[str, ...]:
        if not self.takes_apart or "'" in chunk or self.has_added(chunk):
            return [chunk]
        if chunk.isascii():
            return _ASCII_PARTS(chunk.lower())
        if "İ" in chunk or not unicodedata.is_normalized("NFC", chunk):
            return [chunk]
        if "A" <= chunk[0] <= "Z" and chunk[1].isalpha():
            return [chunk[0].lower() + chunk[1:]]
        found = _LETTERS_THEN_SIGNS(chunk)
        return found.groups() if found else [chunk]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        parts = self._parts(word)
        ids = tuple(chain.from_iterable(map(self.__getitem__, parts))) if list(parts) != [word] else self._encoded(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.replace("\n", " ").split(" "))), np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of unseen chunks. Words among their parts are encoded together, a blank between any two, and taken apart at the tokens that end a word."""
        parted = [(x, self._parts(x)) for x in chunks]
        new = list({x for _, parts in parted for x in parts if x not in self and len(x) <= 64 and _WORD(x)})
        if len(self) + len(new) + len(chunks) > CACHED_WORDS:
            self.clear()
        groups = [new[a : a + WORDS_TOGETHER] for a in range(0, len(new), WORDS_TOGETHER)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False)):
            ids = tuple(map(self.numbers.__getitem__, found.ids))
            ends = (np.flatnonzero(self.word_ends[list(ids)]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):  # else each is encoded by itself when it is met
                self.update(zip(some, (ids[i:j] for i, j in zip([0, *ends], ends))))
        for chunk, parts in parted:
            if len(chunk) <= 64 and (len(parts) != 1 or parts[0] != chunk):
                self[chunk] = tuple(chain.from_iterable(map(self.__getitem__, parts)))

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and the offsets where each text's begin, the end last. Null texts have none."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, distinct))
        unseen = [i for i, x in enumerate(found) if x is None]
        with no_collector():
            self._learn([distinct[i] for i in unseen])
            for i in unseen:
                found[i] = self[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
        words = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))
        before = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))
        return lists.take(coded.indices).flatten().to_numpy(), before[words]

    @cached_property
    def word_ends(self) -> np.ndarray:
        """Flags, by id, of the tokens that end a word."""
        flags = np.zeros(len(self.numbers), bool)
        flags[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        return flags

    @cached_property
    def sentence_ends(self) -> np.ndarray:
        """Flags, by id, of the tokens that end with a full stop, exclamation or question mark."""
        vocabulary = self.tokenizer.get_vocab()
        flags = np.zeros(max(vocabulary.values()) + 2, bool)
        for token, i in vocabulary.items():
            flags[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
        return flags


@cache
def words_of(path: str) -> Words:
    """A Python worker's own, for all tasks that it runs."""
    return Words(path)


def cut_points(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions after which a document may be cut, its end last, and whether each is a sentence's end."""
    stops = np.flatnonzero(ends[ids[:-1]]) + 1
    edges = np.concatenate(([0], stops, [len(ids)]))
    inner = [np.arange(a + stride, b, stride) for a, b in zip(edges[:-1], edges[1:]) if b - a > stride] if np.diff(edges).max(initial=0) > stride else []
    at = np.concatenate([stops, *inner, [len(ids)]])  # no point stands twice: strides lie between stops, stops before the end
    sentence = np.arange(len(at)) < len(stops)
    if inner:
        order = np.argsort(at)
        at, sentence = at[order], sentence[order]
    return at, sentence


def best_cuts(at: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """Indexes of the chosen cuts among ascending positions `at`; the last is always chosen. No gap may exceed length."""
    queue = deque([(0, 0, -1)])  # best + position, position, index
    back = [-1] * len(at)
    for j, (p, extra) in enumerate(zip(at, penalty)):
        while p - queue[0][1] > length:
            queue.popleft()
        least, _, back[j] = queue[0]
        cost = least + length + extra  # best(j) + p(j)
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, p, j))
    chosen, j = [], len(at) - 1
    while j >= 0:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def pack_block(docs: list[tuple[int, np.ndarray]], ends: np.ndarray, first: int, length: int = LENGTH) -> tuple[dict, int]:
    """The pieces of a block of documents, as columns, and the number of the next sequence."""
    at, penalty, base, doc_of = [], [], 0, []
    for k, (_, ids) in enumerate(docs):
        points, sentence = cut_points(ids, ends, min(STRIDE, length))
        cost = np.where(sentence, SENTENCE_PENALTY, STRIDE_PENALTY)
        cost[-1] = 0
        at += (points + base).tolist()
        penalty += cost.tolist()
        base += len(ids)
    starts = np.cumsum([0, *(len(ids) for _, ids in docs)])
    out: dict[str, list] = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")}
    begin, k = 0, 0
    for number, end in enumerate((at[j] for j in best_cuts(at, penalty, length)), first):
        where = begin
        while where < end:
            while starts[k + 1] <= where:
                k += 1
            doc, ids = docs[k]
            a, b = where - int(starts[k]), min(end, int(starts[k + 1])) - int(starts[k])
            for name, value in zip(out, (doc, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), number, where - begin, end - begin)):
                out[name].append(value)
            where += b - a
        begin = end
    return out, (number + 1 if at else first)


def blocks(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Documents (id, tokens with the separator) in blocks of about BLOCK tokens. Batches: id, text."""
    held, tokens = [], 0
    for piece in (x for batch in batches for x in slices(batch, 1, PIECE)):
        found, at = words.tokens(piece.column(1))
        for doc, a, b in zip(piece.column(0).to_pylist(), at[:-1], at[1:]):
            ids = np.append(found[a:b], np.int32(SEPARATOR))
            held.append((doc, ids))
            tokens += len(ids)
            if tokens >= BLOCK:
                yield held
                held, tokens = [], 0
    if held:
        yield held


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    sequence_id is the partition's number times 2^40 plus the sequence's number there. tokenizer: path of the tokenizer's
    file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        ends, number = words.sentence_ends, TaskContext.get().partitionId() << 40
        for held in blocks(batches, words):
            columns, number = pack_block(held, ends, number, length)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, SCHEMA)


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, width: int = 2) -> DataFrame:
    """One row a sequence: sequence_id, n_tokens, pieces and ids, `length` unsigned little-endian integers of `width` bytes, padded with the separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        ends, number = words.sentence_ends, TaskContext.get().partitionId() << 40
        if len(ends) - 2 >= 1 << (8 * width):
            raise ValueError(f"the vocabulary has ids beyond {width} bytes")
        for held in blocks(batches, words):
            columns, number = pack_block(held, ends, number, length)
            first = np.flatnonzero(np.diff(np.array(columns["sequence_id"]), prepend=-1))
            sizes = np.array(columns["sequence_tokens"], np.int64)[first]
            tokens, at, ids = np.concatenate([x for _, x in held]).astype(f"<u{width}"), 0, []
            for n in sizes.tolist():
                row = np.full(length, SEPARATOR, f"<u{width}")
                row[:n] = tokens[at : at + n]
                ids.append(row.tobytes())
                at += n
            offsets = pa.array([*first, len(columns["doc_id"])], pa.int32())
            pieces = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(columns[k], pa.int64()) for k in ("doc_id", "start", "length")], ["doc_id", "start", "length"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(columns["sequence_id"])[first], pa.int64()), pa.array(sizes), pieces, pa.array(ids, pa.binary())], names=["sequence_id", "n_tokens", "pieces", "ids"])

    schema = "sequence_id long, n_tokens long, pieces array<struct<doc_id:long,start:long,length:long>>, ids binary"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
