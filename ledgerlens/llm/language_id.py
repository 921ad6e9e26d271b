"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of 1 to 3 characters, with a blank at either end of the text, are hashed into a fixed
number of buckets. Training counts buckets by language in Spark; the matrix of log probabilities is broadcast (its size
is bounded by max_languages and the buckets) and whole texts are scored batch by batch in numpy.

Defined results. Null text, and text without a letter, gets language `und` and score 0, as does every text if nothing
was learned. Ties go to the alphabetically first language. Repeated rows are judged alike. Extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: About so many labelled rows are counted at most: all of small languages, of larger ones an equal number, chosen by a hash of their id.
MAX_TRAINING_ROWS = 20_000
#: The matrix has so many rows at most: the languages with most labelled rows.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
UNKNOWN = "und"
HASH_RANGE = 1 << 40
MIN_GAIN = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """The bucket of every n-gram of every order."""
    wide, out = points.astype(np.uint64), []
    for n in ORDERS:
        if len(wide) >= n:
            key = np.full(len(wide) - n + 1, n, np.uint64)
            for i in range(n):
                key = (key << np.uint64(20)) ^ wide[i : len(wide) - n + 1 + i]
            out.append(((key * _MIX) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counts(text: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each bucket occurs in a text; worked piece by piece, with overlaps, so a very long text needs no more memory."""
    points, total = code_points(text), np.zeros(1 << bits, np.int64)
    most = max(ORDERS) - 1
    for at in range(0, len(points), PIECE):
        total += np.bincount(buckets(points[at : at + PIECE + most], bits), minlength=1 << bits)
        if (tail := points[at + PIECE : at + PIECE + most]).size:  # n-grams wholly in the overlap come again
            total -= np.bincount(buckets(tail, bits), minlength=1 << bits)
    return total


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is not None:
                sums[lang] = sums.get(lang, 0) + counts(text)
    for lang, row in sums.items():
        used = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())], names=["lang", "bucket", "n"])


def equal_quota(sizes: list[int], most: int) -> float:
    """The number q with sum of min(size, q) = most; infinite if all sizes fit."""
    for i, n in enumerate(sorted(sizes)):
        quota = most / (len(sizes) - i)
        if n > quota:
            return quota
        most -= n
    return math.inf


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix of log probabilities, by language and bucket."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(F.col(lang).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 1 << BUCKET_BITS))
    quota = equal_quota([r["count"] for r in sizes], max_rows)
    limits = [(r["lang"], math.ceil(min(1.0, quota / r["count"]) * HASH_RANGE)) for r in sizes]
    drawn = rows.join(F.broadcast(rows.sparkSession.createDataFrame(limits, "__drawn string, __limit long")), F.col(lang) == F.col("__drawn")).where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(HASH_RANGE)) < F.col("__limit"))
    found = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_count_rows, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix, at = np.full((len(langs), 1 << BUCKET_BITS), SMOOTHING), {x: i for i, x in enumerate(langs)}
    np.add.at(matrix, (np.array([at[x] for x in found["lang"].to_pylist()], np.int64), found["bucket"].to_numpy().astype(np.int64)), found["n"].to_numpy())
    prior = np.array([{r["lang"]: r["count"] for r in sizes}[x] for x in langs], float)
    return langs, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def own_gains(matrix: np.ndarray) -> np.ndarray:
    """The gain of each language's training rows as a whole; 0 where nothing was counted."""
    out = np.zeros(len(matrix))
    for i, row in enumerate(matrix.astype(np.float64)):
        seen = np.exp(row) - np.exp(row.min())  # in proportion to the counts, as some bucket is empty
        out[i] = (seen * (row + np.log(len(row)))).sum() / seen.sum() if seen.sum() > 0 else 0
    return out


def predictor(spark, model: tuple[list[str], np.ndarray, np.ndarray]):
    """A column function: text to struct<lang, score, gain>. The score is the posterior probability of the language; the gain is by how much the text's mean log probability of an n-gram exceeds that of a model to which all buckets are equal, 1 being the gain of the language's own training rows."""
    held = spark.sparkContext.broadcast((*model, own_gains(model[2])))

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}").search
        langs, prior, matrix, own = held.value
        by_bucket = np.ascontiguousarray(matrix.T)
        words = regex.compile(r"(?<![\p{L}\p{M}\p{N}@._-])[\p{L}\p{M}]+(?![\p{L}\p{M}\p{N}@_-]|\.\p{L})").findall

        def gain_of(n: np.ndarray, i: int) -> float:
            used = np.flatnonzero(n)
            mean = n[used].astype(np.float64) @ by_bucket[used, i] / n.sum()
            return float((mean + np.log(len(by_bucket))) / own[i]) if own[i] > 0 else 0.0

        for texts in batches:
            lang_out, score_out, gain_out = [], [], []
            for text in texts.to_pylist():
                if text is None or not langs or not letter(text):
                    lang_out.append(UNKNOWN)
                    score_out.append(0.0)
                    gain_out.append(0.0)
                    continue
                n = counts(text)
                used = np.flatnonzero(n)
                log = prior + n[used].astype(np.float64) @ by_bucket[used]
                odds = np.exp(log - log.max())
                best = int(odds.argmax())
                lang_out.append(langs[best])
                score_out.append(float(odds[best] / odds.sum()))
                gain = gain_of(n, best)
                if gain < MIN_GAIN:  # numbers, keys and addresses say nothing of the language
                    gain = max(gain, gain_of(counts(" ".join(words(text))), best))
                gain_out.append(gain)
            yield pa.StructArray.from_arrays([pa.array(lang_out, pa.string()), pa.array(score_out, pa.float64()), pa.array(gain_out, pa.float64())], ["lang", "score", "gain"])

    return F.arrow_udf(predict, "struct<lang:string,score:double,gain:double>").asNondeterministic()


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def known_language(docs: DataFrame, min_score: float = 0.0, min_gain: float = MIN_GAIN, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose text is in a learned language, with docs' own columns.

    A text in none has a high score too, as the score only compares the learned languages; it goes for its gain, which
    is under min_gain times that of the best language's training rows.
    """
    predict = predictor(docs.sparkSession, fit(docs.where(~held_out(id_col)), lang, text, id_col))
    judged = docs.withColumn("__lang", predict(F.col(text)))
    known = (F.col("__lang.lang") != UNKNOWN) & (F.col("__lang.score") >= min_score) & (F.col("__lang.gain") >= min_gain)
    return judged.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])
