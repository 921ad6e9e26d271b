"""From raw documents to packed training sequences.

Stages, each over all that its predecessor kept:

- language: documents whose text is in no learned language go: those that fit the best one less than half as well as its own rows
- lines: repeated lines, fuzzy ones included, go from the texts; a text may become empty, its document stays
- near-duplicates: of documents linked by five-word shingles of Jaccard similarity 0.8 or more the one with the smallest id stays
- decontamination: documents with benchmark passages go
- packing: the texts' tokens, in sequences of 2,048

The first four return the columns of documents; n_chars follows the text where a line went. Null texts and empty tables
pass as the operators' docstrings say; rows with null id pass the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, line_dedup, packing, shingles
from ledgerlens.llm.common import read_table, stored
from ledgerlens.llm.entry import TOKENIZER

SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicated(docs, into="__removed")
    n_chars = F.when(F.size("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.first_of_each_group(docs, size=SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Naive Bayes in floating point, near-duplicate groups and packing aren't SQL; near-duplicates are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
