"""The corpus pipeline: five stages over ``documents``, each on what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written as
Parquet and read again as the next stage's documents. All but the last return the columns of
documents.

1. language: documents go that have no text or no letter, and those whose predicted language has a calibrated score under
   ``language.LEAST_SCORE`` (one half: no language is likelier than all others together). The model learns from the documents that
   state a language; where none does, only texts without a letter go.
2. near_duplicates: of each component of five-word shingle Jaccard links of 0.75 or more, the
   document with the least doc_id stays (of equal doc_ids one row). Documents without words are alone in theirs.
3. repeats: bytes covered by a 100-byte string that starts earlier are cut from the texts; a character cut
   in part goes whole. A text may end up empty; its row stays.
4. decontamination: documents that hold 75 % of a benchmark item's shingles go. Stages 2 and 4 decide for each row, not
   for its doc_id.
5. bpe: doc_id, ids and n_tokens of every text that is left.

Nulls in other columns are kept as they are; a null doc_id is never preferred over another
in stage 2; an empty table gives empty results; columns beyond those of documents are kept up to the last stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import bpe, decontaminate, jaccard, language, substrings
from lexiquarry.llm.common import scratch, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.tokenizer_path(), ["doc_id"], ["n_tokens", "ids"])


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The first stage is a trained model, the third and last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
