"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents, whatever other columns there are and whatever their names.
An empty table gives an empty one. Whole texts are read, however long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from responsa.llm import decontaminate, dedup, language, packing, sanitize
from responsa.llm.common import cut, relieve, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go: null or empty texts, texts without a letter, and those too unlike any training text. Repeated rows go or stay alike; ties go to the first language by name."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8. The smallest doc_id stays, null ones last, and of equal rows one; rows without words are in no group and stay."""
    relieve(spark)
    return dedup.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows are judged by their texts, whatever their doc_id; null texts and repeated rows stay as they are."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced in their texts; n_chars follows. Null texts and rows without any stay as they are; repeated rows are treated alike."""
    return sanitize.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 4096 tokens. A null or empty text is one piece with the end id alone; equal pieces go by doc_id."""
    relieve(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", pack)]
#: SQL can express neither the language models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from documents; what each returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    done = reduce(lambda df, stage: cut(stage[1](spark, df, sf_dir)), STAGES[:-1], docs)
    return STAGES[-1][1](spark, done, sf_dir)
