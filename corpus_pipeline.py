"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs in the columns of `documents`, and returns what it
kept in the same columns; the last returns the pieces of packed sequences. A stage is judged on its
own input alone. Rows with null texts stay until they are packed as an empty document.
"""

from __future__ import annotations

from candela.llm import _text, decontaminate, near_duplicates, packing, pii
from candela.llm import toxicity as toxic
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the models learn from the labels of the documents at hand."""
    return toxic.reject(docs, toxic.fit(docs, _text.table(spark, sf_dir, "labels")))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document of least id stays."""
    return near_duplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten benchmark words or more, and whole shorter items, are cut out; documents that are mostly such passages go."""
    return _counted(decontaminate.clean(docs, _text.table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.redact(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Language models, signatures and column generation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _text.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _text.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
