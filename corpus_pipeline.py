"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``; extra columns of the input ride along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import language, ngram_join, packing, pii, substrings
from tickloom.llm.queries import WORD_TOKENIZER
from tickloom.llm.textio import prepare
from tickloom.session import checkpoint_dir

#: a document stays if its language is told with at least this posterior
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter and those whose language cannot be told; ``lang`` becomes the predicted one."""
    docs = _prepared(spark, docs)
    found = language.identify(docs, language.train(docs), carry=_rest(docs))
    told = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR))
    return _restored(docs, told, text=F.col("text"), lang=F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, that of the least id."""
    return ngram_join.one_of_each(_prepared(spark, docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 13 words or more that a document of a smaller id has; texts without any stay as they are.

    ``n_chars`` follows the text. A document of which no word is left goes.
    """
    docs = _prepared(spark, docs)
    cleaned = substrings.cleaned(docs, carry=_rest(docs))
    left = cleaned.where((F.col("n_removed") == 0) | (F.col("cleaned") != ""))
    return _restored(docs, left, text=F.col("cleaned"), n_chars=F.char_length("cleaned"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format; every document stays."""
    docs = _prepared(spark, docs)
    return _restored(docs, pii.pseudonymise(docs, carry=_rest(docs)), text=F.col("text"), n_chars=F.char_length("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(_prepared(spark, docs), WORD_TOKENIZER)


def _prepared(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return docs


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _restored(docs: DataFrame, new: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from the struct that was carried along, but those that have changed."""
    columns = [F.col("doc_id") if c == "doc_id" else changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("carried").getField(c).alias(c) for c in docs.columns]
    return new.select(columns)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", pseudonymise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(prepare(spark))}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


#: no stage but the last of its filters can be said in SQL; tests hold every stage against a brute-force version
ORACLE_SQL = None
QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
