"""Registered queries over whole tables, with production parameters.

All of them read texts of any length in slices or whole, give nothing for an empty table, and look at no other columns
than those named, so that further ones may have any names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import byte_bpe, hard_negatives, language, lexical, media, ngram_join, oracles, packing, pii, quality_rules, rule_ensemble, secret_ledger, substrings, token_counts
from tickloom.llm.textio import documents, prepare
from tickloom.session import checkpoint_dir

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its personal data moved; null and empty texts stay as they are, rows that repeat move alike."""
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every whole text; a null text counts as empty, equal texts get equal verdicts, without labels every score is even."""
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.train(docs, _labels(spark, sf_dir)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text; a null text has none."""
    return token_counts.token_counts(documents(spark, sf_dir), WORD_TOKENIZER)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes they decode to; a null text is empty."""
    return byte_bpe.round_trip(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every payload as stored and read back, and the clips' feature; a null text is a payload of spaces."""
    return media.digests(media.store(documents(spark, sf_dir)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; a null or empty text is its end id alone, rows that repeat are packed each."""
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER)


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every whole text; a null text is an empty one, equal texts score equally, a class alone or equal texts leave the prior."""
    docs = documents(spark, sf_dir)
    return rule_ensemble.classify(docs, rule_ensemble.train(docs, _labels(spark, sf_dir)))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every row; texts without a word and null texts are alone, a null id gets the class of its copies or null."""
    return ngram_join.Join(documents(spark, sf_dir)).membership()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what is left of every text; a null text has no words, a row without an id loses none, rows that repeat lose alike."""
    return substrings.digests(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and posterior of every whole text; `und` for null texts and those without a letter, and where nothing was learned."""
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each anchor and positive; rows without a label or a finite vector take no part."""
    return hard_negatives.mine(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, by a ledger of its own in the shared folder; a null text has none."""
    docs = documents(spark, sf_dir)
    return secret_ledger.digests(docs, f"{checkpoint_dir(spark)}/secrets-{uuid.uuid4().hex}")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item; null texts have no terms."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.rank(documents(spark, sf_dir), items, f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (
    op1_pii_pseudonyms, op2_quality_rules, op3_token_counts, op4_byte_bpe, op5_avi_clips,
    op6_best_fit_packing, op7_rule_ensemble, op8_ngram_jaccard_join, op9_substring_dedup, op10_language,
    op11_hard_negatives, op12_secret_ledger, op13_ranked_search,
)}
#: the others cannot be said in SQL as a whole; each is tested against a brute-force version
ORACLES: dict[str, str] = oracles.SQL
