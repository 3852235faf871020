"""Language of texts by multinomial naive Bayes over hashed character n-grams.

Training rows are drawn per language by the hash of the id, so that rare languages are there too; their n-gram counts
are summed by Spark. The matrix of log-probabilities has one row of 128 KB for each language, all of which are kept; it
is broadcast in whole thousandths, so that sums are exact and equal texts get equal scores.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.codepoints import char_grams, code_points, letter_table
from tickloom.llm.labelled import span_sums
from tickloom.llm.textio import carried, fold, held_out, per_text, pieces

BITS = 15
GRAMS = (1, 2, 3)
#: training rows for each language (about)
ROWS_PER_LANGUAGE = 4000
SMOOTHING, UNIT = 0.5, 1000
#: n-grams of the three lengths overlap; their joint evidence is that of one length
TEMPER = 1 / len(GRAMS)
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets, int32 thousandths; bucket 0 is empty


def _buckets(texts: list[bytes | None]):
    """Buckets of each n-gram length by position (0: no letter in it), the texts' spans and their letters."""
    p = code_points(texts, lower=True)
    letter = letter_table()[p.value]
    plain = np.where(letter, p.value, np.uint32(32))
    out, some = [], letter
    for n in GRAMS:
        if n > 1:
            some = some | np.roll(letter, 1 - n)
        out.append(np.where(some, np.maximum(char_grams(plain, n, BITS), 1), 0))
    return out, p.start, p.end, span_sums(letter, p.start, p.end)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and language of the rows outside the held-out fold."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != 2))
    sizes = known.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy("lang").collect()
    if not sizes:
        return Model([], np.zeros(0), np.zeros((0, 1 << BITS), np.int32))
    names = [r["lang"] for r in sizes]
    # one literal, however many languages there are
    every = F.from_json(F.lit(json.dumps({r["lang"]: -(-r["count"] // ROWS_PER_LANGUAGE) for r in sizes})), "map<string,bigint>")
    lang = F.col(lang_col).cast("string")
    sample = known.where(F.pmod(F.xxhash64(id_col, F.lit("language")), every[lang]) == 0).select(lang.alias("_lang"), text_col)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch, texts in pieces(batches):
            grams, start, end, _ = _buckets(texts)
            for name, a, b in zip(batch.column(0).to_pylist(), start, end):
                own = total.setdefault(name, np.zeros(1 << BITS, np.int64))
                for g in grams:
                    own += np.bincount(g[a:b], minlength=1 << BITS)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), 1 << BITS))
    row = {name: i for i, name in enumerate(names)}
    counts[[row[x] for x in counted.column("lang").to_pylist()], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    counts[:, 0] = 0
    log_prob = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]))
    log_prob[:, 0] = 0
    share = np.array([r["count"] for r in sizes], float)
    return Model(names, np.log(share / share.sum()), np.round(log_prob * UNIT).astype(np.int32))


def score(texts: list[bytes | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior; ``und`` and 0 for a null text, one without a letter, or an empty model."""
    if not model.languages or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    grams, start, end, letters = _buckets(texts)
    joint = np.empty((len(texts), len(model.languages)))
    for k, row in enumerate(model.log_prob):  # a language at a time: only its row of the matrix is spread over the texts
        joint[:, k] = sum(span_sums(row[g], start, end) for g in grams)
    joint = joint * (TEMPER / UNIT) + model.prior
    weight = np.exp(joint - joint.max(axis=1, keepdims=True))
    best = joint.argmax(axis=1)
    posterior = np.round(weight.max(axis=1) / weight.sum(axis=1), 9)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best, letters)], np.where(letters > 0, posterior, 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, held_out, lang_pred and score for every row; with ``carry`` also the text and the struct of these columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        names, posterior = score(texts, shared.value)
        return [pa.array(names, pa.string()), pa.array(posterior, pa.float64())]

    further = [] if carry is None else [carried(carry)]
    return per_text(docs.select(id_col, text_col, held_out(F.col(id_col)).alias("held_out"), *further), "lang_pred string, score double", run, keep=carry is not None)
