"""Quality rules: fixed counts first, then a calibrated logistic regression over hashed word and character n-grams.

The regression sees the share of each hashed n-gram among the text's n-grams of its kind. It is trained on a bounded
sample of labelled rows, calibrated on a part that training has not seen, and scored in Arrow batches: a score is two
means of weights, summed in whole units so that equal texts get equal scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.codepoints import char_grams, code_points
from tickloom.llm.labelled import labelled_sample, platt, sigmoid, span_sums
from tickloom.llm.textio import base_counts, gram_starts, grams, hash_words, per_text, split_words

BITS = 15
CHAR_GRAMS = (2, 4)
#: labelled rows (about) that the model is trained on, and the share of them kept for calibration
TRAINING_ROWS, CALIBRATION = 2500, 0.2
STEPS, RATE, PENALTY, UNIT = 120, 0.3, 1e-4, 1 << 16
#: shares of n-grams are small; the same for both kinds
SCALE = 20.0
#: fixed thresholds
LEAST_WORDS, MOST_REPEATED_PERCENT, LEAST_PROBABILITY = 50, 50, 0.5


class Model(NamedTuple):
    words: np.ndarray  # weights by bucket, in units
    chars: np.ndarray
    bias: float
    slope: float
    shift: float


def _buckets(texts: list[bytes | None], w=None, h=None):
    """Buckets and spans by text: of words and word pairs, of character n-grams."""
    w = split_words(texts) if w is None else w
    h = hash_words(w) if h is None else h
    cut = np.uint64(64 - BITS)
    pairs = gram_starts(w, 2)
    word = [((h >> cut).astype(np.int32), w.first[:-1], w.first[1:])]
    first = np.searchsorted(pairs, w.first)
    word.append(((grams(h, 2)[pairs] >> cut).astype(np.int32), first[:-1], first[1:]))
    p = code_points(texts, lower=False)
    return word, [(char_grams(p.value, n, BITS), p.start, p.end) for n in CHAR_GRAMS]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Model of the labels, or None without a labelled row of each class."""
    size = 1 << BITS

    def features(texts):
        index, value = [], []
        kinds = _buckets(texts)
        for i in range(len(texts)):
            own = [np.bincount(np.concatenate([g[a[i] : b[i]] for g, a, b in kind]), minlength=size) for kind in kinds]
            both = np.concatenate([c / max(1, c.sum()) for c in own])
            at = np.flatnonzero(both)
            index.append(at.astype(np.int32))
            value.append((both[at] * SCALE).astype(np.float32))
        return [pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]

    sample = labelled_sample(docs, labels, label, rows, id_col, text_col)
    found = per_text(sample, "at array<int>, value array<float>", features).toArrow().combine_chunks().sort_by(id_col)
    y = found.column("_label").to_numpy().astype(float)
    if len(y) < 10 or y.min() == y.max():
        return None
    index, value = (np.concatenate([c.flatten().to_numpy() for c in found.column(k).chunks]) for k in ("at", "value"))
    first = np.concatenate([[0], np.cumsum([len(x) for x in found.column("at")])])
    del found
    held = np.zeros(len(y), bool)
    held[np.random.default_rng(7).permutation(len(y))[: max(2, int(CALIBRATION * len(y)))]] = True
    row = np.repeat(np.arange(len(y)), np.diff(first))
    fit = ~held[row]
    w, b = np.zeros(2 * size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(2 * size + 1), np.zeros(2 * size + 1)
    at, x, r = index[fit], value[fit], row[fit]
    for step in range(1, STEPS + 1):
        error = np.where(held, 0, sigmoid(np.bincount(r, weights=w[at] * x, minlength=len(y)) + b) - y) / (~held).sum()
        gradient = np.append(np.bincount(at, weights=x * error[r], minlength=2 * size) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) * (1 - step / (STEPS + 1))
        w, b = w - move[:-1], b - move[-1]
    margin = np.bincount(row, weights=w[index] * value, minlength=len(y)) + b
    slope, shift = platt(margin[held], y[held])
    units = np.round(w * SCALE * UNIT).astype(np.int64)
    return Model(units[:size], units[size:], b, slope, shift)


def probability(texts: list[bytes | None], model: Model, w=None, h=None) -> np.ndarray:
    total = np.full(len(texts), model.bias)
    for weights, kind in zip((model.words, model.chars), _buckets(texts, w, h)):
        number = sum(b - a for _, a, b in kind)
        total += sum(span_sums(weights[g], a, b) for g, a, b in kind) / UNIT / np.maximum(number, 1)
    return np.round(sigmoid(model.slope * total + model.shift), 9)


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, kept and the probability for every row.

    A null text counts as empty and fails the base rules, as every text of fewer than 50 words does. Without a model
    the base rules decide and the probability is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        w = split_words(texts)
        h = hash_words(w)
        c = base_counts(texts, w, h)
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"])
        p = None if shared.value is None else probability(texts, shared.value, w, h)
        kept = ~failed if p is None else ~failed & (p >= LEAST_PROBABILITY)
        counts = [pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return counts + [pa.array(failed), pa.array(kept), pa.nulls(len(texts), pa.float64()) if p is None else pa.array(p)]

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return per_text(docs.select(id_col, text_col), schema, run)
