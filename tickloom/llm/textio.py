"""Text batches as byte arrays: words, their hashes and n-grams for a whole Arrow batch at once.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. All separators are ASCII, so words of a UTF-8 text can be cut on its
bytes. Hashes have 64 bits and are the same on every worker.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import apply_defaults

#: documents in an Arrow batch; long texts must not meet by the thousand
BATCH_ROWS = 128
#: bytes of text handled at once, each of which takes some 60 bytes of arrays; one longer text is handled alone
BATCH_BYTES = 1 << 20
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def prepare(spark: SparkSession) -> SparkSession:
    """Session defaults, small Arrow batches, and shuffle files that go when the execution they serve has ended.

    What a later step reads of an earlier one is always a written table, so no shuffle is needed twice.
    """
    apply_defaults(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id) -> F.Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


_KEPT: dict = {}


def once(key, make: Callable):
    """What ``make`` returned when this process first asked for the key: tasks of one worker share it."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Gives freed memory back: workers outlive their tasks, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with at most BATCH_BYTES of text, and the texts as UTF-8; freed memory goes back at the end."""
    for batch in batches:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > begin and size + n > BATCH_BYTES:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
    release()


def column_names(schema: str) -> list[str]:
    """Names in a flat list of columns whose types may be nested."""
    return [c.split()[0] for c in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema)).split(",")]


def carried(columns: list[str]):
    """Further columns in one struct, so that their names cannot clash."""
    return (F.struct(*columns) if columns else F.lit(None).cast("struct<none:int>")).alias("carried")


def per_text(df: DataFrame, schema: str, fn: Callable[[list[bytes | None]], list], make: Callable | None = None, keep: bool = False) -> DataFrame:
    """Columns of ``df`` (the second is the text; it goes unless ``keep``), plus those ``fn`` returns for the texts.

    ``make`` runs once in every task and gives a state that ``fn`` gets as its second argument.
    """
    kept = [f for i, f in enumerate(df.schema.fields) if keep or i != 1]
    names = [f.name for f in kept] + column_names(schema)
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])

    def run(batches):
        state = (make(),) if make else ()
        for batch, texts in pieces(batches):
            columns = [batch.column(i) for i in range(batch.num_columns) if keep or i != 1]
            yield pa.RecordBatch.from_arrays(columns + [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(texts, *state)], names=names)

    return df.mapInArrow(run, full)


# ---------------------------------------------------------------- hashes

_M1, _M2, _R = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_BYTE = None
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to exponent n."""
    if len(_POWERS[0]) <= n:
        size = n + 1 + (n >> 3)
        for k, base in enumerate((_R, pow(_R, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[k] = np.multiply.accumulate(run)
    return _POWERS


def hash_spans(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end): a polynomial over random byte values, shifted to the span's start."""
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
    up, down = _powers(len(buffer))
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    buffer: np.ndarray  # the texts, each followed by a space
    offset: np.ndarray  # of each text in the buffer, and the buffer's length
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index of the text, for every word
    first: np.ndarray  # index of each text's first word, and the number of words


def table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SEPARATOR = table_of(SEPARATORS)


def split_words(texts: list[bytes | None]) -> Words:
    data = [t or b"" for t in texts]
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in data])]).astype(np.int64)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[buffer]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(start, offset)
    doc = np.repeat(np.arange(len(data)), np.diff(first))
    return Words(buffer, offset, start, end, doc, first)


def hash_words(w: Words) -> np.ndarray:
    return hash_spans(w.buffer, w.start, w.end)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values, by its start; runs that cross texts are there too."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(_R) + hashes[j : j + n])
    return out


def gram_starts(w: Words, k: int) -> np.ndarray:
    """Word positions at which a run of k words of one text starts."""
    if len(w.doc) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[: len(w.doc) - k + 1] == w.doc[k - 1 :])


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


# ---------------------------------------------------------------- statistics of texts

_SYMBOL = table_of(b"#*$%&|<>")
_UPPER = table_of(bytes(range(65, 91)))
_DIGIT = table_of(b"0123456789")
_PUNCT = table_of(b".,;:!?'\"()-")
_ALPHA = table_of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def repeated_words(w: Words, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text, the words inside k-word windows that the text has twice or more (the first included)."""
    covered = np.zeros(len(hashes) + k, bool)
    at = gram_starts(w, k)
    if len(at):
        key = grams(hashes, k)[at] ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.concatenate([at[order[1:][same]], at[order[:-1][same]]])
        for j in range(k):
            covered[again + j] = True
    return per_doc(covered[: len(hashes)].astype(np.int8), w.first)


def repeated_lines(text: bytes | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    if not text:
        return 0, 0
    if b"\n" not in text:
        return int(bool(text.strip(SEPARATORS))), 0
    lines = [x for x in text.split(b"\n") if x.strip(SEPARATORS)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(texts: list[bytes | None], w: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    b = w.buffer
    inside = ~_SEPARATOR[b] & ((b & 0xC0) != 0x80)
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": per_doc(inside.astype(np.int8), w.offset),
        "n_symbols": per_doc(_SYMBOL[b].astype(np.int8), w.offset),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated_words(w, hashes),
        "n_lines": lines[:, 0],
    }


def text_statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts and shares of whole texts; all zero for empty ones."""
    w = split_words(texts)
    h = hash_words(w)
    c = base_counts(texts, w, h)
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    key = np.sort(h ^ mix(w.doc.astype(np.uint64) + np.uint64(1)))  # a word of one text
    order = np.argsort(h ^ mix(w.doc.astype(np.uint64) + np.uint64(1)), kind="stable")
    fresh = np.ones(len(h), bool)
    fresh[1:] = key[1:] != key[:-1]
    runs = np.flatnonzero(fresh)
    doc_of_run, size = w.doc[order][runs], np.diff(np.append(runs, len(h)))
    most = np.zeros(len(texts))
    np.maximum.at(most, doc_of_run, size)
    share = lambda t: per_doc(t[w.buffer].astype(np.int8), w.offset) / chars
    length = (w.end - w.start).astype(np.int64)
    capital = _UPPER[w.buffer[w.start]] if len(w.start) else np.zeros(0, bool)
    return {
        "log_words": np.log1p(c["n_words"]),
        "mean_word": per_doc(length, w.first) / words,
        "symbols": c["n_symbols"] / chars,
        "upper": share(_UPPER),
        "digits": share(_DIGIT),
        "punctuation": share(_PUNCT),
        "letters": share(_ALPHA),
        "exclamations": share(table_of(b"!")),
        "capital_words": per_doc(capital.astype(np.int8), w.first) / words,
        "short_words": per_doc((length <= 3).astype(np.int8), w.first) / words,
        "long_words": per_doc((length >= 14).astype(np.int8), w.first) / words,
        "repeated_lines": c["n_dup_lines"] / lines,
        "repeated_words": c["n_repeat_words"] / words,
        "distinct_words": np.bincount(doc_of_run, minlength=len(texts)) / words,
        "top_word": most / words,
        "words_per_line": c["n_words"] / lines,
    }
