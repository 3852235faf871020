"""Token counts by map-side lookup in two tiers.

The tokenizer drops white space and never joins across it, so a text is the sum of its white-space pre-tokens. Tier
one is a compact broadcast table of the lengths of frequent pre-tokens; tier two encodes a miss with the library and
keeps the length in a cache of the worker. No pre-token is shuffled. A text that holds one of the tokenizer's special
strings is encoded whole, because these are cut out before white space is.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textio import once, per_text, pieces

#: documents (about) of the sample that fills tier one; a miss costs time, never a wrong count
SAMPLE_DOCS = 2000
#: pre-tokens in tier one, and in each of the summaries it is made of
TABLE_SIZE = 65_536
SUMMARY_TASKS = 4
#: pre-tokens a worker caches before it starts over
CACHE_SIZE = 600_000


#: words that the tokenizer keeps whole and only lower-cases: letters without combining marks
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
_PROBES = (b"the", b"Zebra", "Élan".encode(), "ærøß".encode(), b"internationalisation")


def _printable_bytes() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """A tokenizer of the tokenizers library, as the library gives ids by default, without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.tokenizer.model, _printable_bytes()
        self.marks = {m: self.ids(m) for m in (b".", b",")}
        # plain words may skip the library's normaliser where that is known to change nothing
        self.direct = all(self._word(p.decode()) == self.ids(p) for p in _PROBES)

    def ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.alphabet))]

    def pre_token_ids(self, token: bytes) -> list[int]:
        word = token.decode("utf-8", "replace")
        if not self.direct:
            return self.ids(token)
        if _LETTERS.fullmatch(word):
            return self._word(word)
        if word[-1] in ".," and word[-2:-1].isascii() and word[-2:-1].isalpha():
            return self.pre_token_ids(token[:-1]) + self.marks[token[-1:]]
        return self.ids(token)

    def split(self, text: bytes) -> list[bytes] | None:
        """Lower-cased pre-tokens, or None where the text must be encoded whole."""
        text = text.lower()
        return None if any(s in text for s in self.special) else text.split()


class Cache(dict):
    """Value of a pre-token; made on a miss and kept while there is room."""

    def __init__(self, make, size: int, frequent: dict | None = None):
        super().__init__(frequent or {})
        self.make, self.size, self.frequent = make, size + len(self), frequent or {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
            self.update(self.frequent)
        value = self[key] = self.make(key)
        return value


def _frequent(docs: DataFrame, sample_docs: int, size: int) -> list[bytes]:
    """The most frequent pre-tokens of a sample of rows drawn by the hash of their id; each task sends one bounded summary."""
    every = max(1, docs.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64(F.col(docs.columns[0])), F.lit(every)) == 0)

    def summarise(batches):
        seen = Counter()
        for _, texts in pieces(batches):
            for t in texts:
                seen.update((t or b"").lower().split())
            if len(seen) > 8 * size:
                seen = Counter(dict(seen.most_common(2 * size)))
        top = [(k, n) for k, n in seen.most_common(size) if len(k) < 256]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    total = Counter()
    for row in sample.coalesce(SUMMARY_TASKS).mapInArrow(summarise, "token binary, n long").toLocalIterator():
        total[bytes(row.token)] += row.n
    return [k for k, _ in total.most_common(size)]


def _table(encoder: Encoder, tokens: list[bytes]) -> tuple[bytes, bytes]:
    """One byte of length for each pre-token, and the pre-tokens joined by line feeds, which none of them holds."""
    lengths = [(t, len(encoder.ids(t))) for t in tokens if encoder.split(t)]
    lengths = [(t, n) for t, n in lengths if n < 256]
    return bytes(n for _, n in lengths), b"\n".join(t for t, _ in lengths)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty, repeated rows stay.

    ``tokenizer`` is the path of a tokenizers file on every worker, of a tokenizer that drops white space.
    """
    docs = docs.select(id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(_table(Encoder(tokenizer), _frequent(docs, sample_docs, table_size)))

    def make():
        encoder = Encoder(tokenizer)
        lengths, tokens = table.value
        return encoder, Cache(lambda t: len(encoder.pre_token_ids(t)), CACHE_SIZE, dict(zip(tokens.split(b"\n"), lengths)))

    # a worker keeps its table and cache between tasks
    key = ("token lengths", tokenizer, hash(table.value))

    def count(texts, state):
        encoder, lengths = state
        sizes, tokens = [], []
        for t in texts:
            t = t or b""
            sizes.append(len(t))
            parts = encoder.split(t)
            tokens.append(len(encoder.ids(t)) if parts is None else sum(map(lengths.__getitem__, parts)))
        return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]

    return per_text(docs, "n_bytes long, n_tokens long, over_limit boolean", count, lambda: once(key, make))
