"""Byte-level BPE by ranks, encoded and decoded in tasks.

A text is split by the published pattern and each match is looked up in two tiers. A minimal perfect hash over the
vocabulary (hash and displace) resolves pre-tokens that are vocabulary entries, with one probe and one comparison.
Others are merged with a heap over linked bytes: the pair of the lowest rank, leftmost first, is taken from the heap
and its neighbours are ranked anew, in n log n steps. The heap of a piece of at most ``SHORT`` bytes is a flat list whose
least entry is looked up: it has no links to keep. Pre-tokens never cross texts, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.textio import once, per_text
from tickloom.llm.token_counts import Cache

CACHE_SIZE = 300_000
#: bytes of a piece whose pairs are scanned for the least one
SHORT = 48
#: vocabulary entries per bucket of the perfect hash
BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class PerfectHash:
    """Minimal perfect hash of byte strings: a bucket's displacement sends its keys to free slots of a table without gaps."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n, m = len(keys), max(1, len(keys) // BUCKET)
        pairs = np.array([_halves(k) for k in keys], np.uint64).reshape(n, 2)
        bucket = (pairs[:, 0] % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.shift, taken, slots = [0] * m, np.zeros(n, bool), np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():  # the fullest buckets first, while most slots are free
            own = order[at[b] : at[b + 1]]
            if not len(own):
                break
            first = 0
            while True:  # displacements in blocks, the first whose slots are free and distinct
                tries = np.arange(first, first + 256, dtype=np.uint64)
                x = pairs[own, 1] + tries[:, None] * np.uint64(_STEP)
                s = ((((x ^ (x >> np.uint64(29))) * np.uint64(_MIX)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                ok = ~taken[s].any(axis=1)
                if len(own) > 1:
                    r = np.sort(s, axis=1)
                    ok &= (r[:, 1:] != r[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.shift[b], slots[own] = first + k, s[k]
                    taken[s[k]] = True
                    break
                first += 256
        self.keys, self.values = [b""] * n, [0] * n
        for i, s in enumerate(slots.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    def get(self, key: bytes) -> int | None:
        a, b = _halves(key)
        x = (b + self.shift[a % len(self.shift)] * _STEP) & _MASK
        slot = (((x ^ (x >> 29)) * _MIX & _MASK) >> 32) % len(self.keys)
        return self.values[slot] if self.keys[slot] == key else None


_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _halves(key: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of the piece: always the pair of adjacent parts with the lowest rank is joined, the leftmost of equals."""
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    end = list(range(1, n + 1))  # of the part that starts here
    before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of its parts has been joined since
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


_NO_RANK = 1 << 62


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` on lists of the parts' borders and of the ranks of neighbours; the first of the least ranks is the leftmost."""
    n, rank = len(piece), ranks.get
    borders = list(range(n + 1))
    pairs = [rank(piece[i : i + 2], _NO_RANK) for i in range(n - 1)]
    while pairs and (least := min(pairs)) != _NO_RANK:
        i = pairs.index(least)
        del borders[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(piece[borders[i] : borders[i + 2]], _NO_RANK)
        if i:
            pairs[i - 1] = rank(piece[borders[i - 1] : borders[i + 1]], _NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(borders, borders[1:])]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, table: PerfectHash | None = None):
        import regex

        self.ranks = read_ranks(path)
        self.table = table or PerfectHash(list(self.ranks), list(self.ranks.values()))
        # white space as Unicode has it: the four separators below U+0020 are not white space
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.text_of = {str(rank): token for token, rank in self.ranks.items()}
        self.memo = Cache(self._joined, CACHE_SIZE)

    def piece_ids(self, piece: bytes) -> list[int]:
        whole = self.table.get(piece)
        return merge(piece, self.ranks) if whole is None else [whole]

    def _joined(self, piece: str) -> str:
        return ",".join(map(str, self.piece_ids(piece.encode())))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.split(","))) if ids else b""


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (decimal, joined by commas; empty for an empty or null text) for every row."""
    return per_text(docs.select(id_col, text_col), "ids string", lambda texts, c: [pa.array([c.encode((t or b"").decode("utf-8", "replace")) for t in texts], pa.string())], _maker(docs, ranks, pattern))


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and bytes of every row of ids; null ids give no bytes."""
    return per_text(encoded.select(id_col, ids_col), "bytes binary", lambda ids, c: [pa.array([c.decode((t or b"").decode()) for t in ids], pa.binary())], _maker(encoded, ranks, pattern))


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and the digests of the ids and of the bytes that they decode to, without moving either."""

    def digest(texts, codec):
        tokens, ids_sha, bytes_sha = [], [], []
        for t in texts:
            ids = codec.encode((t or b"").decode("utf-8", "replace"))
            tokens.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            bytes_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]

    return per_text(docs.select(id_col, text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, _maker(docs, ranks, pattern))


def _maker(df: DataFrame, path: str, pattern: str):
    """The perfect hash is built once and broadcast: its size is that of the vocabulary. A worker keeps its codec between tasks."""
    ranks = read_ranks(path)
    table = df.sparkSession.sparkContext.broadcast(PerfectHash(list(ranks), list(ranks.values())))
    return lambda: once(("codec", path, pattern), lambda: Codec(path, pattern, table.value))
