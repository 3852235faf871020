"""Documents packed into sequences of bounded length.

Texts become token ids in one pass; ids are only kept as a checksum of each piece. Pieces are then dealt to packers
by the hash of their document, about PACKER_PIECES to each, and every packer runs bounded-space online best-fit: a
fixed number of open bins, a bitset with a bit for each amount of free space that some open bin has. A piece goes to
the open bin with the least space that fits; if none fits a bin is opened, and where all are open the fullest closes
first. Pieces arrive in the order of a hash, so that long and short ones alternate. What a packer leaves unfilled at
its end is at most its open bins, a small share of the sequences it makes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textio import once, per_text
from tickloom.llm.token_counts import Cache, Encoder
from tickloom.session import cut_lineage

CAPACITY = 4096
OPEN_BINS = 1024
#: pieces for one packer; a packer streams them and holds its open bins only
PACKER_PIECES = 1_000_000
CACHE_SIZE = 600_000


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.free = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 0 < length <= capacity."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, space = self.made, self.capacity
            self.made += 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        own = self.bins[space]
        number = own.pop()
        if not own:
            self.free ^= 1 << space
        self.open -= 1
        return number


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces-long arrays of length and checksum: every row's ids, then ``end_id``, cut every ``capacity`` ids."""

    def make():
        encoder = Encoder(tokenizer)
        return encoder, Cache(lambda t: struct.pack(f"<{len(ids := encoder.pre_token_ids(t))}I", *ids), CACHE_SIZE)

    end = np.array([end_id], "<u4").tobytes()

    def cut(texts, state):
        encoder, ids_of = state
        lengths, sums = [], []
        for t in texts:
            t = t or b""
            words = encoder.split(t)
            ids = np.array(encoder.ids(t), "<u4").tobytes() if words is None else b"".join(map(ids_of.__getitem__, words))
            ids += end
            parts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
            lengths.append([len(p) // 4 for p in parts])
            sums.append([zlib.crc32(p) for p in parts])
        return [pa.array(lengths, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))]

    cuts = per_text(docs.select(F.col(id_col).alias("doc_id"), text_col), "lengths array<bigint>, sums array<bigint>", cut, lambda: once(("token ids", tokenizer), make))
    piece = F.posexplode(F.arrays_zip("lengths", "sums")).alias("piece", "p")
    return cuts.select("doc_id", piece).select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("p.lengths").alias("length"), F.col("p.sums").alias("ids_crc32"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES, n_pieces: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length and ids_crc32.

    Equal rows are told apart by their order only, which changes no column. A packer's number is the high part of
    its sequences' ids.
    """
    n = max(1, -(-(pieces.count() if n_pieces is None else n_pieces) // packer_pieces))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64(order), F.lit(n))).withColumn("_order", order)
    dealt = dealt.repartitionById(n, F.col("packer").cast("int")).sortWithinPartitions("packer", "_order", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]):
        packer, fit = None, None
        for batch in batches:
            ids, offsets = [], []
            for own, length in zip(batch.column("packer").to_pylist(), batch.column("length").to_pylist()):
                if own != packer:
                    packer, fit = own, BestFit(capacity, open_bins)
                number, offset = fit.place(length)
                ids.append(packer << 40 | number)
                offsets.append(offset)
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as one or more pieces with their place; an empty or null text is its end id alone."""
    # written once: the number of pieces sets the number of packers, and texts are not encoded a second time
    return pack(cut_lineage(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)), capacity, open_bins)
