"""Hard negatives from embeddings: integer inner products by Strassen multiplication of tiles, then heaps.

Rows become tiles of int64 components where they are read; the tiles are written once. Anchors are a stated query set
and get tiles of their own. Anchor tiles meet candidate tiles: broadcast while their size, which is counted first, is
below a bound, and dealt over a grid of both numbers beyond it, so that neither side has to fit anywhere. Each meeting
is one Strassen product. Its scores go into heaps of the best candidates for each anchor, which are merged within a
task, and by rank between tasks. A first pass finds the positives, a second one the negatives inside each positive's
window of scores.

Products are exact: components and all of Strassen's sums are 64-bit integers, leaves are multiplied in doubles
where every sum is proven to stay below 2**53, and where scores could pass 64 bits the tile is multiplied in Python's integers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

#: rows of a tile, and 64-bit components; longer vectors make lower tiles
TILE_ROWS, TILE_CELLS = 512, 1 << 19
#: bytes of anchor tiles that are broadcast at most, and candidate tiles for one cell of the grid beyond that
BROADCAST_BYTES, CELL_TILES = 8 << 20, 64
#: anchors whose heaps a task keeps before it sends them on
HELD_ANCHORS = 65_536
#: sides up to which tiles are multiplied directly
LEAF = 32
POSITIVES = NEGATIVES = 5

TILE = "tile long, size int, dim int, id binary, label binary, value binary"


# ---------------------------------------------------------------- products


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for integers, with seven products of halves; odd sides are padded with a zero."""
    n, m, p = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m, p) <= LEAF:
        return _leaf(a, b)
    a, b = _padded(a, n + (n & 1), m + (m & 1)), _padded(b, m + (m & 1), p + (p & 1))
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * k), m1.dtype)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:n, :p]


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object and _most(a) * _most(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two tiles, the shorter vectors with zeros behind them, held within 64 bits.

    Sums inside of ``strassen`` may pass 64 bits and wrap; what they cancel to is right as long as the score itself fits.
    """
    dim = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = _padded(anchors, len(anchors), dim), _padded(candidates, len(candidates), dim)
    right = np.ascontiguousarray(candidates.T)
    if _most(anchors) * _most(candidates) * dim < 1 << 63:
        return strassen(anchors, right)
    return np.clip(strassen(anchors.astype(object), right.astype(object)), 1 - (1 << 63), (1 << 63) - 1)


# ---------------------------------------------------------------- tiles


class Tile(NamedTuple):
    number: int
    id: np.ndarray
    label: np.ndarray
    value: np.ndarray  # a row for each vector

    @classmethod
    def of(cls, number: int, size: int, dim: int, id_: bytes, label: bytes, value: bytes) -> Tile:
        return cls(number, np.frombuffer(id_, np.int64), np.frombuffer(label, np.int64), np.frombuffer(value, np.int64).reshape(size, dim))


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label (the next one of ten where the id is divisible by 7) and vec of rows that take part."""
    label = F.col(label_col).cast("long")
    own = df.select(
        F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)


def tiles(rows: DataFrame) -> DataFrame:
    """Tiles of the rows of each partition in their order. Components beyond 2**53 in size after scaling are held there."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        widest = 0

        def tile():
            value = np.zeros((len(held), widest), np.int64)
            for k, (_, _, v) in enumerate(held):
                value[k, : len(v)] = v
            ids, labels = (np.array([h[j] for h in held], np.int64).tobytes() for j in (0, 1))
            return pa.RecordBatch.from_pylist([{"tile": number, "size": len(held), "dim": widest, "id": ids, "label": labels, "value": value.tobytes()}], schema=pa.schema([("tile", pa.int64()), ("size", pa.int32()), ("dim", pa.int32()), ("id", pa.binary()), ("label", pa.binary()), ("value", pa.binary())]))

        for batch in batches:
            vec = batch.column(2)
            offset, flat = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(flat * 256), -(2.0**53), 2.0**53).astype(np.int64)
            for k, (i, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                v = whole[offset[k] : offset[k + 1]]
                if held and (len(held) == TILE_ROWS or (len(held) + 1) * max(widest, len(v)) > TILE_CELLS):
                    yield tile()
                    number, held, widest = number + 1, [], 0
                held.append((i, label, v))
                widest = max(widest, len(v))
        if held:
            yield tile()

    return rows.select("id", "label", "vec").mapInArrow(run, TILE)


def meetings(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every anchor tile with every candidate tile, as a_ and c_ columns; both are written tables."""
    n, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value") + F.octet_length("id")), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        rows, columns = 1, 1
    else:
        rows = max(1, -(-size // BROADCAST_BYTES))
        columns = max(1, -(-candidates.count() // CELL_TILES))
    cell = lambda own: F.pmod(F.xxhash64("tile"), F.lit(own))
    every = lambda own: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(own - 1).cast("long")))
    a = anchors.select(cell(rows).alias("row"), every(columns).alias("column"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    c = candidates.select(every(rows).alias("row"), cell(columns).alias("column"), *[F.col(c).alias(f"c_{c}") for c in candidates.columns])
    return c.join(F.broadcast(a) if rows == columns == 1 else a, ["row", "column"]).drop("row", "column")


# ---------------------------------------------------------------- heaps


class Heap:
    """The first ``k`` of what was pushed for each slot: highest score first, then the smallest id.

    An id and score that repeat in a slot count once, so heaps merge by pushing one into the other.
    """

    def __init__(self, k: int):
        self.k = k
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        slot, id_ = np.concatenate([self.slot, slot]), np.concatenate([self.id, id_])
        score = np.concatenate([self.score, score.astype(np.int64)])  # scores are held within 64 bits
        order = np.lexsort((id_, -score, slot))
        slot, score, id_ = slot[order], score[order], id_[order]
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (slot[1:] != slot[:-1]) | (id_[1:] != id_[:-1]) | (score[1:] != score[:-1])
        slot, score, id_ = slot[fresh], score[fresh], id_[fresh]
        kept = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], id_[kept]


def first_of(values: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of at least the first k allowed values of every row, ties at the last one included."""
    width = values.shape[1]
    if width > k and allowed.any():
        held = np.where(allowed, values, -(1 << 63)).astype(np.int64)
        bar = np.partition(held, width - k, axis=1)[:, width - k]
        allowed = allowed & (held >= bar[:, None])
    return np.nonzero(allowed)


HEAPS = "tile long, slot long, anchor_id long, score long, id long"


def _heaps(met: DataFrame, per_anchor: int, push, columns: list[str]) -> DataFrame:
    """Runs ``push(heap, anchor tile, candidate tile, row)`` over all meetings and gives what the heaps of a task hold.

    An anchor has ``per_anchor`` slots.
    """
    parts = [p.split()[0] for p in TILE.split(", ")]

    def run(batches):
        heaps: dict[int, tuple[Heap, np.ndarray]] = {}
        held = 0

        def rows():
            for number, (heap, ids) in heaps.items():
                columns = [np.full(len(heap.slot), number), heap.slot, ids[heap.slot // per_anchor], heap.score.astype(np.int64), heap.id]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "slot", "anchor_id", "score", "id"])

        for batch in batches:
            for met_ in batch.to_pylist():
                anchor, other = (Tile.of(*[met_[side + p] for p in parts]) for side in ("a_", "c_"))
                if anchor.number not in heaps:
                    if held + len(anchor.id) > HELD_ANCHORS:
                        yield from rows()
                        heaps, held = {}, 0
                    heaps[anchor.number] = Heap(NEGATIVES if per_anchor > 1 else POSITIVES), anchor.id
                    held += len(anchor.id)
                push(heaps[anchor.number][0], anchor, other, met_)
        yield from rows()

    return met.select(*columns).mapInArrow(run, HEAPS)


def _positives(heap: Heap, anchor: Tile, other: Tile, met: dict) -> None:
    found = scores(anchor.value, other.value)
    allowed = (anchor.label[:, None] == other.label[None, :]) & (anchor.id[:, None] != other.id[None, :])
    row, column = first_of(found, allowed, POSITIVES)
    heap.push(row, found[row, column], other.id[column])


def _negatives(heap: Heap, anchor: Tile, other: Tile, met: dict) -> None:
    found = scores(anchor.value, other.value)
    if found.dtype != object and 100 * max(_most(found), *[abs(b) for bars in met["a_bars"] for b in bars], 0) >= 1 << 63:
        found = found.astype(object)
    unlike = anchor.label[:, None] != other.label[None, :]
    for rank in range(max(map(len, met["a_bars"]), default=0)):
        has = np.array([len(bars) > rank for bars in met["a_bars"]])
        bar = np.array([bars[rank] if len(bars) > rank else 0 for bars in met["a_bars"]], found.dtype)
        inside = (80 * bar[:, None] <= 100 * found) & (found <= bar[:, None])
        row, column = first_of(found, unlike & has[:, None] & inside.astype(bool), NEGATIVES)
        heap.push(row * POSITIVES + rank, found[row, column], other.id[column])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Heaps of all tasks merged: the first k of each tile and slot, equal ids and scores once."""
    by = Window.partitionBy("tile", "slot").orderBy(F.desc("score"), F.col("id"))
    return found.withColumn("rank", F.dense_rank().over(by)).where(F.col("rank") <= k).distinct()


def mine(df: DataFrame, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. Rows without an id, label or vector, or with a component that is null or
    not finite, take no part; vectors of unlike length are compared with zeros behind the shorter one; an empty vector
    scores 0. A row is told from the anchor by its id. Rows of one id and score count once for an anchor, and equal
    anchors give their rows once. Ties go by id; other columns are not looked at; an empty table gives an empty result.
    """
    rows = usable(df, id_col, vec_col, label_col)
    candidates = cut_lineage(tiles(rows))
    asked = cut_lineage(rows.where(F.col("id") % every == 0).distinct())
    anchors = cut_lineage(tiles(asked.coalesce(max(1, asked.count() // TILE_ROWS))))
    both = [side + c for side in ("a_", "c_") for c in anchors.columns]
    # a row of a meeting has two tiles
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    positives = cut_lineage(_ranked(_heaps(meetings(anchors, candidates), 1, _positives, both), POSITIVES))
    # scores of the positives of every anchor of a tile, in order
    bars = positives.groupBy("tile", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("bars"))
    bars = bars.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bars"))).alias("by_slot"))
    slots = F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)
    of_slot = F.transform(slots, lambda s: F.coalesce(F.try_element_at("by_slot", s), F.array().cast("array<bigint>")))
    asking = cut_lineage(anchors.join(bars, "tile").select(*[anchors[c] for c in anchors.columns], of_slot.alias("bars")))
    negatives = _ranked(_heaps(meetings(asking, candidates), POSITIVES, _negatives, [*both, "a_bars"]), NEGATIVES)
    named = negatives.select(
        "tile", F.floor(F.col("slot") / POSITIVES).alias("slot"), (F.col("slot") % POSITIVES + 1).cast("int").alias("nth"), "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    of = positives.select("tile", "slot", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(of, ["tile", "slot", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
