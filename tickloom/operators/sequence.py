"""Ordered-sequence operators that never put one key's whole history into one task.

A symbol can carry a third of all rows, so nothing here windows over a bare
``(date, symbol)``.  Three forms cover the needs of the library:

* ``last_rows``: the last N rows of a key.  Spark prunes to N on the map side
  (window group limit), a salted first pass prunes again, so the final task sees
  at most ``salts * n`` rows of a key.
* ``running`` / ``previous`` / ``number_rows``: exact prefix operators.  A key of at
  most ``CROWD`` rows is one window.  A larger one is cut into blocks (a monotone
  function of its order, normally a slice of the arrival clock); block totals are
  aggregated with map-side combine, scanned over the few blocks of a key, and added
  to the scan inside each block.  One count of the keys tells which is which, so
  that rows of small keys are shuffled once and meet no join.
* ``overlapping_chunks``: fixed-row frames.  Rows are numbered exactly, cut into
  chunks of equal row count, and every chunk repeats the last ``halo`` rows of the
  one before, so that a frame reaching ``halo`` rows back is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.schema import ORDER_KEY

#: width of a block in microseconds of arrival time
BLOCK_US = 60_000_000
#: rows of a key that one window may hold
CROWD = 200_000


def arrival_block(width_us: int = BLOCK_US) -> Column:
    return F.expr(f"local_us div {int(width_us)}")


def last_rows(
    df: DataFrame,
    keys: Sequence[str],
    n: int,
    order: Sequence[str] = tuple(ORDER_KEY),
    salts: int = 8,
    position: str = "rn",
) -> DataFrame:
    """The last ``n`` rows per key; ``position`` is 1 for the newest."""
    newest = [F.col(c).desc() for c in order]
    if salts > 1:
        salted = Window.partitionBy(*keys, "_salt").orderBy(*newest)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
            .withColumn("_rn", F.row_number().over(salted))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    whole = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn(position, F.row_number().over(whole)).filter(F.col(position) <= n)


def crowded(df: DataFrame, keys: Sequence[str]) -> list[Row]:
    """Keys of more than ``CROWD`` rows; they are fewer than the rows of the table by that factor."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select(*keys).collect()


def _blocked(df: DataFrame, keys: Sequence[str], block: Column | None, crowd: Sequence[Row] | None) -> tuple[DataFrame, bool]:
    """Add ``_block``, NULL for a key that is one window; and whether any key is cut."""
    crowd = crowded(df, keys) if crowd is None else crowd
    if not crowd:
        return df, False
    names = df.sparkSession.createDataFrame(list(crowd), df.select(*keys).schema).withColumn("_crowded", F.lit(True))
    marked = df.join(F.broadcast(names), list(keys), "left")
    return marked.withColumn("_block", F.when(F.col("_crowded"), arrival_block() if block is None else block)).drop("_crowded"), True


def _block_carry(blocks: DataFrame, keys: Sequence[str], merges: dict[str, str]) -> DataFrame:
    """Exclusive scan of block totals over the blocks of a key."""
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    scans = [getattr(F, how)(f"_t_{name}").over(before).alias(f"_c_{name}") for name, how in merges.items()]
    return blocks.select(*keys, "_block", *scans)


def running(
    df: DataFrame,
    keys: Sequence[str],
    spec: dict[str, tuple[str, Column]],
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """Inclusive running ``sum``/``max``/``min`` of each expression over the key's order.

    A sum over no value yet is 0, a max or min is NULL.
    """
    merges = {name: how for name, (how, _) in spec.items()}
    df, cut = _blocked(df, keys, block, crowd)
    df = df.withColumns({f"_x_{k}": v for k, (_, v) in spec.items()})
    inside = Window.partitionBy(*keys, *["_block"] * cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_r_{k}": getattr(F, how)(f"_x_{k}").over(inside) for k, how in merges.items()})
    if cut:
        totals = df.filter("_block IS NOT NULL").groupBy(*keys, "_block").agg(*[getattr(F, how)(f"_x_{k}").alias(f"_t_{k}") for k, how in merges.items()])
        out = out.join(_block_carry(totals, keys, merges), [*keys, "_block"], "left")
    final = {}
    for name, how in merges.items():
        local, base = F.col(f"_r_{name}"), F.col(f"_c_{name}") if cut else None
        if how == "sum":
            final[name] = F.coalesce(local, F.lit(0)) + F.coalesce(base, F.lit(0)) if cut else F.coalesce(local, F.lit(0))
        else:
            pick = F.greatest if how == "max" else F.least
            final[name] = pick(local, base) if cut else local
    helpers = ["_block"] + [f"{p}_{k}" for k in merges for p in ("_x", "_r", "_c")]
    return out.withColumns(final).drop(*helpers)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    name: str = "seq",
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """1-based position of every row in its key."""
    df, cut = _blocked(df, keys, block, crowd)
    inside = F.row_number().over(Window.partitionBy(*keys, *["_block"] * cut).orderBy(*order))
    if not cut:
        return df.withColumn(name, inside.cast("bigint"))
    totals = df.filter("_block IS NOT NULL").groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_t_n"))
    carry = _block_carry(totals, keys, {"n": "sum"})
    return (
        df.withColumn("_r_n", inside)
        .join(carry, [*keys, "_block"], "left")
        .withColumn(name, (F.col("_r_n") + F.coalesce(F.col("_c_n"), F.lit(0))).cast("bigint"))
        .drop("_block", "_r_n", "_c_n")
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """Value of the row just before, for ``{source column: new name}``."""
    df, cut = _blocked(df, keys, block, crowd)
    inside = Window.partitionBy(*keys, *["_block"] * cut).orderBy(*order)
    out = df.withColumns({new: F.lag(old).over(inside) for old, new in columns.items()})
    if not cut:
        return out
    ends = df.filter("_block IS NOT NULL").groupBy(*keys, "_block").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_t_row"))
    carry = ends.select(
        *keys, "_block", F.lag("_t_row").over(Window.partitionBy(*keys).orderBy("_block")).alias("_c_row")
    )
    # only the first row of a block looks into the block before
    out = out.withColumn("_first", F.row_number().over(inside) == 1).join(carry, [*keys, "_block"], "left")
    return out.withColumns({new: F.when(F.col("_first"), F.col("_c_row")[old]).otherwise(F.col(new)) for old, new in columns.items()}).drop("_block", "_first", "_c_row")


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str,
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    inclusive: bool = False,
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """Last non-null ``value`` before (or up to) each row: an as-of join without a join."""
    df, cut = _blocked(df, keys, block, crowd)
    df = df.withColumn("_v", value)
    inside = (
        Window.partitionBy(*keys, *["_block"] * cut)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = df.withColumn("_r_v", F.last("_v", ignorenulls=True).over(inside))
    if not cut:
        return out.withColumn(name, F.col("_r_v")).drop("_v", "_r_v")
    ends = df.filter("_block IS NOT NULL").groupBy(*keys, "_block").agg(
        F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_t_v")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_block", F.last("_t_v", ignorenulls=True).over(before).alias("_c_v"))
    out = out.join(carry, [*keys, "_block"], "left")
    return out.withColumn(name, F.coalesce("_r_v", "_c_v")).drop("_block", "_v", "_r_v", "_c_v")


def overlapping_chunks(
    df: DataFrame,
    keys: Sequence[str],
    halo: int,
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    rows_per_chunk: int = 50_000,
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """Add ``seq``, ``chunk`` and ``halo_row``; window over ``(*keys, chunk)`` then drop halo rows."""
    size = max(rows_per_chunk, halo, 1)
    out = number_rows(df, keys, order, block, crowd=crowd)
    own = F.expr(f"(seq - 1) div {size}")
    repeats = F.pmod(F.col("seq") - 1, F.lit(size)) >= size - halo
    chunks = F.when(repeats, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        out.withColumn("_own", own)
        .withColumn("chunk", F.explode(chunks))
        .withColumn("halo_row", F.col("chunk") != F.col("_own"))
        .drop("_own")
    )


def frame(keys: Sequence[str], start: int, end: int, order: Sequence[str] = ("seq",)):
    """Row frame inside overlapping chunks."""
    return Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(start, end)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    starts: Column,
    order: Sequence[str] = tuple(ORDER_KEY),
    block: Column | None = None,
    name: str = "island",
) -> DataFrame:
    """Number runs: a new island begins on each row where ``starts`` is true."""
    return running(df, keys, {name: ("sum", F.when(starts, 1).otherwise(0))}, order, block)


def peak_of_changes(changes: DataFrame, keys: Sequence[str], change: str, order: Sequence[str], block: Column, name: str = "peak") -> DataFrame:
    """By key, the largest value that the running sum of ``change`` reaches; 0 where it never rises above 0.

    A block of the order is summed up as its total and the largest of its own running sums; these compose, so no key has to
    be walked through in one task.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = changes.withColumn("_block", block).withColumn("_sum", F.sum(change).over(inside)).groupBy(*keys, "_block").agg(F.sum(change).alias("_t_sum"), F.max("_sum").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.withColumn("_top", F.coalesce(F.sum("_t_sum").over(before), F.lit(0)) + F.col("_top"))
    return tops.groupBy(*keys).agg(F.greatest(F.max("_top"), F.lit(0)).cast("bigint").alias(name))
