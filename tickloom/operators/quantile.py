"""Exact comparison of a row with a quantile of all rows before it, in bounded memory.

How many rows before are smaller is counted in three disjoint parts, over a grid of chunks (rows in order) and buckets
(ranges of values, and single values that are common):

* rows of earlier chunks in lower buckets: sums over the grid, which has about as many lines as columns, each for
  ``rows_per_chunk`` rows;
* rows of the same chunk in lower buckets, inside the chunk;
* rows of the same bucket, inside the bucket. A bucket of one value needs no look inside.

The neighbours that the quantile lies between are found in the same three places.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.sequence import number_rows
from tickloom.session import written


def earlier_ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For values in order: how many earlier ones are smaller, and the positions of the largest smaller and the smallest not smaller of them (-1: none).

    Works through the bits of the ranks from below: two earlier and later rows that first differ in a bit meet where
    they share all higher ones. No step depends on a row before.
    """
    n = len(values)
    count, below, above = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, n, np.int64)
    # of equal values the later one has the lower rank, so that it is not above its elders
    order = np.lexsort((-np.arange(n), values))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for bit in range(max(n - 1, 0).bit_length()):
        group, high = rank >> (bit + 1), (rank >> bit) & 1 == 1
        up = np.argsort(group, kind="stable")
        low = ~high[up]
        seen = np.cumsum(low)
        start = np.searchsorted(group[up], group[up])
        before = seen - (seen - low)[start]
        r = up[~low]
        count[r] += before[~low]
        top = np.maximum.accumulate(np.where(low, rank[up], -1))[~low]
        below[r] = np.maximum(below[r], np.where(top >= group[r] << (bit + 1), top, -1))
        down = np.argsort(-group, kind="stable")
        bottom = np.minimum.accumulate(np.where(high[down], rank[down], n))[~high[down]]
        r = down[~high[down]]
        above[r] = np.minimum(above[r], np.where(bottom < (group[r] + 1) << (bit + 1), bottom, n))
    at = np.append(order, -1)
    return count, at[below], at[above]


def _looked_up(values: np.ndarray, at: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.where(at >= 0, values[at], 0), at < 0)


def _most(rows: DataFrame, keys: list[str]) -> int:
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _bucketed(rows: DataFrame, keys: list[str], value: str, rows_per_chunk: int) -> DataFrame | None:
    """``_bucket``: twice the number of edges below the value, and one more where the value is an edge itself. None where no key needs more than one."""
    most = _most(rows, keys)
    n = -(-most // rows_per_chunk)
    if n <= 1:
        return None
    shares = [i / n for i in range(1, n)]
    edges = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), F.lit(100 * n))).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return rows.join(edges, keys).withColumn("_bucket", 2 * below + F.array_contains("_edges", F.col(value)).cast("int")).drop("_edges")


def _grid(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key, chunk and bucket: rows of earlier chunks in lower buckets, the largest of them, and the smallest of earlier chunks in higher buckets."""
    cells = rows.groupBy(*keys, "_chunk", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    every = cells.select(*keys, "_chunk").distinct().join(cells.select(*keys, "_bucket").distinct(), keys)
    earlier = Window.partitionBy(*keys, "_bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = every.join(cells, [*keys, "_chunk", "_bucket"], "left").select(
        *keys, "_chunk", "_bucket", F.col("_n").alias("_own"), F.sum("_n").over(earlier).alias("_n"), F.min("_lo").over(earlier).alias("_lo"), F.max("_hi").over(earlier).alias("_hi")
    )
    line = Window.partitionBy(*keys, "_chunk").orderBy("_bucket")
    lower, higher = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    out = whole.select(*keys, "_chunk", "_bucket", "_own", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_g_n"), F.max("_hi").over(lower).alias("_g_lo"), F.min("_lo").over(higher).alias("_g_hi"))
    return out.where("_own is not null").drop("_own")


def _ranked(rows: DataFrame, group: list[str], value: str, counted: str, prefix: str) -> DataFrame:
    """Adds, inside each group in order: earlier rows with a smaller ``counted``, and the neighbours of ``value`` among the earlier rows."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq", kind="stable")
        v = pdf[value].to_numpy()
        n, lo, hi = earlier_ranks(v)
        if counted != value:
            n = earlier_ranks(pdf[counted].to_numpy())[0]
        return pdf.assign(**{f"{prefix}n": n, f"{prefix}lo": _looked_up(v, lo), f"{prefix}hi": _looked_up(v, hi)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {prefix}n bigint, {prefix}lo bigint, {prefix}hi bigint"
    return rows.groupBy(*group).applyInPandas(rank, schema)


def _above(value: Column, n: Column, smaller: Column, lo: Column, hi: Column, share: tuple[int, int], least: int) -> Column:
    """Whether the value exceeds the quantile of n values that lies between those numbered ``at`` and ``at + 1``."""
    num, den = share
    at, rest = F.floor(num * (n - 1) / den), F.pmod(num * (n - 1), F.lit(den))
    between = F.coalesce(den * (value - lo) > rest * (hi - lo), F.lit(True))
    return (n >= least) & ((smaller >= at + 2) | ((smaller == at + 1) & ((rest == 0) | between)))


def above_past_quantile(df: DataFrame, keys: Sequence[str], value: str, share: tuple[int, int] = (9, 10), least: int = 30, name: str = "above", rows_per_chunk: int = 50_000) -> DataFrame:
    """Add whether an integer value exceeds the ``share`` quantile (linear between neighbours) of all rows before it.

    False with fewer than ``least`` rows before. A key with a third of the rows is many tasks, each of about
    ``rows_per_chunk`` rows, however many values are distinct or equal.
    """
    keys, before = list(keys), F.col("_seq") - 1
    names, v = df.columns, F.col(value)
    numbered = number_rows(df, keys, name="_seq").withColumn("_chunk", F.expr(f"(_seq - 1) div {int(rows_per_chunk)}"))
    if _most(df, keys) <= rows_per_chunk:
        inside = _ranked(numbered, [*keys, "_chunk"], value, value, "_c_")
        return inside.select(*names, _above(v, before, F.col("_c_n"), F.col("_c_lo"), F.col("_c_hi"), share, least).alias(name))
    # rows and ranks are each read several times
    rows = written(_bucketed(written(numbered), keys, value, rows_per_chunk))
    met = _ranked(rows, [*keys, "_chunk"], value, "_bucket", "_c_").join(_grid(rows, keys, value), [*keys, "_chunk", "_bucket"])
    met = written(met)
    # ranges of values are looked into; of a single value it matters only whether it has been there
    ranges = _ranked(met.where("_bucket % 2 = 0"), [*keys, "_bucket"], value, value, "_b_")
    first = rows.where("_bucket % 2 = 1").groupBy(*keys, "_bucket").agg(F.min("_seq").alias("_first"))
    nothing = F.lit(None).cast("bigint")
    single = met.where("_bucket % 2 = 1").join(first, [*keys, "_bucket"]).withColumns({"_b_n": F.lit(0).cast("bigint"), "_b_lo": nothing, "_b_hi": F.when(F.col("_first") < F.col("_seq"), v).cast("bigint")}).drop("_first")
    both = ranges.unionByName(single)
    smaller = F.col("_c_n") + F.col("_g_n") + F.col("_b_n")
    told = _above(v, before, smaller, F.greatest("_c_lo", "_g_lo", "_b_lo"), F.least("_c_hi", "_g_hi", "_b_hi"), share, least)
    return both.select(*names, told.alias(name))
