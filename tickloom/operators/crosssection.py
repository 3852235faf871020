"""Cross-sectional ranks, quantile groups and information coefficients.

A group is one cross section (date, event and so on): one row for each stock of the market, some thousands, however
long the history is.  So a group fits a task, there are as many groups as dates, events and factors, and every
metric of a cross section is read off windows over one exchange on the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import finite


def tie_rank(group: Sequence[str], value: str) -> Column:
    """1-based rank with ties averaged; NULL and NaN values must be filtered before."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2.0


def average_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the 1-based rank with ties averaged; NULL and NaN values must be filtered before."""
    return df.withColumn(name, tie_rank(group, value))


def dense_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the dense rank over distinct values."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*group).orderBy(value)).cast("bigint"))


def quantile_group(
    df: DataFrame, group: Sequence[str], value: str, tie: str, groups: int = 10, name: str = "bucket"
) -> DataFrame:
    """0-based group of each row: rows [g*n/G, (g+1)*n/G) of the ascending order, G = min(groups, n).

    Equal values are ordered by ``tie``, so the result does not depend on partitioning.
    """
    w = Window.partitionBy(*group)
    placed = df.withColumns({"_pos": F.row_number().over(w.orderBy(value, tie)), "_n": F.count(F.lit(1)).over(w)})
    return placed.withColumn(name, F.expr(f"(_pos * least(_n, {groups}L) - 1) div _n")).withColumn(
        f"{name}_count", F.least(F.col("_n"), F.lit(groups))
    ).drop("_pos", "_n")


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(finite(F.col(x)) & finite(F.col(y)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs, NULL below two pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    den = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(F.when(both, 1)) >= 2, F.covar_pop(a, b) / F.nullif(den, F.lit(0.0)))


def _coefficients(x: str, y: str) -> list[Column]:
    """IC, RankIC and the number of pairs, of rows with their ranks in ``_rx`` and ``_ry``."""
    return [correlation(x, y).alias("IC"), correlation("_rx", "_ry").alias("RankIC"), F.count(F.lit(1)).alias("pairs")]


def information_coefficients(df: DataFrame, group: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """IC (Pearson) and RankIC (Pearson of average ranks) per cross section."""
    pairs = finite_pairs(df, x, y).select(*group, x, y)
    ranked = pairs.withColumns({"_rx": tie_rank(group, x), "_ry": tie_rank(group, y)})
    return ranked.groupBy(*group).agg(*_coefficients(x, y))


def group_returns(df: DataFrame, group: Sequence[str], x: str = "x", y: str = "y", tie: str = "symbol", groups: int = 10) -> DataFrame:
    """Mean label per quantile group, in long form: ``bucket`` 0 holds the lowest factor values."""
    placed = quantile_group(finite_pairs(df, x, y), group, x, tie, groups)
    return placed.groupBy(*group, "bucket").agg(F.avg(y).alias("mean_return"), F.max("bucket_count").alias("bucket_count"))


def _deciles(y: str) -> list[Column]:
    """D1 (the highest factor values) to D10, of rows with their ``bucket`` and ``bucket_count``."""
    return [F.avg(F.when(F.col("bucket_count") - F.col("bucket") == i, F.col(y))).alias(f"D{i}") for i in range(1, 11)]


def _decile_shape(wide: DataFrame) -> DataFrame:
    """LS = D1 - D10, and Monotonicity: the correlation of decile number and return over the deciles that exist."""
    numbers = range(1, 11)
    there = sum((F.col(f"D{i}").isNotNull().cast("double") for i in numbers), F.lit(0.0))
    mean_i = sum((F.when(F.col(f"D{i}").isNotNull(), float(i)).otherwise(0.0) for i in numbers), F.lit(0.0)) / F.nullif(there, F.lit(0.0))
    mean_d = sum((F.coalesce(f"D{i}", F.lit(0.0)) for i in numbers), F.lit(0.0)) / F.nullif(there, F.lit(0.0))
    wide = wide.withColumns({"_mi": mean_i, "_md": mean_d})

    def moment(term) -> Column:
        return sum((F.coalesce(term(F.lit(float(i)) - F.col("_mi"), F.col(f"D{i}") - F.col("_md"), F.col(f"D{i}")), F.lit(0.0)) for i in numbers), F.lit(0.0))

    cov = moment(lambda i, d, _: i * d)
    spread = F.sqrt(moment(lambda i, d, own: F.when(own.isNotNull(), i * i)) * moment(lambda i, d, _: d * d))
    # equal returns have no correlation, whatever the last bit of their mean
    flat = F.greatest(*[f"D{i}" for i in numbers]) == F.least(*[f"D{i}" for i in numbers])
    return wide.withColumns({"Monotonicity": F.when(~flat, cov / F.nullif(spread, F.lit(0.0))), "LS": F.col("D1") - F.col("D10")}).drop("_mi", "_md")


def decile_panel(df: DataFrame, group: Sequence[str], x: str = "x", y: str = "y", tie: str = "symbol") -> DataFrame:
    """D1..D10 (D1 holds the highest factor values), LS = D1 - D10 and Monotonicity.

    Monotonicity is the correlation of decile number with decile return: this library's
    definition, with the published sign (opposite to RankIC).
    """
    placed = quantile_group(finite_pairs(df, x, y), group, x, tie)
    return _decile_shape(placed.groupBy(*group).agg(*_deciles(y)))


def long_panel(panel: DataFrame, factors: Sequence[str], keys: Sequence[str] = ("symbol", "date", "event")) -> DataFrame:
    """Wide factors to ``factor, x``, not-ready values as NULL."""
    cells = []
    for f in factors:
        ready = F.col(f"ready_{f}") if f"ready_{f}" in panel.columns else F.lit(True)
        cells.append(F.struct(F.lit(f).alias("factor"), F.when(ready, F.col(f)).alias("x"), ready.alias("ready")))
    return panel.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def long_labels(labels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Label columns to ``label, y``; rows without the label are left out."""
    cells = F.array(*[F.struct(F.lit(name).alias("label"), F.col(c).alias("y")) for name, c in columns.items()])
    return labels.select("symbol", "date", "event", F.explode(cells).alias("_c")).select("symbol", "date", "event", "_c.*").filter("y IS NOT NULL")


def long_membership(universe: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tradable members of each universe by plain symbol."""
    tradable = universe.filter(F.col("isdt1") + F.col("iszt1") == 0)
    cells = F.array(*[F.struct(F.lit(n).alias("universe"), F.col(n).alias("m")) for n in names])
    symbol = F.split_part("code", F.lit("."), F.lit(1))
    return tradable.select(symbol.alias("symbol"), F.explode(cells).alias("_c")).filter("_c.m = 1").select("symbol", "_c.universe")


def evaluation_rows(panel: DataFrame, labels: DataFrame, members: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Factor values with their label inside each universe: the input of every metric."""
    keys = ["symbol", "date", "event"]
    return long_panel(panel, factors).join(labels, keys).join(members, "symbol")


def metric_panel(rows: DataFrame, group: Sequence[str] = ("label", "universe", "date", "event", "factor"), x: str = "x", y: str = "y", tie: str = "symbol") -> DataFrame:
    """The fourteen metrics of every cross section: one exchange, windows over it, one aggregate."""
    pairs = finite_pairs(rows, x, y).select(*group, tie, x, y)
    ranked = pairs.withColumns({"_rx": tie_rank(group, x), "_ry": tie_rank(group, y)})
    placed = quantile_group(ranked, group, x, tie)
    return _decile_shape(placed.groupBy(*group).agg(*_coefficients(x, y), *_deciles(y))).drop("pairs")


def winsorise(
    df: DataFrame, group: Sequence[str], value: str, name: str, cut: float = 0.01, k: float = 3.0, demean: bool = True, scale: bool = True
) -> DataFrame:
    """Clip at the floor(cut*n)-th order statistics, then at mean +- k sigma, then standardise.

    A group whose two order statistics are equal keeps its values.  NULL stays NULL and counts nowhere.
    """
    w = Window.partitionBy(*group)
    low = F.floor(F.col("_n") * cut)
    # values first: the position of a value is its order statistic
    out = df.withColumns({"_pos": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())), "_n": F.count(value).over(w)})
    out = out.withColumns({
        "_lo": F.max(F.when(F.col("_pos") == low + 1, F.col(value))).over(w),
        "_hi": F.max(F.when(F.col("_pos") == F.col("_n") - low, F.col(value))).over(w),
    })

    def between(lo: Column, hi: Column, v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), lo), hi))

    out = out.withColumn("_v", between(F.col("_lo"), F.col("_hi"), value))
    out = out.withColumns({"_m": F.avg("_v").over(w), "_s": F.stddev_pop("_v").over(w)})
    out = out.withColumn("_v", between(F.col("_m") - k * F.col("_s"), F.col("_m") + k * F.col("_s"), "_v"))
    out = out.withColumns({"_m2": F.avg("_v").over(w), "_s2": F.stddev_pop("_v").over(w)})
    v = F.col("_v") - F.col("_m2") if demean else F.col("_v")
    if scale:
        v = v / F.when(F.col("_s2") == 0, 1.0).otherwise(F.col("_s2"))
    flat = F.col("_lo") == F.col("_hi")
    return out.withColumn(name, F.when(flat, F.col(value)).otherwise(v)).drop("_pos", "_n", "_lo", "_hi", "_v", "_m", "_s", "_m2", "_s2")


def factor_correlations(panel: DataFrame, factors: Sequence[str], group: Sequence[str] = ("date", "event")) -> DataFrame:
    """Spearman of every factor pair a < b per cross section, in long form ``a, b, rho``.

    Ranks are computed once per factor; all pairs are one aggregate, so no pair of rows is
    ever emitted.  Missing values drop out pair by pair.
    """
    group = list(group)
    long = long_panel(panel, factors, ["symbol", *group]).filter(finite(F.col("x")))
    ranked = average_rank(long, [*group, "factor"], "x", "_r")
    wide = ranked.groupBy("symbol", *group).agg(
        *[F.max(F.when(F.col("factor") == f, F.col("_r"))).alias(f"_r_{f}") for f in factors]
    )
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    cells = wide.groupBy(*group).agg(*[correlation(f"_r_{a}", f"_r_{b}").alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    out = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p{i}").alias("rho"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return cells.select(*group, F.explode(out).alias("_c")).select(*group, "_c.*")
