"""Factor panels, metric panels, labels and reports: reading, converting, checking, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clock import published_event
from tickloom.functions.scalar import factor_of, finite, metric_of
from tickloom.schema import REASON

KEYS = ["symbol", "date", "event"]


def read_panel(spark: SparkSession, path: str, factors: Sequence[str] | None = None, dates: Sequence[str] | None = None) -> DataFrame:
    """Keys, the requested factors and the readiness columns that exist; dates prune partitions."""
    df = spark.read.parquet(path)
    if dates is not None:
        df = df.filter(F.col("date").isin(*dates))
    if factors is None:
        return df
    extra = [f"{p}_{f}" for f in factors for p in ("ready", "reason") if f"{p}_{f}" in df.columns]
    return df.select(*KEYS, *factors, *extra)


def read_labels(spark: SparkSession, path: str, value: str) -> DataFrame:
    df = spark.read.parquet(path)
    if value not in df.columns:
        raise ValueError(f"exact label column missing: {value}")
    return df.select(*KEYS, value)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Membership or tradability by ``code`` (six digits, a point, the exchange): the other columns must be 0 or 1."""
    df = spark.read.parquet(path)
    flags = [c for c in df.columns if c != "code"]
    if "code" not in df.columns or not flags:
        raise ValueError("a universe needs code and at least one column of flags")
    bad = ~F.coalesce(F.col("code").rlike(r"^[0-9A-Za-z]+\.[A-Z]+$"), F.lit(False))
    for c in flags:
        bad = bad | ~F.coalesce(F.col(f"`{c}`").isin(0, 1), F.lit(False))
    if df.filter(bad).limit(1).count():
        raise ValueError("a universe has plain codes and flags of 0 or 1 only")
    return df.select("code", *[F.col(f"`{c}`").cast("int").alias(c) for c in flags])


def read_label_csv(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """The label column of CSV files with a header, as doubles; text that is no number fails the read."""
    df = spark.read.option("header", True).csv(path)
    if label not in df.columns:
        raise ValueError(f"label CSV must contain {label!r}")
    value = F.col(label).cast("double")
    broken = F.assert_true(value.isNotNull(), F.lit("a label is no number"))
    return df.select(*[c for c in df.columns if c != label], F.when(broken.isNull(), value).alias(label))


def concat_panels(parts: dict[str, DataFrame], name: str = "split", keys: Sequence[str] = ("date", "event")) -> DataFrame:
    """Panels of equal columns one below the other, named in ``name``; their dates must not overlap and no key may repeat."""
    out = None
    for part, df in parts.items():
        if out is not None:
            check_columns(df.columns, out.columns[:-1])
            require_disjoint(out, df, "date")
        df = df.withColumn(name, F.lit(part))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no panel to concatenate")
    if duplicate_keys(out, [name, *keys]).limit(1).count():
        raise ValueError("a key repeats")
    return out


def strict_frame(panel: DataFrame, dates: Sequence[str], events: Sequence[int], factors: Sequence[str], metrics: Sequence[str], threshold: float = 0.95, allow_partial: bool = False) -> DataFrame:
    """A metric panel as it must be frozen: the whole grid once, columns in contract order, finite values, enough of them."""
    check_columns(panel.columns, ["date", "event", *[f"{f}|{m}" for f in factors for m in metrics]])
    check_dates(dates, dates)
    cell = F.struct(F.col("date").cast("string").alias("date"), F.col("event").cast("bigint").alias("event"))
    inside = F.col("date").cast("string").isin(*dates) & F.col("event").isin(*events)
    columns = panel.columns[2:]
    checks = [F.count_if(F.col(f"`{c}`").isNotNull() & ~finite(F.col(f"`{c}`"))).alias(f"bad{i}") for i, c in enumerate(columns)]
    checks += [F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]
    seen = panel.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(cell).alias("cells"), F.count_if(inside).alias("inside"), *checks).first()
    expected = len(dates) * len(events)
    if not seen["rows"] == seen["cells"] == seen["inside"] == expected:
        raise ValueError("frozen date/event grid mismatch")
    for i, c in enumerate(columns):
        if seen[f"bad{i}"]:
            raise ValueError(f"non-finite {c}")
        if not allow_partial and seen[f"n{i}"] < threshold * expected:
            raise ValueError(f"coverage below {threshold}: {c}")
    return panel


def names_of(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The distinct values of a name column, sorted: a catalogue's names, never data that grows with time."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} is no list of names")
    return sorted(found)


def read_strict_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Metric documents; NaN or Infinity literals and malformed text fail the read."""
    reader = spark.read.option("multiLine", True).option("allowNonNumericNumbers", False).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def wide_to_long(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``factor|metric`` columns to ``factor, metric, value``, split on the last pipe."""
    columns = [c for c in panel.columns if "|" in c and c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = panel.select(*keys, F.explode(cells).alias("_c"))
    return long.select(*keys, factor_of(F.col("_c.name")).alias("factor"), metric_of(F.col("_c.name")).alias("metric"), "_c.value")


def long_to_wide(long: DataFrame, keys: Sequence[str], factors: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Back to one ``factor|metric`` column each, in contract order."""
    cells = [
        F.max(F.when((F.col("factor") == f) & (F.col("metric") == m), F.col("value"))).alias(f"{f}|{m}") for f in factors for m in metrics
    ]
    return long.groupBy(*keys).agg(*cells)


def publish(panel: DataFrame, factors: Sequence[str], strict: bool = False) -> DataFrame:
    """Production matrix to the published panel: event renamed, masks and reasons completed.

    A missing reason becomes ``unknown`` for a cell that is not ready, unless ``strict``.
    """
    out = {"event": published_event(F.col("event"))}
    for f in factors:
        if f"reason_{f}" not in panel.columns:
            if strict:
                raise ValueError(f"missing reason column for {f}")
            out[f"reason_{f}"] = F.when(F.col(f"ready_{f}"), REASON["ready"]).otherwise(REASON["unknown"]).cast("short")
    panel = panel.withColumns(out)
    return panel.select(*KEYS, *factors, *[f"ready_{f}" for f in factors], *[f"reason_{f}" for f in factors])


def factor_only(panel: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Values alone: NaN where not ready, a true zero kept."""
    nan = F.lit(float("nan"))
    return panel.select(*KEYS, *[F.when(F.col(f"ready_{f}"), F.coalesce(F.col(f).cast("double"), nan)).otherwise(nan).alias(f) for f in factors])


def evaluator_view(panel: DataFrame) -> DataFrame:
    """Without the reason columns; a panel without readiness is refused."""
    if not any(c.startswith("ready_") for c in panel.columns):
        raise ValueError("panel has no readiness columns")
    return panel.select(*[c for c in panel.columns if not c.startswith("reason_")])


def selected_export(panel: DataFrame, factors: Sequence[str], declared: Sequence[str]) -> DataFrame:
    if len(set(factors)) != len(factors) or not set(factors) <= set(declared):
        raise ValueError("export factors must be a unique subset of the factor list")
    return factor_only(panel, factors)


def save_times(panel: DataFrame, events: Sequence[int] | None) -> DataFrame:
    return panel if events is None else panel.filter(F.col("event").isin(*events))


def write_panel(panel: DataFrame, path: str, by_event: bool = False) -> None:
    """One directory per date (and checkpoint); only the written partitions are replaced.

    Rows are spread by date and a hash of the symbol, so a large date is several files instead
    of one task.
    """
    keys = ["date", "event"] if by_event else ["date"]
    spread = F.pmod(F.xxhash64("symbol"), F.lit(8))
    (
        panel.repartition(*keys, spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def missing_dates(requested: DataFrame, finished: DataFrame) -> DataFrame:
    """Dates that still need work: those without an output whose contract holds."""
    return requested.join(finished.filter("valid").select("date"), "date", "left_anti")


# --- contracts --------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def event_shape(panel: DataFrame) -> DataFrame:
    """Rows and distinct symbols per date and event, against the symbol count of the date."""
    per = panel.groupBy("date", "event").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"))
    day = panel.groupBy("date").agg(F.count_distinct("symbol").alias("date_symbols"))
    return per.join(day, "date").withColumn("complete", (F.col("rows") == F.col("symbols")) & (F.col("symbols") == F.col("date_symbols")))


def mask_violations(panel: DataFrame, factors: Sequence[str], group: Sequence[str] = ("date",)) -> DataFrame:
    """Cells breaking the mask contract: ready but not finite, reason disagreeing with the mask, NULL mask."""

    def counts(f: str) -> list[Column]:
        ready, reason = F.col(f"ready_{f}"), F.col(f"reason_{f}")
        return [
            F.count_if(ready & ~finite(F.col(f))).alias("ready_not_finite"),
            F.count_if(F.coalesce(ready != (reason == REASON["ready"]), F.lit(True))).alias("reason_mismatch"),
            F.count_if(ready.isNull()).alias("mask_null"),
        ]

    aggs = [F.struct(F.lit(f).alias("factor"), *counts(f)).alias(f"_{f}") for f in factors]
    wide = panel.groupBy(*group).agg(*aggs)
    return wide.select(*group, F.explode(F.array(*[f"_{f}" for f in factors])).alias("_c")).select(*group, "_c.*")


def check_columns(actual: Sequence[str], expected: Sequence[str]) -> None:
    if list(actual) != list(expected):
        raise ValueError(f"column contract broken: missing {sorted(set(expected) - set(actual))}, extra {sorted(set(actual) - set(expected))}")


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, duplicates counted."""
    a, b = left.select(*keys), right.select(*keys)
    missing = a.exceptAll(b).withColumn("side", F.lit("missing"))
    return missing.unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    if left.select(key).intersect(right.select(key)).limit(1).count():
        raise ValueError(f"{key} lists overlap")


def require_complete(metrics: DataFrame, labels: Sequence[str], universes: Sequence[str], n_factors: int | None = None) -> DataFrame:
    """The rows of a scorecard's input, if every wanted label and universe has them for the very same factors.

    Refuses a pair without rows, pairs that differ in their factors, and another number of factors than ``n_factors``.
    One row for each pair comes to the driver.
    """
    wanted = {(x, u) for x in labels for u in universes}
    sets = metrics.where(F.col("label").isin(*labels) & F.col("universe").isin(*universes)).groupBy("label", "universe")
    mark = F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("factor").cast("string"))), "\n"), 256)
    found = {(r.label, r.universe): (r.mark, r.n) for r in sets.agg(mark.alias("mark"), F.countDistinct("factor").alias("n")).collect()}
    if missing := sorted(wanted - found.keys()):
        raise ValueError(f"no metrics for {missing}")
    if len({m for m, _ in found.values()}) > 1:
        raise ValueError("labels and universes differ in their factors")
    if n_factors is not None and any(n != n_factors for _, n in found.values()):
        raise ValueError(f"{n_factors} factors wanted")
    return metrics


def metric_coverage(metrics: DataFrame, keys: Sequence[str], names: Sequence[str], gate: float = 0.95) -> DataFrame:
    """By key, the share of rows in which each metric is there, how many values are not finite, and whether any metric stays under the gate.

    A value that is not finite is not there.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    odd = lambda c: F.col(c).isNotNull() & ~finite(c)
    out = metrics.groupBy(*keys).agg(*[(F.count_if(finite(c)) / F.count(F.lit(1))).alias(f"coverage_{c}") for c in names], sum(F.count_if(odd(c)) for c in names).alias("non_finite"))
    low = F.least(*[F.col(f"coverage_{c}") for c in names]) if len(names) > 1 else F.col(f"coverage_{names[0]}")
    return out.withColumn("below_gate", low < gate)


def require_finite(coverage: DataFrame) -> DataFrame:
    """The result of ``metric_coverage``, unless some metric is not finite."""
    if bad := coverage.where("non_finite > 0").limit(1).count():
        raise ValueError(f"metrics that are not finite in {bad} or more cells")
    return coverage


def check_dates(dates: Sequence[str], frozen: Sequence[str]) -> None:
    """Eight digits, sorted, unique, inside the frozen list and before the holdout."""
    if not dates or list(dates) != sorted(set(dates)):
        raise ValueError("date list must be sorted and unique")
    bad = [d for d in dates if len(d) != 8 or not d.isdigit() or d not in set(frozen) or d >= "20250101"]
    if bad:
        raise ValueError(f"dates not allowed: {bad}")


def column_quality(
    panel: DataFrame, factors: Sequence[str], group: Sequence[str], min_coverage: float = 0.8, min_std: float = 0.0, min_unique: int = 2, min_nonzero: float = 0.0,
    warm_up: Column | None = None,
) -> DataFrame:
    """Technical acceptance of every factor column of every group, with the list of reject reasons.

    Rows where ``warm_up`` is true count as rows and for a constant column, but not for coverage and what follows from it; a group that
    has no others is not covered.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x"), F.col(f"ready_{f}").alias("ready")) for f in factors])
    warm = F.lit(False) if warm_up is None else F.coalesce(warm_up, F.lit(False))
    long = panel.select(*group, warm.alias("_warm"), F.explode(cells).alias("_c")).select(*group, "_warm", "_c.*")
    ok = F.col("ready") & finite(F.col("x"))
    any_, v = F.when(ok, F.col("x")), F.when(ok & ~F.col("_warm"), F.col("x"))
    n, after = F.count(F.lit(1)), F.count_if(~F.col("_warm"))
    q = long.groupBy(*group, "factor").agg(
        n.alias("row_count"), F.count(any_).alias("finite_count"), (F.min(any_) == F.max(any_)).alias("_constant"), F.count_if("ready").alias("ready_count"),
        F.count_if(~F.col("ready")).alias("not_ready_count"), F.count_if(~F.col("ready") & (F.col("x") == 0)).alias("not_ready_zero_count"),
        F.count_if(F.isnan("x")).alias("nan_count"), F.count_if(F.abs("x") == float("inf")).alias("inf_count"), F.count_if(any_ == 0).alias("zero_count"),
        F.coalesce(F.count(v) / F.nullif(after, F.lit(0)), F.lit(0.0)).alias("coverage"), F.stddev_pop(v).alias("cross_section_std"), F.count_distinct(v).alias("unique_count"),
        F.coalesce(F.avg(F.when(v != 0, 1.0).when(v.isNotNull(), 0.0)), F.lit(0.0)).alias("nonzero_ratio"),
    )
    reasons = [
        (F.col("coverage") < min_coverage, "post_warmup_coverage_below_threshold"),
        ((F.col("finite_count") >= 2) & F.col("_constant"), "constant_column"),
        (F.col("cross_section_std").isNull() | (F.col("cross_section_std") < min_std), "cross_section_std_below_threshold"),
        (F.col("unique_count") < min_unique, "cross_section_unique_count_below_threshold"),
        (F.col("nonzero_ratio") < min_nonzero, "cross_section_nonzero_ratio_below_threshold"),
        (F.col("unique_count") < min_unique, "cross_section_effective_rank_count_below_threshold"),
    ]
    q = q.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in reasons]))).drop("_constant")
    return q.withColumn("status", F.when(F.size("reject_reasons") > 0, "technical_reject").otherwise("technical_pass"))


def acceptance(quality: DataFrame, group: Sequence[str]) -> DataFrame:
    """A group is accepted when every factor of every checkpoint passes."""
    return quality.groupBy(*group).agg(
        F.bool_and(F.col("status") == "technical_pass").alias("accepted"), F.count_if(F.col("status") != "technical_pass").alias("rejected_columns")
    )


def reproduction(current: DataFrame, historical: DataFrame, factors: Sequence[str], rtol: float = 1e-12, atol: float = 1e-12) -> DataFrame:
    """Error statistics of two panels per event and factor, missing keys counted."""

    def long(df: DataFrame, value: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias(value)) for f in factors])
        return df.select(*KEYS, F.explode(cells).alias("_c")).select(*KEYS, "_c.*", F.lit(True).alias(f"_in_{value}"))

    both = long(current, "a").join(long(historical, "b"), [*KEYS, "factor"], "full_outer")
    err = F.abs(F.col("a") - F.col("b"))
    close = F.coalesce(err <= atol + rtol * F.abs("b"), F.col("a").eqNullSafe(F.col("b")))
    paired = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.groupBy("event", "factor").agg(
        F.count_if(paired).alias("pairs"), F.count_if(~paired).alias("unmatched"), F.max(err).alias("max_abs_error"), F.avg(err).alias("mean_abs_error"),
        F.avg(F.when(paired, F.col("a").eqNullSafe(F.col("b")).cast("double"))).alias("exact_equal_fraction"), F.bool_and(paired & close).alias("passed"),
    )
