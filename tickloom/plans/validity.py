"""Validity cells, evidence cells, their classification and the frozen selection.

Every rule list is one ordered CASE over cell aggregates: no per-cell driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import finite

CELL = ["factor", "event", "universe", "label"]
CORE = ["RankIC", "IC", "LS", "Monotonicity"]

# Gates of the frozen selection.
MIN_COVERAGE = 0.95
MIN_RANK_IC = 0.005
MIN_TSTAT = 2.0


def unpivot_metrics(panel: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return panel.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def metric_summaries(panel: DataFrame, metrics: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Per cell and metric: finite count, mean, std, distinct values and non-finite count."""
    long = unpivot_metrics(panel, metrics, group)
    v = F.when(finite(F.col("value")), F.col("value"))
    bad = F.col("value").isNotNull() & ~finite(F.col("value"))
    return long.groupBy(*group, "metric").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.count_distinct(v).alias("distinct"), F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("rows"),
    )


def classify_validity(cells: DataFrame) -> DataFrame:
    """Status and reason from the cell aggregates, first rule wins.

    Expects ``dates, rows, bad_metrics, bad_factors, ready_null, ready_dates, ready_bad, has_readiness,
    min_metric_count, max_metric_count, min_metric_distinct, factor_std, factor_unique``.
    """
    ready_share = F.col("ready_dates") / F.nullif(F.col("dates").cast("double"), F.lit(0.0))
    coverage = F.col("min_metric_count") / F.nullif(F.col("dates").cast("double"), F.lit(0.0))
    rules: list[tuple[Column, str, str]] = [
        ((F.col("dates") <= 0) | (F.col("rows") != F.col("dates")), "data_error", "invalid_date_count"),
        (F.col("bad_factors") > 0, "data_error", "non_finite_factor_value"),
        (F.col("bad_metrics") > 0, "data_error", "non_finite_metric"),
        (F.col("has_readiness") & (F.col("ready_null") > 0), "data_error", "readiness_contains_null"),
        (F.col("has_readiness") & (F.col("ready_bad") > 0), "data_error", "ready_factor_value_not_finite"),
        (F.col("has_readiness") & ((F.col("ready_dates") == 0) | (ready_share < MIN_COVERAGE)), "not_ready", "explicit_readiness_false"),
        (F.col("max_metric_count") == 0, "metric_undefined", "no_finite_metric_values"),
        (coverage < MIN_COVERAGE, "coverage_fail", "metric_coverage_below_threshold"),
        (F.col("min_metric_distinct") < 2, "metric_undefined", "insufficient_metric_variation"),
        (F.col("factor_std").isNull() | (F.col("factor_std") <= 0) | (F.col("factor_unique") < 2), "metric_undefined", "insufficient_cross_sectional_variation"),
        (~F.col("has_readiness"), "review", "readiness_not_provided"),
    ]
    status = reason = None
    for cond, s, r in rules:
        hit = F.coalesce(cond, F.lit(False))
        status = F.when(hit, s) if status is None else status.when(hit, s)
        reason = F.when(hit, r) if reason is None else reason.when(hit, r)
    return cells.withColumns({"status": status.otherwise("pass"), "reason": reason.otherwise("explicit_readiness_true"), "metric_coverage": coverage})


def validity_cells(panel: DataFrame, date_counts: DataFrame, cross: DataFrame, metrics: Sequence[str] = tuple(CORE), grid: DataFrame | None = None) -> DataFrame:
    """Validity matrix over the cells of ``panel``, or of ``grid`` (split and cell), where a cell without a row is a data error.

    ``date_counts`` is ``split, dates``; ``cross`` is the per (split, factor, event) cross-section
    roll-up with ``ready_dates, ready_null, ready_bad, factor_std, factor_unique, has_readiness``.
    """
    group = ["split", *CELL]
    stats = metric_summaries(panel, metrics, group)
    per_cell = stats.groupBy(*group).agg(
        F.min("n").alias("min_metric_count"), F.max("n").alias("max_metric_count"),
        F.min(F.when(F.col("n") > 0, F.col("distinct"))).alias("min_metric_distinct"),
        F.sum("bad").alias("bad_metrics"), F.max("rows").alias("rows"),
        F.max(F.when(F.col("metric") == "RankIC", F.col("mean"))).alias("mean_rank_ic"),
    )
    if grid is not None:
        absent = {c: 0 for c in ("min_metric_count", "max_metric_count", "bad_metrics", "rows")}
        per_cell = grid.select(*group).distinct().join(per_cell, group, "left").na.fill(absent)
    cells = per_cell.join(F.broadcast(date_counts), "split").join(cross, ["split", "factor", "event"], "left")
    cells = cells.withColumns(
        {"bad_factors": F.coalesce("bad_factors", F.lit(0)), "has_readiness": F.coalesce("has_readiness", F.lit(False))}
    )
    return classify_validity(cells)


def evidence_cells(panel: DataFrame, date_counts: DataFrame) -> DataFrame:
    """Training and observation statistics of a cell side by side, with availability flags.

    ``panel``: ``split, factor, event, universe, label, date`` and the core metrics;
    ``date_counts``: ``split, dates``.
    """
    names = {"RankIC": "rank_ic", "IC": "ic", "LS": "ls", "Monotonicity": "monotonicity"}
    splits = ("training", "observation")
    aggs = []
    for s in splits:
        inside = F.col("split") == s
        aggs.append(F.count_if(inside).alias(f"{s}_rows"))
        for m, k in names.items():
            v = F.when(inside & finite(F.col(m)), F.col(m).cast("double"))
            aggs += [F.avg(v).alias(f"{s}_{k}"), F.count(v).alias(f"{s}_{k}_count")]
            aggs.append(F.count_if(inside & F.col(m).isNotNull() & ~finite(F.col(m))).alias(f"{s}_{k}_bad"))
        rank = F.when(inside & finite(F.col("RankIC")), F.col("RankIC").cast("double"))
        std = F.stddev_samp(rank)
        aggs.append((F.avg(rank) / F.when(std > 0, std) * F.sqrt(F.count(rank))).alias(f"{s}_rank_ic_tstat"))
    cells = panel.filter(F.col("split").isin(*splits)).groupBy(*CELL).agg(*aggs)
    dates = date_counts.groupBy().agg(*[F.max(F.when(F.col("split") == s, F.col("dates"))).alias(f"{s}_dates") for s in splits])
    # one row: the two date counts
    cells = cells.join(F.broadcast(dates))
    shares = [F.col(f"{s}_{k}_count") / F.nullif(F.col(f"{s}_rows").cast("double"), F.lit(0.0)) for s in splits for k in names.values()]
    error = None
    for s in splits:
        wrong = F.col(f"{s}_rows") != F.col(f"{s}_dates")
        for k in names.values():
            wrong = wrong | (F.col(f"{s}_{k}_bad") > 0)
        error = wrong if error is None else error | wrong
    defined = None
    for s in splits:
        for k in names.values():
            ok = F.col(f"{s}_{k}").isNotNull()
            defined = ok if defined is None else defined & ok
    coverage = F.least(*[F.coalesce(x, F.lit(0.0)) for x in shares])
    keep = [f"{s}_{k}" for s in splits for k in (*names.values(), "rank_ic_tstat")]
    return cells.select(
        *CELL, *keep, coverage.alias("coverage"), error.alias("data_error"), (coverage > 0).alias("ready"), defined.alias("metric_defined")
    )


def classify_evidence(cells: DataFrame) -> DataFrame:
    """error, not_evaluable, supported, promising or unsupported, first rule wins.

    A stable negative direction passes like a positive one.  ``parent_rank_ic`` is optional.
    """
    if "parent_rank_ic" not in cells.columns:
        cells = cells.withColumn("parent_rank_ic", F.lit(None).cast("double"))
    train, obs = F.col("training_rank_ic"), F.col("observation_rank_ic")
    delta = F.abs((train + obs) / 2.0) - F.abs("parent_rank_ic")
    direction = F.when(train > 0, 1.0).otherwise(-1.0)
    same = train * obs > 0
    coherent = (
        (direction * F.col("training_ls") > 0)
        & (direction * F.col("observation_ls") > 0)
        & (direction * F.col("training_monotonicity") < 0)
        & (direction * F.col("observation_monotonicity") < 0)
    )
    large = F.least(F.abs(train), F.abs(obs)) >= MIN_RANK_IC
    resolved = (F.coalesce(F.abs("training_rank_ic_tstat"), F.lit(MIN_TSTAT)) >= MIN_TSTAT) & (
        F.coalesce(F.abs("observation_rank_ic_tstat"), F.lit(MIN_TSTAT)) >= MIN_TSTAT
    )
    supported = same & F.coalesce(coherent, F.lit(False)) & large & resolved & F.coalesce(delta > 0, F.lit(True))
    rules = [
        (F.col("data_error"), "error", "data_error"),
        (~F.col("ready"), "not_evaluable", "not_ready"),
        (~F.col("metric_defined"), "not_evaluable", "metric_undefined"),
        (F.coalesce(F.col("coverage"), F.lit(0.0)) < MIN_COVERAGE, "not_evaluable", "insufficient_coverage"),
        (train.isNull() | obs.isNull(), "not_evaluable", "rank_ic_undefined"),
        (supported, "supported", "split_stable_incremental_evidence"),
        (same, "promising", "split_sign_agrees_but_evidence_incomplete"),
    ]
    status = reason = None
    for cond, s, r in rules:
        status = F.when(cond, s) if status is None else status.when(cond, s)
        reason = F.when(cond, r) if reason is None else reason.when(cond, r)
    return cells.withColumns(
        {
            "parent_delta_rank_ic": delta,
            "status": status.otherwise("unsupported"),
            "reason": reason.otherwise("split_direction_does_not_replicate"),
        }
    )


def require_no_errors(classified: DataFrame) -> DataFrame:
    if classified.filter("status = 'error'").limit(1).count():
        raise ValueError("data_error cells block holdout selection")
    return classified


def _strength() -> Column:
    return F.abs(F.col("training_rank_ic") + F.col("observation_rank_ic"))


def selected_directions(classified: DataFrame) -> DataFrame:
    """Factors with a supported cell, and the sign of their strongest one."""
    total = F.col("training_rank_ic") + F.col("observation_rank_ic")
    order = F.struct(_strength(), -F.col("event"), "universe", "label")
    return classified.filter("status = 'supported'").groupBy("factor").agg(
        F.when(F.max_by(total, order) > 0, "positive").otherwise("negative").alias("direction"),
        F.count(F.lit(1)).alias("supported_cells"),
    )


def cell_directions(classified: DataFrame) -> DataFrame:
    """Sign of every cell of a selected factor; cells without a sign are left out."""
    chosen = classified.filter("status = 'supported'").select("factor").distinct()
    total = F.col("training_rank_ic") + F.col("observation_rank_ic")
    return (
        classified.join(chosen, "factor", "left_semi")
        .filter(total.isNotNull() & (total != 0))
        .select(*CELL, F.when(total > 0, "positive").otherwise("negative").alias("direction"))
    )


def best_events(classified: DataFrame) -> DataFrame:
    """Best supported event per factor, universe and label: strength, then parent gain, then the earliest."""
    order = F.struct(_strength(), F.coalesce("parent_delta_rank_ic", F.lit(float("-inf"))), -F.col("event"))
    return classified.filter("status = 'supported'").groupBy("factor", "universe", "label").agg(F.max_by("event", order).alias("best_event"))


def result_signature(panel: DataFrame, metrics: Sequence[str] = tuple(CORE)) -> DataFrame:
    """Order-free signature of a factor's whole metric panel: equal panels give equal rows.

    A 128-bit-wide sum of two independent row hashes plus the row count; it is combined map-side,
    so no panel is ever collected to be hashed.
    """
    keys = ["split", "date", "event", "universe", "label"]
    row = [F.col(c) for c in (*keys, *metrics)]
    filled = [F.coalesce(c.cast("string"), F.lit("~")) for c in row]
    return panel.groupBy("factor").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(*filled).cast("decimal(20,0)")).alias("h1"),
        F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *filled), 256), 1, 15), 16, 10).cast("decimal(20,0)")).alias("h2"),
    )


def redundancy(panel: DataFrame, manifest: DataFrame) -> DataFrame:
    """Factors in manifest order with the first factor that has the same results."""
    sig = result_signature(panel).join(manifest, "factor")
    first = sig.groupBy("rows", "h1", "h2").agg(F.min_by("factor", "position").alias("kept"))
    return sig.join(first, ["rows", "h1", "h2"]).select("factor", "position", "kept", (F.col("factor") == F.col("kept")).alias("retained"))
