"""Panel conversion, contracts, comparison and roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.catalog.evidence import stat_columns, stats_sql
from tickloom.fixtures import r6s
from tickloom.functions.scalar import r6
from tickloom.sources import panels as pn

P = f"WITH {fx.PANEL_SQL}"
M = f"WITH {fx.METRICS_SQL}"
FACTORS = fx.PANEL_FACTORS
_LP = ", ".join(f"('{f}', {f}, ready_{f}, reason_{f})" for f in FACTORS)
LONG = f"lp AS (SELECT symbol, date, event, u.factor, u.x, u.ready, u.reason FROM panel, LATERAL (VALUES {_LP}) u(factor, x, ready, reason))"


@query(
    "panel_publish",
    f"""{P} SELECT symbol, date, CASE WHEN event = 92700000 THEN 92600000 ELSE event END AS event, {", ".join(f"{r6s(f)} AS {f}" for f in FACTORS)},
  {", ".join(f"ready_{f}" for f in FACTORS)}, {", ".join(f"reason_{f}" for f in FACTORS)} FROM panel""",
)
def panel_publish(spark, sf_dir):
    """Published panel with completed masks and reasons."""
    p = pn.publish(fx.panel(spark, sf_dir), FACTORS)
    return p.select("symbol", "date", "event", *[r6(F.col(f)).alias(f) for f in FACTORS], *[f"ready_{f}" for f in FACTORS], *[F.col(f"reason_{f}").cast("int").alias(f"reason_{f}") for f in FACTORS])


@query(
    "factor_only_view",
    f"""{P} SELECT date, event, count(*) AS rows, {", ".join(f"count(*) FILTER (WHERE NOT ready_{f}) AS nan_{f}, count(*) FILTER (WHERE ready_{f} AND {f} = 0) AS zero_{f}" for f in FACTORS)} FROM panel
WHERE event <> 143000000 GROUP BY date, event""",
)
def factor_only_view(spark, sf_dir):
    """Not-ready values become NaN, true zeros stay; only the saved checkpoints are kept."""
    saved = [e for e in fx.EVENTS if e != 143_000_000]
    v = pn.save_times(pn.selected_export(pn.evaluator_view(fx.panel(spark, sf_dir)), FACTORS, FACTORS), saved)
    counts = [c for f in FACTORS for c in (F.count_if(F.isnan(f)).alias(f"nan_{f}"), F.count_if(F.col(f) == 0).alias(f"zero_{f}"))]
    return v.groupBy("date", "event").agg(F.count(F.lit(1)).alias("rows"), *counts)


@query(
    "panel_shape",
    f"""{P}, d AS (SELECT date, count(DISTINCT symbol) AS date_symbols FROM panel GROUP BY date)
SELECT p.date, p.event, count(*) AS rows, count(DISTINCT symbol) AS symbols, date_symbols, count(*) = count(DISTINCT symbol) AND count(DISTINCT symbol) = date_symbols AS complete
FROM panel p JOIN d USING (date) GROUP BY p.date, p.event, date_symbols""",
)
def panel_shape(spark, sf_dir):
    """Row and symbol counts per event against the date."""
    return pn.event_shape(fx.panel(spark, sf_dir))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    """Keys that are not unique."""
    return pn.duplicate_keys(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "mask_violations",
    f"""{P}, bad AS (SELECT * REPLACE (CASE WHEN symbol % 7 = 0 THEN NULL ELSE fa END AS fa, CASE WHEN symbol % 5 = 0 THEN 3 ELSE reason_fb END AS reason_fb) FROM panel),
lb AS (SELECT date, u.factor, u.x, u.ready, u.reason FROM bad, LATERAL (VALUES {_LP}) u(factor, x, ready, reason))
SELECT date, factor, count(*) FILTER (WHERE ready AND x IS NULL) AS ready_not_finite, count(*) FILTER (WHERE ready <> (reason = 0)) AS reason_mismatch,
  count(*) FILTER (WHERE ready IS NULL) AS mask_null FROM lb GROUP BY date, factor""",
)
def mask_violations(spark, sf_dir):
    """Cells that break ready => finite or reason <=> mask, on a panel damaged on purpose."""
    p = fx.panel(spark, sf_dir).withColumns(
        {
            "fa": F.when(F.col("symbol") % 7 == 0, None).otherwise(F.col("fa")),
            "reason_fb": F.when(F.col("symbol") % 5 == 0, F.lit(3)).otherwise(F.col("reason_fb")),
        }
    )
    return pn.mask_violations(p, FACTORS)


@query(
    "event_set_contract",
    f"""{P}, want AS (SELECT DISTINCT date, e.event FROM panel, (VALUES {", ".join(f"({e})" for e in fx.EVENTS)}) e(event)), have AS (SELECT DISTINCT date, event FROM panel)
SELECT date, event, 'missing' AS side FROM (SELECT * FROM want EXCEPT SELECT * FROM have) UNION ALL SELECT date, event, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM want)""",
)
def event_set_contract(spark, sf_dir):
    """Checkpoints missing from, or not expected in, each date."""
    have = fx.panel(spark, sf_dir).select("date", "event").distinct()
    want = have.select("date").distinct().withColumn("event", F.explode(F.array(*[F.lit(e).cast("bigint") for e in fx.EVENTS])))
    return pn.key_differences(want, have, ["date", "event"])


@query(
    "calendar_intersection",
    """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE)::VARCHAR FROM lineitem""",
)
def calendar_intersection(spark, sf_dir):
    """Dates present in both calendars."""
    a = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("date"))
    b = fx.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("date"))
    return a.intersect(b)


@query(
    "matrix_completeness",
    f"""{M}, d AS (SELECT DISTINCT split, date FROM metrics), f AS (SELECT DISTINCT factor FROM metrics), c AS (SELECT DISTINCT universe, label, event FROM metrics)
SELECT d.split, d.date, f.factor, c.event, c.universe, c.label FROM d, f, c EXCEPT SELECT split, date, factor, event, universe, label FROM metrics""",
)
def matrix_completeness(spark, sf_dir):
    """Cells of the complete matrix that have no metric row; the names are those in the data."""
    m = fx.metrics(spark, sf_dir)
    grid = m.select("split", "date").distinct()
    for name in ("factor", "universe", "label", "event"):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, pn.names_of(m, name)))))
    keys = ["split", "date", "factor", "event", "universe", "label"]
    return grid.join(m.select(*keys), keys, "left_anti").select(*keys)


_METRICS = ("IC", "RankIC", "LS", "Monotonicity")


@query(
    "metric_coverage_gate",
    f"""{M}, c AS (SELECT split, factor, universe, label, {", ".join(f"count(*) FILTER (isfinite({m})) / count(*) AS {m.lower()}" for m in _METRICS)}, CAST({" + ".join(f"count(*) FILTER (NOT isfinite({m}))" for m in _METRICS)} AS BIGINT) AS non_finite FROM metrics GROUP BY ALL)
SELECT split, factor, universe, label, {", ".join(f"{r6s(m.lower())} AS coverage_{m}" for m in _METRICS)}, non_finite, least({", ".join(m.lower() for m in _METRICS)}) < 0.95 AS below_gate FROM c""",
)
def metric_coverage_gate(spark, sf_dir):
    """Share of rows that have each metric, against the 95 % gate, and values that are not finite."""
    keys = ["split", "factor", "universe", "label"]
    c = pn.metric_coverage(fx.metrics(spark, sf_dir), keys, _METRICS)
    return c.select(*keys, *[r6(F.col(f"coverage_{m}")).alias(f"coverage_{m}") for m in _METRICS], "non_finite", "below_gate")


@query(
    "metric_wide_long",
    f"""{M}, k AS (SELECT DISTINCT date, event, universe, label FROM metrics), f AS (SELECT DISTINCT factor FROM metrics),
l AS (SELECT date, event, universe, label, factor, u.metric, u.value FROM metrics, LATERAL (VALUES ('RankIC', RankIC), ('IC', IC), ('LS', LS), ('Monotonicity', Monotonicity)) u(metric, value))
SELECT k.date, k.event, k.universe, k.label, f.factor, n.metric, {r6s("l.value")} AS value FROM k, f, (VALUES ('RankIC'), ('IC'), ('LS'), ('Monotonicity')) n(metric)
LEFT JOIN l ON l.date = k.date AND l.event = k.event AND l.universe = k.universe AND l.label = k.label AND l.factor = f.factor AND l.metric = n.metric""",
)
def metric_wide_long(spark, sf_dir):
    """Metric panel to ``factor|metric`` columns and back."""
    keys = ["date", "event", "universe", "label"]
    m = fx.metrics(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in fx.CORE])
    long = m.select(*keys, "factor", F.explode(cells).alias("c")).select(*keys, "factor", "c.*")
    back = pn.wide_to_long(pn.long_to_wide(long, keys, pn.names_of(m, "factor"), fx.CORE), keys)
    return back.withColumn("value", r6(F.col("value")))


_Q = f"""{P}, {LONG}, q AS (SELECT date, event, factor, count(*) AS row_count, count(x) FILTER (WHERE ready) AS finite_count, count(*) FILTER (WHERE ready) AS ready_count,
  count(*) FILTER (WHERE NOT ready AND x = 0) AS not_ready_zero_count, count(*) FILTER (WHERE ready AND x = 0) AS zero_count,
  count(x) FILTER (WHERE ready) / count(*)::DOUBLE AS coverage, stddev_pop(x) FILTER (WHERE ready) AS std, count(DISTINCT x) FILTER (WHERE ready) AS uq,
  coalesce(avg(CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE ready), 0) AS nz FROM lp GROUP BY ALL),
r AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.8 THEN 'post_warmup_coverage_below_threshold' END, CASE WHEN finite_count >= 2 AND uq = 1 THEN 'constant_column' END,
  CASE WHEN std IS NULL OR std < 0.05 THEN 'cross_section_std_below_threshold' END, CASE WHEN uq < 2 THEN 'cross_section_unique_count_below_threshold' END,
  CASE WHEN nz < 0.5 THEN 'cross_section_nonzero_ratio_below_threshold' END, CASE WHEN uq < 2 THEN 'cross_section_effective_rank_count_below_threshold' END) AS reasons FROM q)"""


def quality(spark, sf_dir):
    return pn.column_quality(fx.panel(spark, sf_dir), FACTORS, ["date", "event"], min_std=0.05, min_nonzero=0.5)


@query(
    "column_quality",
    f"""{_Q} SELECT date, event, factor, row_count, finite_count, ready_count, not_ready_zero_count, zero_count, {r6s("coverage")} AS coverage, {r6s("std")} AS cross_section_std,
  uq AS unique_count, {r6s("nz")} AS nonzero_ratio, reasons AS reject_reasons, CASE WHEN reasons = '' THEN 'technical_pass' ELSE 'technical_reject' END AS status FROM r""",
)
def column_quality(spark, sf_dir):
    """Technical acceptance of every column of every checkpoint with its reject reasons."""
    q = quality(spark, sf_dir)
    plain = ["date", "event", "factor", "row_count", "finite_count", "ready_count", "not_ready_zero_count", "zero_count", "unique_count", "status"]
    return q.select(*plain, F.array_join("reject_reasons", ",").alias("reject_reasons"), *[r6(F.col(c)).alias(c) for c in ("coverage", "cross_section_std", "nonzero_ratio")])


@query("directory_acceptance", f"{_Q} SELECT date, bool_and(reasons = '') AS accepted, count(*) FILTER (WHERE reasons <> '') AS rejected_columns FROM r GROUP BY date")
def directory_acceptance(spark, sf_dir):
    """A date is accepted when all its columns and checkpoints pass."""
    return pn.acceptance(quality(spark, sf_dir), ["date"])


@query(
    "readiness_census",
    f"{P}, {LONG} SELECT event, factor, reason, count(*) AS cells FROM lp GROUP BY ALL",
)
def readiness_census(spark, sf_dir):
    """Cells by event, factor and readiness reason."""
    p = fx.panel(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"reason_{f}").cast("int").alias("reason")) for f in FACTORS])
    return p.select("event", F.explode(cells).alias("c")).groupBy("event", "c.factor", "c.reason").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "cross_section_rollup",
    f"""{P}, {LONG}, d AS (SELECT date, event, factor, count(*) AS symbols, stddev_samp(x) AS std, count(DISTINCT x) AS uq, avg(CASE WHEN x <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS nz,
  count(*) FILTER (WHERE ready) AS rc FROM lp GROUP BY ALL)
SELECT event, factor, count(*) AS dates, {r6s("avg(symbols)")} AS symbols_mean, {r6s("avg(std)")} AS std_mean, {r6s("min(std)")} AS std_min, min(uq) AS unique_min, {r6s("avg(nz)")} AS nonzero_mean, CAST(sum(rc) AS BIGINT) AS ready_count
FROM d GROUP BY ALL""",
)
def cross_section_rollup(spark, sf_dir):
    """Date-level cross-section statistics rolled up per factor and event."""
    p = fx.panel(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x"), F.col(f"ready_{f}").alias("ready")) for f in FACTORS])
    long = p.select("date", "event", F.explode(cells).alias("c")).select("date", "event", "c.*")
    d = long.groupBy("date", "event", "factor").agg(
        F.count(F.lit(1)).alias("symbols"), F.stddev_samp("x").alias("std"), F.count_distinct("x").alias("uq"),
        F.avg(F.when(F.col("x") != 0, 1.0).otherwise(0.0)).alias("nz"), F.count_if("ready").alias("rc"),
    )
    return d.groupBy("event", "factor").agg(
        F.count(F.lit(1)).alias("dates"), r6(F.avg("symbols")).alias("symbols_mean"), r6(F.avg("std")).alias("std_mean"), r6(F.min("std")).alias("std_min"),
        F.min("uq").alias("unique_min"), r6(F.avg("nz")).alias("nonzero_mean"), F.sum("rc").alias("ready_count"),
    )


_HIST = "hist AS (SELECT symbol, date, event, CASE WHEN symbol % 9 = 0 THEN fa + 0.5 ELSE fa END AS fa, fb, CASE WHEN symbol % 4 = 0 THEN NULL ELSE fc END AS fc FROM panel WHERE symbol % 13 <> 0)"


def history(spark, sf_dir):
    return fx.panel(spark, sf_dir).filter("symbol % 13 <> 0").withColumns(
        {"fa": F.when(F.col("symbol") % 9 == 0, F.col("fa") + 0.5).otherwise(F.col("fa")), "fc": F.when(F.col("symbol") % 4 != 0, F.col("fc"))}
    )


def _pairs_sql(on: str) -> str:
    cells = ", ".join(f"('{f}', p.{f}, h.{f})" for f in FACTORS)
    return f"""j AS (SELECT coalesce(p.event, h.event) AS event, p.symbol IS NOT NULL AND h.symbol IS NOT NULL AS paired, u.factor, u.a, u.b
  FROM panel p FULL JOIN hist h USING (symbol, date, event), LATERAL (VALUES {cells}) u(factor, a, b))"""


@query(
    "reproduction_check",
    f"""{P}, {_HIST}, {_pairs_sql("")} SELECT event, factor, count(*) FILTER (WHERE paired) AS pairs, count(*) FILTER (WHERE NOT paired) AS unmatched, {r6s("max(abs(a - b))")} AS max_abs_error,
  {r6s("avg(abs(a - b))")} AS mean_abs_error, {r6s("avg(CASE WHEN paired THEN CASE WHEN a IS NOT DISTINCT FROM b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END)")} AS exact_equal_fraction,
  bool_and(paired AND coalesce(abs(a - b) <= 1e-12 + 1e-12 * abs(b), a IS NOT DISTINCT FROM b)) AS passed FROM j GROUP BY ALL""",
)
def reproduction_check(spark, sf_dir):
    """Current panel against a historical one: errors, exact share and tolerance verdict."""
    r = pn.reproduction(fx.panel(spark, sf_dir), history(spark, sf_dir), FACTORS)
    return r.select("event", "factor", "pairs", "unmatched", "passed", *[r6(F.col(c)).alias(c) for c in ("max_abs_error", "mean_abs_error", "exact_equal_fraction")])


@query(
    "two_run_comparison",
    f"""{P}, {_HIST}, k AS (SELECT date, event, symbol, p.fa AS pa, h.fa AS ha, p.fb AS pb, h.fb AS hb, p.fc AS pc, h.fc AS hc, p.n IS NOT NULL AS inp, h.hit IS NOT NULL AS inh FROM panel p FULL JOIN (SELECT *, 1 AS hit FROM hist) h USING (symbol, date, event))
SELECT date, event, count(*) FILTER (WHERE inp AND NOT inh) AS only_first, count(*) FILTER (WHERE inh AND NOT inp) AS only_second,
  count(*) FILTER (WHERE inp AND inh AND pa IS DISTINCT FROM ha) AS unequal_fa, count(*) FILTER (WHERE inp AND inh AND pb IS DISTINCT FROM hb) AS unequal_fb, count(*) FILTER (WHERE inp AND inh AND pc IS DISTINCT FROM hc) AS unequal_fc FROM k GROUP BY date, event""",
)
def two_run_comparison(spark, sf_dir):
    """Rows on one side only and unequal values per column of two runs."""
    a = fx.panel(spark, sf_dir).select(*pn.KEYS, *[F.col(f).alias(f"a_{f}") for f in FACTORS], F.lit(True).alias("in_a"))
    b = history(spark, sf_dir).select(*pn.KEYS, *[F.col(f).alias(f"b_{f}") for f in FACTORS], F.lit(True).alias("in_b"))
    j = a.join(b, pn.KEYS, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return j.groupBy("date", "event").agg(
        F.count_if(F.col("in_b").isNull()).alias("only_first"), F.count_if(F.col("in_a").isNull()).alias("only_second"),
        *[F.count_if(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"unequal_{f}") for f in ("fa", "fb", "fc")],
    )


@query(
    "inventory_join",
    """WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders), f AS (SELECT DISTINCT CAST(l_shipdate AS DATE)::VARCHAR AS date FROM lineitem),
l AS (SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS date FROM (SELECT ts - INTERVAL 28 YEAR AS ts FROM events))
SELECT r.date, CASE WHEN f.date IS NULL THEN 'factor_missing' WHEN l.date IS NULL THEN 'label_missing' ELSE 'ready' END AS status FROM r LEFT JOIN f USING (date) LEFT JOIN l USING (date)""",
)
def inventory_join(spark, sf_dir):
    """Requested dates against the factor and the label inventory."""
    day = lambda t, c: fx.table(spark, sf_dir, t).select(F.expr(c).cast("date").cast("string").alias("date"))
    r = day("orders", "o_orderdate").distinct()
    f = fx.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("date")).distinct().withColumn("f", F.lit(1))
    lab = day("events", "ts - INTERVAL 28 YEAR").distinct().withColumn("l", F.lit(1))
    status = F.when(F.col("f").isNull(), "factor_missing").when(F.col("l").isNull(), "label_missing").otherwise("ready")
    return r.join(f, "date", "left").join(lab, "date", "left").select("date", status.alias("status"))


@query(
    "previous_trading_day",
    """WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders), i AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM c)
SELECT a.date, b.date AS previous, z.date AS fifth_before FROM i a LEFT JOIN i b ON b.idx = a.idx - 1 LEFT JOIN i z ON z.idx = a.idx - 5""",
)
def previous_trading_day(spark, sf_dir):
    """n-th trading day before each date of the calendar."""
    from tickloom.sources.daily import calendar_index, nth_before

    cal = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("date")).distinct()
    idx = calendar_index(cal)
    return nth_before(nth_before(idx, idx, 1, "previous"), idx, 5, "fifth_before").select("date", "previous", "fifth_before")


@query(
    "incremental_dates",
    """WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS date FROM orders), f AS (SELECT CAST(l_shipdate AS DATE)::VARCHAR AS date, count(*) >= 20 AS valid FROM lineitem GROUP BY 1)
SELECT date FROM r WHERE date NOT IN (SELECT date FROM f WHERE valid)""",
)
def incremental_dates(spark, sf_dir):
    """Requested dates whose finished output does not exist or fails its contract."""
    r = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("date")).distinct()
    f = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("date")).agg((F.count(F.lit(1)) >= 20).alias("valid"))
    return pn.missing_dates(r, f)


@query(
    "factor_observation",
    f"""{M} SELECT factor, label, universe, count(*) AS observation_count, {", ".join(f"{r6s(f'avg({m})')} AS mean_{k}" for m, k in (("RankIC", "rank_ic"), ("IC", "ic"), ("LS", "long_short"), ("Monotonicity", "monotonicity")))},
  {r6s("avg(CASE WHEN RankIC > 0 THEN 1.0::DOUBLE WHEN RankIC IS NOT NULL THEN 0.0::DOUBLE END)")} AS rank_ic_positive_fraction, {r6s("avg(CASE WHEN IC > 0 THEN 1.0::DOUBLE WHEN IC IS NOT NULL THEN 0.0::DOUBLE END)")} AS ic_positive_fraction
FROM metrics GROUP BY ALL""",
)
def factor_observation(spark, sf_dir):
    """Multi-day means and positive shares per factor, label and universe."""
    pos = lambda c: F.avg(F.when(F.col(c) > 0, 1.0).when(F.col(c).isNotNull(), 0.0))
    names = {"RankIC": "rank_ic", "IC": "ic", "LS": "long_short", "Monotonicity": "monotonicity"}
    return fx.metrics(spark, sf_dir).groupBy("factor", "label", "universe").agg(
        F.count(F.lit(1)).alias("observation_count"), *[r6(F.avg(m)).alias(f"mean_{k}") for m, k in names.items()],
        r6(pos("RankIC")).alias("rank_ic_positive_fraction"), r6(pos("IC")).alias("ic_positive_fraction"),
    )


@query(
    "scorecard",
    f"""{M}, s AS (SELECT date, label, universe, factor, count(*) AS event_count, count(RankIC) AS rank_ic_count, avg(RankIC) AS a, avg(IC) AS b, avg(LS) AS c, avg(Monotonicity) AS d FROM metrics GROUP BY ALL),
f AS (SELECT date, label, universe, count(*) AS factor_count FROM s GROUP BY ALL)
SELECT date, label, universe, factor, event_count, rank_ic_count, {r6s("a")} AS mean_rank_ic, {r6s("b")} AS mean_ic, {r6s("c")} AS mean_long_short, {r6s("d")} AS mean_monotonicity, factor_count FROM s JOIN f USING (date, label, universe)""",
)
def scorecard(spark, sf_dir):
    """Single-date scorecard of every label, universe and factor, with the factor count of the combination; an incomplete matrix is refused."""
    m = fx.metrics(spark, sf_dir)
    m = pn.require_complete(m, pn.names_of(m, "label"), pn.names_of(m, "universe"))
    s = m.groupBy("date", "label", "universe", "factor").agg(
        F.count(F.lit(1)).alias("event_count"), F.count("RankIC").alias("rank_ic_count"),
        *[r6(F.avg(c)).alias(f"mean_{k}") for c, k in {"RankIC": "rank_ic", "IC": "ic", "LS": "long_short", "Monotonicity": "monotonicity"}.items()],
    )
    n = s.groupBy("date", "label", "universe").agg(F.count(F.lit(1)).alias("factor_count"))
    return s.join(n, ["date", "label", "universe"])


@query(
    "metric_statistics",
    f"""{M} SELECT split, label, universe, factor, u.metric, {stats_sql("u.value")} FROM metrics, LATERAL (VALUES ('RankIC', RankIC), ('IC', IC), ('LS', LS), ('Monotonicity', Monotonicity)) u(metric, value) GROUP BY ALL""",
)
def metric_statistics(spark, sf_dir):
    """Statistics of every metric of every panel."""
    from tickloom.plans.validity import unpivot_metrics

    keys = ["split", "label", "universe", "factor"]
    return unpivot_metrics(fx.metrics(spark, sf_dir), fx.CORE, keys).groupBy(*keys, "metric").agg(*stat_columns(F.col("value")))


@query(
    "last_wins",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def last_wins(spark, sf_dir):
    """One row per key: the last one in file order wins."""
    from tickloom.operators.sequence import last_rows

    li = fx.table(spark, sf_dir, "lineitem")
    return last_rows(li, ["l_orderkey", "l_linenumber"], 1, order=["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "training_vs_observation",
    f"""{M} SELECT factor, event, universe, label, {r6s("avg(RankIC) FILTER (WHERE split = 'training')")} AS training, {r6s("avg(RankIC) FILTER (WHERE split = 'observation')")} AS observation FROM metrics WHERE split <> 'holdout' GROUP BY ALL""",
)
def training_vs_observation(spark, sf_dir):
    """Both splits of a cell side by side by pivot."""
    p = fx.metrics(spark, sf_dir).filter("split <> 'holdout'").groupBy("factor", "event", "universe", "label").pivot("split", ["training", "observation"]).agg(F.avg("RankIC"))
    return p.select("factor", "event", "universe", "label", r6(F.col("training")).alias("training"), r6(F.col("observation")).alias("observation"))
