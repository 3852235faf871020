"""Labels, universes, ranks, ICs, deciles and cross-section quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.fixtures import r6s
from tickloom.functions.scalar import finite, list_hash, r6
from tickloom.operators import crosssection as cs

P = f"WITH {fx.PANEL_SQL}"
FULL = f"WITH {fx.PANEL_SQL}, {fx.LABELS_SQL}, {fx.UNIVERSE_SQL}"
LABEL_COLUMNS = {"raw926": "v_1D_v_demean", "ease926": "v_1D_v_neuted"}
UNIVERSES = ["000985", "003800", "000906"]
GROUP = ["label", "universe", "date", "event", "factor"]


def rows(spark, sf_dir):
    members = cs.long_membership(fx.universe(spark, sf_dir), UNIVERSES).withColumn("symbol", F.col("symbol").cast("bigint"))
    return cs.evaluation_rows(
        fx.panel(spark, sf_dir), cs.long_labels(fx.labels(spark, sf_dir), LABEL_COLUMNS), members, fx.PANEL_FACTORS
    )


ROWS_SQL = f"""{FULL},
lp AS (SELECT symbol, date, event, 'fa' AS factor, CASE WHEN ready_fa THEN fa END AS x FROM panel
  UNION ALL SELECT symbol, date, event, 'fb', CASE WHEN ready_fb THEN fb END FROM panel
  UNION ALL SELECT symbol, date, event, 'fc', CASE WHEN ready_fc THEN fc END FROM panel),
ll AS (SELECT symbol, date, event, 'raw926' AS label, v_1D_v_demean AS y FROM labels_p WHERE v_1D_v_demean IS NOT NULL
  UNION ALL SELECT symbol, date, event, 'ease926', v_1D_v_neuted FROM labels_p WHERE v_1D_v_neuted IS NOT NULL),
ev AS (SELECT label, universe, date, event, factor, lp.symbol, x, y FROM lp JOIN ll USING (symbol, date, event) JOIN members m USING (symbol) WHERE m.tradable AND x IS NOT NULL)"""

_G = "label, universe, date, event, factor"
RANK_SQL = f"""rk AS (SELECT {_G}, x, y,
  rank() OVER (PARTITION BY {_G} ORDER BY x) + (count(*) OVER (PARTITION BY {_G}, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY {_G} ORDER BY y) + (count(*) OVER (PARTITION BY {_G}, y) - 1) / 2.0::DOUBLE AS ry FROM ev)"""
CORR = "CASE WHEN count(*) >= 2 AND stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"


@query(
    "information_coefficients",
    f"""{ROWS_SQL}, {RANK_SQL} SELECT {_G}, {r6s(CORR.format(x="x", y="y"))} AS ic, {r6s(CORR.format(x="rx", y="ry"))} AS rank_ic, count(*) AS pairs
FROM rk GROUP BY ALL""",
)
def information_coefficients(spark, sf_dir):
    """IC and RankIC of every factor, label, universe, date and event."""
    ic = cs.information_coefficients(rows(spark, sf_dir), GROUP)
    return ic.select(*GROUP, r6(F.col("IC")).alias("ic"), r6(F.col("RankIC")).alias("rank_ic"), "pairs")


BUCKET_SQL = f"""bk AS (SELECT {_G}, y, (rn * least(n, 10) - 1) // n AS bucket, least(n, 10) AS bucket_count FROM (
  SELECT {_G}, y, row_number() OVER (PARTITION BY {_G} ORDER BY x, symbol) AS rn, count(*) OVER (PARTITION BY {_G}) AS n FROM ev)),
gr AS (SELECT {_G}, bucket, avg(y) AS r, any_value(bucket_count) AS bucket_count FROM bk GROUP BY ALL)"""


@query(
    "quantile_group_returns",
    f"{ROWS_SQL}, {BUCKET_SQL} SELECT {_G}, CAST(bucket AS BIGINT) AS bucket, {r6s('r')} AS mean_return, CAST(bucket_count AS BIGINT) AS bucket_count FROM gr",
)
def quantile_group_returns(spark, sf_dir):
    """Mean label of every ascending quantile group."""
    g = cs.group_returns(rows(spark, sf_dir), GROUP)
    return g.select(*GROUP, "bucket", r6(F.col("mean_return")).alias("mean_return"), "bucket_count")


@query(
    "metric_panel",
    f"""{ROWS_SQL}, {RANK_SQL}, {BUCKET_SQL},
ic AS (SELECT {_G}, {CORR.format(x="x", y="y")} AS ic, {CORR.format(x="rx", y="ry")} AS ric FROM rk GROUP BY ALL),
dc AS (SELECT {_G}, {", ".join(f"max(r) FILTER (WHERE bucket_count - bucket = {i}) AS d{i}" for i in range(1, 11))},
  CASE WHEN count(*) >= 2 AND stddev_pop(r) > 0 THEN corr(bucket_count - bucket, r) END AS mono FROM gr GROUP BY ALL)
SELECT {_G}, {r6s("ic")} AS "IC", {r6s("ric")} AS "RankIC", {", ".join(f'{r6s(f"d{i}")} AS "D{i}"' for i in range(1, 11))},
  {r6s("d1 - d10")} AS "LS", {r6s("mono")} AS "Monotonicity" FROM ic JOIN dc USING (label, universe, date, event, factor)""",
)
def metric_panel(spark, sf_dir):
    """All fourteen metrics: deciles, long-short, monotonicity, IC and RankIC."""
    m = cs.metric_panel(rows(spark, sf_dir))
    names = ["IC", "RankIC", *[f"D{i}" for i in range(1, 11)], "LS", "Monotonicity"]
    return m.select(*GROUP, *[r6(F.col(c)).alias(c) for c in names])


@query(
    "label_join_coverage",
    f"""{FULL} SELECT p.date, p.event, count(*) AS cells, count(v_1D_v_demean) AS labelled, count(*) - count(v_1D_v_demean) AS dropped,
  {r6s("count(v_1D_v_demean) / count(*)")} AS coverage FROM panel p LEFT JOIN labels_p USING (symbol, date, event) GROUP BY p.date, p.event""",
)
def label_join_coverage(spark, sf_dir):
    """Factor cells with and without a label per date and event."""
    p = fx.panel(spark, sf_dir).join(fx.labels(spark, sf_dir), ["symbol", "date", "event"], "left")
    n, k = F.count(F.lit(1)), F.count("v_1D_v_demean")
    return p.groupBy("date", "event").agg(n.alias("cells"), k.alias("labelled"), (n - k).alias("dropped"), r6(k / n).alias("coverage"))


@query(
    "denominators",
    f"""{FULL}, ll AS (SELECT symbol, date, event, 'raw926' AS label, v_1D_v_demean AS y FROM labels_p UNION ALL SELECT symbol, date, event, 'ease926', v_1D_v_neuted FROM labels_p),
ex AS (SELECT universe, count(*) FILTER (WHERE NOT tradable) AS excluded FROM members GROUP BY universe),
g AS (SELECT d.date, d.event, u.universe, l.label FROM (SELECT DISTINCT date, event FROM labels_p) d, (SELECT DISTINCT universe FROM members) u, (SELECT DISTINCT label FROM ll) l),
h AS (SELECT ll.date, ll.event, m.universe, ll.label, count(*) AS n, 'sha256:' || sha256(string_agg(CAST(symbol AS VARCHAR), chr(10) ORDER BY CAST(symbol AS VARCHAR)) || chr(10)) AS hash
  FROM ll JOIN members m USING (symbol) WHERE m.tradable AND y IS NOT NULL GROUP BY ALL)
SELECT g.date, g.event, g.universe, g.label, coalesce(n, 0) AS symbol_count, coalesce(hash, 'sha256:' || sha256('')) AS symbols_hash, ex.excluded AS non_limit_exclusions
FROM g LEFT JOIN h USING (date, event, universe, label) JOIN ex USING (universe)""",
)
def denominators(spark, sf_dir):
    """Evaluable symbols of every date, event, universe and label, with their content hash."""
    u = fx.universe(spark, sf_dir)
    members = cs.long_membership(u, UNIVERSES).withColumn("symbol", F.col("symbol").cast("bigint"))
    lab = cs.long_labels(fx.labels(spark, sf_dir), LABEL_COLUMNS)
    hit = lab.join(members, "symbol").groupBy("date", "event", "universe", "label").agg(
        F.count(F.lit(1)).alias("symbol_count"), list_hash(F.col("symbol").cast("string")).alias("symbols_hash")
    )
    days = fx.labels(spark, sf_dir).select("date", "event").distinct()
    grid = days.withColumn("universe", F.explode(F.array(*map(F.lit, UNIVERSES)))).withColumn(
        "label", F.explode(F.array(*map(F.lit, LABEL_COLUMNS)))
    )
    barred = F.col("isdt1") + F.col("iszt1") != 0
    cells = F.array(*[F.struct(F.lit(n).alias("universe"), ((F.col(n) == 1) & barred).cast("int").alias("x")) for n in UNIVERSES])
    excluded = u.select(F.explode(cells).alias("c")).groupBy("c.universe").agg(F.sum("c.x").alias("non_limit_exclusions"))
    empty = F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256))
    return (
        grid.join(hit, ["date", "event", "universe", "label"], "left")
        .join(excluded, "universe")
        .select("date", "event", "universe", "label", F.coalesce("symbol_count", F.lit(0)).cast("bigint").alias("symbol_count"),
                F.coalesce("symbols_hash", empty).alias("symbols_hash"), "non_limit_exclusions")
    )


@query(
    "cross_section_stats",
    f"""{P}, lp AS (SELECT date, event, 'fa' AS factor, fa AS x, ready_fa AS ready FROM panel UNION ALL SELECT date, event, 'fb', fb, ready_fb FROM panel
  UNION ALL SELECT date, event, 'fc', fc, ready_fc FROM panel)
SELECT date, event, factor, count(*) AS symbols, count(x) AS finite, {r6s("stddev_samp(x)")} AS std, count(DISTINCT x) AS unique_count,
  {r6s("avg(CASE WHEN x <> 0 THEN 1 ELSE 0 END)")} AS nonzero_ratio, count(*) FILTER (WHERE ready) AS ready_count,
  count(*) FILTER (WHERE NOT ready) AS not_ready, count(*) FILTER (WHERE NOT ready AND x = 0) AS not_ready_zero FROM lp GROUP BY ALL""",
)
def cross_section_stats(spark, sf_dir):
    """Spread, distinct values and readiness of every cross section."""
    p = fx.panel(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x"), F.col(f"ready_{f}").alias("ready")) for f in fx.PANEL_FACTORS])
    long = p.select("date", "event", F.explode(cells).alias("c")).select("date", "event", "c.*")
    return long.groupBy("date", "event", "factor").agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(finite(F.col("x"))).alias("finite"),
        r6(F.stddev_samp("x")).alias("std"),
        F.count_distinct("x").alias("unique_count"),
        r6(F.avg(F.when(F.col("x") != 0, 1.0).otherwise(0.0))).alias("nonzero_ratio"),
        F.count_if("ready").alias("ready_count"),
        F.count_if(~F.col("ready")).alias("not_ready"),
        F.count_if(~F.col("ready") & (F.col("x") == 0)).alias("not_ready_zero"),
    )


@query(
    "dense_ranks",
    f"{P} SELECT date, event, symbol, dense_rank() OVER (PARTITION BY date, event ORDER BY fb) AS dense FROM panel",
)
def dense_ranks(spark, sf_dir):
    """Dense rank of a factor inside each cross section."""
    return cs.dense_rank(fx.panel(spark, sf_dir), ["date", "event"], "fb", "dense").select("date", "event", "symbol", "dense")


@query(
    "factor_value_spearman",
    f"""{P}, v AS (SELECT date, event, symbol, fa, CASE WHEN ready_fb THEN fb END AS fb, CASE WHEN ready_fc THEN fc END AS fc FROM panel),
r AS (SELECT date, event, {", ".join(f"CASE WHEN {f} IS NOT NULL THEN rank() OVER (PARTITION BY date, event ORDER BY {f} NULLS LAST) + (count(*) OVER (PARTITION BY date, event, {f}) - 1) / 2.0::DOUBLE END AS {f}" for f in ("fa", "fb", "fc"))} FROM v),
p AS (SELECT date, event, 'fa' AS a, 'fb' AS b, fa AS x, fb AS y FROM r UNION ALL SELECT date, event, 'fa', 'fc', fa, fc FROM r UNION ALL SELECT date, event, 'fb', 'fc', fb, fc FROM r),
c AS (SELECT date, event, a, b, {CORR.format(x="x", y="y")} AS rho FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT a, b, {r6s("avg(rho)")} AS spearman_mean, count(rho) AS observations FROM c GROUP BY a, b""",
)
def factor_value_spearman(spark, sf_dir):
    """Mean cross-sectional Spearman of every factor pair."""
    rho = cs.factor_correlations(fx.panel(spark, sf_dir), fx.PANEL_FACTORS)
    return rho.groupBy("a", "b").agg(r6(F.avg("rho")).alias("spearman_mean"), F.count("rho").alias("observations"))


@query(
    "winsorised_exposure",
    f"""{P}, o AS (SELECT date, event, symbol, fb, row_number() OVER (PARTITION BY date, event ORDER BY fb) AS rn, count(*) OVER (PARTITION BY date, event) AS n FROM panel),
e AS (SELECT date, event, max(fb) FILTER (WHERE rn = CAST(floor(n * 0.05::DOUBLE) AS BIGINT) + 1) AS lo, max(fb) FILTER (WHERE rn = n - CAST(floor(n * 0.05::DOUBLE) AS BIGINT)) AS hi FROM o GROUP BY ALL),
a AS (SELECT date, event, symbol, fb, lo, hi, least(greatest(fb, lo), hi) AS v FROM o JOIN e USING (date, event)),
b AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM a WINDOW w AS (PARTITION BY date, event)),
c AS (SELECT *, least(greatest(v, m - 2 * s), m + 2 * s) AS v2 FROM b),
d AS (SELECT *, avg(v2) OVER w AS m2, stddev_pop(v2) OVER w AS s2 FROM c WINDOW w AS (PARTITION BY date, event))
SELECT date, event, symbol, {r6s("CASE WHEN lo = hi THEN fb ELSE (v2 - m2) / (CASE WHEN s2 = 0 THEN 1 ELSE s2 END) END")} AS exposure FROM d""",
)
def winsorised_exposure(spark, sf_dir):
    """Two-step outlier clipping and standardisation per cross section."""
    w = cs.winsorise(fx.panel(spark, sf_dir), ["date", "event"], "fb", "exposure", cut=0.05, k=2.0)
    return w.select("date", "event", "symbol", r6(F.col("exposure")).alias("exposure"))
