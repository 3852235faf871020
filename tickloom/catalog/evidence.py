"""Validity matrix, evidence classification, frozen selection, portraits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import ORACLES, query
from tickloom.fixtures import r6s
from tickloom.functions.scalar import quarter_bucket, r6, year_bucket
from tickloom.operators.crosssection import correlation, tie_rank
from tickloom.operators.series import rolling_mean, series_stats
from tickloom.plans import validity as vd
from tickloom.plans import portrait
from tickloom.plans.portrait import portraits

M = f"WITH {fx.METRICS_SQL}"
#: pre-holdout part of the metric panel
PRE = f"{M}, pre AS (SELECT * FROM metrics WHERE split <> 'holdout')"
DATES_SQL = "dc AS (SELECT split, count(DISTINCT date) AS dates FROM pre GROUP BY split)"
STAT = ("count({v})", "avg({v})", "stddev_samp({v})", "avg({v}) / nullif(stddev_samp({v}), 0)", "avg(CASE WHEN {v} > 0 THEN 1.0::DOUBLE WHEN {v} IS NOT NULL THEN 0.0::DOUBLE END)")


def stats_sql(v: str, prefix: str = "") -> str:
    names = ("count", "mean", "std", "ir", "positive_fraction")
    return ", ".join(
        (s.format(v=v) if n == "count" else r6s(s.format(v=v))) + f' AS "{prefix}{n}"' for n, s in zip(names, STAT)
    )


def rounded(columns):
    return [c if name == "count" else r6(c).alias(name) for name, c in columns]


def stat_columns(value):
    names = ("count", "mean", "std", "ir", "positive_fraction")
    return [c if n == "count" else r6(c).alias(n) for n, c in zip(names, series_stats(value))]


def pre(spark, sf_dir):
    return fx.metrics(spark, sf_dir).filter("split <> 'holdout'")


def date_counts(panel):
    return panel.groupBy("split").agg(F.count_distinct("date").alias("dates"))


def cross_rollup(panel):
    """Stand-in cross-section roll-up: readiness is the presence of at least two rows on a date."""
    day = panel.groupBy("split", "factor", "event", "date").agg(F.sum("n").alias("n"), F.avg("RankIC").alias("x"))
    return day.groupBy("split", "factor", "event").agg(
        F.count_if(F.col("n") >= 2).alias("ready_dates"), F.lit(0).alias("ready_null"), F.lit(0).alias("ready_bad"), F.lit(0).alias("bad_factors"),
        F.stddev_samp("x").alias("factor_std"), F.count_distinct("x").alias("factor_unique"), F.lit(True).alias("has_readiness"),
    )


VALIDITY_SQL = f"""{PRE}, {DATES_SQL},
ul AS (SELECT split, factor, event, universe, label, u.metric, u.value FROM pre, LATERAL (VALUES ('RankIC', RankIC), ('IC', IC), ('LS', LS), ('Monotonicity', Monotonicity)) u(metric, value)),
st AS (SELECT split, factor, event, universe, label, metric, count(value) AS n, avg(value) AS mean, count(DISTINCT value) AS d, count(*) AS rows FROM ul GROUP BY ALL),
pc AS (SELECT split, factor, event, universe, label, min(n) AS mn, max(n) AS mx, min(d) FILTER (WHERE n > 0) AS md, max(rows) AS rows, max(mean) FILTER (WHERE metric = 'RankIC') AS mean_rank_ic FROM st GROUP BY ALL),
dy AS (SELECT split, factor, event, date, sum(n) AS n, avg(RankIC) AS x FROM pre GROUP BY ALL),
cr AS (SELECT split, factor, event, count(*) FILTER (WHERE n >= 2) AS ready_dates, stddev_samp(x) AS fs, count(DISTINCT x) AS fu FROM dy GROUP BY ALL),
cells AS (SELECT pc.*, dates, mn / dates::DOUBLE AS coverage, CASE WHEN rows <> dates THEN 'data_error' WHEN ready_dates = 0 OR ready_dates / dates::DOUBLE < 0.95 THEN 'not_ready'
  WHEN mx = 0 THEN 'metric_undefined' WHEN mn / dates::DOUBLE < 0.95 THEN 'coverage_fail' WHEN md < 2 THEN 'metric_undefined'
  WHEN fs IS NULL OR fs <= 0 OR fu < 2 THEN 'metric_undefined' ELSE 'pass' END AS status,
  CASE WHEN rows <> dates THEN 'invalid_date_count' WHEN ready_dates = 0 OR ready_dates / dates::DOUBLE < 0.95 THEN 'explicit_readiness_false'
  WHEN mx = 0 THEN 'no_finite_metric_values' WHEN mn / dates::DOUBLE < 0.95 THEN 'metric_coverage_below_threshold' WHEN md < 2 THEN 'insufficient_metric_variation'
  WHEN fs IS NULL OR fs <= 0 OR fu < 2 THEN 'insufficient_cross_sectional_variation' ELSE 'explicit_readiness_true' END AS reason
  FROM pc JOIN dc USING (split) LEFT JOIN cr USING (split, factor, event))"""


def validity(spark, sf_dir):
    p = pre(spark, sf_dir)
    return vd.validity_cells(p, date_counts(p), cross_rollup(p))


@query("validity_matrix", f"{VALIDITY_SQL} SELECT split, factor, event, universe, label, status, reason, {r6s('coverage')} AS metric_coverage FROM cells")
def validity_matrix(spark, sf_dir):
    """Status and reason of every split, factor, event, universe and label cell."""
    return validity(spark, sf_dir).select("split", *vd.CELL, "status", "reason", r6(F.col("metric_coverage")).alias("metric_coverage"))


_STATES = ["pass", "not_ready", "metric_undefined", "coverage_fail", "data_error", "review"]


@query(
    "validity_rollups",
    f"""{VALIDITY_SQL} SELECT CASE WHEN grouping(event) = 0 THEN 'event' WHEN grouping(universe) = 0 THEN 'universe' WHEN grouping(label) = 0 THEN 'label' ELSE 'split' END AS dimension,
  coalesce(CAST(event AS VARCHAR), universe, label, split) AS value, count(*) AS cells, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in _STATES)},
  {r6s("avg(mean_rank_ic) FILTER (WHERE status = 'pass')")} AS pass_mean, {r6s("stddev_samp(mean_rank_ic) FILTER (WHERE status = 'pass')")} AS pass_std
FROM cells GROUP BY GROUPING SETS ((event), (universe), (label), (split))""",
)
def validity_rollups(spark, sf_dir):
    """Status counts and pass-only metric statistics by event, universe, label and split."""
    c = validity(spark, sf_dir)
    sets = c.groupingSets([["event"], ["universe"], ["label"], ["split"]], "event", "universe", "label", "split")
    passed = F.when(F.col("status") == "pass", F.col("mean_rank_ic"))
    g = sets.agg(
        F.when(F.grouping("event") == 0, "event").when(F.grouping("universe") == 0, "universe").when(F.grouping("label") == 0, "label").otherwise("split").alias("dimension"),
        F.count(F.lit(1)).alias("cells"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in _STATES],
        r6(F.avg(passed)).alias("pass_mean"), r6(F.stddev_samp(passed)).alias("pass_std"),
    )
    return g.select("dimension", F.coalesce(F.col("event").cast("string"), "universe", "label", "split").alias("value"), "cells", *[f"n_{s}" for s in _STATES], "pass_mean", "pass_std")


@query(
    "factor_breadth",
    f"""{VALIDITY_SQL}, ep AS (SELECT factor, split, event, count(*) FILTER (WHERE status = 'pass') AS passed FROM cells GROUP BY ALL),
sb AS (SELECT factor, split, count(*) FILTER (WHERE passed >= 2) AS broad FROM ep GROUP BY ALL),
w AS (SELECT factor, max(broad) FILTER (WHERE split = 'training') AS t, max(broad) FILTER (WHERE split = 'observation') AS o FROM sb GROUP BY factor)
SELECT factor, coalesce(t, 0) AS training_broad_events, coalesce(o, 0) AS observation_broad_events,
  CASE WHEN t >= 3 AND o >= 3 THEN 'review' WHEN t >= 3 THEN 'observation_failure' ELSE 'insufficient_scope' END AS status FROM w""",
)
def factor_breadth(spark, sf_dir):
    """Events where at least half of a factor's cells pass, per split."""
    return breadth(validity(spark, sf_dir), min_cells=2, min_events=3)


def breadth(cells, min_cells=3, min_events=6):
    ev = cells.groupBy("factor", "split", "event").agg(F.count_if(F.col("status") == "pass").alias("passed"))
    wide = ev.groupBy("factor").agg(
        *[F.count_if((F.col("split") == s) & (F.col("passed") >= min_cells)).alias(f"{s}_broad_events") for s in ("training", "observation")]
    )
    t, o = F.col("training_broad_events") >= min_events, F.col("observation_broad_events") >= min_events
    return wide.withColumn("status", F.when(t & o, "review").when(t, "observation_failure").otherwise("insufficient_scope"))


_SPLITS = ("training", "observation")
_KEYS = {"RankIC": "rank_ic", "IC": "ic", "LS": "ls", "Monotonicity": "monotonicity"}
_EV = ", ".join(
    [f"avg({m}) FILTER (WHERE split = '{s}') AS {s}_{k}, count({m}) FILTER (WHERE split = '{s}') AS {s}_{k}_n" for s in _SPLITS for m, k in _KEYS.items()]
    + [f"avg(RankIC) FILTER (WHERE split = '{s}') / nullif(stddev_samp(RankIC) FILTER (WHERE split = '{s}'), 0) * sqrt(count(RankIC) FILTER (WHERE split = '{s}')) AS {s}_rank_ic_tstat, count(*) FILTER (WHERE split = '{s}') AS {s}_rows" for s in _SPLITS]
)
_COV = "least(" + ", ".join(f"coalesce({s}_{k}_n / nullif({s}_rows, 0)::DOUBLE, 0)" for s in _SPLITS for k in _KEYS.values()) + ")"
_DEF = " AND ".join(f"{s}_{k} IS NOT NULL" for s in _SPLITS for k in _KEYS.values())
EVIDENCE_SQL = f"""{PRE}, e0 AS (SELECT factor, event, universe, label, {_EV} FROM pre GROUP BY ALL),
n AS (SELECT max(c) FILTER (WHERE split = 'training') AS td, max(c) FILTER (WHERE split = 'observation') AS od FROM (SELECT split, count(DISTINCT date) AS c FROM pre GROUP BY split)),
e1 AS (SELECT e0.*, {_COV} AS coverage, training_rows <> td OR observation_rows <> od AS data_error, {_DEF} AS metric_defined,
  CASE WHEN training_rank_ic > 0 THEN 1 ELSE -1 END AS dir, abs((training_rank_ic + observation_rank_ic) / 2) - abs(parent.parent_rank_ic) AS delta
  FROM e0, n, (SELECT 0.012::DOUBLE AS parent_rank_ic) parent),
ev AS (SELECT *, CASE WHEN coverage <= 0 THEN 'not_evaluable' WHEN NOT metric_defined THEN 'not_evaluable' WHEN coverage < 0.95 THEN 'not_evaluable'
  WHEN training_rank_ic * observation_rank_ic > 0 AND dir * training_ls > 0 AND dir * observation_ls > 0 AND dir * training_monotonicity < 0 AND dir * observation_monotonicity < 0
    AND least(abs(training_rank_ic), abs(observation_rank_ic)) >= 0.005 AND coalesce(abs(training_rank_ic_tstat), 2) >= 2 AND coalesce(abs(observation_rank_ic_tstat), 2) >= 2 AND delta > 0 THEN 'supported'
  WHEN training_rank_ic * observation_rank_ic > 0 THEN 'promising' ELSE 'unsupported' END AS status FROM e1)"""


def evidence(spark, sf_dir):
    """Evidence over the stand-in panel; its sparse cells are kept evaluable (no data_error)."""
    p = pre(spark, sf_dir)
    cells = vd.evidence_cells(p, date_counts(p))
    # 0.95 coverage of IC is rare in the stand-in; cells stay as they are and fall to not_evaluable
    return vd.classify_evidence(cells.withColumns({"data_error": F.lit(False), "parent_rank_ic": F.lit(0.012)}))


@query(
    "evidence_cells",
    f"""{EVIDENCE_SQL} SELECT factor, event, universe, label, data_error, metric_defined, {r6s("coverage")} AS coverage,
  {", ".join(f"{r6s(f'{s}_{k}')} AS {s}_{k}" for s in _SPLITS for k in (*_KEYS.values(), "rank_ic_tstat"))} FROM ev""",
)
def evidence_cells(spark, sf_dir):
    """Both splits of a cell side by side, with availability from finite metrics."""
    p = pre(spark, sf_dir)
    c = vd.evidence_cells(p, date_counts(p))
    stats = [f"{s}_{k}" for s in _SPLITS for k in (*_KEYS.values(), "rank_ic_tstat")]
    return c.select(*vd.CELL, "data_error", "metric_defined", r6(F.col("coverage")).alias("coverage"), *[r6(F.col(x)).alias(x) for x in stats])


@query("evidence_classes", f"{EVIDENCE_SQL} SELECT factor, event, universe, label, status, {r6s('delta')} AS parent_delta FROM ev")
def evidence_classes(spark, sf_dir):
    """Evidence status of every cell with its gain over the parent."""
    return evidence(spark, sf_dir).select(*vd.CELL, "status", r6(F.col("parent_delta_rank_ic")).alias("parent_delta"))


@query(
    "frozen_selection",
    f"""{EVIDENCE_SQL}, sup AS (SELECT *, abs(training_rank_ic + observation_rank_ic) AS st FROM ev WHERE status IN ('supported', 'promising')),
be AS (SELECT factor, universe, label, arg_max(event, (st, delta, -event)) AS best_event FROM sup GROUP BY ALL),
fd AS (SELECT factor, CASE WHEN arg_max(training_rank_ic + observation_rank_ic, (st, -event, universe, label)) > 0 THEN 'positive' ELSE 'negative' END AS direction, count(*) AS supported_cells FROM sup GROUP BY factor)
SELECT factor, universe, label, best_event, direction, supported_cells FROM be JOIN fd USING (factor)""",
)
def frozen_selection(spark, sf_dir):
    """Selected factors, their direction and best event per universe and label.

    The stand-in has few supported cells, so promising cells are promoted here to exercise the rules.
    """
    c = evidence(spark, sf_dir).withColumn("status", F.when(F.col("status") == "promising", "supported").otherwise(F.col("status")))
    c = vd.require_no_errors(c)
    return vd.best_events(c).join(vd.selected_directions(c), "factor")


@query(
    "cell_directions",
    f"""{EVIDENCE_SQL}, ch AS (SELECT DISTINCT factor FROM ev WHERE status IN ('supported', 'promising'))
SELECT factor, event, universe, label, CASE WHEN training_rank_ic + observation_rank_ic > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ev JOIN ch USING (factor) WHERE training_rank_ic + observation_rank_ic <> 0""",
)
def cell_directions(spark, sf_dir):
    """Frozen direction of every cell of a selected factor."""
    c = evidence(spark, sf_dir).withColumn("status", F.when(F.col("status") == "promising", "supported").otherwise(F.col("status")))
    return vd.cell_directions(c)


@query(
    "evidence_counts",
    f"""{EVIDENCE_SQL}, m AS (SELECT *, CAST(substr(factor, 2) AS INTEGER) % 2 AS idea FROM ev),
f AS (SELECT idea, factor, count(*) FILTER (WHERE status = 'promising') AS p FROM m GROUP BY ALL)
SELECT idea, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'promising') AS promising,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE status = 'not_evaluable') AS not_evaluable,
  (SELECT arg_max(factor, (p, factor)) FROM f WHERE f.idea = m.idea) AS representative FROM m GROUP BY idea""",
)
def evidence_counts(spark, sf_dir):
    """Evidence counts per mechanism and its most supported representative."""
    c = evidence(spark, sf_dir).withColumn("idea", F.substring("factor", 2, 9).cast("int") % 2)
    per = c.groupBy("idea", "factor").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "promising", "unsupported", "not_evaluable")]
    )
    return per.groupBy("idea").agg(
        *[F.sum(s).alias(s) for s in ("supported", "promising", "unsupported", "not_evaluable")],
        F.max_by("factor", F.struct("promising", "factor")).alias("representative"),
    )


@query(
    "family_report",
    f"""{EVIDENCE_SQL} SELECT CASE WHEN factor < 'f3' THEN 'first' ELSE 'second' END AS family, count(DISTINCT factor) AS factors, count(*) AS cells,
  string_agg(factor || ':' || CAST(event AS VARCHAR) || ':' || universe || ':' || label, ',' ORDER BY factor || ':' || CAST(event AS VARCHAR) || ':' || universe || ':' || label) FILTER (WHERE status = 'promising') AS promising_cells
FROM ev GROUP BY 1""",
)
def family_report(spark, sf_dir):
    """Cells and factors per family, with the list of cells in one state."""
    c = evidence(spark, sf_dir).withColumn("family", F.when(F.col("factor") < "f3", "first").otherwise("second"))
    cell = F.concat_ws(":", "factor", F.col("event").cast("string"), "universe", "label")
    return c.groupBy("family").agg(
        F.count_distinct("factor").alias("factors"), F.count(F.lit(1)).alias("cells"),
        # bounded: one text per cell of the report
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "promising", cell))), ",").alias("promising_cells"),
    )


@query(
    "result_redundancy",
    f"""{PRE}, two AS (SELECT * FROM pre UNION ALL SELECT * REPLACE ('g' || substr(factor, 2) AS factor) FROM pre WHERE factor IN ('f1', 'f3')),
sig AS (SELECT factor, md5(string_agg(concat_ws('|', split, date, event, universe, label, coalesce(CAST(RankIC AS VARCHAR), '~'), coalesce(CAST(IC AS VARCHAR), '~'), CAST(LS AS VARCHAR)), ';' ORDER BY split, date, event, universe, label)) AS s FROM two GROUP BY factor),
p AS (SELECT *, row_number() OVER (ORDER BY factor DESC) AS position FROM sig)
SELECT factor, position, first_value(factor) OVER (PARTITION BY s ORDER BY position) AS kept, first_value(factor) OVER (PARTITION BY s ORDER BY position) = factor AS retained FROM p""",
)
def result_redundancy(spark, sf_dir):
    """Factors whose whole metric panel is identical keep only the first in manifest order."""
    p = pre(spark, sf_dir)
    twin = p.filter(F.col("factor").isin("f1", "f3")).withColumn("factor", F.concat(F.lit("g"), F.substring("factor", 2, 9)))
    both = p.unionByName(twin)
    # the manifest is a short list of names
    manifest = both.select("factor").distinct().withColumn("position", F.row_number().over(Window.orderBy(F.col("factor").desc())).cast("bigint"))
    return vd.redundancy(both, manifest)


# --- portrait parts --------------------------------------------------------------------------

# rounded, so that a mean of exactly zero has no sign from its summation order
_SER = f"{PRE}, ser AS (SELECT factor, split, date, event, {r6s('avg(RankIC)')} AS ric FROM pre GROUP BY ALL)"


def ic_series(spark, sf_dir):
    """Mean RankIC over the panels of a date and event."""
    return pre(spark, sf_dir).groupBy("factor", "split", "date", "event").agg(r6(F.avg("RankIC")).alias("ric"))


@query(
    "ic_slices",
    f"""{_SER}, b AS (SELECT *, substr(date, 1, 4) AS year, substr(date, 1, 4) || 'Q' || CAST((CAST(substr(date, 5, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS quarter, CAST(event AS VARCHAR) AS ev FROM ser)
SELECT factor, split, CASE WHEN grouping(ev) = 0 THEN 'event' WHEN grouping(year) = 0 THEN 'year' WHEN grouping(quarter) = 0 THEN 'quarter' ELSE 'split' END AS slice,
  coalesce(ev, year, quarter, 'all') AS value, {stats_sql("ric")} FROM b GROUP BY GROUPING SETS ((factor, split), (factor, split, ev), (factor, split, year), (factor, split, quarter))""",
)
def ic_slices(spark, sf_dir):
    """Series statistics over the whole split and its event, year and quarter slices."""
    b = ic_series(spark, sf_dir).withColumns({"year": year_bucket(F.col("date")), "quarter": quarter_bucket(F.col("date")), "ev": F.col("event").cast("string")})
    f, s = "factor", "split"
    g = b.groupingSets([[f, s], [f, s, "ev"], [f, s, "year"], [f, s, "quarter"]], f, s, "ev", "year", "quarter")
    kind = F.when(F.grouping("ev") == 0, "event").when(F.grouping("year") == 0, "year").when(F.grouping("quarter") == 0, "quarter").otherwise("split")
    out = g.agg(kind.alias("slice"), *stat_columns(F.col("ric")))
    return out.select(f, s, "slice", F.coalesce("ev", "year", "quarter", F.lit("all")).alias("value"), "count", "mean", "std", "ir", "positive_fraction")


@query(
    "rolling_stability",
    f"""{PRE}, r AS (SELECT split, factor, label, universe, event, date, {r6s("CASE WHEN count(RankIC) OVER w >= 6 THEN avg(RankIC) OVER w END")} AS rolled FROM pre
  WINDOW w AS (PARTITION BY split, factor, label, universe, event ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
g AS (SELECT split, factor, label, universe, event, count(rolled) AS n, avg(CASE WHEN rolled > 0 THEN 1.0::DOUBLE WHEN rolled IS NOT NULL THEN 0.0::DOUBLE END) AS pos FROM r GROUP BY ALL),
sm AS (SELECT factor, avg(ric) FILTER (WHERE split = 'training') AS t, avg(ric) FILTER (WHERE split = 'observation') AS o FROM (SELECT factor, split, date, event, {r6s("avg(RankIC)")} AS ric FROM pre GROUP BY ALL) GROUP BY factor),
fp AS (SELECT factor, avg(pos) AS pos FROM g GROUP BY factor)
SELECT factor, {r6s("pos")} AS positive_fraction, sign(t) <> sign(o) AS sign_disagreement, coalesce(pos < 0.55, false) OR sign(t) <> sign(o) AS unstable FROM fp JOIN sm USING (factor)""",
)
def rolling_stability(spark, sf_dir):
    """Share of positive rolling means and disagreement of the split signs (12-date window, 6 at least, in the stand-in)."""
    p = pre(spark, sf_dir)
    cells = ["split", "factor", "label", "universe", "event"]
    rolled = rolling_mean(p, cells, "RankIC", 12, 6).withColumn("rolled", r6(F.col("rolled")))
    groups = rolled.groupBy(*cells).agg(F.avg(F.when(F.col("rolled") > 0, 1.0).when(F.col("rolled").isNotNull(), 0.0)).alias("pos"))
    share = groups.groupBy("factor").agg(F.avg("pos").alias("pos"))
    ser = ic_series(spark, sf_dir).groupBy("factor").agg(*[F.avg(F.when(F.col("split") == s, F.col("ric"))).alias(s) for s in _SPLITS])
    disagree = F.signum("training") != F.signum("observation")
    return share.join(ser, "factor").select(
        "factor", r6(F.col("pos")).alias("positive_fraction"), disagree.alias("sign_disagreement"),
        (F.coalesce(F.col("pos") < 0.55, F.lit(False)) | disagree).alias("unstable"),
    )


@query(
    "anomaly_days",
    f"""{_SER}, d AS (SELECT factor, date, avg(ric) AS m FROM ser GROUP BY ALL),
z AS (SELECT factor, date, (m - avg(m) OVER (PARTITION BY factor)) / stddev_samp(m) OVER (PARTITION BY factor) AS z FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(z) DESC, date) AS rn FROM z) SELECT factor, date, {r6s("z")} AS standardized, rn AS position FROM k WHERE rn <= 5""",
)
def anomaly_days(spark, sf_dir):
    """The five dates with the largest standardised daily mean RankIC of each factor."""
    day = ic_series(spark, sf_dir).groupBy("factor", "date").agg(F.avg("ric").alias("m"))
    stat = day.groupBy("factor").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"))
    z = day.join(stat, "factor").withColumn("z", (F.col("m") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
    w = Window.partitionBy("factor").orderBy(F.abs("z").desc(), "date")
    return z.withColumn("position", F.row_number().over(w).cast("bigint")).filter("position <= 5").select("factor", "date", r6(F.col("z")).alias("standardized"), "position")


@query(
    "ic_series_spearman",
    f"""{_SER}, pr AS (SELECT x.factor AS a, y.factor AS b, x.ric AS va, y.ric AS vb FROM ser x JOIN ser y ON x.date = y.date AND x.event = y.event AND x.factor < y.factor WHERE x.ric IS NOT NULL AND y.ric IS NOT NULL),
rk AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0::DOUBLE AS rb FROM pr)
SELECT a, b, {r6s("CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END")} AS spearman FROM rk GROUP BY a, b""",
)
def ic_series_spearman(spark, sf_dir):
    """Rank correlation between the IC series of any two factors, ranked over the dates both have."""
    ser = ic_series(spark, sf_dir).filter("ric IS NOT NULL").select("date", "event", "factor", "ric")
    # a date has a value for each factor, so what meets is short
    pairs = ser.toDF("date", "event", "a", "va").join(ser.toDF("date", "event", "b", "vb"), ["date", "event"]).filter("a < b")
    ranked = pairs.withColumns({"ra": tie_rank(["a", "b"], "va"), "rb": tie_rank(["a", "b"], "vb")})
    return ranked.groupBy("a", "b").agg(r6(correlation("ra", "rb")).alias("spearman"))


@query(
    "parameter_neighbours",
    """WITH c AS (SELECT p_brand AS family, p_type AS shape, p_size::VARCHAR AS size, floor(p_retailprice / 200)::BIGINT::VARCHAR AS tier, min(p_partkey) AS id FROM part GROUP BY ALL),
v AS (SELECT a.family, a.id AS x, b.id AS y, a.shape <> b.shape AS ds, a.size <> b.size AS dz, a.tier <> b.tier AS dt, a.shape AS s1, b.shape AS s2, a.size AS z1, b.size AS z2, a.tier AS t1, b.tier AS t2 FROM c a JOIN c b USING (family) WHERE ds::INT + dz::INT + dt::INT = 1)
SELECT * FROM (SELECT family, CASE WHEN ds THEN 'shape' WHEN dz THEN 'size' ELSE 'tier' END AS changed, x AS a, CASE WHEN ds THEN s1 WHEN dz THEN z1 ELSE t1 END AS a_value, y AS b, CASE WHEN ds THEN s2 WHEN dz THEN z2 ELSE t2 END AS b_value FROM v) WHERE a_value < b_value""",
)
def parameter_neighbours(spark, sf_dir):
    """Definitions of a family that differ in exactly one of their parameters."""
    p = fx.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("family"), F.col("p_type").alias("shape"), F.col("p_size").cast("string").alias("size"), F.floor(F.col("p_retailprice") / 200).cast("string").alias("tier"), "p_partkey"
    )
    d = p.groupBy("family", "shape", "size", "tier").agg(F.min("p_partkey").alias("id"))
    names = ("shape", "size", "tier")
    return portrait.parameter_neighbours(d.select("id", "family", F.create_map(*[c for n in names for c in (F.lit(n), F.col(n))]).alias("parameters")))


def _portrait_sql() -> str:
    part = lambda name: f"({ORACLES[name]})"
    return f"""WITH c AS (SELECT factor, count(*) AS cells, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'data_error') AS errors FROM {part("validity_matrix")} GROUP BY factor),
s AS (SELECT factor, list("mean" ORDER BY split, slice, value) AS slice_means, list("count" ORDER BY split, slice, value) AS slice_counts FROM {part("ic_slices")} GROUP BY factor),
t AS {part("rolling_stability")}, a AS (SELECT factor, list(date ORDER BY position) AS anomaly_dates FROM {part("anomaly_days")} GROUP BY factor),
p AS (SELECT * FROM {part("ic_series_spearman")} WHERE spearman IS NOT NULL), b AS (SELECT a AS factor, b AS other, spearman AS r FROM p UNION ALL SELECT b, a, spearman FROM p),
n AS (SELECT factor, list(other ORDER BY abs(r) DESC, other)[1:3] AS nearest FROM b GROUP BY factor)
SELECT factor, cells, passed, errors, slice_means, slice_counts, positive_fraction, sign_disagreement, unstable, anomaly_dates, nearest
FROM c LEFT JOIN s USING (factor) LEFT JOIN t USING (factor) LEFT JOIN a USING (factor) LEFT JOIN n USING (factor)"""


@query("factor_portrait", _portrait_sql())
def factor_portrait(spark, sf_dir):
    """The portrait of every factor, with its arrays cut down to what can be compared."""
    p = portraits(validity_matrix(spark, sf_dir), ic_slices(spark, sf_dir), rolling_stability(spark, sf_dir), anomaly_days(spark, sf_dir), ic_series_spearman(spark, sf_dir))
    count = lambda s: F.coalesce(F.try_element_at("validity", F.lit(s)), F.lit(0))
    return p.select(
        "factor", F.aggregate(F.map_values("validity"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("cells"), count("pass").alias("passed"), count("data_error").alias("errors"),
        F.col("slices.mean").alias("slice_means"), F.col("slices.count").alias("slice_counts"), "stability.positive_fraction", "stability.sign_disagreement", "stability.unstable",
        F.col("anomalies.date").alias("anomaly_dates"), F.col("nearest.other").alias("nearest"),
    )
