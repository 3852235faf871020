"""Factor families at market-wide checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import fixtures as fx
from tickloom.catalog import query
from tickloom.functions.scalar import r6
from tickloom.operators.cuts import market_cuts
from tickloom.plans import event_families as ev
from tickloom.plans.registry import FAMILIES, KEYS

W = f"WITH {fx.MARKET_SQL}"


def cuts_of(streams):
    return market_cuts(streams.present())


def family_query(name):
    def run(spark, sf_dir):
        s = fx.streams(spark, sf_dir)
        family = FAMILIES[name]
        panel = family.build(s, cuts_of(s))
        cols = [r6(F.col(c)).alias(c) for c in family.columns]
        reasons = [F.col(f"reason_{c}").cast("int").alias(f"reason_{c}") for c in family.columns]
        return panel.select(*KEYS, *cols, *reasons)

    return run


def reason_sql(name: str, ready: str) -> str:
    return f"CASE WHEN {ready} THEN 0 ELSE 255 END AS reason_{name}"


_LAST_TRADES = """,
valid AS (SELECT *, CASE bsflag WHEN 'B' THEN volume ELSE -volume END AS v FROM trades
  WHERE trade_type <> 'C' AND volume > 0 AND bsflag IN ('B', 'S') AND price > 0),
seen AS (SELECT t.date, t.symbol, c.event, t.v, t.price,
    row_number() OVER (PARTITION BY t.date, t.symbol, c.event ORDER BY t.local_us DESC, t.exch_ms DESC, t.channel DESC, t.serial DESC) AS rn
  FROM valid t JOIN cuts c ON t.date = c.date AND (t.local_us, t.exch_ms, t.channel, t.serial) < c.cut)"""


def _flow_sql(name, kind, w, lag, hl):
    f = f"FILTER (WHERE rn > {lag} AND rn <= {lag + w})"
    if kind == "ratio":
        val = f"sum(v) {f} / nullif(sum(abs(v)) {f}, 0)::DOUBLE"
    elif kind == "zscore":
        var = f"greatest(0.0, sum(v::DOUBLE * v) {f} / nullif(count(v) {f}, 0) - pow(avg(v::DOUBLE) {f}, 2))"
        den = f"sqrt({var}) * sqrt({w}::DOUBLE)"
        val = f"CASE WHEN {den} > 1e-12 THEN sum(v) {f} / ({den}) END"
    else:
        wt = f"pow(2.0, -(rn - 1 - {lag}) / {hl}::DOUBLE)"
        val = f"sum({wt} * v) {f} / nullif(sum({wt} * abs(v)) {f}, 0)"
    return f"{fx.r6s(f'coalesce({val}, 0)')} AS {name}"


FLOW_SQL = (
    W
    + _LAST_TRADES
    + "\nSELECT date, symbol, event, "
    + ", ".join([_flow_sql(*r) for r in ev.FLOW] + [reason_sql(r[0], "true") for r in ev.FLOW])
    + " FROM seen GROUP BY date, symbol, event"
)
query("flow_pressure_family", FLOW_SQL)(family_query("flow_pressure"))


def _impact_sql(name, kind, w, lag):
    f = f"FILTER (WHERE rn > {lag} AND rn <= {lag + w})"
    last, first = f"arg_min(price, rn) {f}", f"arg_max(price, rn) {f}"
    mid = f"greatest(1.0, 0.5 * ({first} + {last}))"
    move = f"(({last} - {first}) / ({mid}))"
    net, size = f"sum(v) {f}", f"sum(abs(v)) {f}"
    val = {
        "impact": f"{move} * ({net} / greatest({size}, 1.0)::DOUBLE)",
        "mid": f"{move} * ({net} / greatest({size} * {mid}, 1.0)::DOUBLE)",
        "ofi": f"CASE WHEN abs({net} / greatest({size}, 1.0)::DOUBLE) > 1e-12 THEN {move} / ({net} / greatest({size}, 1.0)::DOUBLE) END",
        "absorption": f"({net} / greatest({size}, 1.0)::DOUBLE) * (1.0 - abs({last} - {first}) / ({mid}))",
    }[kind]
    body = f"coalesce(CASE WHEN count(v) {f} >= 2 THEN {val} END, 0)"
    return f"{fx.r6s(body)} AS {name}"


IMPACT_SQL = (
    W
    + _LAST_TRADES
    + "\nSELECT date, symbol, event, "
    + ", ".join(
        [_impact_sql(*r) for r in ev.IMPACT]
        + [reason_sql(r[0], "count(*) >= 2" + ("" if r[1] == "absorption" else " AND event <> 92700000")) for r in ev.IMPACT]
    )
    + " FROM seen WHERE rn <= 130 GROUP BY date, symbol, event"
)
query("impact_efficiency_family", IMPACT_SQL)(family_query("impact_efficiency"))

_LATEST_QUOTE = """,
qseen AS (SELECT q.*, c.event,
    count(*) OVER (PARTITION BY q.date, q.symbol, c.event) AS n_quotes,
    row_number() OVER (PARTITION BY q.date, q.symbol, c.event ORDER BY q.local_us DESC, q.exch_ms DESC, q.channel DESC, q.serial DESC) AS rn
  FROM quotes q JOIN cuts c ON q.date = c.date AND (q.local_us, q.exch_ms, q.channel, q.serial) < c.cut)"""


def depth_sql(p, v, variant):
    terms = [
        f"(CASE WHEN {v}[{i + 1}] > 0 AND {p}[{i + 1}] > 0 THEN {v}[{i + 1}]::DOUBLE / {float(i + 1)}::DOUBLE"
        + (f" * ({p}[{i + 1}] / 10000.0::DOUBLE)" if variant % 2 else "")
        + " ELSE 0 END)"
        for i in range(min(10, 2 + 2 * variant))
    ]
    return "(" + " + ".join(terms) + ")"


def imbalance_sql(variant):
    b, a = depth_sql("bp", "bv", variant), depth_sql("ap", "av", variant)
    return f"(CASE WHEN {b} + {a} > 0 THEN ({b} - {a}) / ({b} + {a}) ELSE 0 END)"


MICRO_SQL = (
    "(CASE WHEN bv[1] >= 0 AND av[1] >= 0 AND ap[1] > bp[1] AND bv[1] + av[1] > 0 THEN "
    "((ap[1] * bv[1] + bp[1] * av[1]) / (bv[1] + av[1])::DOUBLE - 0.5 * (bp[1] + ap[1])) / (ap[1] - bp[1])::DOUBLE END)"
)


def spread_sql(variant):
    ref = "greatest(1.0, 0.5 * (bp[1] + ap[1]) * 0.001)::DOUBLE"
    return f"(CASE WHEN ap[1] - bp[1] >= 0 THEN {imbalance_sql(variant)} / (1.0 + greatest(0.0, (ap[1] - bp[1]) / {ref} - 1.0)) END)"


def _book_sql(name, kind, w, variant, lag, op):
    raw = {"depth": imbalance_sql(variant), "micro": MICRO_SQL, "spread": spread_sql(variant)}[kind]
    signal = f"(greatest(-8.0::DOUBLE, least(8.0::DOUBLE, {raw})) * {1.0 + 0.25 * variant}::DOUBLE / {1.0 + lag}::DOUBLE)"
    norm = f"greatest(1e-6, least(1.0::DOUBLE, greatest(n_quotes, 1) / {w}::DOUBLE) / {w}::DOUBLE)"
    body = f"CASE WHEN {raw} IS NULL THEN 0 ELSE {signal} {op} {norm} END"
    return f"{fx.r6s(body)} AS {name}"


_TOUCH_OK = "bp[1] > 0 AND ap[1] > bp[1]"
BOOK_SQL = (
    W
    + _LATEST_QUOTE
    + "\nSELECT date, symbol, event, "
    + ", ".join([_book_sql(*r) for r in ev.BOOK] + [reason_sql(r[0], _TOUCH_OK) for r in ev.BOOK])
    + " FROM qseen WHERE rn = 1"
)
query("book_imbalance_family", BOOK_SQL)(family_query("book_imbalance"))


def _resilience_sql(table):
    names = [r[0] for r in table]

    def arr(level, w, lag):
        size = f"len({level})"
        return f"list_slice({level}, greatest({size} - {lag} - {w} + 1, 1), {size} - {lag})"

    def recovery(level, w, lag):
        a = arr(level, w, lag)
        return f"greatest(0.0, least(1.0, list_extract({a}, -1) / nullif(list_max({a}), 0)))"

    def value(kind, level, w, lag):
        size = f"len({level})"
        if kind == "recovery":
            v = recovery(level, w, lag)
        else:
            v = f"sp_{level}_{w}_{lag}"
        return f"CASE WHEN ok AND coalesce({size}, 0) >= {w + lag} THEN {v} END"

    # shock search: for each interior position i, the running maximum before it is a window maximum
    speeds = sorted({(lv, w, lag) for _, k, lv, w, lag in table if k == "speed"})
    ctes = []
    for lv, w, lag in speeds:
        ctes.append(f"""
p_{lv}_{w}_{lag} AS (
  SELECT date, symbol, event, rn - {lag} AS r, {lv} AS x,
    max({lv}) OVER (PARTITION BY date, symbol, event ORDER BY rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak
  FROM dseen WHERE rn > {lag} AND rn <= {lag + w}),
s_{lv}_{w}_{lag} AS (
  SELECT date, symbol, event,
    arg_min((x, peak, r), (x, -r)) FILTER (WHERE r > 1 AND peak > 0 AND x < peak * 0.8) AS low,
    arg_min(x, r) AS last_x
  FROM p_{lv}_{w}_{lag} GROUP BY date, symbol, event),
v_{lv}_{w}_{lag} AS (
  SELECT date, symbol, event, CASE WHEN low IS NOT NULL AND last_x - low[1] > 0 AND low[2] - low[1] > 0
    THEN (last_x - low[1]) / (low[2] - low[1]) / (low[3] - 1)::DOUBLE END AS sp_{lv}_{w}_{lag}
  FROM s_{lv}_{w}_{lag})""")

    def liq(levels):
        vol = " + ".join(f"bv[{i}] + av[{i}]" for i in range(1, levels + 1))
        ref = "greatest(1.0, 0.5 * (bp[1] + ap[1]) * 0.001)::DOUBLE"
        return f"(CASE WHEN bp[1] > 0 AND ap[1] > bp[1] THEN ({vol})::DOUBLE / (1.0 + (ap[1] - bp[1]) / {ref}) ELSE 0 END)"

    joins = " ".join(f"LEFT JOIN v_{lv}_{w}_{lag} USING (date, symbol, event)" for lv, w, lag in speeds)
    cols = ", ".join(
        f"{fx.r6s(value(*r[1:]))} AS {r[0]}, CASE WHEN ({value(*r[1:])}) IS NULL THEN 255 ELSE 0 END AS reason_{r[0]}" for r in table
    )
    return f"""{W},
dq AS (SELECT date, symbol, local_us, exch_ms, channel, serial, {liq(1)} AS l1, {liq(5)} AS l5 FROM quotes),
dcur AS (SELECT q.date, q.symbol, c.event,
    row_number() OVER (PARTITION BY q.date, q.symbol, c.event ORDER BY q.local_us DESC, q.exch_ms DESC, q.channel DESC, q.serial DESC) AS rn, l1 > 0 AS ok
  FROM dq q JOIN cuts c ON q.date = c.date AND (q.local_us, q.exch_ms, q.channel, q.serial) < c.cut),
dseen AS (SELECT q.date, q.symbol, c.event,
    row_number() OVER (PARTITION BY q.date, q.symbol, c.event ORDER BY q.local_us DESC, q.exch_ms DESC, q.channel DESC, q.serial DESC) AS rn, l1, l5
  FROM dq q JOIN cuts c ON q.date = c.date AND (q.local_us, q.exch_ms, q.channel, q.serial) < c.cut WHERE l1 > 0),
arrs AS (SELECT date, symbol, event, list(l1 ORDER BY rn DESC) AS l1, list(l5 ORDER BY rn DESC) AS l5
  FROM dseen WHERE rn <= 130 GROUP BY date, symbol, event),{",".join(ctes)},
cur AS (SELECT date, symbol, event, ok FROM dcur WHERE rn = 1)
SELECT date, symbol, event, {cols}
FROM cur LEFT JOIN arrs USING (date, symbol, event) {joins}"""


query("liquidity_resilience_family", _resilience_sql(ev.RESILIENCE))(family_query("liquidity_resilience"))
query("liquidity_resilience_v2_family", _resilience_sql(ev.RESILIENCE_V2))(family_query("liquidity_resilience_v2"))
