"""Series statistics of one symbol-day, evaluated at checkpoints wherever a checkpoint is all that is read.

Exponential averages are geometric sums, so they are plain aggregates once a row knows its
position; the frames that must see every row (gaps, runs, big events) use the block and chunk
operators of ``sequence``.  A block operator reads its input twice, so where one follows another the
result in between is written to the checkpoint folder instead of being computed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import moments
from tickloom.functions.scalar import marketable, touch_distance
from tickloom.operators.cuts import as_of_quote, assign_segment, last_at_cuts, window_at_cuts
from tickloom.operators.sequence import BLOCK_US, carry_forward, crowded, frame, islands, last_rows, number_rows, overlapping_chunks, previous, running
from tickloom.schema import ORDER_KEY, STOCK_DAY
from tickloom.session import cut_lineage

KEYS = [*STOCK_DAY, "event"]
#: positions that are discounted together
RUN = 256


def decayed_sums_at_cuts(events: DataFrame, cuts: DataFrame, value: str, ratios: dict[str, float]) -> DataFrame:
    """``n``, ``x1``, ``x2``, ``xn`` and, per ratio r, ``sum r^(n - i) x_i`` over the events seen at each checkpoint.

    ``events`` carry their position ``seq``. Runs of ``RUN`` positions of a segment are summed relative to the run's end, which
    their number tells; runs are discounted to the segment's end and the few segments of a key to the checkpoint. No event meets another table.
    """
    seg = assign_segment(events.select(*STOCK_DAY, *ORDER_KEY, "seq", value), cuts)
    x, run = F.col(value).cast("double"), F.expr(f"(seq - 1) div {RUN}")
    runs = seg.groupBy(*STOCK_DAY, "_seg", run.alias("_run")).agg(
        F.max("seq").alias("_last"),
        *[F.sum(F.pow(F.lit(r), ((run + 1) * RUN - F.col("seq")).cast("double")) * x).alias(k) for k, r in ratios.items()],
        F.max(F.when(F.col("seq") == 1, x)).alias("x1"),
        F.max(F.when(F.col("seq") == 2, x)).alias("x2"),
        F.max_by(x, "seq").alias("xn"),
    )

    def discounted(rows: DataFrame, keys: list[str], end: str, own_end: Column) -> DataFrame:
        return rows.groupBy(*keys, end).agg(
            *[F.sum(F.pow(F.lit(r), (F.col(end) - own_end).cast("double")) * F.col(k)).alias(k) for k, r in ratios.items()], F.max("x1").alias("x1"), F.max("x2").alias("x2"),
            F.max_by("xn", own_end).alias("xn"),
        )

    in_segment = [*STOCK_DAY, "_seg"]
    part = discounted(runs.withColumn("_end", F.max("_last").over(Window.partitionBy(*in_segment))), in_segment, "_end", (F.col("_run") + 1) * RUN)
    names = cuts.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("cut", "event"))).alias("_cuts"))
    spread = part.join(F.broadcast(names), "date").select(
        *STOCK_DAY, "_end", *ratios, "x1", "x2", "xn", F.explode(F.slice("_cuts", F.col("_seg") + 1, F.size("_cuts"))["event"]).alias("event")
    )
    return discounted(spread.withColumn("n", F.max("_end").over(Window.partitionBy(*KEYS))), KEYS, "n", F.col("_end"))


def seeded_ema(alpha: float, decayed: str, n: str = "n", first: str = "x1") -> Column:
    """Exponential average seeded with the first value, from its geometric sum."""
    r = 1.0 - alpha
    return alpha * F.col(decayed) + (1.0 - alpha) * F.pow(F.lit(r), F.col(n) - 1.0) * F.col(first)


def zero_ema(alpha: float, decayed: str) -> Column:
    """Exponential average seeded with zero."""
    return alpha * F.col(decayed)


def macd_at_cuts(events: DataFrame, cuts: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9, velocity: float = 0.2) -> DataFrame:
    """EMA fast and slow, MACD line, signal and histogram, and the smoothed velocity."""
    af, asl, b = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    ratios = {"_df": 1 - af, "_ds": 1 - asl, "_db": 1 - b, "_dv": 1 - velocity}
    base = decayed_sums_at_cuts(events, cuts, value, ratios)

    def smoothed(a: float, d: str) -> Column:
        # an EMA of an EMA: the convolution of two geometric weights
        ra, rb = 1 - a, 1 - b
        body = a * b / (rb - ra) * (rb * F.col("_db") - ra * F.col(d))
        seed = (1 - a) * b / (rb - ra) * (F.pow(F.lit(rb), F.col("n")) - F.pow(F.lit(ra), F.col("n"))) * F.col("x1")
        return body + seed

    rv = 1 - velocity
    n = F.col("n").cast("double")
    moves = F.col("_dv") - F.pow(F.lit(rv), n - 1) * F.col("x1") - (F.col("_dv") - F.col("xn")) / rv
    velocity_ema = velocity * moves + (1 - velocity) * F.pow(F.lit(rv), n - 2) * (F.col("x2") - F.col("x1"))
    line = seeded_ema(af, "_df") - seeded_ema(asl, "_ds")
    sig = smoothed(af, "_df") - smoothed(asl, "_ds")
    return base.select(
        *KEYS, "n", seeded_ema(af, "_df").alias("ema_fast"), seeded_ema(asl, "_ds").alias("ema_slow"),
        line.alias("macd_line"), sig.alias("macd_signal"), (line - sig).alias("macd_hist"),
        F.when(F.col("n") >= 2, velocity_ema).alias("smoothed_velocity"),
    )


def differences_at_cuts(events: DataFrame, cuts: DataFrame, value: str) -> DataFrame:
    """First to fourth difference and rate of change of the latest value."""
    recent = last_at_cuts(events, cuts, 5, [value])
    x = [F.max(F.when(F.col("rn") == i + 1, F.col(value).cast("double"))).alias(f"_x{i}") for i in range(5)]
    w = recent.groupBy(*KEYS).agg(*x)
    a, b, c, d, e = (F.col(f"_x{i}") for i in range(5))
    roc = F.when(b.isNull(), None).when(F.abs(b) > 2.220446049250313e-16, (a - b) / F.nullif(F.abs(b), F.lit(0.0))).otherwise(0.0)
    return w.select(
        *KEYS, (a - b).alias("velocity"), (a - 2 * b + c).alias("acceleration"), (a - 3 * b + 3 * c - d).alias("jerk"),
        (a - 4 * b + 6 * c - 4 * d + e).alias("snap"), roc.alias("roc"),
    )


def recent_moments_at_cuts(events: DataFrame, cuts: DataFrame, value: str, window: int) -> DataFrame:
    """Mean, variance and standard deviation of the last ``window`` values."""
    recent = last_at_cuts(events, cuts, window, [value])
    x = F.col(value).cast("double")
    return recent.groupBy(*KEYS).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("std"))


def span_stats_at_cuts(events: DataFrame, cuts: DataFrame, value: str, width_ms: int, cap: int) -> DataFrame:
    """Basic statistics of the trailing time span before each checkpoint, at most the last ``cap`` events."""
    span = window_at_cuts(events.select(*STOCK_DAY, *ORDER_KEY, value), cuts, width_ms)
    kept = last_rows(span, KEYS, cap)
    x = F.col(value)
    sums = kept.groupBy(*KEYS).agg(*moments.power_sums(x), F.max(F.when(F.col("rn") == 1, x.cast("double"))).alias("last"))
    b = moments.basic()
    return sums.select(*KEYS, F.col("n"), "last", *[e.alias(k) for k, e in b.items()])


def span_ols_at_cuts(events: DataFrame, cuts: DataFrame, value: str, width_ms: int, cap: int, min_n: int = 5) -> DataFrame:
    """Least squares of a value on real seconds over the trailing span."""
    span = window_at_cuts(events.select(*STOCK_DAY, *ORDER_KEY, value), cuts, width_ms)
    kept = last_rows(span, KEYS, cap)
    # centred clock: seconds before the checkpoint, for a stable fit
    from tickloom.functions.clock import ms_of_day

    x = (F.col("exch_ms") - ms_of_day(F.col("event"))) / 1000.0
    sums = kept.groupBy(*KEYS).agg(*moments.ols_sums(x, F.col(value)))
    return sums.select(*KEYS, F.col("n").cast("bigint").alias("n"), *[e.alias(k) for k, e in moments.ols_fit(min_n).items()])


def gap_statistics(events: DataFrame, id_column: str) -> DataFrame:
    """Per row: gap to the previous id, its expanding mean and deviation (current gap included), and the jump flag."""
    rows = cut_lineage(previous(events, STOCK_DAY, {id_column: "_before"}))
    rows = rows.withColumn("gap", (F.col(id_column) - F.col("_before")).cast("double"))
    rows = running(
        rows, STOCK_DAY,
        {"_n": ("sum", F.when(F.col("gap").isNotNull(), 1).otherwise(0)), "_s1": ("sum", F.coalesce("gap", F.lit(0.0))), "_s2": ("sum", F.coalesce(F.col("gap") * F.col("gap"), F.lit(0.0)))},
    )
    mean = F.when(F.col("_n") >= 2, F.col("_s1") / F.nullif(F.col("_n"), F.lit(0))).otherwise(0.0)
    spread = F.col("_s2") - 2 * mean * F.col("_s1") + F.col("_n") * mean * mean
    std = F.when((F.col("_n") >= 2) & (spread > 1e-9), F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(F.col("_n") - 1, F.lit(0)))).otherwise(0.0)
    rows = rows.withColumns({"gap_mean": mean, "gap_std": std})
    jump = F.col("gap") > F.col("gap_mean") + 3 * F.greatest(F.lit(1e-9), F.col("gap_std"))
    return rows.withColumn("jump", F.coalesce(jump, F.lit(False))).drop("_before", "_n", "_s1", "_s2")


def id_runs(events: DataFrame, column: str, threshold: float) -> DataFrame:
    """Runs of neighbouring ids: a new run begins when the step exceeds ``threshold``; one row per run."""
    rows = cut_lineage(previous(events, STOCK_DAY, {column: "_before"}))
    starts = F.col("_before").isNull() | (F.abs(F.col(column) - F.col("_before")) > threshold)
    return islands(rows, STOCK_DAY, starts).groupBy(*STOCK_DAY, "island").agg(F.count(F.lit(1)).alias("size"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Clusters (runs of two or more), members beyond the first, largest run and runs of five or more."""
    return runs.groupBy(*STOCK_DAY).agg(
        F.count_if(F.col("size") >= 2).alias("clusters"), F.sum(F.col("size") - 1).alias("extra_members"),
        F.max("size").alias("max_size"), F.count_if(F.col("size") >= 5).alias("large_runs"),
    )


def value_runs(events: DataFrame, column: str, name: str = "run") -> DataFrame:
    """Length so far of the current run of equal values, per row."""
    rows = previous(events, STOCK_DAY, {column: "_before"})
    rows = cut_lineage(number_rows(rows, STOCK_DAY))
    starts = F.col("_before").isNull() | (F.col(column) != F.col("_before"))
    rows = running(rows, STOCK_DAY, {"_start": ("max", F.when(starts, F.col("seq")))})
    return rows.withColumn(name, F.col("seq") - F.col("_start") + 1).drop("_before", "_start")


def big_events(events: DataFrame, value: str, window: int = 200, min_n: int = 30, k: float = 2.0, z_clip: float = 8.0, fallback: float | None = None) -> DataFrame:
    """Decision per row against the ``window`` rows before it: threshold, clipped z and flag."""
    rows = overlapping_chunks(events, STOCK_DAY, window)
    w = frame(STOCK_DAY, -window, -1)
    x = F.col(value).cast("double")
    rows = rows.withColumns({"ref_n": F.count(x).over(w), "ref_mean": F.avg(x).over(w), "ref_std": F.stddev_samp(x).over(w)})
    return big_decision(rows.filter(~F.col("halo_row")).drop("chunk", "halo_row"), value, min_n, k, z_clip, fallback)


def big_decision(rows: DataFrame, value: str, min_n: int = 30, k: float = 2.0, z_clip: float = 8.0, fallback: float | None = None) -> DataFrame:
    """Threshold, clipped z and flag from the reference count, mean and deviation."""
    x = F.col(value).cast("double")
    usable = (F.col("ref_n") >= min_n) & (F.coalesce(F.col("ref_std"), F.lit(0.0)) > 1e-12)
    flat = (F.col("ref_n") >= min_n) & ~(F.coalesce(F.col("ref_std"), F.lit(0.0)) > 1e-12)
    threshold = F.when(usable, F.col("ref_mean") + k * F.col("ref_std"))
    z = F.when(usable, F.greatest(F.lit(-z_clip), F.least(F.lit(z_clip), (x - F.col("ref_mean")) / F.nullif(F.col("ref_std"), F.lit(0.0)))))
    if fallback:
        threshold = F.when(flat, F.lit(float(fallback))).otherwise(threshold)
    rows = rows.withColumns({"threshold": F.coalesce(threshold, F.lit(0.0)), "z": F.coalesce(z, F.lit(0.0))})
    decided = usable if not fallback else usable | flat
    return rows.withColumn("is_big", decided & (x >= F.col("threshold")))


def span_reference(events: DataFrame, value: str, width_ms: int) -> DataFrame:
    """Add ref_n, ref_mean and ref_std: the ``width_ms`` that end with the event before, as arrivals tell the time.

    The event before belongs to its span, one exactly ``width_ms`` older does not. The span is a difference of two
    prefix sums. Where no key is crowded both are growing frames of one window; else each event asks for the prefix at the
    moment its span begins, and finds it in the union of events and questions, by blocks. So no frame has to be held,
    however many events a minute has. ``value`` is a whole number.
    """
    x = F.col(value).cast("decimal(38,0)")
    names = events.columns
    sums = {"_n": ("sum", F.lit(1).cast("decimal(38,0)")), "_s1": ("sum", x), "_s2": ("sum", x * x)}
    crowd = crowded(events, STOCK_DAY)
    rows = running(events, STOCK_DAY, sums, crowd=crowd).withColumn("_ms", F.floor(F.col("local_us") / 1000).cast("bigint"))
    if not crowd:
        left = Window.partitionBy(*STOCK_DAY).orderBy("_ms").rangeBetween(Window.unboundedPreceding, -width_ms)
        inside = {k: F.col(k) - F.coalesce(F.sum(e).over(left), F.lit(0)) for k, (_, e) in sums.items()}
        return _span_moments(rows.select(*names, *[e.cast("decimal(38,0)").alias(f"_w{k}") for k, e in inside.items()]), names, list(sums), crowd)
    rows = rows.withColumns({f"_a{k}": F.col(k) for k in ORDER_KEY} | {"_asks": F.lit(0)})
    known = rows.select(*STOCK_DAY, "_ms", "_asks", *[f"_a{k}" for k in ORDER_KEY], F.struct(*sums).alias("_at"))
    # a question stands behind all events of its millisecond: those have left the span
    asked = rows.withColumns({"_ms": F.col("_ms") - width_ms, "_asks": F.lit(1)})
    order = ["_ms", "_asks", *[f"_a{k}" for k in ORDER_KEY]]
    met = carry_forward(asked.unionByName(known, allowMissingColumns=True), STOCK_DAY, F.col("_at"), "_gone", order, F.expr(f"_ms div {BLOCK_US // 1000}"))
    inside = {k: F.col(k) - F.coalesce(F.col(f"_gone.{k}"), F.lit(0)) for k in sums}
    spans = met.filter("_asks = 1").select(*names, *[e.cast("decimal(38,0)").alias(f"_w{k}") for k, e in inside.items()])
    return _span_moments(spans, names, list(sums), crowd)


def _span_moments(spans: DataFrame, names: list[str], sums: list[str], crowd: list) -> DataFrame:
    """Count, mean and deviation that the event before had in its span."""
    spans = previous(spans, STOCK_DAY, {f"_w{k}": f"_p{k}" for k in sums}, crowd=crowd)
    n, s1, s2 = (F.coalesce(F.col(f"_p{k}"), F.lit(0)).cast("decimal(19,0)") for k in sums)
    spread = (n * s2 - s1 * s1).cast("double") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0))
    return spans.select(*names, n.cast("bigint").alias("ref_n"), (s1.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))).alias("ref_mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("ref_std"))


def big_orders(
    orders: DataFrame, quotes: DataFrame, width_ms: int = 60_000, min_n: int = 30, k: float = 2.0, z_clip: float = 8.0, fallback: float | None = None, need_marketable: bool = False, need_touch: bool = False
) -> DataFrame:
    """Decision per order against those of the time before it: threshold, clipped z and flag.

    With ``need_marketable`` only an order that crosses the last quote before it can be big, with ``need_touch`` only
    one at no distance from the touch. ``fallback`` is the threshold where the orders before are all alike.
    """
    seen = as_of_quote(orders, quotes.withColumns({"bid": F.get("bp", 0), "ask": F.get("ap", 0)}), ["bid", "ask"])
    bid, ask = F.coalesce("quote.bid", F.lit(0)), F.coalesce("quote.ask", F.lit(0))
    seen = seen.withColumns({"marketable": marketable(bid, ask), "touch_distance": touch_distance(bid, ask)}).drop("quote")
    rows = big_decision(span_reference(seen, "volume", width_ms), "volume", min_n, k, z_clip, fallback)
    gate = F.lit(True)
    gate = gate & F.col("marketable") if need_marketable else gate
    gate = gate & (F.col("touch_distance") == 0) if need_touch else gate
    return rows.withColumn("is_big", F.col("is_big") & gate)


def entropy_bits(events: DataFrame, category: str, keys: Sequence[str] = tuple(STOCK_DAY)) -> DataFrame:
    """Shannon entropy of the categories of a key, from counts combined map-side."""
    counts = events.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return counts.join(total, list(keys)).groupBy(*keys).agg(F.max("_n").alias("n"), (-F.sum(p * F.log2(p))).alias("entropy"))


def minute_bars(ticks: DataFrame, price: str, total_volume: str, interval: int = 1, order: Sequence[str] = tuple(ORDER_KEY)) -> DataFrame:
    """Tumbling bars: open, high, low, close and the growth of the day-to-date volume."""
    minute = F.floor(F.col("exch_ms") / (60_000 * interval)).cast("bigint")
    key = F.struct(*order)
    return ticks.groupBy(*STOCK_DAY, minute.alias("bar")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        (F.max_by(total_volume, key) - F.min_by(total_volume, key)).alias("volume"), F.count(F.lit(1)).alias("ticks"),
    )


def causal_zscore(events: DataFrame, value: str) -> DataFrame:
    """z of each value against the values seen so far, itself included."""
    x = F.col(value).cast("double")
    rows = running(events, STOCK_DAY, {"_n": ("sum", F.lit(1)), "_s1": ("sum", x), "_s2": ("sum", x * x)})
    mean = F.col("_s1") / F.col("_n")
    var = F.greatest(F.lit(0.0), F.col("_s2") / F.col("_n") - mean * mean) * F.col("_n") / F.nullif(F.col("_n") - 1, F.lit(0))
    return rows.withColumn("z", F.when(var > 1e-9, (x - mean) / F.sqrt(F.when(var > 1e-9, var)))).drop("_n", "_s1", "_s2")


def reversal(events: DataFrame, value: str) -> DataFrame:
    """Distance from the running maximum and minimum seen so far."""
    x = F.col(value).cast("double")
    rows = running(events, STOCK_DAY, {"_hi": ("max", x), "_lo": ("min", x)})
    return rows.withColumns({"from_high": x - F.col("_hi"), "from_low": x - F.col("_lo")}).drop("_hi", "_lo")


def newest_first(keys: Sequence[str] = tuple(KEYS)):
    return Window.partitionBy(*keys).orderBy("rn")
