"""Market-wide checkpoints.

A checkpoint T fires just before the first arriving record, of any stream and any
symbol, whose exchange time has reached T.  The cut is therefore an arrival key
per date, not a clock filter per symbol, and it is computed from the unfiltered
streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import ms_of_day
from tickloom.operators.sequence import last_rows
from tickloom.schema import CHECKPOINTS, ORDER_KEY, STOCK_DAY


def _clock_ms(packed: int) -> int:
    hour, minute, second, ms = packed // 10_000_000, packed // 100_000 % 100, packed // 1000 % 100, packed % 1000
    return ((hour * 60 + minute) * 60 + second) * 1000 + ms


def arrivals(*streams: DataFrame) -> DataFrame:
    """All records of the day on the shared clock, order columns only."""
    return reduce(DataFrame.unionByName, [s.select("date", *ORDER_KEY) for s in streams])


def market_cuts(
    streams: Sequence[DataFrame], checkpoints: Sequence[int] = tuple(CHECKPOINTS), skip_missed: bool = False
) -> DataFrame:
    """``date, event, cut`` with ``cut`` the arrival key that fires the checkpoint.

    Two passes over four narrow columns: the first finds the earliest arrival
    microsecond per date and checkpoint slot in a hash aggregate, the second settles
    ties inside that microsecond.  Both shuffle a handful of rows per date.
    """
    times = sorted(checkpoints)
    reached = reduce(lambda a, b: a + b, [(F.col("exch_ms") >= _clock_ms(t)).cast("int") for t in times])
    # one comparison decides, so that the scan does not work the slot out for its filter as well
    rows = arrivals(*streams).filter(F.col("exch_ms") >= _clock_ms(times[0])).withColumn("_slot", reached)
    first = (
        rows.groupBy("date", "_slot")
        .agg(F.min("local_us").alias("local_us"))
        .select("date", F.explode(F.sequence(F.lit(1), F.col("_slot"))).alias("_i"), "local_us")
        .groupBy("date", "_i")
        .agg(F.min("local_us").alias("local_us"))
    )
    # bounded: one row per date and checkpoint
    ties = rows.join(F.broadcast(first), ["date", "local_us"]).filter("_slot >= _i")
    event = F.element_at(F.array(*[F.lit(t).cast("bigint") for t in times]), F.col("_i"))
    cuts = ties.groupBy("date", "_i").agg(F.min(F.struct(*ORDER_KEY)).alias("cut"))
    cuts = cuts.select("date", event.alias("event"), "cut")
    if skip_missed:
        cuts = cuts.groupBy("date", "cut").agg(F.max("event").alias("event")).select("date", "event", "cut")
    return cuts


def family_cuts(cuts: DataFrame, events: Sequence[int] | None) -> DataFrame:
    """Restrict the trigger list of one factor family; ``None`` keeps the send list."""
    return cuts if events is None else cuts.filter(F.col("event").isin(*events))


def _by_date(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("cut", "event"))).alias("_cuts"))


def _reached(position: int) -> Column:
    """Whether a record's arrival key has reached the cut at ``position`` of its date: one column after the other."""
    out = F.lit(True)
    for c in reversed(ORDER_KEY):
        cut = F.get(f"_cut_{c}", F.lit(position))
        out = (cut < F.col(c)) | ((cut == F.col(c)) & out)
    return F.coalesce(out, F.lit(False)).cast("int")


def assign_segment(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``_cuts`` and ``_seg``, the number of checkpoints already fired at arrival.

    The record is visible to the checkpoints at positions ``_seg`` and later. Up to the published number of checkpoints
    are compared in plain columns; a longer list, or a key with a NULL in it, as structs.
    """
    whole = F.forall("_cuts", lambda c: reduce(lambda a, b: a & b, [c["cut"][k].isNotNull() for k in ORDER_KEY]))
    plain_days = {**{f"_cut_{k}": F.col(f"_cuts.cut.{k}") for k in ORDER_KEY}, "_plain": (F.size("_cuts") <= len(CHECKPOINTS)) & whole}
    days = _by_date(cuts).withColumns(plain_days)
    plain = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ORDER_KEY], F.col("_plain"))
    columns = reduce(lambda a, b: a + b, [_reached(i) for i in range(len(CHECKPOINTS))])
    structs = F.size(F.filter("_cuts", lambda c: c["cut"] <= F.struct(*ORDER_KEY)))
    joined = events.join(F.broadcast(days), "date").withColumn("_seg", F.when(plain, columns).otherwise(structs))
    return joined.filter("_seg < size(_cuts)").drop(*[f"_cut_{k}" for k in ORDER_KEY], "_plain")


def _spread() -> Column:
    """Explode a segment to every checkpoint that can see it."""
    return F.explode(F.slice("_cuts", F.col("_seg") + 1, F.size("_cuts"))["event"]).alias("event")


def last_at_cuts(
    events: DataFrame,
    cuts: DataFrame,
    n: int,
    columns: Sequence[str],
    keys: Sequence[str] = tuple(STOCK_DAY),
    salts: int = 8,
    crowd: Sequence[Row] | None = None,
) -> DataFrame:
    """The last ``n`` records of each key before every checkpoint, ``rn`` = 1 for the newest.

    Pruned to ``n`` per segment before the first shuffle, so a hot symbol ships
    ``n`` rows per map task; later steps handle at most ``checkpoints * n`` rows per key.
    Where no key is crowded (an empty ``crowd``), the records are shuffled once, before a
    record is repeated for the checkpoints that see it.
    """
    order = [c for c in ORDER_KEY if c not in columns]
    seg = assign_segment(events.select(*keys, *order, *columns), cuts)
    if crowd is not None and not crowd:
        newest = last_rows(seg.repartition(*keys), [*keys, "_seg"], n, salts=1).drop("rn")
        return last_rows(newest.select(*keys, *order, *columns, _spread()), [*keys, "event"], n, salts=1)
    newest = last_rows(seg, [*keys, "_seg"], n, salts=salts).drop("rn")
    spread = newest.select(*keys, *order, *columns, _spread())
    return last_rows(spread, [*keys, "event"], n, salts=1)


def latest_at_cuts(events: DataFrame, cuts: DataFrame, columns: Sequence[str], keys: Sequence[str] = tuple(STOCK_DAY)) -> DataFrame:
    """The last record of each key before every checkpoint: the newest of each segment, combined map-side, then the newest of the segments seen."""
    order = [c for c in ORDER_KEY if c not in columns]
    # the arrival key leads, so that the largest row is the newest
    row = F.struct(*ORDER_KEY, *[c for c in columns if c not in ORDER_KEY])
    latest = totals_at_cuts(events, cuts, {"_row": ("max", row)}, keys)
    return latest.select(*keys, "event", *[F.col("_row")[c].alias(c) for c in (*order, *columns)])


def totals_at_cuts(
    events: DataFrame,
    cuts: DataFrame,
    spec: dict[str, tuple[str, Column]],
    keys: Sequence[str] = tuple(STOCK_DAY),
) -> DataFrame:
    """Day-to-date ``sum``/``max``/``min`` at every checkpoint, combined map-side per segment."""
    inputs = events.select(*keys, *ORDER_KEY, *[e.alias(f"_x_{k}") for k, (_, e) in spec.items()])
    seg = assign_segment(inputs, cuts)
    part = seg.groupBy(*keys, "_seg").agg(
        *[getattr(F, how)(f"_x_{k}").alias(k) for k, (how, _) in spec.items()]
    )
    # one row per key and segment from here on; attach the few cuts of a date again
    spread = part.join(F.broadcast(_by_date(cuts)), "date").select(*keys, _spread(), *spec)
    return spread.groupBy(*keys, "event").agg(*[getattr(F, how)(k).alias(k) for k, (how, _) in spec.items()])


def window_at_cuts(events: DataFrame, cuts: DataFrame, width_ms: int, clock: Column | None = None) -> DataFrame:
    """Records of the trailing ``(T - width, T]`` span before each checkpoint's arrival cut.

    T is the checkpoint's own clock.  A record meets only the checkpoints whose span covers it,
    so the join stays an equi-join on date followed by a filter on a short array.
    """
    t = F.col("exch_ms") if clock is None else clock
    joined = events.join(F.broadcast(_by_date(cuts)), "date")
    hits = F.filter(
        "_cuts",
        lambda c: (F.struct(*ORDER_KEY) < c["cut"]) & (t > ms_of_day(c["event"]) - width_ms),
    )
    return joined.withColumn("event", F.explode(hits["event"])).drop("_cuts")


def grid_at_cuts(codes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every code of a date at every checkpoint of that date."""
    return codes.join(F.broadcast(_by_date(cuts)), "date").select(
        "date", "symbol", F.explode(F.col("_cuts")["event"]).alias("event")
    )


def opening_rows(panel: DataFrame, until: int = 92_500_000) -> DataFrame:
    """At or before 09:25 only Shenzhen codes (0.., 3..) are valid rows."""
    prefix = F.substring(F.col("symbol").cast("string"), 1, 1)
    return panel.filter((F.col("event") > until) | prefix.isin("0", "3"))


def tracked(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Keep events of the code list; apply after the cuts are computed."""
    return events.join(codes.select("date", "symbol").distinct(), ["date", "symbol"], "left_semi")


def as_of_quote(events: DataFrame, quotes: DataFrame, payload: Sequence[str], name: str = "quote") -> DataFrame:
    """Each event with the last quote that arrived before it (no join, blocks of the union)."""
    from tickloom.operators.sequence import carry_forward

    tagged = quotes.select(*STOCK_DAY, *ORDER_KEY, F.struct(*payload).alias(name), F.lit(True).alias("_is_quote"))
    both = events.withColumn("_is_quote", F.lit(False)).unionByName(tagged, allowMissingColumns=True)
    out = carry_forward(both, STOCK_DAY, F.col(name), "_asof")
    return out.filter(~F.col("_is_quote")).drop(name, "_is_quote").withColumnRenamed("_asof", name)


def position_window(keys: Sequence[str] = (*STOCK_DAY, "event")):
    """Newest-first window over an already bounded last-N set."""
    return Window.partitionBy(*keys).orderBy("rn")
