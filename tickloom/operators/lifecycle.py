"""Parent-order reconstruction and trade pairs as DataFrame jobs.

Shenzhen orders are confirmed when they arrive.  A Shanghai parent is known only from fragments
around its add record, so it stays pending until the arrival clock has passed its latest event
time by the watermark; fragments before that moment are split by ``biz_index``, later records
change the live remainder.  Because every change takes volume away and the remainder is clipped
at zero, the state after any record is a closed form of running sums:
``rest = max(0, rest0 - taken)``.

The whole reconstruction is one shuffle on ``(date, symbol, order_id)``: phase, confirmed state and
running state are windows over that partitioning, and the per-order result is an aggregate over
it.  The group is one parent order, not a stock: every record of an order takes at least one share
of its declared quantity, which exchanges cap at a million, so a busy stock still spreads over all
tasks and no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import SH, SZ, aggressor, canonical_order_id
from tickloom.operators.sequence import peak_of_changes
from tickloom.schema import ORDER_KEY
from tickloom.session import written

ORDER = ["date", "symbol", "order_id"]

# Watermark of pending Shanghai orders and the session close, in milliseconds.
WATERMARK_MS = 20_000
CLOSE_MS = 54_000_000


def order_legs(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per effect on a parent order: add (A), delete (D), cancel (C) or fill (F); ``paired`` fills name both parents."""
    base = ["date", "symbol", *ORDER_KEY, "market"]
    is_add = (F.col("market") == SZ) | (F.col("order_type") == "A")
    adds = orders.filter((is_add | (F.col("order_type") == "D")) & (canonical_order_id() != 0)).select(
        *base, canonical_order_id().alias("order_id"), F.when(is_add, "A").otherwise("D").alias("kind"),
        F.greatest(F.col("volume"), F.lit(0)).alias("qty"), F.lit(0).cast("bigint").alias("amount"), "biz_index",
        F.when(F.upper("bsflag") == "B", 0).otherwise(1).alias("side"), F.lit(False).alias("incoming"), "price", F.lit(False).alias("paired"),
    )
    target = F.when(F.col("buy_id") != 0, F.col("buy_id")).otherwise(F.col("sell_id"))
    cancels = trades.filter((F.col("trade_type") == "C") & (F.col("market") == SZ) & (F.col("volume") > 0)).select(
        *base, target.alias("order_id"), F.lit("C").alias("kind"), F.col("volume").alias("qty"), F.lit(0).cast("bigint").alias("amount"), "biz_index",
        F.when(F.col("buy_id") != 0, 0).otherwise(1).alias("side"), F.lit(False).alias("incoming"), "price", F.lit(False).alias("paired"),
    )
    side = aggressor()["side"]
    legs = F.array(
        F.struct(F.col("buy_id").alias("id"), F.lit(0).alias("s"), (side == 1).alias("i")),
        F.struct(F.col("sell_id").alias("id"), F.lit(1).alias("s"), (side == -1).alias("i")),
    )
    fills = (
        trades.filter((F.col("trade_type") != "C") & (F.col("volume") > 0) & F.col("market").isin(SZ, SH))
        .withColumn("_leg", F.explode(legs))
        .filter("_leg.id <> 0")
        .select(*base, F.col("_leg.id").alias("order_id"), F.lit("F").alias("kind"), F.col("volume").alias("qty"), "amount", "biz_index",
                F.col("_leg.s").alias("side"), F.col("_leg.i").alias("incoming"), "price", ((F.col("buy_id") != 0) & (F.col("sell_id") != 0)).alias("paired"))
    )
    return adds.unionByName(cancels).unionByName(fills)


LEG_ORDER = [*ORDER_KEY, "side"]


def _windows():
    ordered = Window.partitionBy(*ORDER).orderBy(*LEG_ORDER)
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, 0)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _qty(cond: Column, value: str = "qty") -> Column:
    return F.when(cond, F.col(value)).otherwise(F.lit(0).cast("bigint"))


def order_states(legs: DataFrame, watermark_ms: int = WATERMARK_MS) -> DataFrame:
    """Every leg with its phase, its order's state at confirmation and the state after the leg.

    ``live``: the leg arrived after confirmation and found the order open; ``late``: it found it
    closed; ``orphan``: its order was not known (Shenzhen) or could no longer change it.
    """
    ordered, upto = _windows()
    before, whole = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
    add, fill, sz = F.col("kind") == "A", F.col("kind") == "F", F.col("market") == SZ
    rows = legs.withColumns(
        {
            "_pm": F.max("exch_ms").over(before),
            "_pe": F.coalesce(F.max(_flag(add | F.col("incoming"))).over(before), F.lit(0)),
            "_adds": F.sum(_flag(add)).over(upto),
        }
    )
    # the market clock at arrival, against the deadline left by the legs before
    passed = (F.col("_pe") == 1) & (F.floor(F.col("local_us") / 1000) > F.col("_pm") + watermark_ms)
    rows = rows.withColumn("_after", F.max(_flag(passed)).over(upto) == 1)
    # a second Shenzhen add of the same id, or legs before the first one, change nothing
    orphan = F.when(sz, (F.col("_adds") == 0) | (add & (F.col("_adds") > 1))).otherwise(F.col("_after") & add)
    after = F.when(sz, ~add & (F.col("_adds") > 0)).otherwise(F.col("_after") & ~add)
    rows = rows.withColumns({"orphan": orphan, "_live": after})
    rows = rows.withColumn("_pre", ~F.col("orphan") & ~F.col("_live"))
    pre = F.col("_pre")
    rows = rows.withColumns(
        {
            "has_a": F.max(_flag(pre & add)).over(whole) == 1,
            "_inc": F.max(_flag(pre & F.col("incoming"))).over(whole) == 1,
            "_a_qty": F.max(F.when(pre & add, F.col("qty"))).over(whole),
            "_a_biz": F.max(F.when(pre & add, F.col("biz_index"))).over(whole),
            "order_price": F.max(F.when(pre & add, F.col("price"))).over(whole),
            "_a_us": F.min(F.when(pre & add, F.col("local_us"))).over(whole),
            "_last": F.max(F.when(pre, F.col("exch_ms"))).over(whole),
            "first_ms": F.min(F.when(pre, F.col("exch_ms"))).over(whole),
            "order_side": F.first(F.when(pre, F.col("side")), ignorenulls=True).over(whole),
            "cancelled0": F.sum(_qty(pre & (F.col("kind") == "D"))).over(whole),
            "amount0": F.sum(_qty(pre, "amount")).over(whole),
        }
    )
    before_a = F.when(F.col("has_a"), F.col("biz_index") < F.col("_a_biz")).otherwise(F.col("incoming"))
    after_a = F.col("has_a") & (F.col("biz_index") > F.col("_a_biz"))
    rows = rows.withColumns({"confirmed": F.col("has_a") | F.col("_inc"), "_live": F.col("_live") & (F.col("has_a") | F.col("_inc"))})
    rows = rows.withColumns(
        {
            "immediate0": F.sum(_qty(pre & fill & before_a)).over(whole),
            "passive0": F.sum(_qty(pre & fill & after_a)).over(whole),
            "_taken": F.sum(_qty(F.col("_live"))).over(upto),
        }
    )
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumns(
        {
            "estimated": ~F.col("has_a"),
            "original": F.when(F.col("has_a"), F.col("_a_qty") + F.col("immediate0")).otherwise(F.col("immediate0")),
            "rest0": F.when(F.col("has_a"), F.greatest(zero, F.col("_a_qty") - F.col("passive0") - F.col("cancelled0"))).otherwise(zero),
            "confirm_ms": F.when(sz, F.floor(F.col("_a_us") / 1000)).otherwise(F.least(F.col("_last") + watermark_ms, F.lit(CLOSE_MS))).cast("bigint"),
        }
    )
    found = F.col("rest0") - F.col("_taken") + F.col("qty")
    rows = rows.withColumns(
        {
            "late": F.col("_live") & (found <= 0),
            "live": F.col("_live") & (found > 0),
            "rest": F.greatest(zero, F.col("rest0") - F.col("_taken")),
            "applied": F.least(F.col("qty"), F.greatest(zero, found)),
        }
    )
    # Shenzhen counts the whole fill, Shanghai what the remainder allowed
    rows = rows.withColumn("_filled", F.when(sz, F.col("qty")).otherwise(F.col("applied")))
    active = F.col("live") & sz & F.col("incoming")
    rows = rows.withColumns(
        {
            "immediate": F.col("immediate0") + F.sum(_qty(F.col("live") & fill & active, "_filled")).over(upto),
            "passive": F.col("passive0") + F.sum(_qty(F.col("live") & fill & ~active, "_filled")).over(upto),
            "cancelled": F.col("cancelled0") + F.sum(_qty(F.col("live") & ~fill, "applied")).over(upto),
            "filled_amount": F.col("amount0") + F.sum(_qty(F.col("live") & fill, "amount")).over(upto),
        }
    )
    return rows.drop("_adds", "_pm", "_pe", "_after", "_inc", "_a_qty", "_a_biz", "_a_us", "_last", "_taken", "_filled", "_live")


def order_results(states: DataFrame) -> DataFrame:
    """One row per parent, ``confirmed`` or not: the counts of its legs and, for a confirmed one, its state after the session close.

    An open remainder is cancelled at the close. The aggregate needs no exchange of its own behind ``order_states``.
    """
    closing = F.col("live") & (F.col("rest") == 0)
    leg = F.struct(*LEG_ORDER)
    same = ["market", "original", "immediate0", "passive0", "cancelled0", "amount0", "rest0", "estimated", "confirm_ms", "first_ms"]
    g = states.groupBy(*ORDER).agg(
        F.max("confirmed").alias("confirmed"), F.max("order_side").alias("side"), *[F.max(c).alias(c) for c in same],
        *[F.max(c).alias(f"_{c}") for c in ("immediate", "passive", "cancelled", "filled_amount")],
        F.min("rest").alias("_rest"), F.max(F.when(closing, F.col("kind"))).alias("_kind"), F.max(F.when(closing, leg)).alias("close_key"),
        F.max(F.when(~F.col("late") & ~F.col("orphan"), F.col("exch_ms"))).alias("last_ms"), F.count_if("live").alias("changes"),
        F.count(F.lit(1)).alias("legs"), F.count_if(F.col("kind").isin("C", "D")).alias("cancel_legs"), F.count_if("orphan").alias("orphan_legs"), F.count_if("late").alias("late_legs"),
        F.min("local_us").alias("first_us"),
    )
    none = F.col("rest0") == 0
    reason = (
        F.when(none & F.col("estimated"), "FullyFilledOnArrival")
        .when(none & (F.col("market") == SH), F.when(F.col("cancelled0") > 0, "Cancelled").otherwise("FullyFilledAfterResting"))
        .when((F.col("_rest") == 0) & (F.col("_kind") == "F"), "FullyFilledAfterResting")
        .when((F.col("_rest") == 0) & F.col("_kind").isNotNull(), "Cancelled")
        .otherwise("SessionClose")
    )
    return g.select(
        *ORDER, "market", "side", "original", F.col("_immediate").alias("immediate"), F.col("_passive").alias("passive"),
        (F.col("_cancelled") + F.col("_rest")).alias("cancelled"), F.lit(0).cast("bigint").alias("rest"), F.col("_rest").alias("rest_at_close"),
        F.col("_filled_amount").alias("filled_amount"), "immediate0", "passive0", "cancelled0", "rest0", "estimated", "confirm_ms", "first_ms", "last_ms", "close_key",
        reason.alias("close_reason"), "changes", "confirmed", *LEG_COUNTS, "first_us",
    )


#: per parent: all legs, cancels and deletes, those that changed nothing, those that came after its close
LEG_COUNTS = ["legs", "cancel_legs", "orphan_legs", "late_legs"]


def final_orders(states: DataFrame) -> DataFrame:
    """Every confirmed parent after the session close, with its close reason."""
    return confirmed_orders(order_results(states))


def confirmed_orders(results: DataFrame) -> DataFrame:
    return results.filter("confirmed").drop("confirmed", *LEG_COUNTS, "first_us")


def with_first_leg(states: DataFrame) -> DataFrame:
    """Adds ``first_leg``, for states that are written: their events then need no window of their own."""
    ordered, _ = _windows()
    return states.withColumn("first_leg", F.row_number().over(ordered) == 1)


#: what only the reconstruction itself reads of a leg
WORKING = ["amount", "biz_index", "incoming", "price", "paired", "has_a", "_pre"]


def kept_states(states: DataFrame) -> DataFrame:
    """The states to write: with ``first_leg`` and without what nothing reads any more."""
    return with_first_leg(states).drop(*WORKING)


def lifecycle_events(states: DataFrame) -> DataFrame:
    """Confirmed, RestQtyChanged and Closed events with the quantities after each, on the arrival clock.

    The first leg of an order also carries its confirmation; one pass over the states.
    """
    zero = F.lit(0).cast("bigint")

    def event(ms: Column, kind: Column, imm: str, pas: str, can: str, rest: str, delta: Column, born: bool = True) -> Column:
        return F.struct(
            F.lit(born).alias("at_confirmation"),
            ms.cast("bigint").alias("event_ms"), kind.alias("event"), F.col(imm).alias("immediate"), F.col(pas).alias("passive"),
            F.col(can).alias("cancelled"), F.col(rest).alias("rest"), delta.alias("delta"),
        )

    born = event(F.col("confirm_ms"), F.lit("Confirmed"), "immediate0", "passive0", "cancelled0", "rest0", zero)
    shut = event(F.col("confirm_ms"), F.lit("Closed"), "immediate0", "passive0", "cancelled0", "rest0", zero)
    moved = event(
        F.floor(F.col("local_us") / 1000), F.when(F.col("rest") == 0, "Closed").otherwise("RestQtyChanged"),
        "immediate", "passive", "cancelled", "rest", F.when(F.col("kind") == "F", F.col("qty")).otherwise(zero),
        born=False,
    )
    # an order is confirmed or not as a whole, so that its first leg stays the first
    rows = (states if "first_leg" in states.columns else with_first_leg(states.filter("confirmed"))).filter("confirmed")
    out = F.array_compact(
        F.array(
            F.when(F.col("first_leg"), born),
            F.when(F.col("first_leg") & (F.col("rest0") == 0) & (F.col("market") == SH), shut),
            F.when(F.col("live"), moved),
        )
    )
    return rows.select(*ORDER, *ORDER_KEY, F.col("order_side").alias("side"), "original", "estimated", F.col("order_price").alias("price"), F.explode(out).alias("_e")).select(
        *ORDER, *ORDER_KEY, "side", "original", "estimated", "price", "_e.*"
    )


#: what a trade pair reads of its parents
PARENT = [*ORDER, "original", "estimated", "confirm_ms", "close_key", "immediate", "passive"]


def trade_pairs(trades: DataFrame, finals: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Every trade with both parents; ``resolved`` when both were confirmed and neither had closed before it.

    The parents are those of the whole day.  With ``states`` the pair also has ``buy_filled`` and ``sell_filled``: what
    each parent had filled once this trade was counted, so that a checkpoint never sees later fills.
    """
    a = aggressor()
    t = trades.filter((F.col("trade_type") != "C") & (F.col("volume") > 0) & (F.col("buy_id") != 0) & (F.col("sell_id") != 0))
    t = t.withColumns({"aggressor": a["side"], "source": a["source"]})

    def parent(name: str) -> DataFrame:
        return finals.select(
            "date", "symbol", F.col("order_id").alias(f"{name}_id"),
            F.struct(*PARENT[2:]).alias(name),
        )

    pairs = t.join(parent("buy"), ["date", "symbol", "buy_id"], "left").join(parent("sell"), ["date", "symbol", "sell_id"], "left")
    ok = F.lit(True)
    for name, side in (("buy", 0), ("sell", 1)):
        here = F.struct(*ORDER_KEY, F.lit(side).alias("side"))
        after_close = F.coalesce(here > F.col(f"{name}.close_key"), F.lit(False))
        ok = ok & F.col(name).isNotNull() & ~after_close
    resolved_ms = F.greatest(F.floor(F.col("local_us") / 1000).cast("bigint"), F.col("buy.confirm_ms"), F.col("sell.confirm_ms"))
    for name, side in (("buy", 0), ("sell", 1)) if states is not None else ():
        own = states.filter((F.col("kind") == "F") & (F.col("side") == side))
        own = own.select("date", "symbol", F.col("order_id").alias(f"{name}_id"), *ORDER_KEY, (F.col("immediate") + F.col("passive")).alias(f"{name}_filled"))
        pairs = pairs.join(own, ["date", "symbol", f"{name}_id", *ORDER_KEY], "left")
    return pairs.withColumns({"resolved": ok, "resolved_ms": F.when(ok, resolved_ms)})


#: what is known of a parent at a moment
SNAPSHOT = ["original", "immediate", "passive", "cancelled", "rest"]


def pair_snapshots(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Resolved pairs with ``buy`` and ``sell`` replaced by the parents as they stood when the pair was resolved.

    ``events`` are the versions of the orders, with the leg of each. A pair resolved by its own trade sees what its parents were once the trade was
    counted; one resolved later, by a confirmation, sees all that had reached them by that millisecond. What happens
    afterwards changes nothing. Versions and requests meet under their order: the group is one parent, never a stock.
    """
    keys = [F.col(c).cast("bigint") for c in ORDER_KEY]
    zeros = [F.lit(0).cast("bigint") for _ in ORDER_KEY]

    def moment(ms: Column, part: Column, key: list[Column], asks: bool) -> Column:
        return F.struct(ms.cast("bigint").alias("ms"), part.cast("int").alias("part"), *[k.alias(c) for k, c in zip(key, ORDER_KEY)], F.lit(asks).alias("asks"))

    born = F.col("at_confirmation")
    at = moment(F.col("event_ms"), F.when(born, 0).otherwise(1), [F.when(born, z).otherwise(k) for z, k in zip(zeros, keys)], False)
    state = F.struct(*[F.col(c).cast("bigint").alias(c) for c in SNAPSHOT])
    late = F.col("resolved_ms") > F.floor(F.col("local_us") / 1000)
    asked = moment(F.col("resolved_ms"), F.when(late, 2).otherwise(1), [F.when(late, z).otherwise(k) for z, k in zip(zeros, keys)], True)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("order_id")) for s in ("buy", "sell")])).alias("leg")
    plain = [c for c in pairs.columns if c not in ("buy", "sell", "date", "symbol")]
    resolved = pairs.filter("resolved")
    pair = F.struct(*plain)
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in resolved.select(*plain).schema)
    versions = events.select(*ORDER, at.alias("at"), state.alias("state"), F.lit(None).cast("string").alias("leg_side"), F.lit(None).cast(f"struct<{kinds}>").alias("pair"))
    unknown = F.lit(None).cast(versions.schema["state"].dataType).alias("state")
    requests = resolved.select("date", "symbol", sides, asked.alias("at"), pair.alias("pair")).select("date", "symbol", F.col("leg.order_id").alias("order_id"), "at", unknown, F.col("leg.side").alias("leg_side"), "pair")
    met = versions.union(requests)
    upto = Window.partitionBy(*ORDER).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = met.withColumn("state", F.last("state", ignorenulls=True).over(upto)).filter("at.asks")
    whole = seen.groupBy("date", "symbol", *[F.col(f"pair.{c}").alias(f"_{c}") for c in (*ORDER_KEY, "buy_id", "sell_id")]).agg(
        F.first("pair").alias("pair"), *[F.max(F.when(F.col("leg_side") == s, F.col("state"))).alias(s) for s in ("buy", "sell")]
    )
    return whole.select("date", "symbol", "pair.*", "buy", "sell")


def reconstruct(trades: DataFrame, orders: DataFrame, watermark_ms: int = WATERMARK_MS) -> dict[str, DataFrame]:
    """The whole reconstruction as named DataFrames."""
    states = order_states(order_legs(trades, orders), watermark_ms)
    finals = final_orders(states)
    # lazy: where two of them are used, or pairs, which read the orders twice, write what they share: see ``day_pairs``
    return {"states": states, "finals": finals, "events": lifecycle_events(states), "pairs": trade_pairs(trades, finals)}


def day_pairs(trades: DataFrame, orders: DataFrame, watermark_ms: int = WATERMARK_MS) -> DataFrame:
    """The trade pairs of ``reconstruct`` from one reconstruction: the parents are written before both sides look them up."""
    return trade_pairs(trades, written(final_orders(order_states(order_legs(trades, orders), watermark_ms)).select(*PARENT)))


def _peak(spans: DataFrame, name: str) -> DataFrame:
    """By stock-day, the most spans (``from_ms``, ``to_ms``, the end not included) that are open at once."""
    ends = F.explode(F.array(F.struct(F.col("from_ms").alias("ms"), F.lit(1).alias("change")), F.struct(F.col("to_ms").alias("ms"), F.lit(-1).alias("change")))).alias("e")
    changes = spans.where("from_ms < to_ms").select("date", "symbol", ends).select("date", "symbol", "e.ms", "e.change")
    # what happens in one millisecond is one change: its order inside says nothing
    moments = changes.groupBy("date", "symbol", "ms").agg(F.sum("change").alias("change"))
    return peak_of_changes(moments, ["date", "symbol"], "change", ["ms"], F.expr("ms div 60000"), name)


def replay_peaks(results: DataFrame) -> DataFrame:
    """Most orders open at once, and most Shanghai orders waiting for their confirmation at once, in each stock-day.

    An order is open from its confirmation to the leg that closes it, or the session's close; it waits from its first
    leg's arrival to its confirmation, for ever if it never comes. ``results`` are those of ``order_results``.
    """
    leg_ms = F.floor(F.col("close_key.local_us") / 1000).cast("bigint")
    closed = F.when(F.col("close_key").isNotNull(), leg_ms).when((F.col("rest0") == 0) & (F.col("market") == SH), F.col("confirm_ms")).otherwise(F.lit(CLOSE_MS))
    active = _peak(results.filter("confirmed").select("date", "symbol", F.col("confirm_ms").alias("from_ms"), closed.alias("to_ms")), "max_active")
    until = F.coalesce(F.when(F.col("confirmed"), F.col("confirm_ms")), F.lit(CLOSE_MS))
    waiting = _peak(results.where(F.col("market") == SH).select("date", "symbol", F.floor(F.col("first_us") / 1000).cast("bigint").alias("from_ms"), until.alias("to_ms")), "max_pending")
    return active.join(waiting, ["date", "symbol"], "full").na.fill(0, ["max_active", "max_pending"])


def conservation_violations(finals: DataFrame) -> DataFrame:
    return finals.filter(F.col("original") != F.col("immediate") + F.col("passive") + F.col("cancelled") + F.col("rest"))


def arrival_inversions(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Shanghai adds joined with the trade just before them in exchange order; positive when the trade arrived later."""
    adds = orders.filter((F.col("market") == SH) & (F.col("order_type") == "A")).select("date", "symbol", F.col("orderorino").alias("order_id"), (F.col("biz_index") - 1).alias("biz_index"), F.col("local_us").alias("a_us"))
    legs = trades.filter((F.col("market") == SH) & (F.col("trade_type") != "C")).select(
        "date", "symbol", "biz_index", F.col("local_us").alias("t_us"), "serial", F.explode(F.array_distinct(F.array("buy_id", "sell_id"))).alias("order_id")
    )
    j = adds.join(legs, ["date", "symbol", "order_id", "biz_index"])
    return j.withColumn("inversion_us", F.greatest(F.lit(0).cast("bigint"), F.col("t_us") - F.col("a_us")))
