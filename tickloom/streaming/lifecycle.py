"""Stateful order reconstruction and pair resolution on a stream of order legs.

Orders of a stock-day are dealt over buckets by their id, so a busy stock spreads over the cluster. A bucket is one
group of the stateful operator: a micro-batch brings all legs of its orders in one call, which advances
all orders of the bucket together, leg by leg in numpy. Its state is one value with three packed tables: orders, the
fragments of those still pending, and fills that wait for their parent. The rule that confirms a
Shanghai order is the batch rule (the arrival clock has passed the latest event time by the watermark); an event-time
timer at the earliest deadline of the bucket applies it when no later record arrives, and a last one closes what is
left at the end of the session.

PySpark hands a stateful operator its rows one by one, at some tens of microseconds each. So a task packs what it has read
of a bucket into one value of fixed-size records before the shuffle, some hundreds of thousands of rows at a time, and
the operator gets a row for many legs. A packed row has the latest event time of its legs: one that is late beside others that
are not is still taken, as the batch rule takes it; a row that is late as a whole is dropped by Spark.

A fill whose trade names both parents leaves the bucket once its own parent is known. A second operator, over buckets
of trades, holds such halves until both are there. Both parents as they stood then come from the events that have
left by that time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.scalar import SZ
from tickloom.operators.lifecycle import CLOSE_MS, LEG_ORDER, WATERMARK_MS, order_legs, pair_snapshots
from tickloom.schema import ORDER_KEY

#: groups that the orders, or trades, of a stock-day are dealt over
BUCKETS = 32
#: rows that a task packs at once
CHUNK = 1 << 18
DEALT, GROUP = ["date", "symbol", "bucket"], ["date", "stock", "bucket"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = (
    "date string, symbol string, order_id bigint, event_ms bigint, event string, close_reason string, side int, original bigint, immediate bigint, "
    "passive bigint, cancelled bigint, rest bigint, estimated boolean, delta bigint, at_confirmation boolean, local_us bigint, exch_ms bigint, channel bigint, serial bigint"
)
PAIRS = (
    "date string, symbol string, local_us bigint, exch_ms bigint, channel bigint, serial bigint, buy_id bigint, sell_id bigint, "
    "estimated boolean, resolved boolean, resolved_ms bigint"
)
PENDING, OPEN, CLOSED = 0, 1, 2
CONFIRMED, CHANGED, SHUT, KNOWN, UNKNOWN = range(5)
#: a parent's events; the last two are halves of pairs, whose parent became known, or never will
NAMES = np.array(["Confirmed", "RestQtyChanged", "Closed", "ParentKnown", "ParentUnknown"], object)
REASONS = np.array([None, "FullyFilledOnArrival", "FullyFilledAfterResting", "Cancelled", "SessionClose"], object)
ON_ARRIVAL, RESTING, CANCELLED, SESSION = 1, 2, 3, 4
KINDS = {"A": 0, "D": 1, "C": 2, "F": 3}
ADD, DELETE, FILL = KINDS["A"], KINDS["D"], KINDS["F"]

_KEY = [(c, "<i8") for c in ORDER_KEY]
_QUANTITIES = ["original", "immediate", "passive", "cancelled", "rest"]
ORDER_T = np.dtype(
    [("order_id", "<i8"), ("phase", "i1"), ("market", "<i2"), ("side", "i1"), *[(q, "<i8") for q in _QUANTITIES], ("estimated", "?"), ("has_a", "?"), ("incoming", "?"), ("by_leg", "?"),
     ("a_qty", "<i8"), ("a_biz", "<i8"), ("latest", "<i8"), ("confirm_ms", "<i8")]
)
FRAGMENT_T = np.dtype([("order_id", "<i8"), ("biz", "<i8"), ("qty", "<i8"), ("incoming", "?")])
HALF_T = np.dtype([("order_id", "<i8"), ("side", "i1"), *_KEY])
LEG_T = np.dtype([*_KEY, ("side", "i1"), ("order_id", "<i8"), ("market", "<i2"), ("kind", "i1"), ("qty", "<i8"), ("biz", "<i8"), ("incoming", "?"), ("paired", "?")])
EVENT_T = np.dtype([("order_id", "<i8"), ("event_ms", "<i8"), ("event", "i1"), ("reason", "i1"), ("side", "i1"), *[(q, "<i8") for q in _QUANTITIES], ("estimated", "?"), ("delta", "<i8"), ("born", "?"), *_KEY])


def event_time(date: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(F.to_date(date, "yyyyMMdd").cast("timestamp")) + ms)


def midnight_ms(date: str) -> int:
    return int(dt.datetime.strptime(date, "%Y%m%d").replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


class Bucket:
    """The orders of a bucket and what their legs cause; all orders move at once, each by one leg at a time."""

    def __init__(self, orders: bytes = b"", fragments: bytes = b"", halves: bytes = b""):
        self.orders = np.frombuffer(orders, ORDER_T).copy()  # sorted by id
        self.fragments = np.frombuffer(fragments, FRAGMENT_T)
        self.halves = np.frombuffer(halves, HALF_T)
        self.out: list[np.ndarray] = []

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.orders.tobytes(), self.fragments.tobytes(), self.halves.tobytes()

    def eligible(self) -> np.ndarray:
        o = self.orders
        return (o["phase"] == PENDING) & (o["has_a"] | o["incoming"]) & (o["market"] != SZ)

    def deadline(self) -> int | None:
        """Event time that has to pass before the next order is confirmed without a further leg."""
        due = self.orders["latest"][self.eligible()]
        return int(due.min()) if len(due) else None

    def advance(self, legs: np.ndarray) -> None:
        legs = legs[np.lexsort([legs[c] for c in reversed(LEG_ORDER)])]
        ids = np.union1d(self.orders["order_id"], legs["order_id"])
        grown = np.zeros(len(ids), ORDER_T)
        grown["order_id"] = ids
        grown[np.searchsorted(ids, self.orders["order_id"])] = self.orders
        self.orders = grown
        at = np.searchsorted(ids, legs["order_id"])
        order = np.argsort(at, kind="stable")
        nth = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        for k in range(int(nth.max()) + 1 if len(nth) else 0):
            now = order[nth == k]
            self._step(at[now], legs[now])

    def _step(self, p: np.ndarray, leg: np.ndarray) -> None:
        """One leg for each of the orders at ``p``."""
        o, clock = self.orders, leg["local_us"] // 1000
        due = self.eligible()[p] & (clock > o["latest"][p] + WATERMARK_MS)
        if due.any():
            self._confirm(p[due])
        phase, add, fill = o["phase"][p], leg["kind"] == ADD, leg["kind"] == FILL
        half = fill & leg["paired"]
        if half.any():
            wait = half & (phase == PENDING)
            told = half & ~wait
            self._halves(self._as_halves(leg[told]), p[told], ~o["by_leg"][p[told]])
            self.halves = np.concatenate([self.halves, self._as_halves(leg[wait])])
        live = (phase == OPEN) & ~add
        if live.any():
            self._take(p[live], leg[live], clock[live])
        pending = phase == PENDING
        born = pending & (leg["market"] == SZ) & add
        if born.any():
            q = p[born]
            for name, value in (("market", SZ), ("side", leg["side"][born]), ("phase", OPEN), ("original", leg["qty"][born]), ("rest", leg["qty"][born]), ("has_a", True), ("confirm_ms", clock[born])):
                o[name][q] = value
            self._emit(q, clock[born], CONFIRMED, born=True)
            o["phase"][q[o["rest"][q] == 0]] = CLOSED
            self._release(q)
        grow = pending & (leg["market"] != SZ)
        if grow.any():
            self._collect(p[grow], leg[grow])

    def _collect(self, p: np.ndarray, leg: np.ndarray) -> None:
        """Fragments of Shanghai orders that are not confirmed yet."""
        o = self.orders
        fresh = o["latest"][p] == 0
        o["market"][p[fresh]], o["side"][p[fresh]] = leg["market"][fresh], leg["side"][fresh]
        o["latest"][p] = np.maximum(o["latest"][p], leg["exch_ms"])
        add, gone, fill = (leg["kind"] == k for k in (ADD, DELETE, FILL))
        o["has_a"][p[add]], o["a_qty"][p[add]], o["a_biz"][p[add]] = True, leg["qty"][add], leg["biz"][add]
        o["cancelled"][p[gone]] += leg["qty"][gone]
        o["incoming"][p[fill]] |= leg["incoming"][fill]
        more = np.zeros(int(fill.sum()), FRAGMENT_T)
        for name in ("order_id", "biz", "qty", "incoming"):
            more[name] = leg[name][fill]
        self.fragments = np.concatenate([self.fragments, more])

    def _take(self, p: np.ndarray, leg: np.ndarray, clock: np.ndarray) -> None:
        """Legs of open orders: Shenzhen counts the whole fill, Shanghai what the remainder allowed."""
        o, fill, sz = self.orders, leg["kind"] == FILL, leg["market"] == SZ
        applied = np.minimum(o["rest"][p], leg["qty"])
        counted = np.where(fill, np.where(o["market"][p] == SZ, leg["qty"], applied), 0)
        active = (o["market"][p] == SZ) & sz & leg["incoming"]
        o["immediate"][p] += np.where(active, counted, 0)
        o["passive"][p] += np.where(active, 0, counted)
        o["cancelled"][p] += np.where(fill, 0, applied)
        o["rest"][p] -= applied
        shut = o["rest"][p] == 0
        o["phase"][p[shut]], o["by_leg"][p[shut]] = CLOSED, True
        self._emit(p, clock, np.where(shut, SHUT, CHANGED), np.where(shut, np.where(fill, RESTING, CANCELLED), 0), np.where(fill, leg["qty"], 0), key=leg)

    def _confirm(self, p: np.ndarray) -> None:
        """Shanghai: split the fragments around the add and fix the original quantity; ``p`` is sorted or not, without repeats."""
        o = self.orders
        p = np.sort(p)
        ids = o["order_id"][p]
        f = self.fragments
        spot = np.minimum(np.searchsorted(ids, f["order_id"]), len(ids) - 1)
        mine = ids[spot] == f["order_id"]
        f, spot, self.fragments = f[mine], spot[mine], f[~mine]
        q = p[spot]
        has = o["has_a"][q]
        before = np.where(has, f["biz"] < o["a_biz"][q], f["incoming"])
        behind = has & (f["biz"] > o["a_biz"][q])
        np.add.at(o["immediate"], q, np.where(before, f["qty"], 0))
        np.add.at(o["passive"], q, np.where(behind, f["qty"], 0))
        has = o["has_a"][p]
        o["original"][p] = np.where(has, o["a_qty"][p], 0) + o["immediate"][p]
        o["rest"][p] = np.where(has, np.maximum(0, o["a_qty"][p] - o["passive"][p] - o["cancelled"][p]), 0)
        o["estimated"][p] = ~has
        o["confirm_ms"][p] = np.minimum(o["latest"][p] + WATERMARK_MS, CLOSE_MS)
        o["phase"][p] = OPEN
        self._emit(p, o["confirm_ms"][p], CONFIRMED, born=True)
        shut = p[o["rest"][p] == 0]
        o["phase"][shut] = CLOSED
        reason = np.where(o["estimated"][shut], ON_ARRIVAL, np.where(o["cancelled"][shut] > 0, CANCELLED, RESTING))
        self._emit(shut, o["confirm_ms"][shut], SHUT, reason, born=True)
        self._release(p)

    def expire(self, event_ms: int) -> None:
        """Confirms what the event clock has passed."""
        due = np.flatnonzero(self.eligible() & (self.orders["latest"] < event_ms))
        if len(due):
            self._confirm(due)

    def close(self) -> None:
        """End of the session: an open remainder is cancelled, what is not known by now never will be."""
        due = np.flatnonzero(self.eligible())
        if len(due):
            self._confirm(due)
        o = self.orders
        left = np.flatnonzero(o["phase"] == OPEN)
        o["cancelled"][left] += o["rest"][left]
        o["rest"][left], o["phase"][left] = 0, CLOSED
        self._emit(left, np.full(len(left), CLOSE_MS), SHUT, SESSION)
        self._halves(self.halves, np.searchsorted(o["order_id"], self.halves["order_id"]), np.zeros(len(self.halves), bool))
        self.halves = self.halves[:0]

    def _as_halves(self, leg: np.ndarray) -> np.ndarray:
        out = np.zeros(len(leg), HALF_T)
        for name in HALF_T.names:
            out[name] = leg[name]
        return out

    def _release(self, p: np.ndarray) -> None:
        """Halves that waited for the orders at ``p``."""
        where = np.searchsorted(self.orders["order_id"], self.halves["order_id"])
        free = np.isin(where, p)
        if free.any():
            self._halves(self.halves[free], where[free], np.ones(int(free.sum()), bool))
            self.halves = self.halves[~free]

    def _halves(self, halves: np.ndarray, p: np.ndarray, known: np.ndarray) -> None:
        self._emit(p, self.orders["confirm_ms"][p], np.where(known, KNOWN, UNKNOWN), key=halves, side=halves["side"])

    def _emit(self, p, ms, event, reason=0, delta=0, born: bool = False, key: np.ndarray | None = None, side=None) -> None:
        if not len(p):
            return
        out = np.zeros(len(p), EVENT_T)
        for name in ("order_id", "side", *_QUANTITIES, "estimated"):
            out[name] = self.orders[name][p]
        out["event_ms"], out["event"], out["reason"], out["delta"], out["born"] = ms, event, reason, delta, born
        if side is not None:
            out["side"] = side
        if key is not None:
            for name in ORDER_KEY:
                out[name] = key[name]
        self.out.append(out)

    def frame(self, date: str, symbol: str, wanted: Sequence[int] | None = None) -> pd.DataFrame | None:
        """What has been emitted since, as rows of EVENTS with codes for names and reasons; ``wanted`` are codes of events, else all."""
        parts = self.out if wanted is None else [e[np.isin(e["event"], wanted)] for e in self.out]
        self.out = []
        if not sum(map(len, parts)):
            return None
        e = np.concatenate(parts)
        columns = {"date": date, "symbol": symbol, "order_id": e["order_id"], "event_ms": e["event_ms"], "event": e["event"].astype(np.int32), "close_reason": e["reason"].astype(np.int32), "side": e["side"].astype(np.int32)}
        columns |= {q: e[q] for q in _QUANTITIES} | {"estimated": e["estimated"], "delta": e["delta"], "at_confirmation": e["born"]} | {c: e[c] for c in ORDER_KEY}
        return pd.DataFrame(columns, index=range(len(e)))


def _pack(batches: Iterator[pa.RecordBatch], record: np.dtype, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT, ``event_ms`` and the fields of ``record`` to one row for each bucket in a chunk."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        code = np.zeros(len(table), np.int64)
        for name in DEALT:
            known = table[name].combine_chunks().dictionary_encode("encode")  # nulls are a value of their own
            code = code * len(known.dictionary) + known.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        own = np.zeros(len(order), record)
        for name in record.names:
            own[name] = table[name].fill_null(False if record[name] == bool else 0).to_numpy()[order]
        ends = (np.append(first, len(order)) * record.itemsize).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
        latest = np.maximum.reduceat(table["event_ms"].fill_null(0).to_numpy()[order], first)
        heads = table.select(DEALT).take(pa.array(order[first]))
        return pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() for c in DEALT), pa.array(latest), values], [*DEALT, "event_ms", "packed"])

    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        parts.append(batch)
        held += batch.num_rows
        if held >= chunk:
            yield packed(parts)
            parts, held = [], 0
    if held:
        yield packed(parts)


def pack(rows: DataFrame, record: np.dtype, buckets: int, *dealt_by: str, chunk: int = CHUNK) -> DataFrame:
    """``rows``, dealt over buckets, as groups with ``event_ms`` (the latest) and ``packed``: the records of many rows in one value.

    The group of a row is in texts: other types of keys do not reach the state whole.
    """
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*dealt_by), F.lit(buckets)).cast("int")).select(*DEALT, "event_ms", *record.names)
    symbol = rows.schema["symbol"].dataType.simpleString()
    whole = dealt.mapInArrow(lambda batches: _pack(batches, record, chunk), f"date string, symbol {symbol}, bucket int, event_ms bigint, packed binary")
    return whole.select("date", F.coalesce(F.col("symbol").cast("string"), F.lit("")).alias("stock"), F.col("bucket").cast("string").alias("bucket"), "event_ms", "packed")


def _unpacked(rows: Iterator[pd.DataFrame], record: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(value for pdf in rows for value in pdf["packed"]), record)


def _named(code: str, names: np.ndarray) -> Column:
    """The name of a code, by its place."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(code) + 1).alias(code)


class OrderProcessor(StatefulProcessor):
    """State and timers of the buckets: one value and the earliest deadline of each; ``wanted`` are codes of the events that leave, else all."""

    def __init__(self, wanted: Sequence[int] | None = None):
        self.wanted = wanted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "orders binary, fragments binary, halves binary, timer bigint")

    def _load(self) -> tuple[Bucket, int]:
        kept = self.state.get()
        return (Bucket(*map(bytes, kept[:3])), int(kept[3])) if kept is not None else (Bucket(), 0)

    def _keep(self, key: tuple, bucket: Bucket, timer: int) -> None:
        """Saves the bucket; a timer that comes too early finds nothing to do."""
        base, due = midnight_ms(key[0]), bucket.deadline()
        wanted = base + min(CLOSE_MS, CLOSE_MS if due is None else due + 1)
        if not timer or wanted < timer:
            self.handle.registerTimer(wanted)
            timer = wanted
        self.state.update((*bucket.packed(), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[1]:  # heartbeats only move the watermark
            return
        bucket, timer = self._load()
        bucket.advance(_unpacked(rows, LEG_T))
        self._keep(key, bucket, timer)
        out = bucket.frame(key[0], key[1], self.wanted)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket, _ = self._load()
        event_ms = timerValues.getCurrentWatermarkInMs() - midnight_ms(key[0])
        if event_ms >= CLOSE_MS:
            bucket.close()
            self.state.clear()
            for left in self.handle.listTimers():
                self.handle.deleteTimer(left)
        else:
            bucket.expire(event_ms)
            self._keep(key, bucket, 0)
        out = bucket.frame(key[0], key[1], self.wanted)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


def session_ends(dates: DataFrame, ms: int = CLOSE_MS) -> DataFrame:
    """A heartbeat after ``ms`` of each ``date``, late enough to pass every watermark of the session."""
    return dates.select("date", F.lit(ms + 2 * WATERMARK_MS).cast("bigint").alias("exch_ms"))


def lifecycle_stream(trades: DataFrame, orders: DataFrame, heartbeat: DataFrame | None = None, buckets: int = BUCKETS, events: Sequence[str] | None = None) -> DataFrame:
    """Lifecycle events of two tick streams and the halves of their pairs, in append mode; see EVENTS.

    ``heartbeat`` (date, exch_ms) is a stream of clock messages: without one the last day closes only when a record
    of the next day arrives. ``events`` names those that leave the operator, else all do.
    """
    legs = order_legs(trades, orders)
    kinds = legs.schema
    if heartbeat is not None:
        legs = legs.unionByName(heartbeat.select("date", "exch_ms"), allowMissingColumns=True)
    kind = F.coalesce(*[F.when(F.col("kind") == name, code) for name, code in KINDS.items()])
    legs = legs.withColumns({"event_ms": F.col("exch_ms"), "kind": kind, "biz": F.col("biz_index")})
    trades.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    packed = pack(legs, LEG_T, buckets, "order_id").withColumn("event_time", event_time(F.col("date"), F.col("event_ms"))).drop("event_ms")
    dealt = packed.withWatermark("event_time", f"{WATERMARK_MS // 1000} seconds").groupBy(*GROUP)
    coded = EVENTS.replace(" event string, close_reason string,", " event int, close_reason int,")
    wanted = None if events is None else [code for code, name in enumerate(NAMES) if name in events]
    told = dealt.transformWithStateInPandas(OrderProcessor(wanted), coded, "Append", "EventTime")
    return told.withColumns({"symbol": F.col("symbol").cast(kinds["symbol"].dataType), "event": _named("event", NAMES), "close_reason": _named("close_reason", REASONS)})


class PairProcessor(StatefulProcessor):
    """Halves of pairs wait in one packed value of their bucket until both parents are told; nothing is left behind, as every half is told by the end of its session."""

    HALF = np.dtype([*_KEY, ("side", "i1"), ("order_id", "<i8"), ("confirm_ms", "<i8"), ("estimated", "?"), ("known", "?")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("halves", "halves binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get()
        new = _unpacked(rows, self.HALF)
        h = np.concatenate([np.frombuffer(bytes(kept[0]), self.HALF), new]) if kept is not None else new
        h = h[np.lexsort([h[c] for c in ("side", *reversed(ORDER_KEY))])]
        pair = np.zeros(len(h), bool)  # a buying half and the selling one behind it
        pair[:-1] = (h["side"][:-1] == 0) & (h["side"][1:] == 1) & np.logical_and.reduce([h[c][:-1] == h[c][1:] for c in ORDER_KEY])
        first = np.flatnonzero(pair)
        left = np.ones(len(h), bool)
        left[first] = left[first + 1] = False
        if left.any():
            self.state.update((h[left].tobytes(),))
        else:
            self.state.clear()
        if len(first):
            b, s = h[first], h[first + 1]
            both = b["known"] & s["known"]
            moment = np.maximum(b["local_us"] // 1000, np.maximum(b["confirm_ms"], s["confirm_ms"]))
            columns = {"date": key[0], "symbol": key[1]} | {c: b[c] for c in ORDER_KEY} | {"buy_id": b["order_id"], "sell_id": s["order_id"], "estimated": b["estimated"] | s["estimated"], "resolved": both}
            yield pd.DataFrame(columns | {"resolved_ms": pd.array(np.where(both, moment, 0), "Int64").copy()}, index=range(len(b))).assign(resolved_ms=lambda d: d["resolved_ms"].where(d["resolved"]))

    def close(self) -> None:
        pass


def pair_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Pairs of a stream of EVENTS (the sink of ``lifecycle_stream``) as soon as both parents are known; see PAIRS.

    A pair of which a parent stays unknown, or had closed before the trade, comes with ``resolved`` false.
    """
    halves = events.filter(F.col("event").isin(*NAMES[[KNOWN, UNKNOWN]])).withColumns({"confirm_ms": F.col("event_ms"), "known": F.col("event") == NAMES[KNOWN]})
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pairs = pack(halves, PairProcessor.HALF, buckets, "local_us", "serial").groupBy(*GROUP).transformWithStateInPandas(PairProcessor(), PAIRS, "Append", "None")
    return pairs.withColumn("symbol", F.col("symbol").cast(events.schema["symbol"].dataType))


def resolved_pairs(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs of ``pair_stream`` with both parents as they stood, from the events that the lifecycle sink has by then."""
    versions = events.filter(F.col("event").isin(*NAMES[[CONFIRMED, CHANGED, SHUT]]) & F.coalesce(F.col("close_reason") != REASONS[SESSION], F.lit(True)))
    return pair_snapshots(pairs, versions)
