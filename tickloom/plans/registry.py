"""Factor families as registered DataFrame transforms.

A family is a function ``(streams, cuts) -> DataFrame`` with the key columns
``date, symbol, event`` and, per factor, the value plus a readiness reason.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.cuts import family_cuts
from tickloom.schema import REASON

KEYS = ["date", "symbol", "event"]


@dataclass(frozen=True)
class Streams:
    """The three tick streams of a run; any of them may be absent."""

    quotes: DataFrame | None = None
    trades: DataFrame | None = None
    orders: DataFrame | None = None

    def present(self) -> list[DataFrame]:
        return [s for s in (self.quotes, self.trades, self.orders) if s is not None]


@dataclass(frozen=True)
class Family:
    name: str
    columns: tuple[str, ...]
    build: Callable[[Streams | DataFrame, DataFrame], DataFrame]
    cross_sectional: bool = False
    events: tuple[int, ...] | None = None
    inputs: tuple[str, ...] = field(default=())


FAMILIES: dict[str, Family] = {}


def default_names(family: str, size: int) -> tuple[str, ...]:
    """Names of a family that declares only how many columns it has."""
    return tuple(f"{family}_F{i:03d}" for i in range(size))


def factor_family(
    name: str,
    columns: Sequence[str] | int,
    *,
    cross_sectional: bool = False,
    events: Sequence[int] | None = None,
    inputs: Sequence[str] = (),
):
    """Register a family; a second registration under the same name is refused.

    ``build(streams, cuts)`` returns the keys, the columns and their readiness.  A cross-sectional family instead gets
    the panel of all symbols, with the columns of the per-symbol families, as its first argument.
    """
    names = default_names(name, columns) if isinstance(columns, int) else tuple(columns)

    def register(build: Callable[[Streams, DataFrame], DataFrame]):
        if name in FAMILIES:
            raise ValueError(f"factor family {name} is already registered")
        if len(set(names)) != len(names):
            raise ValueError(f"factor family {name} repeats a column")
        FAMILIES[name] = Family(name, names, build, cross_sectional, tuple(events) if events else None, tuple(inputs))
        return build

    return register


def with_readiness(panel: DataFrame, columns: Sequence[str], reasons: dict[str, Column] | None = None) -> DataFrame:
    """Add ``ready_<f>`` and ``reason_<f>``; without a rule a NULL value is not ready for an unknown reason.

    Ready always means reason 0, and a value that is not ready is NULL, never 0.
    """
    reasons = reasons or {}
    out = {}
    for c in columns:
        default = F.when(F.col(c).isNotNull(), REASON["ready"]).otherwise(REASON["unknown"])
        out[f"reason_{c}"] = reasons.get(c, default).cast("short")
    panel = panel.withColumns(out)
    return panel.withColumns({f"ready_{c}": F.col(f"reason_{c}") == REASON["ready"] for c in columns})


def build_panel(streams: Streams, cuts: DataFrame, families: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Families side by side in the order given, every code at every checkpoint.

    Families that share the key layout join on ``(date, symbol, event)``; a factor absent for a
    key is NULL with reason ``no_input``.
    """
    from tickloom.operators.cuts import grid_at_cuts

    if codes is None:
        from functools import reduce

        codes = reduce(DataFrame.union, [s.select("date", "symbol") for s in streams.present()]).distinct()
    panel = grid_at_cuts(codes, cuts)
    columns = [c for name in families for c in FAMILIES[name].columns]
    # a cross-sectional family reads the columns of the others at the same checkpoint, so it comes after them
    for name in sorted(families, key=lambda n: FAMILIES[n].cross_sectional):
        family = FAMILIES[name]
        if family.cross_sectional:
            there = panel if family.events is None else panel.filter(F.col("event").isin(*family.events))
            built = family.build(there, cuts)
        else:
            built = family.build(streams, family_cuts(cuts, family.events))
        panel = panel.join(built, KEYS, "left")
    fill = {f"reason_{c}": F.coalesce(F.col(f"reason_{c}"), F.lit(REASON["no_input"]).cast("short")) for c in columns}
    fill |= {f"ready_{c}": F.coalesce(F.col(f"ready_{c}"), F.lit(False)) for c in columns}
    panel = panel.withColumns(fill)
    return panel.select(*KEYS, *columns, *[f"ready_{c}" for c in columns], *[f"reason_{c}" for c in columns])
