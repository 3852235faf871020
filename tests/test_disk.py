"""What a step leaves on disk: narrow tables and shuffles, and nothing that is no longer read."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.catalog import load
from tickloom.session import checkpoint_dir, drop_written, written

DAY = pd.Timestamp("1995-03-01")


def tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("table-")}


@pytest.fixture
def feed(tmp_path):
    """A few hundred lines and their orders."""
    n = np.arange(400)
    key = n // 4
    pd.DataFrame({
        "l_orderkey": key, "l_partkey": n % 30, "l_suppkey": key % 3, "l_linenumber": (1 + n % 4).astype("int32"), "l_quantity": 1.0 + n % 9, "l_extendedprice": 900.0 + n, "l_discount": 0.0, "l_tax": 0.0,
        "l_returnflag": np.where(n % 3 == 0, "A", np.where(n % 3 == 1, "R", "N")), "l_linestatus": "O", "l_shipdate": (DAY + pd.to_timedelta(n % 50, "D")).astype("datetime64[us]"),
    }).to_parquet(tmp_path / "lineitem.parquet")
    k = np.arange(100)
    pd.DataFrame({"o_orderkey": k, "o_orderdate": (DAY + pd.to_timedelta(k % 40, "D")).astype("datetime64[us]"), "o_totalprice": 20_000.0 + 1000 * k}).to_parquet(tmp_path / "orders.parquet")
    return str(tmp_path)


def test_a_written_table_can_go(spark):
    before = tables(spark)
    df = written(spark.range(10))
    assert df.agg(F.sum("id")).first()[0] == 45 and len(tables(spark) - before) == 1
    drop_written(df)
    assert tables(spark) == before


def test_pairs_travel_with_what_is_asked_for(spark, feed):
    before = tables(spark)
    out = load()[0]["trade_pairs"](spark, feed)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "trade_index" not in plan and "bsflag" not in plan and out.count() > 0
    assert len(tables(spark) - before) == 2  # states and pairs; the parents are gone
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


@pytest.mark.parametrize("name", ["market_microstructure_family", "demo_family"])
def test_families_leave_no_states_behind(spark, feed, name):
    before = tables(spark)
    load()[0][name](spark, feed)
    folder = checkpoint_dir(spark).removeprefix("file:")
    left = [set(spark.read.parquet(f"{folder}/{table}").columns) for table in tables(spark) - before]
    assert left and not any(c & {"first_leg", "_calm", "o9", "buy_id", "close_key"} for c in left)


def test_flows_of_a_written_series_are_those_of_the_books(spark, tmp_path):
    from tests.test_passes import cuts_of, market
    from tickloom.operators.ofi import flow_series
    from tickloom.plans.demo_family import flows
    from tickloom.plans.registry import Streams

    df = market(spark, tmp_path)
    book = [F.array(*[F.get(n, F.lit(0)) + F.lit(i).cast("bigint") for i in range(10)]).alias(n) for n in ("bp", "bv", "ap", "av")]
    quotes = df.select(*[c for c in df.columns if c not in ("bp", "bv", "ap", "av")], *book)
    streams, cuts = Streams(quotes, df, df), cuts_of(spark, [(300_000_000, 0, 0, 0), (10**12, 0, 0, 0)])
    got, want = (sorted(map(tuple, f.collect())) for f in (flows(streams, cuts, flow_series(quotes, [])), flows(streams, cuts)))
    assert got == want and len(got) == 4
