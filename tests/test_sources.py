"""Round trips of the tick, panel and report sources."""

import pytest
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.sources import ledger, panels, ticks


def _rows(spark, struct, n=6):
    """Typed rows of a tick schema: two dates, three symbols, other columns NULL unless simple numbers."""
    base = spark.range(n).select(
        *[
            (
                F.when(F.col("id") < n // 2, "20240102").otherwise("20240103") if f.name == "date"
                else (F.col("id") % 3).cast("string") if f.name == "symbol"
                else F.col("id") if f.dataType.simpleString() in ("bigint", "int")
                else F.lit(None)
            ).cast(f.dataType).alias(f.name)
            for f in struct
        ]
    )
    return base


@pytest.mark.parametrize("name, struct, message", [("quotes", schema.QUOTE, "quote"), ("trades", schema.TRADE, "trade"), ("orders", schema.ORDER, "order"), ("order_queue", schema.ORDER_QUEUE, "order_queue")])
def test_tick_scans_prune_and_keep_the_schema(spark, tmp_path, name, struct, message):
    _rows(spark, struct).write.partitionBy("date").parquet(f"{tmp_path}/mi_type={ticks.MESSAGE[message]}")
    got = getattr(ticks, name)(spark, str(tmp_path), dates=["20240102"], symbols=["1"])
    assert {f.name: f.dataType for f in got.schema} == {f.name: f.dataType for f in struct}
    assert [(r.date, r.symbol) for r in got.collect()] == [("20240102", "1")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(symbol,1)" in plan


def test_queue_details(spark):
    q = spark.sql("SELECT '20240102' AS date, '1' AS symbol, 0 AS side, 10L AS price, 5L AS serial, array(7, 8) AS qty")
    assert [(r.place, r.queued) for r in ticks.queue_details(q).collect()] == [(0, 7), (1, 8)]


def test_combined_rows_split_by_message(spark):
    df = _rows(spark, schema.TRADE, 4).withColumn("order_index", F.lit(9).cast("bigint"))
    df = df.withColumn("mi_type_quote", F.element_at(F.array(*map(F.lit, (256, 254, 257, 253))), (F.col("serial") + 1).cast("int")))
    trade, order = ticks.split_order_trade(df)
    assert trade.count() == order.count() == 2
    assert [f.name for f in trade.schema] == [f.name for f in schema.TRADE] and {r.order_index for r in order.collect()} == {9}


def test_futures_follow_the_contract_of_the_day(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('20240102', 'IF2401', 1.0D), ('20240102', 'IF2402', 2.0D), ('20240103', 'IF2402', 3.0D), ('20240103', 'IC2401', 4.0D) AS t(date, symbol, px)").write.parquet(f"{tmp_path}/f")
    contracts = spark.sql("SELECT * FROM VALUES ('20240102', 'IF', 'IF2401'), ('20240103', 'IF', 'IF2402'), ('20240103', 'IC', 'IC2401') AS t(date, product, symbol)")
    assert {r.px for r in ticks.futures(spark, f"{tmp_path}/f", "IF", contracts).collect()} == {1.0, 3.0}
    assert {r.px for r in ticks.futures(spark, f"{tmp_path}/f", "IF", contracts, ["20240103"]).collect()} == {3.0}


def test_labels_need_their_exact_column(spark, tmp_path):
    spark.sql("SELECT '1' AS symbol, '20240102' AS date, 1L AS event, 0.5D AS v_1D_v_demean").write.parquet(f"{tmp_path}/l")
    assert panels.read_labels(spark, f"{tmp_path}/l", "v_1D_v_demean").first().v_1D_v_demean == 0.5
    with pytest.raises(ValueError):
        panels.read_labels(spark, f"{tmp_path}/l", "v_1D_v_neuted")


def test_candidates_must_be_the_expected_set(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"candidate_id": "a", "family_id": "f", "canonical_hash": "h", "parameters": {"w": "16"}}')
    (tmp_path / "b.json").write_text('{"candidate_id": "b", "family_id": "f", "canonical_hash": "i", "parameters": {"w": "32"}}')
    assert {r.candidate_id: r.parameters["w"] for r in ledger.read_candidates(spark, str(tmp_path), ["a", "b"]).collect()} == {"a": "16", "b": "32"}
    with pytest.raises(ValueError):
        ledger.read_candidates(spark, str(tmp_path), ["a", "b", "c"])


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_reports_are_replaced(spark, tmp_path, fmt):
    for value in ("1", "2"):
        panels.write_report(spark.createDataFrame([(value, "x")], "a string, b string"), f"{tmp_path}/r", fmt)
    back = spark.read.format(fmt).option("header", True).load(f"{tmp_path}/r")
    assert [(str(r.a), r.b) for r in back.collect()] == [("2", "x")]


def test_disjoint_dates_and_saved_events(spark):
    a, b = (spark.createDataFrame([(d, 1), (d, 2)], "date string, event int") for d in ("20240102", "20240103"))
    panels.require_disjoint(a, b, "date")
    with pytest.raises(ValueError):
        panels.require_disjoint(a, a.unionByName(b), "date")
    assert [r.event for r in panels.save_times(a, [2]).collect()] == [2] and panels.save_times(a, None).count() == 2


def test_incomplete_matrices_are_refused(spark):
    rows = [(x, u, f, 0.1) for x in ("l1", "l2") for u in ("u1", "u2") for f in ("a", "b")]
    df = lambda own: spark.createDataFrame(own, "label string, universe string, factor string, IC double")
    labels, universes = ["l1", "l2"], ["u1", "u2"]
    assert panels.require_complete(df(rows), labels, universes, 2).count() == 8
    for own, n in ((rows[:-2], None), (rows[:-1], None), (rows, 3), ([], None)):
        with pytest.raises(ValueError):
            panels.require_complete(df(own), labels, universes, n)


def test_coverage_counts_what_is_finite(spark):
    rows = [("a", 0.1, 1.0), ("a", None, 2.0), ("a", float("nan"), 3.0), ("a", float("inf"), None), ("b", 0.5, 0.5)]
    c = panels.metric_coverage(spark.createDataFrame(rows, "factor string, IC double, LS double"), ["factor"], ["IC", "LS"])
    assert sorted(map(tuple, c.collect())) == [("a", 0.25, 0.75, 2, True), ("b", 1.0, 1.0, 0, False)]
    with pytest.raises(ValueError):
        panels.require_finite(c)
    assert panels.require_finite(c.where("factor = 'b'")).count() == 1


def test_coverage_after_the_warm_up(spark):
    """Warm-up rows neither cover nor lower the coverage; a column that is constant with them is constant."""
    rows = [(i, None if i < 3 else float(i), True, 5.0 if i < 9 else None, True) for i in range(10)]
    df = spark.createDataFrame(rows, "at int, a double, ready_a boolean, b double, ready_b boolean").withColumn("g", F.lit(1))
    got = {r.factor: r for r in panels.column_quality(df, ["a", "b"], ["g"], warm_up=F.col("at") < 3).collect()}
    assert (got["a"].row_count, got["a"].finite_count, got["a"].coverage, got["a"].unique_count, got["a"].status) == (10, 7, 1.0, 7, "technical_pass")
    assert got["b"].coverage == pytest.approx(6 / 7) and "constant_column" in got["b"].reject_reasons and got["b"].zero_count == 0
    plain = {r.factor: r for r in panels.column_quality(df, ["a"], ["g"]).collect()}
    assert plain["a"].coverage == 0.7 and "post_warmup_coverage_below_threshold" in plain["a"].reject_reasons
    nothing = panels.column_quality(df, ["a"], ["g"], warm_up=F.lit(True)).first()
    assert nothing.coverage == 0.0 and nothing.status == "technical_reject"
