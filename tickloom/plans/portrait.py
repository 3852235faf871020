"""Everything known about a factor in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: correlated factors and anomaly days that a portrait names
NEIGHBOURS = 3


def _gathered(df: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    """The rows of a factor as an array of structs; a report part, bounded by the catalogue and the calendar's years."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("by"), F.struct(*fields).alias("row"))))
    return df.groupBy("factor").agg(F.transform(rows, lambda r: r["row"]).alias(name))


def portraits(cells: DataFrame, slices: DataFrame, stability: DataFrame, anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row for each factor with validity cells: status counts, slices, stability, anomaly days, nearest factors.

    ``cells``: factor, status; ``slices``: factor, split, slice, value and statistics; ``stability``: one row for each
    factor; ``anomalies``: factor, date, standardized, position; ``correlations``: a, b, spearman for a < b.
    """
    counted = cells.groupBy("factor", "status").agg(F.count(F.lit(1)).alias("n"))
    status = counted.groupBy("factor").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("validity"))
    parts = [
        _gathered(slices, "slices", ["split", "slice", "value"], ["split", "slice", "value", "count", "mean", "std", "ir", "positive_fraction"]),
        stability.select("factor", F.struct(*[c for c in stability.columns if c != "factor"]).alias("stability")),
        _gathered(anomalies, "anomalies", ["position"], ["date", "standardized"]),
    ]
    both = correlations.select(F.col("a").alias("factor"), F.col("b").alias("other"), "spearman").unionByName(correlations.select(F.col("b").alias("factor"), F.col("a").alias("other"), "spearman"))
    near = _gathered(both.filter("spearman IS NOT NULL").withColumn("_far", -F.abs("spearman")), "nearest", ["_far", "other"], ["other", "spearman"])
    out = status
    for part in (*parts, near.withColumn("nearest", F.slice("nearest", 1, NEIGHBOURS))):
        out = out.join(part, "factor", "left")
    return out


def parameter_neighbours(definitions: DataFrame) -> DataFrame:
    """Definitions (id, family, parameters as a map) of a family that have the same parameters and differ in the value of exactly one.

    Each is keyed once for every parameter, by all others; so neighbours meet on an equi-join, however many parameters
    there are, and no two that differ elsewhere. Returns family, changed, a, b (ids) and a_value, b_value, with
    a_value before b_value. Equal definitions are no neighbours; one without parameters has none.
    """
    entries = F.array_sort(F.map_entries("parameters"))
    keyed = definitions.select("family", "id", entries.alias("entries")).select("family", "id", "entries", F.explode("entries").alias("own"))
    rest = F.to_json(F.filter("entries", lambda e: e["key"] != F.col("own.key")))
    keyed = keyed.select("family", F.col("own.key").alias("changed"), rest.alias("rest"), "id", F.col("own.value").alias("value"))
    meet = ["family", "changed", "rest"]
    a, b = (keyed.select(*meet, F.col("id").alias(side), F.col("value").alias(f"{side}_value")) for side in "ab")
    return a.join(b, meet).where("a_value < b_value").drop("rest")
