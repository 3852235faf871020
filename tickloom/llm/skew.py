"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than one in HOT of all rows is dealt over salts
HOT = 4096


def salted_join(rows: DataFrame, table: DataFrame, key: str, copies: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``copies`` how many of ``total`` rows may have it.

    A key that has more than one in HOT of them is dealt over so many salts that each gets about that share. Such keys
    number at most HOT, so their list is broadcast.
    """
    salts = F.ceil(F.col(copies) * HOT / F.lit(max(total, 1))).cast("int")
    is_hot = F.col(copies) * HOT > F.lit(total)
    hot = F.broadcast(table.where(is_hot).select(key, salts.alias("_salts")))
    left = rows.join(hot, key, "left").withColumn("_salt", F.floor(F.rand(7) * F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, salts).otherwise(1) - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")
