"""Deterministic de-duplication: first, last or best rank wins, each with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import trim_ws


def link_key(url: str = "url", title: str = "title") -> Column:
    return F.concat(F.lower(F.col(url)), F.lit("|"), F.lower(trim_ws(title)))


def keep_first(rows: DataFrame, scope: list[str], key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key within a scope, such as a page."""
    w = Window.partitionBy(*scope, "_key").orderBy(pos)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def keep_last(rows: DataFrame, scope: list[str], key: Column, pos: str = "pos") -> DataFrame:
    """The last row of each key, in the place `first_pos` of the first."""
    w = Window.partitionBy(*scope, "_key")
    out = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w.orderBy(F.desc(pos)))).withColumn("first_pos", F.min(pos).over(w))
    return out.filter("_n = 1").drop("_key", "_n")


def keep_best(rows: DataFrame, scope: list[str], key: Column, rank: str = "rank_order", pos: str = "pos") -> DataFrame:
    """The row of least rank of each key, ties to the earliest; `first_pos` orders equal ranks."""
    w = Window.partitionBy(*scope, "_key")
    out = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w.orderBy(rank, pos))).withColumn("first_pos", F.min(pos).over(w))
    return out.filter("_n = 1").drop("_key", "_n")
