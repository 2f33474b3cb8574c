"""Rows clustered by site and time, with the bounds of each file, so that a site's newest rows are read from the end of one range.

Rows are dealt by range of (site, time, key) and sorted, so a file holds one stretch of few sites, and a large site is split by time. Beside them lies a
small table of bounds: for each file and site the first and last time and the number of rows. More rows may be appended; their files overlap older
ones in time, and the bounds say so. Rows count once their bounds are written, which is the last step.

Null sites are a site of their own, null times come before all others. Ties are in the order of the key, repeated rows stay. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.views import LIST_SIZE

#: Bounds of sites (one row each) up to which they are broadcast to the rows that are read.
FEW = 100_000


def append(rows: DataFrame, folder: str, time: str = "crawled_at", key: str = "id", files: int | None = None) -> None:
    """Write the rows, clustered, and then their bounds."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    order = ["site_id", time, key]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(f"{folder}/rows/{name}")
    written = spark.read.parquet(f"{folder}/rows/{name}").select("site_id", F.col(time).cast("bigint").alias("t"), F.col("_metadata.file_path").alias("file"))
    bounds = written.groupBy("file", "site_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").isNull()).alias("untimed"))
    bounds.coalesce(1).write.mode("append").parquet(f"{folder}/bounds")


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/bounds")


def ends(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """file, site_id and since of the files that can hold one of a site's newest k rows, and the time from which they count (null: all).

    Files are taken from the last time on until they hold k rows; the earliest time in them bounds the k-th row, and every file that reaches it is read.
    """
    own = bounds(spark, folder)
    newest = Window.partitionBy("site_id").orderBy(F.col("last").desc_nulls_last(), "file").rowsBetween(Window.unboundedPreceding, -1)
    before = own.withColumn("before", F.coalesce(F.sum("n").over(newest), F.lit(0)))
    taken = F.col("before") < k
    site = Window.partitionBy("site_id")
    # where the taken files hold rows without a time, or the site has no more than k rows, everything counts
    loose = F.max(taken & (F.col("untimed") > 0)).over(site) | (F.sum("n").over(site) <= k)
    since = F.when(~loose, F.min(F.when(taken, F.col("first"))).over(site))
    return before.withColumn("since", since).filter("since IS NULL OR last >= since").select("file", "site_id", "since")


def _read(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    return spark.read.parquet(*files) if files else spark.read.parquet(f"{folder}/rows/*").limit(0)


def top_of_site(spark: SparkSession, folder: str, site: str, time: str = "crawled_at", key: str = "id", k: int = LIST_SIZE) -> DataFrame:
    """Latest k rows of one site, out of the files at the end of its range."""
    own = ends(spark, folder, k).filter(F.col("site_id").eqNullSafe(F.lit(site))).collect()
    rows = _read(spark, folder, [r["file"] for r in own]).filter(F.col("site_id").eqNullSafe(F.lit(site)))
    since = own[0]["since"] if own else None
    rows = rows.filter(F.col(time) >= since) if since is not None else rows
    return rows.orderBy(F.desc(time), F.desc(key)).limit(k)


def top_of_each(spark: SparkSession, folder: str, time: str = "crawled_at", key: str = "id", k: int = LIST_SIZE) -> DataFrame:
    """Latest k rows of every site with their place, out of the files at the ends of their ranges."""
    own = ends(spark, folder, k)
    rows = _read(spark, folder, [r["file"] for r in own.select("file").distinct().collect()])
    since = own.filter("since IS NOT NULL").groupBy("site_id").agg(F.min("since").alias("_since")).withColumnRenamed("site_id", "_site")
    since = F.broadcast(since) if since.count() <= FEW else since
    held = rows.join(since, F.col("site_id").eqNullSafe(F.col("_site")), "left").filter(F.col("_since").isNull() | (F.col(time) >= F.col("_since"))).drop("_site", "_since")
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc(time), F.desc(key)))
    return held.withColumn("place", place).filter(F.col("place") <= k)
