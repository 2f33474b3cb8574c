"""Lists and counts over items and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIST_SIZE, HISTORY_SIZE = 200, 20


def top_of_site(rows: DataFrame, site: str, time: str = "crawled_at", key: str = "id", k: int = LIST_SIZE) -> DataFrame:
    """Latest k rows of one site; ties by key, latest first. One bounded heap per task."""
    return rows.filter(F.col("site_id") == site).orderBy(F.desc(time), F.desc(key)).limit(k)


def top_of_each(rows: DataFrame, time: str = "crawled_at", key: str = "id", k: int = LIST_SIZE) -> DataFrame:
    """The same for every site; Spark limits each group before the shuffle."""
    w = Window.partitionBy("site_id").orderBy(F.desc(time), F.desc(key))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("site_id").agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")


def counts(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of each requested site, 0 where it has none."""
    return sites.join(rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_items")), "site_id", "left").select("site_id", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"))


def run_history(runs: DataFrame, k: int = HISTORY_SIZE) -> DataFrame:
    """Latest k runs of every site."""
    return top_of_each(runs, "started_at", "run_id", k)


def site_of(rows: DataFrame, sites: DataFrame, *columns: str) -> DataFrame:
    """The rows with columns of their site, null where it is unknown; of sites that share an id the least counts."""
    one = sites.groupBy("id").agg(F.min(F.struct(*columns)).alias("_site"))
    return rows.join(one.withColumnRenamed("id", "site_id"), "site_id", "left").select(*rows.columns, *(F.col(f"_site.{c}").alias(c) for c in columns))


def matching_sites(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with the sites whose (configured) origin or a glob pattern they match, each once. Origins join by key, patterns by one pass over each URL."""
    from sluice.functions.urls import origin
    from sluice.operators.patterns import glob_hits

    known = sites.select(F.col("id").alias("site_id"), origin(F.coalesce("configured_url", "url")).alias("_origin"), "match_patterns")
    columns = [*pages.columns, "site_id"]
    hits = pages.withColumn("_origin", origin("url")).join(known.select("site_id", "_origin"), "_origin").select(*columns)
    return hits.union(glob_hits(pages, known.select("site_id", F.explode("match_patterns").alias("glob")))).distinct()


def overrides(settings: DataFrame, column: str = "settings") -> DataFrame:
    """id and override_url out of settings texts: the string values of a JSON object; corrupt texts give none."""
    held = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    each = settings.select(F.explode(held).alias("id", "v"))
    return each.filter(F.schema_of_variant("v") == "STRING").select("id", F.try_variant_get("v", "$", "string").alias("override_url"))


def configured(sites: DataFrame, overrides: DataFrame) -> DataFrame:
    """Sites with the override URL where one is given that is not blank."""
    from sluice.functions.text import blank_to_null, trim_ws

    own = overrides.select("id", blank_to_null(trim_ws("override_url")).alias("override_url"))
    return sites.join(own, "id", "left").withColumn("configured_url", F.coalesce("override_url", "url")).drop("override_url")
