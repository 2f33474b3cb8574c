import random

import pytest

from sluice.operators import views
from sluice.sources import clustered

SCHEMA = "site_id string, crawled_at bigint, id string, crowd int"


def rows(seed, n, sites):
    rng = random.Random(seed)
    return [(rng.choice([None, *(f"s{i}" for i in range(sites))]) if rng.random() < 0.7 else "s0", rng.choice([None, *range(300)]) if rng.random() < 0.1 else rng.randrange(2000), f"i{rng.randrange(n)}", i) for i in range(n)]


def listed(frame):
    """What decides the list; repeated keys may stand in any order."""
    return sorted(((r["site_id"], r["crawled_at"], r["id"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 7, 60, 100_000])
def test_equal_to_the_whole_table(spark, tmp_path, k):
    every = []
    for part in range(3):  # appended parts overlap in time
        own = rows(part, 700, 6)
        every += own
        clustered.append(spark.createDataFrame(own, SCHEMA), str(tmp_path), files=5)
    table = spark.createDataFrame(every, SCHEMA)
    assert listed(clustered.top_of_each(spark, str(tmp_path), k=k)) == listed(views.top_of_each(table, k=k))
    for site in ("s0", "s5"):
        assert listed(clustered.top_of_site(spark, str(tmp_path), site, k=k)) == listed(views.top_of_site(table, site, k=k))
    assert clustered.top_of_site(spark, str(tmp_path), "nowhere", k=k).collect() == []


def test_files_of_one_site_fall_as_sites_grow(spark, tmp_path):
    read = {}
    for sites in (2, 8, 32):
        folder = str(tmp_path / str(sites))
        own = spark.range(6400).selectExpr(f"concat('s', id % {sites}) AS site_id", f"id div {sites} AS crawled_at", "cast(id AS string) AS id", "0 AS crowd")
        clustered.append(own, folder, files=32)
        read[sites] = len(clustered.top_of_site(spark, folder, "s1", k=6400).inputFiles())
        assert len(clustered.top_of_site(spark, folder, "s1", k=5).inputFiles()) <= 2  # the end of the range alone
        assert clustered.ends(spark, folder, 5).select("file").distinct().count() <= 2 * sites
    assert read[2] >= 2 * read[8] >= 4 * read[32] >= 4


def test_empty_table(spark, tmp_path):
    clustered.append(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert clustered.top_of_each(spark, str(tmp_path)).collect() == [] and clustered.top_of_site(spark, str(tmp_path), "s").collect() == []
