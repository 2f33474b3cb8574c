import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Planted rows: prose, copies, a leak, personal data and junk."""
    top = tmp_path_factory.mktemp("tables")
    prose = lambda i: " ".join(f"word{i}x{j} and{'.' if j % 8 == 7 else ''}" for j in range(60)) + " end."
    item = "a question about the seven bridges of the old town and who could cross them all just once in one walk"
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(100, prose(1)), (101, prose(2) + " more."), (102, prose(50) + " " + item), (103, prose(51) + " mail a.b@c.org now."), (104, "$$$ ### " * 60), (105, None), (106, "short text")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows] + [(None, prose(70), None, None, None), (39, prose(39), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stage_decisions_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    clean = {None, *range(40)}
    assert ids["quality_rules"] == clean | {100, 101, 102, 103}
    assert ids["near_dedup"] == clean | {102, 103} and seen["near_dedup"].count() == 43
    assert ids["decontamination"] == clean | {103} == ids["pii"] == ids["packing"]
    text = seen["pii"].filter("doc_id = 103").first()
    assert text["text"].endswith("mail [EMAIL] now.") and text["n_chars"] == len(text["text"])


def test_run(spark, folder):
    out = P.run(spark, folder).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 1024 and len(out.doc_id.unique()) == 42


def test_documents_are_told_apart_by_text_too(spark, tmp_path):
    prose = lambda i: " ".join(f"word{i}x{j} and{'.' if j % 8 == 7 else ''}" for j in range(60)) + " end."
    rows = [(3, prose(0)), (5, prose(0) + " x."), (5, prose(1)), (7, prose(2)), (None, prose(3)), (None, prose(3))]
    docs = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], "doc_id long, text string, lang string, node long, c long")
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t in [(3, prose(0)), (5, prose(1)), (7, prose(2)), (None, prose(3))])


def test_empty_tables_and_long_texts(spark, tmp_path):
    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    long = " ".join(f"word{j} item{j} of{'.' if j % 8 == 7 else ''}" for j in range(60_000)) + " end."
    spark.createDataFrame([(1, long, "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).toPandas()
    assert len(out) > 200 and out.length.iloc[1:].eq(1024).sum() >= len(out) - 2
