"""The pipeline's stages keep what they should, with their columns."""

import corpus_pipeline
from racelab.llm import jaccard_join
from racelab.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = q.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and 0.5 * before.count() <= docs.count() <= before.count()
    before, after = seen["near_duplicates"]
    kept = {r.doc_id for r in jaccard_join.join(before).where("doc_id = component_id").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept)
    packed = seen["packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["packing"][0].collect()}


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "un deux", "fr", "s", 7), (2, "un deux", "fr", "s", 7), (2, "un deux", "fr", "s", 7)]):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), SF)
            assert out.count() <= max(len(rows), 0), name


def test_near_duplicates_of_rows_with_one_id(spark):
    """Rows of one id are judged by their own texts; extra columns and long texts pass through."""
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(3, text[0], "x", 1), (5, text[1], "x", 2), (5, text[0], "x", 3), (6, text[2], None, 4), (6, text[2], None, 4), (7, text[3] * 3000, "y", 5), (8, None, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, node int")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.node) for r in out.collect()) == [(3, 1), (5, 2), (6, 4), (7, 5), (8, 6)]


def test_one_row_of_a_component_stays_whatever_the_ids(spark):
    """Near copies under one id or without any id; rows that differ in other columns only; two components
    that share their smallest id."""
    text = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    near = lambda t: t.replace("59", "x")
    rows = [(None, text[0], 1), (None, near(text[0]), 2), (5, text[1], 3), (5, near(text[1]), 4), (5, text[2], 5), (9, text[2], 6), (7, text[3], 8), (7, text[3], 7), (None, None, 9), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    for n in (1, 5):
        out = [(r.doc_id, r.node) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(n), SF).collect()]
        assert sum(node in (1, 2) for _, node in out) == 1 and sum(node in (3, 4) for _, node in out) == 1
        assert (5, 5) in out and (7, 7) in out and (None, 9) in out and len(out) == 5


def test_repeated_labels(spark, tmp_path):
    """Ids that occur several times among the labels don't multiply documents."""
    q.table(spark, SF, "documents").write.parquet(str(tmp_path / "documents.parquet"))
    labels = q.table(spark, SF, "labels")
    labels.unionByName(labels).unionByName(labels.limit(5)).write.parquet(str(tmp_path / "labels.parquet"))
    docs = q.table(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.toxic(spark, docs, str(tmp_path))
    assert kept.count() == kept.select("doc_id").distinct().count() <= docs.count()
