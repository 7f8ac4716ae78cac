"""The pipeline's stages on a small table."""

import numpy as np

import corpus_pipeline
from weftline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.toPandas()
        assert 0 < len(kept) <= docs.count() and kept.doc_id.is_unique, name
        docs = spark.createDataFrame(kept, docs.schema)
    ids = set(kept.doc_id)
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert set(pieces.doc_id) == ids
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all() and g.length.sum() <= 2048


def test_near_duplicate_stage_keeps_one_of_each(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(3, a, "en"), (1, a, "en"), (2, a.upper(), "en"), (5, b, "en"), (5, b, "en"), (7, None, None), (None, "x y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 5, 7]


def test_contaminated_documents_go(spark):
    item = queries.table(spark, SF, "benchmark").orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, f"before {item} after", "own"), (2, "clean words", "own"), (3, None, "own")], "doc_id long, text string, n_hit string")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]
