from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import mixing, near_dedup

from .helpers import awkward, empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == COLUMNS
        if i < 3:
            assert docs.join(before, COLUMNS[:2], "left_anti").count() == 0
    assert counts[1] >= 0.98 * counts[0]
    assert spark.read.parquet(f"{tmp_path}/1").groupBy("text").count().filter("count > 1").count() == 0
    near = near_dedup.near_dedup(spark.read.parquet(f"{tmp_path}/2"))
    assert near.filter("not kept").count() == 0
    words = lambda p: p.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    share = words(spark.read.parquet(f"{tmp_path}/3")) / words(spark.read.parquet(f"{tmp_path}/2"))
    assert 1.45 <= share <= 1.55
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(docs.columns)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_awkward_rows_through_all_stages(spark, sf_dir):
    """Nulls, repeated rows and ids, very long and empty texts, and columns with the names of results."""
    names = ("score", "lang_pred", "rejected", "n_tokens", "ids", "taken", "target", "keep_id", "kept", "node", "text_sha256")
    docs = awkward(spark).withColumns({c: F.lit(c) for c in names})
    columns = docs.columns
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert i == 4 or docs.columns == columns
        ids.append(sorted((r.doc_id for r in docs.select("doc_id").collect()), key=repr))
    # no letters: 3, 4, 5 and 9; copies: 1 and one of 2, and 6
    assert set(ids[0]) <= {1, 2, 6, 7, 8, None} and {2, 7} <= set(ids[0])
    assert len(ids[1]) == len(set(ids[1])) and {2, 7} <= set(ids[1]) and not {1, 6} & set(ids[1])
    assert ids[2] == ids[1]
    assert set(ids[3]) <= set(ids[2]) and len(ids[4]) == len(ids[3])


def test_no_rows_through_all_stages(spark, sf_dir):
    docs = empty(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        assert i == 4 or docs.columns == columns
        assert docs.count() == 0
