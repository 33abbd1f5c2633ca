"""Tables whose rows share an id, or have none."""

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import mixing, pivot_search


def test_vectors_of_one_query_id_answer_each(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(50, rng.normal(size=6).tolist()), (50, rng.normal(size=6).tolist())]
    rows.append(rows[50])  # a repeated row answers once
    got = pivot_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for i, q in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        best = sorted((-int(np.dot(q, x)), j) for j, x in whole if j != i)[:5]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert len(want) == (6 + 2) * 5
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_rows_without_ids_are_dealt_over_shards(spark):
    df = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    laid = mixing.allotments(df).groupBy("shard").count()
    assert laid.count() > 200 and laid.agg(F.max("count")).first()[0] < 60
    mixed = mixing.mix(df)
    assert mixed.count() == 4000
    taken = mixed.agg(F.sum("taken")).first()[0]
    assert abs(taken - 1.5 * 12_000) <= 200
    assert mixing.apply_mix(df.withColumn("n_chars", F.length("text"))).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    one = df.withColumn("doc_id", F.lit(7).cast("bigint"))
    assert mixing.allotments(one).groupBy("shard").count().count() > 200
