import numpy as np
from pyspark.sql import functions as F

from lorespark.operators import ranking, retrieval, supply


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_block_of_queries_has_no_table_of_queries_and_words():
    asked = ranking.Asked.of([(q, [(k, f"w{q}x{k}", True) for k in range(40)]) for q in range(300)])
    held = [v.nbytes for v in vars(asked).values() if isinstance(v, np.ndarray)]
    assert len(asked.words) == 12_000 and sum(held) < 1 << 20


def test_texts_are_cut_into_terms_once_and_scored_from_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta alphabet"), (2, "beta"), (3, None), (4, "数据 查询 alpha")], "id bigint, content string")
    q = spark.createDataFrame([(7, "alpha beta"), (8, "数据查"), (9, "数据")], "qid bigint, query string")
    hits = retrieval.ranked(docs, q, 5)
    assert "regexp_extract_all" not in _plan(hits)
    got = {(r.qid, r.id): r.whole for r in hits.collect()}
    assert got == {(7, 1): 1, (7, 2): 1, (7, 4): 1, (8, 4): 0, (9, 4): 1}


def test_a_text_is_signed_once_where_it_is_held_against_queries(spark):
    docs = spark.createDataFrame([(1, "a text of some length to sign"), (2, ""), (3, "another thing altogether")], "id bigint, content string")
    q = spark.createDataFrame([(7, "a text of some length to sign"), (8, "a")], "qid bigint, query string")
    hits = retrieval.fuzzy(docs, q)
    assert "ArrowEvalPython" not in _plan(hits) and [(r.qid, r.id, r.sim) for r in hits.collect()] == [(7, 1, 1.0)]
    assert retrieval.fuzzy(docs, q.where("qid = 8")).count() == 0


def test_what_hits_look_up_shuffles_no_text(spark):
    mem = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    hits = spark.createDataFrame([(1, 5), (2, 7), (3, 5)], "qid bigint, id bigint")
    out = retrieval.looked_up(hits, mem, "content")
    assert "SortMergeJoin" not in _plan(out) and sorted((r.qid, r.content) for r in out.collect()) == [(1, "text 5"), (2, "text 7"), (3, "text 5")]


def test_metrics_count_each_expected_pair_once(spark):
    trace = spark.createDataFrame([(1, 5, 1), (1, 6, 0), (2, 5, 1)], "qid bigint, id bigint, injection_rank int")
    want = spark.createDataFrame([(1, 5), (1, 5), (2, 9), (3, None)], "qid bigint, id bigint")
    assert tuple(supply.metrics(trace, want).first()) == (0.5, 0.5, 1.0)
