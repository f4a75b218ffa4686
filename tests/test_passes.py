from pyspark.sql import functions as F

from lorespark.operators import ranking, retrieval


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_scores_texts_once(spark):
    """What follows the fused hits reads written rows: no second scoring of the texts, however often they are used."""
    mem = spark.createDataFrame([(i, f"alpha beta gamma{i} the same long text", 0.5, i) for i in range(20)], "id bigint, content string, salience double, last_seen_at bigint")
    q = spark.createDataFrame([(1, "alpha gamma3 the same long text"), (2, "beta")], "qid bigint, query string")
    hits = retrieval.fused(mem, q, F.col("salience"), F.lit(True))
    plan = _plan(hits)
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and hits.count() == 20


def test_words_that_queries_share_make_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 100)
    p = "p array<struct<grp:int,term:string,prefix:boolean>>"
    alike = spark.createDataFrame([(i, [(k, f"w{k}", True) for k in range(10)]) for i in range(10)], f"qid bigint, {p}")
    apart = spark.createDataFrame([(i, [(k, f"w{i} {k}", True) for k in range(10)]) for i in range(10)], f"qid bigint, {p}")
    assert len(list(retrieval._query_blocks(alike, "p"))) == 1
    blocks = list(retrieval._query_blocks(apart, "p"))
    assert len(blocks) == 4 and sorted(r.qid for b in blocks for r in b.collect()) == list(range(10))
