"""Queries of the kept index: documents in three appends, one of them written twice, a deletion and a merge, then searched without their texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.index import Index
from .registry import _questions, query
from .scratch import shared_dir
from .sql import bm25
from .tables import memories

_KEPT = bm25("kept_texts", tag="_k") | {"kept_texts": "SELECT id, content FROM memories WHERE id % 10 <> 7"}


def _index(spark: SparkSession, d: str) -> Index:
    out, m = Index(spark, f"{shared_dir(spark)}/lorespark/index-{uuid.uuid4().hex}"), memories(spark, d).select("id", "content")
    out.append(m.where("id % 3 = 0").withColumn("content", F.concat(F.col("content"), F.lit(" draft "), F.col("content"))))
    for part in range(3):
        out.append(m.where(f"id % 3 = {part}"))
    out.delete(m.where("id % 10 = 7").select("id"))
    return out


def _best(index: Index, queries: DataFrame) -> DataFrame:
    hits = index.search(queries, 10)
    return retrieval.top(hits, 10, F.col("bm25"), F.col("id")).select("qid", "id", "rank", F.round("bm25", 6).alias("bm25"))


@query("SELECT qid, id, rank, round(bm25, 6) AS bm25 FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bm25, id)::INTEGER AS rank, bm25 FROM hits_k) WHERE rank <= 10", **_KEPT)
def kept_index_search(spark, d):
    return _best(_index(spark, d), _questions(spark, d))


@query("SELECT 'live' AS what, id, len(t)::INTEGER AS n FROM toks_k UNION ALL SELECT 'missing', id, 0 FROM memories WHERE id % 10 = 7", **_KEPT)
def kept_index_rows(spark, d):
    index = _index(spark, d)
    index.merge()
    gone = index.missing(memories(spark, d)).select(F.lit("missing").alias("what"), "id", F.lit(0).alias("n"))
    return index.live().select(F.lit("live").alias("what"), "id", F.col("len").alias("n")).unionByName(gone)
