import re

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import promotion
from lorespark.plans import registry

DIR = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candidate_insert", "import_superseding", "invalid_gold_report", "sync_three_way", "committed_memories"])
def test_texts_are_hashed_before_what_reads_the_hash(spark, name):
    """No scan of the documents is left behind the written hashes."""
    plan = _plan(registry.QUERIES[name](spark, DIR))
    assert not re.search(r"FileScan parquet \[[^]]*\btext#", plan)


def test_trimming_and_normalising_by_characters_equal_the_patterns(spark):
    rows = ["", " ", "a", " 　a b \n", "x. \u0085", "Ends...!!\n", "。．？", "a\n.\n", "\x0b\x1ca\x1c", "mid...dle ;", "​a​", None, "é., "]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    c = F.col("c")
    folded = F.trim(F.regexp_replace(F.lower(c), f"{T.SPACE}+", " "))
    want = df.select(F.regexp_replace(F.regexp_replace(c, f"^{T.SPACE}+", ""), f"{T.SPACE}+$", "").alias("s"), F.regexp_replace(folded, "[。．.!！?？;；,，:：]+$", "").alias("n"))
    assert df.select(T.strip(c).alias("s"), T.normalize(c).alias("n")).collect() == want.collect()


def test_a_candidate_without_a_hash_is_accepted_by_its_content(spark):
    c = spark.createDataFrame([(1, 1, "fact", "A text.", "", "p", "pending", 0, 0.5, None, None)], "id bigint, session_id bigint, kind string, content string, content_hash string, project string, status string, revision int, salience double, memory_id bigint, decided_at bigint")
    mem = spark.createDataFrame([], "id bigint, content string, content_hash string, project string, kind string, salience double, access_count bigint, adopted_count bigint, updated_at bigint, last_seen_at bigint, created_at bigint, source string")
    cand, after = promotion.accept(c, c.select("id", F.lit(-1).alias("expected")), mem, 9, F.col("first") + 100)
    assert after.select("id", "content_hash").collect() == c.select(F.lit(101).cast("bigint"), T.content_hash(F.col("content"))).collect()
    assert [(r.content_hash, r.status, r.memory_id) for r in cand.collect()] == [("", "accepted", 101)]
