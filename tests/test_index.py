import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorespark.operators import index, retrieval
from lorespark.operators.index import Index

WORDS = "cache lock retry build deploy branch merge schema index query token batch window shard replica".split()
HAN = "部署回滚缓存锁重试分支合并索引"


def texts(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(WORDS) + r.choice(["", "s", "ed", str(r.randrange(9))]) if r.random() < 0.8 else "".join(r.choice(HAN) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(0, 60))]
        out.append((i, " ".join(words) if i % 29 else None, r.random(), r.randrange(1000)))
    return out


QUERIES = [(1, "cache lock"), (2, "部署回滚 deploy"), (3, "合并"), (4, "锁"), (5, "retry retry the build"), (6, ""), (7, "nothing of the kind zzz"), (8, "b"), (9, "缓存锁重试"), (10, " ".join(WORDS))]


@pytest.fixture
def kept(spark, tmp_path, monkeypatch):
    """An index of three appends, of which the second writes rows of the first again, and a deletion; the rows that live; queries."""
    monkeypatch.setattr(index, "SHARD_DOCS", 64)
    monkeypatch.setattr(index, "BLOCK", 4)
    rows = spark.createDataFrame(texts(400), "id long, content string, salience double, last_seen_at long")
    out = Index(spark, str(tmp_path / "index"))
    out.append(rows.where("id < 150").withColumn("content", F.lit("stale cache stale")))
    out.append(rows.where("id >= 50 and id < 250"))
    out.append(rows.where("id < 50 or id >= 250"))
    out.delete(spark.createDataFrame([(7,), (60,), (399,), (10_000,)], "id long"))
    return out, rows.where("id not in (7, 60, 399)"), spark.createDataFrame(QUERIES, "qid long, query string")


def best(hits, n):
    """Each query's first ``n`` of all hits and of the whole ones."""
    by = defaultdict(list)
    for r in hits.collect():
        by[r.qid].append((round(r.bm25, 7), tuple(r.order or ()), r.id, r.whole))
    return {q: (sorted(v)[:n], sorted(x for x in v if x[3])[:n]) for q, v in by.items()}


def test_kept_index_equals_one_built_anew(spark, kept):
    out, live, queries = kept
    order = (-F.col("salience"), F.col("last_seen_at"))
    keep = F.col("id") % 3 > 0
    for n in (None, 5, 1):
        assert best(out.search(queries, n), n or 10**6) == best(retrieval.ranked(live, queries, n), n or 10**6)
        assert best(out.search(queries, n, live, order, keep), n or 10**6) == best(retrieval.ranked(live, queries, n, order, keep), n or 10**6)
    assert {r.id for r in out.live().collect()} == {r.id for r in live.collect()}
    assert [r.id for r in out.missing(spark.createDataFrame([(1,), (7,), (500,)], "id long")).orderBy("id").collect()] == [7, 500]


def test_segments_are_merged_by_size(spark, kept, monkeypatch):
    out, live, queries = kept
    assert not out.merge()
    monkeypatch.setattr(index, "TIER", 3)
    monkeypatch.setattr(index.np, "log", lambda x, log=index.np.log: log(x))
    before = best(out.search(queries, 5), 5)
    while out.merge():
        pass
    m = out.manifest()
    assert len(m["segments"]) == 1 and m["segments"][0]["docs"] == live.count() and not m["deletions"]
    assert best(out.search(queries, 5), 5) == before
    assert {r.id: r.ds for r in out.signatures().collect()} == {r.id: r.ds for r in live.select("id", index.M.minhash("content").alias("ds")).where("ds is not null").collect()}
    out.append(spark.createDataFrame([(1, "back again")], "id long, content string"))
    assert {r.id for r in out.search(spark.createDataFrame([(1, "again")], "qid long, query string")).collect()} == {1}
    assert out.live().count() == live.count()


def test_fused_search_over_a_kept_index(spark, kept):
    out, live, queries = kept
    got = retrieval.fused(live.drop("content"), queries, F.col("salience"), F.col("id") % 4 > 0, index=out)
    want = retrieval.fused(live, queries, F.col("salience"), F.col("id") % 4 > 0)
    key = lambda df: sorted((r.qid, r.id, r.rank, round(r.score, 9), r.exact, r.routes) for r in df.collect())
    assert key(got) == key(want)


def test_blocks_are_left_out(spark, kept):
    """With many hits of a rare word, the postings of a common one are read for those documents alone."""
    block = index.Words()
    block.add(1, [(0, "rare", False), (1, "common", False)])
    import numpy as np
    import pyarrow as pa

    posts = index._blocks(0, np.repeat([0, 1], [400, 20]), ["common", "rare"], np.concatenate([np.arange(400), np.arange(20)]), np.ones(420, np.int64), np.full(400, 10))
    found = posts.append_column("seq", pa.array([0] * posts.num_rows, pa.int32())).append_column("words", pa.array([[0] if t == "rare" else [1] for t in posts.column("term").to_pylist()], pa.list_(pa.int32())))
    known = pa.table({"place": pa.array(range(400), pa.int32()), "id": pa.array(range(400), pa.int64()), "len": pa.array([10] * 400, pa.int32()), "ok": [True] * 400})
    for n in (3, None):
        got = index._score(block, np.array([5.0, 0.1]), 10.0, n, 0, pa.int64())(found, known)
        assert got.num_rows == (3 if n else 400) and set(got.column("id").to_pylist()[:3]) == {0, 1, 2}
        assert round(got.column("bm25")[0].as_py(), 6) == -5.1


def test_odd_appends(spark, tmp_path):
    out = Index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([("a", "word"), ("b", "w " * 300_000)], "qid string, query string")
    assert out.search(queries).count() == 0 and not out.merge() and out.live().count() == 0
    out.append(spark.createDataFrame([], "id long, content string"))
    assert out.manifest()["version"] == 0
    out.append(spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000), (4, "wording")], "id int, content string"))
    assert {(r.qid, r.id) for r in out.search(queries, 10).collect()} == {(q, i) for q in "ab" for i in (3, 4)}
    with pytest.raises(ValueError):
        out.append(spark.createDataFrame([(5, "x"), (5, "y")], "id int, content string"))
    stale = out.manifest()
    out.delete(spark.createDataFrame([(4,)], "id int"))
    with pytest.raises(Exception, match="exist"):
        out._commit(stale)  # another writer made this version
    assert {r.id for r in out.live().collect()} == {1, 2, 3}
