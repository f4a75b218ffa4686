import pytest
from pyspark.sql import functions as F

from lorespark.operators import index
from lorespark.operators.index import Index


@pytest.mark.parametrize("told", [True, False])
def test_shards_are_powers_of_two_and_merge_by_blocks(spark, tmp_path, monkeypatch, told):
    """Segments of 8 and 4 shards, the first of them without its number of shards, as it was written before."""
    monkeypatch.setattr(index, "SHARD_DOCS", 16)
    monkeypatch.setattr(index, "TIER", 2)
    out = Index(spark, str(tmp_path / "index"))
    rows = spark.range(128).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 5).cast("string")), F.col("id").cast("string")).alias("content"))
    out.append(rows.where("id < 100"))
    out.append(rows.where("id >= 72"))
    out.delete(rows.where("id = 3").select("id"))
    m = out.manifest()
    assert [s["shards"] for s in m["segments"]] == [8, 4]
    if not told:
        m["segments"][0].pop("shards")
        out._commit(m)
    q = spark.createDataFrame([(1, "all w1"), (2, "99"), (3, "3")], "qid long, query string")
    key = lambda df: sorted((r.qid, r.id, round(r.bm25, 9), r.whole) for r in df.collect())
    before, m = key(out.search(q)), out.manifest()
    out._merge(m, list(m["segments"]))
    after = out.manifest()
    assert [(s["docs"], s["shards"]) for s in after["segments"]] == [(127, 8)] and key(out.search(q)) == before
    assert "_opened" not in vars(index)  # no row a posting


def test_a_shard_fits_a_task():
    assert index.SHARD_DOCS <= 2048 and [index._shards(n) for n in (1, index.SHARD_DOCS, index.SHARD_DOCS + 1, 5 * index.SHARD_DOCS)] == [1, 1, 2, 8]
