import pytest
from pyspark.sql import functions as F

from lorespark.sources import readers, spool

EVENT = "event_uid string, source_id string, session_id string, n int"


def events(spark, session, a, b):
    return spark.range(a, b).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("event_uid"), F.lit("src").alias("source_id"), F.lit(session).alias("session_id"), F.col("id").cast("int").alias("n")).coalesce(1)


@pytest.fixture
def ledger(spark, tmp_path):
    out = str(tmp_path / "ledger")

    def store(df):
        known = spark.read.schema(EVENT).parquet(out) if readers.exists(spark, out) else df.where("false")
        df.dropDuplicates(["event_uid"]).join(known.select("event_uid"), "event_uid", "left_anti").select("event_uid", "source_id", "session_id", "n").write.mode("append").parquet(out)

    return store, lambda: sorted(r.n for r in spark.read.schema(EVENT).parquet(out).collect()) if readers.exists(spark, out) else []


def segments(path):
    return sorted(f.name for f in path.glob("*/seg-*"))


def test_lines_are_drained_within_a_budget(spark, tmp_path, ledger):
    store, kept = ledger
    path = tmp_path / "spool"
    assert spool.drain(spark, str(path), EVENT, store) == spool.Drained()
    for a in (0, 5, 10):
        assert spool.write(events(spark, "s 1/x+é", a, a + 5), str(path)) == []
    assert [f.name for f in path.iterdir()] == ["s 1_x+é"] and len(segments(path)) == 3
    (path / "s 1_x+é" / "seg-000.jsonl").write_text('not json\n\n{"event_uid": "", "source_id": "src", "n": 1}\n{"event_uid": "u99", "source_id": "src", "n": 99}')
    got = spool.drain(spark, str(path), EVENT, store, 8)
    assert (got.files, got.drained, got.dropped, got.restored) == (2, 8, 2, 2) and len(kept()) == 8 and 99 in kept()
    assert not any(n.endswith(spool.CLAIMED) for n in segments(path))
    for _ in range(3):
        spool.drain(spark, str(path), EVENT, store, 8)
    assert kept() == [*range(15), 99] and segments(path) == []


def test_nothing_is_lost_between_rename_and_store(spark, tmp_path, ledger):
    store, kept = ledger
    path = tmp_path / "spool"
    spool.write(events(spark, "a", 0, 3), str(path))
    spool.write(events(spark, "b", 3, 6), str(path))

    def broken(df):
        raise OSError("no room")

    with pytest.raises(OSError):
        spool.drain(spark, str(path), EVENT, broken)
    assert len(segments(path)) == 2 and kept() == []
    one = next(path.glob("a/seg-*"))
    one.rename(one.with_name(one.name + spool.CLAIMED))  # a process died here
    assert spool.drain(spark, str(path), EVENT, store).drained == 6 and kept() == list(range(6)) and segments(path) == []


def test_a_session_has_a_bound(spark, tmp_path, ledger):
    path = tmp_path / "spool"
    for a in range(2):
        assert spool.write(events(spark, "a", a, a + 1), str(path), 2) == []
    assert spool.write(events(spark, "a", 2, 3).unionByName(events(spark, None, 3, 4)), str(path), 2) == ["a"]
    assert len(segments(path)) == 3 and [f.name for f in sorted(path.iterdir())] == ["a", "unknown"]
