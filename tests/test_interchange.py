import glob

import pytest
from pyspark.sql import functions as F

from lorespark.sources import interchange

MEM = "id string, content string, kind string, content_hash string, project string, salience double, created_at bigint, superseded_by string"


def text_of(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_export_import_export_is_the_same_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(interchange, "ROWS_PER_FILE", 7)
    mem = spark.createDataFrame([(f"m{i}", f"text {i} é\n", "fact", f"h{i * 7 % 40:02d}", "p" if i % 2 else "", i / 8, i, f"m{i - 1}" if i % 5 == 4 else None) for i in range(40)], MEM)
    tags = spark.createDataFrame([(f"m{i}", k, v) for i in range(0, 40, 3) for k, v in (("area", "b"), ("area", "a"), ("lang", "x"), ("area", "a"))], "memory_id string, key string, value string")
    ev = spark.createDataFrame([(f"m{i}", f"e{j}", f"u{(i * j) % 5}", "arc", "arc#1", "A", j, 5) for i in range(0, 40, 4) for j in (3, 1, 2)], "memory_id string, evidence_id string, event_uid string, archive_hash string, raw_locator string, grade string, seq int, occurred_at_ns bigint")
    one, two, three = (str(tmp_path / x) for x in ("one", "two", "three"))
    recs = interchange.records(mem, tags, ev)
    assert [e.event_uid for e in recs.where("id = 'm4'").first().evidence] == sorted(e.event_uid for e in recs.where("id = 'm4'").first().evidence)
    interchange.write(recs, one)
    interchange.write(interchange.records(mem.repartition(5), tags.repartition(3), ev.repartition(4)), two)
    back = interchange.read(spark, one)
    assert back.count() == 40 and back.where("superseded_by_id is not null").count() == 8 and back.where("superseded.hash is not null").count() == 8
    interchange.write(back.drop("file", "record"), three)
    assert text_of(one) == text_of(two) == text_of(three) and len(glob.glob(f"{one}/part-*")) > 3
    assert interchange.read(spark, str(tmp_path / "none")).count() == 0


def test_the_record_that_is_bad_is_named(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    good = '{"id": "a", "content": "c"}\n'
    f.write_text(good * 300 + "\n" + good * 41 + '{"id": \n' + good * 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        with pytest.raises(ValueError, match="x.jsonl: record 342 "):
            interchange.read(spark, str(f))
        f.write_text(good * 300 + "\n" + good * 41)
        got = interchange.read(spark, str(f))
        assert got.rdd.getNumPartitions() > 3 and sorted(r.record for r in got.collect()) == list(range(1, 342)) and got.select(F.min("id")).first()[0] == "a"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
