import gzip
import json

import pytest

from lorespark.functions import identity as I
from lorespark.operators import context, extraction, lifecycle, promotion
from lorespark.sources import logs, readers
from lorespark.streaming import capture


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_segments_are_named_by_their_content(spark, tmp_path):
    ev = spark.createDataFrame([("s", i, f"u{i}", f"text {i}".encode()) for i in range(7)], "source_id string, seq int, event_uid string, raw binary")
    seg = logs.build_segments(ev, 3)
    assert rows(seg, "n") == [(1,), (3,), (3,)]
    again = logs.build_segments(ev.repartition(5), 3)
    assert rows(seg, "segment") == rows(again, "segment")
    r = seg.where("n = 1").first()
    assert json.loads(gzip.decompress(r.payload))["event_uid"] == "u6" and r.payload[4:8] == b"\0\0\0\0" and r.payload[9] == 255
    path = str(tmp_path / "archive")
    logs.write_archive(seg, path)
    logs.write_archive(again, path)
    assert spark.read.parquet(path).count() == 3
    got = logs.read_archive(spark, path)
    assert sorted((q.seq, bytes(q.raw)) for q in got.collect()) == [(i, f"text {i}".encode()) for i in range(7)]
    wanted = spark.createDataFrame([(f"{r.segment}#6",), ("none#1",)], "locator string")
    assert [(q.seq, q.event_uid) for q in logs.read_archive(spark, path, wanted).collect()] == [(6, "u6")]
    spark.createDataFrame([("s", "0" * 64, 1, r.payload)], seg.schema).write.mode("append").parquet(path)
    assert logs.read_archive(spark, path).count() == 7  # bytes that are not what the name says


def test_audit_log_is_rotated(spark, tmp_path):
    path = str(tmp_path / "audit")
    for n in range(5):
        logs.append_audit(spark.createDataFrame([(n, "x" * 50)], "ts long, event string"), path, 1, 2)
    assert [r.ts for r in logs.read_audit(spark, path, "ts long, event string").collect()] == [4]
    assert [r.ts for r in spark.read.json(f"{path}.1").collect()] == [3] and [r.ts for r in spark.read.json(f"{path}.2").collect()] == [2]
    assert not readers.exists(spark, f"{path}.3")
    logs.append_audit(spark.createDataFrame([(9, "y")], "ts long, event string"), path, 10**6, 2)
    assert [r.ts for r in logs.read_audit(spark, path, "ts long, event string", 1).collect()] == [9]
    (tmp_path / "audit" / "bad.json").write_text("{not json\n")
    assert logs.read_audit(spark, path, "ts long, event string").count() == 2


def test_spool_is_drained_once(spark, tmp_path):
    path, schema, out = str(tmp_path / "spool"), "event_uid string, seq long", str(tmp_path / "ledger")
    assert logs.drain_spool(spark, path, schema, print) == 0
    for n in range(3):
        logs.write_spool(spark.createDataFrame([(f"u{n}", n), ("u0", 0)], schema), path, f"part{n}")

    def broken(df):
        raise OSError("no room")

    with pytest.raises(OSError):
        logs.drain_spool(spark, path, schema, broken)

    def store(df):
        known = spark.read.schema(schema).parquet(out) if readers.exists(spark, out) else df.where("false")
        df.dropDuplicates(["event_uid"]).join(known.select("event_uid"), "event_uid", "left_anti").select("event_uid", "seq").write.mode("append").parquet(out)

    assert logs.drain_spool(spark, path, schema, store, 2) == 2 and logs.drain_spool(spark, path, schema, store) == 1 and logs.drain_spool(spark, path, schema, store) == 0
    assert rows(spark.read.parquet(out), "event_uid") == [("u0",), ("u1",), ("u2",)]


def test_new_lines_leave_the_unfinished_tail(spark, tmp_path):
    f = tmp_path / "a" / "t.jsonl"
    f.parent.mkdir()
    f.write_bytes("één\r\ntwo\nthr".encode())
    (tmp_path / "a" / "t.txt").write_text("no\n")
    files = logs.files_of(spark, str(tmp_path))
    none = spark.createDataFrame([], "path string, offset long")
    got, cur = logs.new_lines(files, none)
    assert rows(got, "start", "value") == [(0, "één"), (7, "two")] and rows(cur, "offset") == [(11,)]
    cur = spark.createDataFrame([(r.path, r.offset) for r in cur.collect()], "path string, offset long")
    assert logs.new_lines(logs.files_of(spark, str(tmp_path)), cur)[0].count() == 0
    with f.open("ab") as more:
        more.write(b"ee\nfour\n")
    got, cur2 = logs.new_lines(logs.files_of(spark, str(tmp_path)), cur, rows=1)
    assert rows(got, "start", "value") == [(11, "three")] and rows(cur2, "offset") == [(17,)]


def test_capture_is_exactly_once_however_late(spark, tmp_path):
    schema = "ord bigint, event_uid string, source_id string, generation int, seq bigint"
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    put = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
    go = lambda: capture.capture(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination(120)
    put([(1, "a", "s", 1, 1), (2, "a", "s", 1, 2), (3, "", "s", 1, 1), (4, "", "", 1, 0), (5, "", "", 1, 0)])
    go()
    put([(6, "a", "t", 1, 9), (7, "b", "s", 1, 1), (8, "c", "s", 1, 2)])
    go()
    assert rows(spark.read.parquet(out), "ord") == [(1,), (4,), (8,)] or rows(spark.read.parquet(out), "ord") == [(1,), (4,), (5,), (8,)]


def test_order_of_a_stream(spark, tmp_path):
    schema = "ord bigint, source_id string, generation bigint, seq bigint"
    src = str(tmp_path / "in")
    data = [(1, "s", 1, 1), (2, "s", 1, 3), (3, "s", 1, 2), (4, "s", 2, 3), (5, "s", 1, 3), (6, "t", 1, 2)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
    q = capture.ordered(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("ordered_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = [(1, "accepted"), (2, "gap"), (3, "accepted"), (4, "generation"), (5, "accepted"), (6, "gap")]
    assert rows(spark.table("ordered_out"), "ord", "state") == want
    from lorespark.operators.capture import arrivals

    batch = arrivals(spark.createDataFrame(data, schema), spark.createDataFrame([], "source_id string, generation bigint, last_seq bigint"))
    assert rows(batch, "ord", "state") == want


def test_opening_cuts_the_first_line_where_none_fits(spark):
    row = lambda i, section, place, text: ("p", section, place, i, text, "rule", "")
    pool = spark.createDataFrame([row(1, 0, 1, "a" * 80), row(2, 0, 2, "b" * 90), row(3, 1, 1, "c" * 5), row(4, 1, 2, "d")], "for_project string, section int, place int, id bigint, content string, kind string, project string")
    got = {r.id: (r.injection_rank, r.drop_reason, r.line) for r in context.opening(pool, 60, 3).collect()}
    assert got[1][0] == 1 and got[1][2].startswith("- [rule] mem:1 aaa") and "…" in got[1][2] and len(got[1][2]) + 15 == 60
    assert got[2][1] == "budget" and got[3][1] == got[4][1] == "budget"
    wide = {r.id: r.injection_rank for r in context.opening(pool, 900, 1).collect()}
    assert wide == {1: 1, 2: 0, 3: 2, 4: 0}


def test_executors_fall_back_only_where_unreachable():
    def away(_):
        raise extraction.Unavailable

    def late(_):
        raise TimeoutError

    def bad(_):
        raise ValueError("broken")

    assert extraction.execute("p", ("local", away), ("host", late), ("own", str.upper)) == ("own", "P") and extraction.execute("p", ("local", away)) == ("none", "")
    with pytest.raises(ValueError):
        extraction.execute("p", ("local", bad), ("own", str.upper))
    assert extraction.repaired('{"kind":1}', None) == '{"kind":1}' and extraction.repaired("[]", None) == "[]" and extraction.repaired("sorry", lambda p: p[-5:]) == "sorry"


def test_configuration_and_paths():
    assert logs.read_config("[other]\nmodel = x\n[distill]\nmodel = \"m1\" # note\ntimeout_sec = 20\nodd = 3") == {"model": "m1", "timeout_sec": 20}
    assert logs.read_config("[distill]\ntimeout_sec = soon") == {"model": "", "timeout_sec": 0}
    assert I.path_candidates("docs/../a.md", "/r") == ["a.md", "docs/../a.md", "/r/a.md"] and I.path_candidates("/x/a.md", "/r") == ["/x/a.md"] and I.path_candidates(" ") == []


def test_ingest_refuses_unknown_sources(spark):
    with pytest.raises(ValueError):
        lifecycle.ingest(None, None, "rumour", 0, None)


def test_decisions_are_logged_once(spark):
    cands = spark.createDataFrame([(1, "pending", 0, None), (2, "accepted", 1, 9), (3, "rejected", 0, None)], "id bigint, status string, revision int, memory_id bigint")
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, -1)], "id bigint, expected int")
    items = spark.createDataFrame([(1, "u", "e", "a", "direct", 1)], "candidate_id bigint, event_uid string, evidence_id string, archive string, role string, seq int")
    j = promotion.judge(cands, asked, "accepted")
    assert rows(j, "id", "outcome") == [(1, "commit"), (2, "already"), (3, "closed"), (4, "missing")]
    new = promotion.decisions(j, items, "human_accept")
    log = promotion.append_decisions(new.where("false"), new)
    assert log.count() == 2 and promotion.append_decisions(log, new).count() == 2


def test_receipts_hold_no_texts(spark, tmp_path):
    from lorespark.operators import evaluation

    q = spark.createDataFrame([(1, "secret question")], "qid bigint, query string")
    hits = spark.createDataFrame([(1, "h2", 2), (1, "h1", 1)], "qid bigint, hash string, rank int")
    logs.write_receipts(str(tmp_path / "r"), q.select("qid"), hits, evaluation.evidence_of(q, hits))
    text = "".join(p.read_text() for p in (tmp_path / "r" / "evidence").glob("*.json"))
    assert "question" not in text and '"hashes":["h1","h2"]' in text
    a = evaluation.fingerprint(q, "qid", "query").first()
    assert evaluation.fingerprint(q.union(q).limit(1), "qid", "query").first() == a and a.rows == 1


def test_gold_folder(spark, tmp_path):
    (tmp_path / "a.gold.jsonl").write_text('# c\n\n{"query":"x","gold":["ab"]}\n')
    (tmp_path / "b.gold.jsonl").write_text('{"query":"y","gold":["cd"],"note":"n"}\n')
    (tmp_path / "c.jsonl").write_text("no gold\n")
    assert rows(readers.read_gold(spark, str(tmp_path)), "query") == [("x",), ("y",)]
    (tmp_path / "d.gold.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|json"):
        readers.read_gold(spark, str(tmp_path)).collect()


def test_snapshot_never_replaces(spark, tmp_path):
    readers.snapshot(spark.range(2), str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exists"):
        readers.snapshot(spark.range(3), str(tmp_path), "v1")
