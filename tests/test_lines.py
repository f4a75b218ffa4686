import json

import pytest
from pyspark.sql import functions as F

from lorespark.sources import lines, logs

BAD = b'{"a": "caf\xe9"}\n'


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "t.jsonl").write_bytes("één\n".encode() + BAD + b"\n  \r\nlast\r\nhalf")
    got, cur = lines.new_lines(logs.files_of(spark, str(tmp_path)), spark.createDataFrame([], "path string, offset long"))
    end = 6 + len(BAD) + 1 + 4
    assert rows(got, "start", "end", "value", "valid") == [(0, 6, "één", True), (6, 6 + len(BAD), '{"a": "caf�"}', False), (end, end + 6, "last", True)]
    assert rows(cur, "offset") == [(end + 6,)]


def test_a_tail_that_is_whole_json_is_taken(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_bytes(b'one\n{"a": 1}')
    none = spark.createDataFrame([], "path string, offset long")
    got, cur = lines.new_lines(logs.files_of(spark, str(tmp_path)), none)
    assert rows(got, "value") == [("one",), ('{"a": 1}',)] and rows(cur, "offset") == [(12,)]
    kept = spark.createDataFrame([tuple(r) for r in cur.select("path", "offset").collect()], "path string, offset long")
    with f.open("ab") as more:
        more.write(b'\n{"b": 2')
    got, cur = lines.new_lines(logs.files_of(spark, str(tmp_path)), kept)
    assert got.count() == 0 and rows(cur, "offset") == [(13,)]


def test_files_that_were_cut_off(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_bytes(b"new\n")
    at = [r.path for r in logs.files_of(spark, str(tmp_path)).collect()][0]
    cursors = spark.createDataFrame([(at, 100)], "path string, offset long")
    got, cur = lines.new_lines(logs.files_of(spark, str(tmp_path)), cursors)
    assert rows(got, "start", "value", "fresh") == [(0, "new", True)] and rows(cur, "offset") == [(4,)]
    f.write_bytes(b"half")
    got, cur = lines.new_lines(logs.files_of(spark, str(tmp_path)), cursors)
    assert got.count() == 0 and rows(cur, "offset") == [(0,)]


def test_a_read_is_bounded(spark, tmp_path):
    (tmp_path / "t.jsonl").write_bytes(b"x" * 50 + b"\n" + b"y\n" * 300)
    files, cursors, seen = logs.files_of(spark, str(tmp_path)), spark.createDataFrame([], "path string, offset long"), []
    for _ in range(8):
        got, cur = lines.new_lines(files, cursors, 100, 40)
        seen.append([r.value for r in got.orderBy("start").collect()])
        cursors = spark.createDataFrame([tuple(r) for r in cur.select("path", "offset").collect()], "path string, offset long")
    assert len(seen[0]) == 1 and all(len(s) == 20 for s in seen[1:])


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_spans_give_each_line_once(tmp_path, size):
    text = b"".join((b"%d" % i) * (i % 9) + b"\n" for i in range(200)) + b'{"tail": 1}'
    f = tmp_path / "t.jsonl"
    f.write_bytes(text)
    fs, _ = lines._open(str(f))
    stop = lines._last_end(fs, str(f), len(text), 3)
    got = [r for s in lines._spans(str(f), 0, stop, False, size) for r in lines._read(str(f), s)]
    assert stop == len(text) and [(r[1], r[2], r[3]) for r in got] == [(a, b, lines.told(text[a:b])[0]) for a, b in lines.cut(text, 0, 10**9, 10**9) if text[a:b].strip()]


def test_stream_equals_batch(spark, tmp_path):
    """Files that grow, hold bad bytes, end in JSON or in half a line, are cut off and grow again; a stream that is started anew goes on where it was."""
    lines.register(spark)
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()

    def go():
        s = spark.readStream.format("byte_lines").option("stopBytes", 40).load(str(src))
        s.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination(180)
        return rows(spark.read.parquet(out).withColumn("path", F.regexp_extract("path", "[^/]+$", 0)), "path", "start", "value", "fresh")

    a, b = src / "a.jsonl", src / "b.jsonl"
    a.write_bytes(b"a1\na2\na" + BAD[:8])
    b.write_bytes(b'b1\n{"b": 2}')
    first = go()
    assert first == [("a.jsonl", 0, "a1", False), ("a.jsonl", 3, "a2", False), ("b.jsonl", 0, "b1", False), ("b.jsonl", 3, '{"b": 2}', False)]
    with a.open("ab") as more:
        more.write(b"\xe9\n" + b"".join(b"line %d\n" % i for i in range(30)))
    with b.open("ab") as more:
        more.write(b"\nb3\n")
    sizes = [len(go())]
    while len(sizes) < 2 or sizes[-1] > sizes[-2]:  # a stop takes 40 bytes
        sizes.append(len(go()))
    second = go()
    assert len(sizes) > 3
    whole = [(p, s, v, False) for p, s, v in rows(spark.read.format("byte_lines").load(str(src)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0)), "path", "start", "value")]
    assert second == whole and go() == second
    b.write_bytes(b"n1\n")
    assert go() == sorted([*second, ("b.jsonl", 0, "n1", True)])
    with b.open("ab") as more:
        more.write(json.dumps({"n": 2}).encode() + b"\n")
    assert ("b.jsonl", 3, '{"n": 2}', False) in go()
