"""A spool of events that could not be stored: a folder a session, segments of JSON lines in it, written whole under another name and renamed; drained line by line within a budget.

A segment is claimed by renaming it (.processing). One that a dead process has left claimed is drained like any other, one that was not drained to its end gets its name back: its lines come again, and the
store must take each event once. Lines that are no event are dropped and counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import cut, told

#: Events a drain takes, and segments a session may have.
BUDGET, SEGMENTS = 200, 4096
CLAIMED = ".processing"


@dataclass
class Drained:
    files: int = 0
    drained: int = 0
    dropped: int = 0
    restored: int = 0


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder_of(session) -> F.Column:
    """The folder of a session: what could part a path is an underscore, dots at its ends go, at most 100 characters; unknown without a name."""
    name = F.regexp_replace(F.trim(F.coalesce(session.cast("string"), F.lit(""))), "[/\\\\:\\x00-\\x1f]", "_")
    name = F.substring(F.regexp_replace(name, "^\\.+|\\.+$", ""), 1, 100)
    return F.when(name == "", "unknown").otherwise(name)


def _segments(fs, p, folder: str) -> list[str]:
    if not fs.exists(p(folder)):
        return []
    return sorted(n for s in fs.listStatus(p(folder)) if (n := s.getPath().getName()).startswith("seg-") and n.endswith((".jsonl", ".jsonl" + CLAIMED)))


def write(events: DataFrame, path: str, most: int = SEGMENTS) -> list[str]:
    """Spool events (session_id and further columns), a segment a session and task. Sessions that have ``most`` segments take no more: their names are returned, and their events are the caller's still."""
    spark = events.sparkSession
    fs, p = _fs(spark, path)
    stage = f"{path}/.{uuid.uuid4().hex}"
    rows = events.select(folder_of(F.col("session_id")).alias("folder"), F.to_json(F.struct(*events.columns)).alias("value"))
    rows.repartition("folder").write.partitionBy("folder").text(stage)
    full = []
    for part in [s.getPath() for s in fs.listStatus(p(stage)) if s.getPath().getName().startswith("folder=")]:
        name = spark.sparkContext._jvm.java.net.URLDecoder.decode(part.getName().removeprefix("folder=").replace("+", "%2B"), "UTF-8")
        have = len(_segments(fs, p, f"{path}/{name}"))
        if have >= most:
            full.append(name)
            continue
        fs.mkdirs(p(f"{path}/{name}"))
        for s in fs.listStatus(part):
            fs.rename(s.getPath(), p(f"{path}/{name}/seg-{uuid.uuid4().hex}.jsonl"))
    fs.delete(p(stage), True)
    return full


def _numbered(files: DataFrame) -> DataFrame:
    """(path, at, value): the lines of files (path, content) by number, blank ones left out."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                # a spool's last line is whole: segments appear under their name only when they are written
                spans = list(cut(content if content.endswith(b"\n") else content + b"\n", 0, len(content) + 1, len(content) + 1))
                out += [(path, n, told(content[a:b])[0]) for n, (a, b) in enumerate(spans) if content[a:b].strip()]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["path", "at", "value"])

    return files.mapInArrow(run, "path string, at bigint, value string")


def drain(spark: SparkSession, path: str, schema: str, store: Callable[[DataFrame], None], most: int = BUDGET) -> Drained:
    """Hand spooled events to ``store`` (which takes each once), folder by folder and segment by segment, ``most`` in all. Where ``store`` fails every claimed segment gets its name back and the error goes on. schema: what the
    events hold, event_uid and source_id among it; a line without either is dropped."""
    fs, p = _fs(spark, path)
    out, claimed = Drained(), []
    folders = sorted(s.getPath().getName() for s in fs.listStatus(p(path)) if s.isDirectory() and not s.getPath().getName().startswith(".")) if fs.exists(p(path)) else []
    for folder in folders:
        for name in _segments(fs, p, f"{path}/{folder}"):
            if len(claimed) > most:  # a segment has a line at least
                break
            file = f"{path}/{folder}/{name}"
            if not name.endswith(CLAIMED):
                if not fs.rename(p(file), p(file + CLAIMED)):
                    continue  # another drain has it
                file += CLAIMED
            claimed.append(file)
    if not claimed:
        return out

    def back(file: str) -> None:
        if not fs.exists(p(file.removesuffix(CLAIMED))):
            fs.rename(p(file), p(file.removesuffix(CLAIMED)))
        out.restored += 1

    order = spark.createDataFrame([("/".join(f.split("/")[-2:]), i) for i, f in enumerate(claimed)], "tail string, i int")
    files = spark.read.format("binaryFile").load(claimed).select("path", "content")
    decoded = F.expr("url_decode(replace(array_join(slice(split(path, '/'), -2, 2), '/'), '+', '%2B'))")
    rows = _numbered(files).withColumn("tail", decoded).join(F.broadcast(order), "tail").withColumn("e", F.from_json("value", schema))
    rows = rows.withColumn("ok", (F.coalesce("e.event_uid", F.lit("")) != "") & (F.coalesce(F.col("e.source_id").cast("string"), F.lit("")) != ""))
    count = {r.i: (r.n, r.bad) for r in rows.groupBy("i").agg(F.count_if(F.col("ok")).alias("n"), F.count_if(~F.col("ok")).alias("bad")).collect()}
    left, take, done = most, {}, []
    for i in range(len(claimed)):
        n, bad = count.get(i, (0, 0))
        take[i] = min(n, left)
        left -= take[i]
        if take[i] == n:
            done.append(i)
            out.dropped += bad
    limits = spark.createDataFrame([(i, k) for i, k in take.items() if k], "i int, k int")
    try:
        within = rows.where("ok").join(F.broadcast(limits), "i").withColumn("r", F.row_number().over(_in_file())).where("r <= k")
        if sum(take.values()):
            store(within.select("e.*"))
    except Exception:
        for f in claimed:
            back(f)
        raise
    out.drained, out.files = sum(take.values()), len(done)
    for i, f in enumerate(claimed):
        if i in done:
            fs.delete(p(f), False)
        else:
            back(f)
    return out


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("i").orderBy("at")
