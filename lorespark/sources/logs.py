"""Logs and archives: rotated audit logs, content-addressed evidence segments, spools, transcripts read from where they were left, synonym files, configuration, receipts, sandbox seeds."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import new_lines  # noqa: F401  (logs.new_lines)
from .readers import SEGMENT, exists, read_jsonl

AUDIT_BYTES, AUDIT_KEEP, SPOOL_FILES, TOOLS, BATCH_ROWS, BATCH_BYTES = 5 << 20, 3, 200, 128, 200, 1 << 20


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def append_audit(records: DataFrame, path: str, most: int = AUDIT_BYTES, keep: int = AUDIT_KEEP) -> None:
    """Append JSON lines to the log folder. One that has reached ``most`` bytes is first renamed to path.1, older ones move up, and the one beyond ``keep`` goes."""
    fs, Path = _fs(records.sparkSession, path)
    if fs.exists(Path(path)) and fs.getContentSummary(Path(path)).getLength() >= most:
        fs.delete(Path(f"{path}.{keep}"), True)
        for n in range(keep - 1, 0, -1):
            if fs.exists(Path(f"{path}.{n}")):
                fs.rename(Path(f"{path}.{n}"), Path(f"{path}.{n + 1}"))
        fs.rename(Path(path), Path(f"{path}.1"))
    records.write.mode("append").json(path)


def last_records(audit: DataFrame, n: int = 0, order: str = "ts", tie: str = "ord") -> DataFrame:
    """The newest ``n`` records, newest first; 0: all."""
    out = audit.orderBy(F.desc(order), F.desc(tie))
    return out.limit(n) if n else out


def read_audit(spark: SparkSession, path: str, schema: str, n: int = 0) -> DataFrame:
    """Audit records; lines that are no JSON are skipped."""
    rows = read_jsonl(spark, path, schema, strict=False)
    return rows.orderBy(F.desc("ts")).limit(n) if n else rows


def union_lines(*logs: DataFrame) -> DataFrame:
    """Lines (value) of several logs, each once, blanks left out."""
    out = logs[0].select("value")
    for other in logs[1:]:
        out = out.unionByName(other.select("value"))
    return out.where(F.trim("value") != "").distinct()


def segment_of(rows: list[dict]) -> tuple[str, bytes]:
    """(SHA-256 of the file, the file): gzip JSON lines without a time or system in its head, so equal rows make equal files."""
    raw = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for r in rows).encode()
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0, filename="") as f:
        f.write(raw)
    data = bytearray(out.getvalue())
    data[9] = 255  # no operating system
    return hashlib.sha256(bytes(data)).hexdigest(), bytes(data)


def build_segments(events: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """(source_id, segment, n, payload): each source's events in segments of at most ``rows``, by seq. events: source_id, seq, event_uid, raw (binary) and what else SEGMENT names."""
    cols = [f.split()[0] for f in SEGMENT.split(", ")]
    have = [c for c in cols if c in events.columns]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        lines = [{c: base64.b64encode(v).decode() if isinstance(v, bytes | bytearray) else getattr(v, "item", lambda v=v: v)() for c, v in zip(have, r, strict=True) if v is not None} for r in pdf[have].itertuples(index=False)]
        name, data = segment_of(lines)
        return pd.DataFrame({"source_id": [str(pdf.source_id.iloc[0])], "segment": [name], "n": [len(lines)], "payload": [data]})

    part = F.floor((F.row_number().over(Window.partitionBy("source_id").orderBy("seq")) - 1) / rows)
    return events.withColumn("_part", part).groupBy("source_id", "_part").applyInPandas(pack, "source_id string, segment string, n int, payload binary")


def write_archive(segments: DataFrame, path: str) -> None:
    """Append segments that the archive does not hold yet: the name is the content, so writing again changes nothing."""
    spark = segments.sparkSession
    new = segments.dropDuplicates(["segment"])
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("segment"), "segment", "left_anti").select(*segments.columns)
    new.write.mode("append").parquet(path)


def read_archive(spark: SparkSession, path: str, locators: DataFrame | None = None) -> DataFrame:
    """(locator, segment, seq, event_uid, raw) of all records, or of those named by ``locators`` (locator: ``segment#seq``). A segment whose bytes are not what its name says gives none."""
    rows = spark.read.parquet(path).select("segment", "payload")
    if locators is not None:
        rows = rows.join(locators.select(F.split_part("locator", F.lit("#"), F.lit(1)).alias("segment")).distinct(), "segment", "left_semi")

    def unpack(frames):
        for pdf in frames:
            out = []
            for name, data in zip(pdf.segment, pdf.payload, strict=True):
                if hashlib.sha256(data).hexdigest() != name:
                    continue
                for line in gzip.decompress(data).decode().splitlines():
                    r = json.loads(line)
                    out.append((f"{name}#{r.get('seq')}", name, r.get("seq"), r.get("event_uid"), base64.b64decode(r.get("raw", ""))))
            yield pd.DataFrame(out, columns=["locator", "segment", "seq", "event_uid", "raw"])

    got = rows.mapInPandas(unpack, "locator string, segment string, seq int, event_uid string, raw binary")
    return got if locators is None else got.join(locators.select("locator").distinct(), "locator", "left_semi")


def write_spool(events: DataFrame, path: str, name: str) -> None:
    """Events that could not be stored, as a folder of JSON lines of their own under the spool."""
    events.write.mode("overwrite").json(f"{path}/{name}")


def drain_spool(spark: SparkSession, path: str, schema: str, store: Callable[[DataFrame], None], most: int = SPOOL_FILES) -> int:
    """Hand spooled events to ``store`` (which must write each event once, whatever is repeated), the oldest ``most`` folders first. A folder is claimed by renaming it; where ``store`` fails
    it is put back. Returns how many were drained."""
    if not exists(spark, path):
        return 0
    fs, Path = _fs(spark, path)
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(Path(path)) if not s.getPath().getName().endswith(".processing"))
    done = 0
    for _, name in found[:most]:
        claimed = f"{path}/{name}.processing"
        if not fs.rename(Path(f"{path}/{name}"), Path(claimed)):
            continue
        try:
            store(spark.read.schema(schema).json(claimed))
        except Exception:
            fs.rename(Path(claimed), Path(f"{path}/{name}"))
            raise
        fs.delete(Path(claimed), True)
        done += 1
    return done


def files_of(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, content) of files under a folder, however deep."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def remember_tools(old: Column, new: Column, most: int = TOOLS) -> Column:
    """The last ``most`` of two arrays of (id, name), old ones first; a later name of an id replaces the earlier."""
    both = F.concat(old, new)
    at = F.transform(both, lambda x, i: F.struct(x["id"].alias("id"), x["name"].alias("name"), i.alias("i")))
    last = F.filter(at, lambda x: ~F.exists(at, lambda y: (y["id"] == x["id"]) & (y["i"] > x["i"])))
    return F.transform(F.slice(last, F.greatest(F.lit(1), F.size(last) - most + 1), F.lit(most)), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))


def import_transcripts(records: DataFrame, known: DataFrame, since: int = 0, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records (source_id, seq, uid, ts, text) to import, each with what became of it, and how many of each: old (before ``since``), empty, duplicate (known, or of an earlier record), over
    (beyond ``limit`` of a source) or imported. known: uid."""
    k = known.select(F.col("uid"), F.lit(True).alias("_k")).distinct()
    j = records.join(k, "uid", "left")
    pre = F.when(F.coalesce(F.col("ts"), F.lit(0)) < since, "old").when(T.strip(F.coalesce("text", F.lit(""))) == "", "empty").when(F.col("_k"), "duplicate")
    j = j.withColumn("_pre", pre)
    again = F.row_number().over(Window.partitionBy("uid", F.col("_pre").isNull()).orderBy("source_id", "seq")) > 1
    j = j.withColumn("_pre", F.coalesce("_pre", F.when(F.col("uid").isNotNull() & again, "duplicate")))
    n = F.row_number().over(Window.partitionBy("source_id", F.col("_pre").isNull()).orderBy("seq"))
    state = F.coalesce("_pre", F.when(F.lit(limit > 0) & (n > limit), "over").otherwise("imported"))
    out = j.withColumn("state", state).drop("_k", "_pre")
    return out, out.groupBy("state").agg(F.count("*").alias("n"))


def synonym_lines(lines: DataFrame, known: DataFrame, clusters: DataFrame, project: str) -> DataFrame:
    """A synonym file (line, value) with the new aliases of ``clusters`` (term, standard) appended under the project's section, a line each standard, in order; aliases that the section
    has stay as they are. known: project, alias, standard."""
    have = known.where(F.col("project") == project).select(F.col("alias").alias("term")).distinct()
    new = clusters.where("term <> standard").join(have, "term", "left_anti").groupBy("standard").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("a"))
    at = lines.agg(F.coalesce(F.max("line") + 1, F.lit(0))).first()[0]
    if new.isEmpty():
        return lines
    head = lines.sparkSession.createDataFrame([(at, f"[{project}]")], "line long, value string")
    rows = new.select((F.row_number().over(Window.orderBy("standard")) + at).cast("long").alias("line"), F.concat("standard", F.lit(" = "), "a").alias("value"))  # one small file
    return lines.select(F.col("line").cast("long").alias("line"), "value").unionByName(head).unionByName(rows)


def read_config(text: str) -> dict[str, object]:
    """model and timeout_sec of the [distill] section; other sections, unknown keys and bad numbers are passed over."""
    section, out = "", {"model": "", "timeout_sec": 0}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif section == "distill" and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            value = value.strip("\"'")
            if key == "model":
                out["model"] = value
            elif key == "timeout_sec" and value.isdigit():
                out["timeout_sec"] = int(value)
    return out


def seeds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sandbox rows by layer: memories and observations; one without a layer is a memory."""
    layer = F.lower(F.trim(F.coalesce("layer", F.lit(""))))
    return rows.where(layer.isin("", "memory")), rows.where(layer == "observation")


def write_receipts(path: str, manifest: DataFrame, scores: DataFrame, evidence: DataFrame) -> None:
    """An evaluation's receipts: manifest, scores and evidence, each a folder of JSON lines; evidence holds hashes alone."""
    for name, df in (("manifest", manifest), ("scores", scores), ("evidence", evidence)):
        df.write.mode("overwrite").json(f"{path}/{name}")
