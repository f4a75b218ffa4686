"""Sources and sinks: JSON lines, transcripts, Markdown, synonym files, gold sets, evidence segments, snapshots. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EXPORT = (
    "id string, content string, kind string, content_hash string, project string, salience double, created_at bigint, updated_at bigint, last_seen_at bigint, expires_at bigint, superseded_by_id string, "
    "superseded struct<hash: string, project: string>, origin_device string, origin_tool string, source string, channel string, provenance string, "
    "evidence array<struct<evidence_id: string, event_uid: string, archive_hash: string, raw_locator: string, grade: string, seq: int, occurred_at_ns: bigint>>, access_count int, tags map<string, array<string>>"
)
AUDIT = "ts bigint, event string, harness string, project string, session_id string, query string, hashes array<string>, kinds array<string>, empty boolean, inject_bytes int, mode string, suppressed boolean, ms bigint, source string, provider string, count int, failed int"
SEGMENT = "v int, event_uid string, source_id string, generation int, seq int, occurred_at_ns bigint, session_id string, project string, harness string, event_type string, parser_version string, proposal_eligible boolean, raw string, summary_override string"
GOLD = "query string, gold array<string>, note string"
MARKDOWN_CHARS = (8, 500)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a missing path is an empty table. strict: a bad line is an error, else it is skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold queries of a file, or of all ``*.gold.jsonl`` of a folder; blank and comment lines are skipped, a bad one is an error."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory()
    source = spark.read.option("pathGlobFilter", "*.gold.jsonl") if folder else spark.read
    lines = source.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", GOLD, {"mode": "FAILFAST"}).alias("g")).select("g.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Evidence segments (gzip JSON lines) with the raw bytes decoded."""
    return read_jsonl(spark, path, SEGMENT).withColumn("raw", F.unbase64("raw"))


def write_segments(events: DataFrame, path: str) -> None:
    """Evidence as gzip JSON lines; raw bytes in base64. Segments that are named by their content are ``logs.build_segments``'."""
    events.withColumn("raw", F.base64("raw")).write.mode("append").option("compression", "gzip").json(path)


def snapshot(df: DataFrame, path: str, version: str) -> str:
    """A backup that never replaces an older one."""
    out = f"{path}/{version}"
    df.write.mode("error").parquet(out)
    return out


def parse_time(c: Column) -> Column:
    """Seconds of an RFC 3339 text or a number, in milliseconds if over 1e12."""
    n = c.try_cast("double")
    return F.when(n > 1e12, (n / 1000).cast("bigint")).when(n.isNotNull(), n.cast("bigint")).otherwise(F.unix_timestamp(F.try_to_timestamp(c)))


def parse_transcript(lines: DataFrame) -> DataFrame:
    """(source_id, seq, kind, role, uid, session_id, ts, text) of transcript lines (source_id, seq, value).

    Blocks of a message give a row each. Housekeeping lines are skipped; a summary, a native message, text or block content are told by
    shape; whatever else stays verbatim as ``unparsed``.
    """
    get = lambda p: F.get_json_object("value", p)
    skip = F.coalesce(get("$.type").isin("queue-operation", "file-history-snapshot", "progress"), F.lit(False))
    body = F.coalesce(get("$.message.content"), get("$.content"))
    t = lines.where((F.trim("value") != "") & ~skip).select("source_id", "seq", "value", get("$.summary").alias("summary"), body.alias("body"), F.coalesce(get("$.message.role"), get("$.role")).alias("role"), F.coalesce(get("$.uuid"), get("$.id")).alias("uid"), get("$.sessionId").alias("session_id"), parse_time(get("$.timestamp")).alias("ts"))
    listed = F.col("body").startswith("[")
    t = t.withColumn("b", F.explode_outer(F.when(listed, F.from_json("body", "array<struct<type: string, text: string, name: string, input: string>>"))))
    kind = F.when(F.col("summary").isNotNull(), "summary").when(F.col("b").isNotNull(), F.coalesce("b.type", F.lit("text"))).when(F.col("body").isNotNull(), "text").otherwise("unparsed")
    tool = F.concat_ws(" ", "b.name", "b.input")
    text = F.when(kind == "summary", F.col("summary")).when(kind == "unparsed", F.col("value")).when(F.col("b").isNotNull(), F.when(F.col("b.type") == "tool_use", tool).otherwise(F.coalesce("b.text", F.lit("")))).otherwise(F.col("body"))
    return t.select("source_id", "seq", kind.alias("kind"), "role", "uid", "session_id", "ts", T.user_query_text(text).alias("text"))


def markdown_items(docs: DataFrame) -> DataFrame:
    """(id, line, text): list items and paragraphs of Markdown texts (id, text). Blank lines, headings, tables, comments and fences end an item, fenced code gives none; an
    indented line goes on with the item before it, any other line begins one. The marker of a list or quotation is stripped; an item has 8 to 500 characters, and 8 of them
    outside links; each text once a file, with its first line (from 1)."""
    raw = F.regexp_replace("raw", "\r$", "")
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("id", (F.col("at") + 1).alias("line"), raw.alias("raw"))
    cut = F.regexp_replace(F.regexp_replace("raw", f"^{T.SPACE}+", ""), f"{T.SPACE}+$", "")
    w = Window.partitionBy("id").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("t", cut).withColumn("fence", F.col("t").rlike("^(```|~~~)"))
    rows = rows.withColumn("code", F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1)
    ends = F.col("fence") | F.col("code") | (F.col("t") == "") | F.col("t").rlike("^(#|\\||<!--)")
    rows = rows.withColumn("ends", ends).withColumn("before", F.lag(~F.col("ends"), 1, False).over(w))
    more = ~F.col("ends") & F.col("before") & F.col("raw").rlike("^[ \t]")
    rows = rows.withColumn("more", more).withColumn("grp", F.sum((~F.col("more")).cast("int")).over(upto)).where(~F.col("ends"))
    mark = F.regexp_replace(F.regexp_replace("t", "^[-*+] ", ""), "^[0-9]+[.)]\\s+", "")
    part = F.when(F.col("more"), F.col("t")).otherwise(F.trim(F.regexp_replace(mark, "^>+", "")))
    items = rows.groupBy("id", "grp").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", part.alias("p")))).alias("ps"))
    items = items.select("id", "line", F.trim(F.array_join(F.col("ps.p"), " ")).alias("text"))
    bare = F.length(F.trim(F.regexp_replace("text", "!?\\[[^\\]]*\\]\\([^)]*\\)", "")))
    items = items.where(F.length("text").between(*MARKDOWN_CHARS) & (bare >= MARKDOWN_CHARS[0]))
    return items.groupBy("id", "text").agg(F.min("line").alias("line")).select("id", "line", "text")


def parse_synonyms(lines: DataFrame) -> DataFrame:
    """(project, alias, standard) of a synonym file (line, value): ``[project]`` sections, ``standard = alias, alias``, # comments, ! disabled."""
    t = lines.withColumn("v", F.trim("value")).where((F.col("v") != "") & ~F.col("v").startswith("#") & ~F.col("v").startswith("!"))
    section = F.when(F.col("v").rlike("^\\[.*\\]$"), F.trim(F.regexp_extract("v", "^\\[(.*)\\]$", 1)))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    t = t.withColumn("project", F.coalesce(F.last(section, ignorenulls=True).over(w), F.lit(""))).where(F.col("v").contains("="))
    pair = t.select("project", F.trim(F.split_part("v", F.lit("="), F.lit(1))).alias("standard"), F.explode(F.split(F.split_part("v", F.lit("="), F.lit(2)), "[,，]")).alias("alias"))
    return pair.select("project", F.trim("alias").alias("alias"), "standard").where("alias <> '' and standard <> ''")
