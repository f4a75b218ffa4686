"""Queries of sources and sinks: transcripts read on from a cursor, imports, logs, seeds, ingested Markdown, and distilling by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, lifecycle
from ..sources import logs, readers
from .capture_queries import _txt
from .registry import _MARKED, _MD, _hashed, _markdown, _scrubbed, query
from .sql import HASH, STRIP
from .tables import NOW, memories, observations, table

#: Files of ASCII lines: a text's base64 with line breaks in it, the last line unfinished; some are shorter than their cursor and are read from their start.
_FILES = "SELECT * REPLACE (CASE WHEN cursor > length(body) THEN 0 ELSE cursor END AS cursor) FROM (SELECT id, 'f' || id AS path, replace(to_base64(encode(content)), 'g', chr(10)) || 'tail' AS body, id % 40 AS cursor FROM memories)"
_LINES = {
    "files_of": _FILES,
    "rest_of": "SELECT path, cursor, string_split(substr(body, cursor + 1), chr(10)) AS ls FROM files_of",
    "cut_lines": "SELECT path, cursor, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS value FROM (SELECT path, cursor, ls[1:len(ls) - 1] AS ls FROM rest_of WHERE len(ls) > 1)",
    "ends_of": "SELECT *, sum(length(value) + 1) OVER (PARTITION BY path ORDER BY pos)::BIGINT AS stop FROM cut_lines",
    "batch_of": "SELECT path, cursor + stop - length(value) - 1 AS start, value, cursor + stop AS past FROM ends_of WHERE pos < 20 AND (stop <= 400 OR pos = 0)",
}


def _files(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    body = F.concat(F.replace(F.regexp_replace(F.base64(F.encode("content", "UTF-8")), "\\s", ""), F.lit("g"), F.lit("\n")), F.lit("tail"))
    f = m.select(_txt("f", F.col("id")).alias("path"), F.encode(body, "UTF-8").alias("content"), (F.col("id") % 40).alias("offset"))
    return f.select("path", "content"), f.select("path", "offset")


@query("SELECT path, start, value FROM batch_of WHERE trim(value) <> ''", **_LINES)
def incremental_lines(spark, d):
    return logs.new_lines(*_files(memories(spark, d)), 20, 400)[0].select("path", "start", "value")


@query('SELECT path, coalesce((SELECT max(past) FROM batch_of b WHERE b.path = f.path), cursor) AS "offset" FROM files_of f', **_LINES)
def transcript_cursors(spark, d):
    return logs.new_lines(*_files(memories(spark, d)), 20, 400)[1]


_RECS = {
    "recs": f"SELECT conv_id AS source_id, turn AS seq, CASE WHEN turn % 6 = 5 THEN NULL ELSE 'u' || (conv_id % 20) || '-' || turn END AS uid, {NOW} - (conv_id * 13 + turn) % 100 AS ts, CASE WHEN turn % 7 = 3 THEN '  ' ELSE coalesce(text, '') END AS body FROM conversations",
    "first_look": f"SELECT *, CASE WHEN ts < {NOW} - 80 THEN 'old' WHEN trim(body) = '' THEN 'empty' WHEN uid LIKE '%-4' THEN 'duplicate' END AS pre FROM recs",
    "second_look": "SELECT * REPLACE (coalesce(pre, CASE WHEN uid IS NOT NULL AND row_number() OVER (PARTITION BY uid, pre IS NULL ORDER BY source_id, seq) > 1 THEN 'duplicate' END) AS pre) FROM first_look",
    "judged_recs": "SELECT source_id, seq, coalesce(pre, CASE WHEN row_number() OVER (PARTITION BY source_id, pre IS NULL ORDER BY seq) > 3 THEN 'over' ELSE 'imported' END) AS state FROM second_look",
}


def _imported(spark, d):
    c = table(spark, d, "conversations")
    i, t = F.col("conv_id"), F.col("turn")
    uid = F.when(t % 6 != 5, F.concat(F.lit("u"), (i % 20).cast("string"), F.lit("-"), t.cast("string")))
    r = c.select(i.alias("source_id"), t.alias("seq"), uid.alias("uid"), (F.lit(NOW) - (i * 13 + t) % 100).alias("ts"), F.when(t % 7 == 3, "  ").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return logs.import_transcripts(r, r.where("uid like '%-4'").select("uid"), NOW - 80, 3)


@query("SELECT source_id, seq, state FROM judged_recs", **_RECS)
def transcript_import(spark, d):
    return _imported(spark, d)[0].select("source_id", "seq", "state")


@query("SELECT state, count(*) AS n FROM judged_recs GROUP BY state", **_RECS)
def transcript_import_counts(spark, d):
    return _imported(spark, d)[1]


@query("SELECT DISTINCT value FROM (SELECT 'e' || (event_id % 500) AS value FROM events UNION ALL SELECT CASE WHEN user_id % 3 = 0 THEN ' ' ELSE 'e' || (user_id * 7) END FROM events) WHERE trim(value) <> ''")
def audit_log_union(spark, d):
    e = table(spark, d, "events")
    return logs.union_lines(e.select(_txt("e", F.col("event_id") % 500).alias("value")), e.select(F.when(F.col("user_id") % 3 == 0, " ").otherwise(_txt("e", F.col("user_id") * 7)).alias("value")))


@query("SELECT event_id AS ord, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def audit_tail(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), "event_type", "ts")
    return logs.last_records(e, 25).select("ord", "event_type")


#: The file that stands already, and clusters of the documents' opening words: a word's first two letters are its standard.
_FILE = [(0, "# words"), (1, "[src1]"), (2, "th = the, this"), (3, "[src2]"), (4, "de = des")]


@query(
    "SELECT * FROM held UNION ALL SELECT 5, '[src1]' WHERE (SELECT count(*) FROM written) > 0 UNION ALL SELECT 5 + row_number() OVER (ORDER BY standard), standard || ' = ' || a FROM written",
    held="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _FILE) + ") t(line, value)",
    opened="SELECT DISTINCT regexp_extract(lower(content), '^[^a-z]*([a-z]+)', 1) AS term FROM memories",
    written="SELECT substr(term, 1, 2) AS standard, string_agg(term, ', ' ORDER BY term) AS a FROM opened WHERE term <> substr(term, 1, 2) AND term NOT IN ('the', 'this') GROUP BY 1",
)
def synonym_writing(spark, d):
    lines = spark.createDataFrame(_FILE, "line int, value string")
    terms = memories(spark, d).select(F.regexp_extract(F.lower("content"), "^[^a-z]*([a-z]+)", 1).alias("term")).distinct().select("term", F.substring("term", 1, 2).alias("standard"))
    return logs.synonym_lines(lines, readers.parse_synonyms(lines), terms, "src1").withColumn("line", F.col("line").cast("int"))


_TOOLS = {
    "named_tools": "SELECT conv_id, turn, substr(role, 1, 1) || (length(coalesce(text, '')) % 4) AS id, substr(md5(coalesce(text, '')), 1, 6) AS name FROM conversations",
    "last_named": "SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn DESC) AS r FROM named_tools",
    "kept_tools": "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM last_named WHERE r = 1",
}


@query("SELECT conv_id, string_agg(id || '=' || name, ',' ORDER BY turn) AS tools FROM kept_tools WHERE place <= 3 GROUP BY conv_id", **_TOOLS)
def remembered_tools(spark, d):
    """Tools named in a session's first four turns, and those of its others after them."""
    text = F.coalesce("text", F.lit(""))
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.substring("role", 1, 1), (F.length(text) % 4).cast("string")).alias("id"), F.substring(F.md5(text), 1, 6).alias("name"))
    pairs = lambda of: F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("turn", "id", "name")))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))
    both = c.groupBy("conv_id").agg(pairs(F.col("turn") < 4).alias("old"), pairs(F.col("turn") >= 4).alias("new"))
    kept = logs.remember_tools(F.col("old"), F.col("new"), 3)
    return both.select("conv_id", F.array_join(F.transform(kept, lambda x: F.concat(x["id"], F.lit("="), x["name"])), ",").alias("tools"))


@query("SELECT id, CASE WHEN id % 4 = 2 THEN 'observation' ELSE 'memory' END AS layer FROM memories WHERE id % 4 <> 3")
def sandbox_seeds(spark, d):
    i = F.col("id") % 4
    m, o = logs.seeds(memories(spark, d).select("id", F.when(i == 0, "Memory ").when(i == 1, "").when(i == 2, "observation").otherwise("edge").alias("layer")))
    return m.select("id", F.lit("memory").alias("layer")).unionByName(o.select("id", F.lit("observation").alias("layer")))


_INGEST = {
    **_MD,
    "picked": "SELECT id::VARCHAR AS file, min(line)::INTEGER AS line, text FROM md_items WHERE length(text) BETWEEN 8 AND 500 AND length(trim(regexp_replace(text, '!?\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'))) >= 8 GROUP BY id, text",
    "hashed_items": f"SELECT *, sha256({STRIP.format(c='text')}) AS content_hash, CASE WHEN file::BIGINT % 2 = 0 THEN 'p' ELSE '' END AS project FROM picked",
    "firsts_of": "SELECT *, row_number() OVER (PARTITION BY content_hash, project ORDER BY file, line) AS n FROM hashed_items",
    "shelf": f"SELECT {HASH} AS content_hash, 'p' AS project, min(id) AS id, max(access_count) AS access_count, max(salience) AS salience FROM memories GROUP BY 1",
}


@query("SELECT content_hash, project, coalesce(s.id, -1) AS id, CASE WHEN n.file IS NULL THEN s.access_count WHEN s.id IS NULL THEN 0 ELSE s.access_count + 1 END AS access_count, CASE WHEN n.file IS NOT NULL THEN '{\"file\":\"' || n.file || '\",\"line\":' || n.line || '}' END AS provenance FROM (SELECT * FROM firsts_of WHERE n = 1) n FULL JOIN shelf s USING (content_hash, project)", **_INGEST)
def ingested_memories(spark, d):
    m = memories(spark, d)
    items = readers.markdown_items(_markdown(m)).withColumn("project", F.when(F.col("id") % 2 == 0, "p").otherwise(""))
    shelf = _hashed(m).groupBy("content_hash").agg(F.min("id").alias("id"), F.max("access_count").alias("access_count"), F.max("salience").alias("salience"), F.min("content").alias("content"), F.min("kind").alias("kind"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("last_seen_at").alias("last_seen_at")).withColumn("project", F.lit("p"))
    shelf = shelf.withColumns({c: F.lit(None).cast(t) for c, t in (("channel", "string"), ("expires_at", "bigint"), ("origin_tool", "string"), ("source", "string"), ("provenance", "string"))})
    return lifecycle.ingest(shelf, items, "ingest", NOW, F.lit(-1).cast("bigint")).select("content_hash", "project", "id", "access_count", "provenance")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'user' WHEN kind = 'rule' THEN 'import' ELSE 'agent' END AS channel FROM memories")
def legacy_labels(spark, d):
    m = memories(spark, d).select("id", "kind", F.when(F.col("id") % 3 == 0, "user").otherwise("").alias("channel"))
    value = F.when(F.col("kind") == "rule", "import").otherwise("agent")
    once, marks = lifecycle.label_legacy(m, spark.createDataFrame([], "mark string"), "channels", "channel", value)
    return lifecycle.label_legacy(once, marks, "channels", "channel", F.lit("never"))[0].select("id", "channel")


_SESSIONS = {
    "marked": _MARKED,
    "keys": "SELECT session_id, substr(sha256(string_agg((session_id * 1000 + seq)::VARCHAR, chr(10) ORDER BY (session_id * 1000 + seq)::VARCHAR)), 1, 32) AS window_key FROM marked GROUP BY session_id",
    "done_of": "SELECT session_id FROM keys WHERE session_id % 4 = 0",
    "found": "SELECT session_id, role, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS content, CASE WHEN regexp_matches(text, '踩坑|报错|失败|坑了|不要再|(?i:\\berror\\b)') THEN 'pitfall' WHEN regexp_matches(text, '决策|决定|定为|之所以|拍板') THEN 'decision' WHEN regexp_matches(text, '偏好|默认|禁用|优先用|不要用') THEN 'preference' WHEN regexp_matches(text, '待办|还剩|下次|做到哪|(?i:\\bTODO\\b)') THEN 'task' END AS kind FROM marked WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND session_id % 3 > 0",
    "facts_of": "SELECT session_id, count(*) AS n FROM (SELECT DISTINCT session_id, kind, content FROM found WHERE kind IS NOT NULL AND NOT (kind = 'preference' AND role = 'assistant')) GROUP BY session_id",
}


@query("SELECT k.session_id, window_key, CASE WHEN d.session_id IS NOT NULL THEN 'skipped' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN d.session_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS inserted FROM keys k LEFT JOIN done_of d USING (session_id) LEFT JOIN facts_of f ON f.session_id = k.session_id", **_SESSIONS)
def session_distill_runs(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    n = t % 5
    mark = F.when(n == 1, "TODO ").when(n == 2, "决定 ").when(n == 3, "偏好 ").otherwise("")
    turns = table(spark, d, "conversations").select(i.alias("session_id"), t.alias("seq"), F.when(i % 3 > 0, F.col("role")).otherwise("tool").alias("role"), F.concat(mark, F.coalesce("text", F.lit(""))).alias("summary"), (i * 1000 + t).alias("id"))
    keys = extraction.distill_sessions(turns, spark.createDataFrame([], "session_id bigint, window_key string, status string"))[1]
    runs = keys.select("session_id", "window_key", F.when(F.col("session_id") % 4 == 0, "ok").otherwise("fail").alias("status"))
    return extraction.distill_sessions(turns, runs)[1]


@query(f"SELECT session_id, md5('H' || chr(10) || string_agg('[' || id || '] (' || event || ') ' || {_scrubbed("trim(regexp_replace(summary, $S, $B, $G))")} || chr(10), '' ORDER BY created_at, id)) AS prompt_md5 FROM observations GROUP BY session_id".replace("$S", "'\\s+'").replace("$B", "' '").replace("$G", "'g'"))
def distill_prompts(spark, d):
    return extraction.distill_prompt(observations(spark, d), "H\n").select("session_id", F.md5("prompt").alias("prompt_md5"))
