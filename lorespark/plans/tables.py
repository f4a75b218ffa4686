"""The engine's tables derived from the driver's, in Spark and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 1735689600
#: Memories stand for documents, observations for conversation turns, audit records for events. Plain SQL that both engines read alike.
MEMORIES = f"""SELECT doc_id AS id, coalesce(text, '') AS content,
 CASE doc_id % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'pitfall' WHEN 3 THEN 'preference' WHEN 4 THEN 'task' ELSE 'rule' END AS kind,
 CASE WHEN source = 'src0' THEN '' ELSE coalesce(source, '') END AS project, (doc_id * 7919 % 101) / CAST(100 AS DOUBLE) AS salience,
 {NOW} - (doc_id * 37 % 500) * 86400 AS created_at, {NOW} - (doc_id * 41 % 300) * 86400 AS updated_at, {NOW} - (doc_id * 53 % 200) * 86400 - doc_id % 86400 AS last_seen_at,
 CASE WHEN doc_id % 13 = 0 THEN {NOW} - 60 WHEN doc_id % 11 = 0 THEN {NOW} + 86400 END AS expires_at,
 CASE WHEN doc_id % 17 = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by, doc_id % 12 AS access_count, doc_id % 5 AS adopted_count FROM documents"""
OBSERVATIONS = f"""SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS seq, coalesce(text, '') AS summary,
 CASE role WHEN 'user' THEN 'user-prompt' WHEN 'assistant' THEN 'assistant-reply' ELSE 'system' END AS event,
 {NOW} - (conv_id * 31 % 60) * 86400 + turn * 5 AS created_at FROM conversations"""
AUDIT = """SELECT event_id, user_id AS session_id, ts, CAST(floor(value) AS BIGINT) AS ms, 'p' || CAST(user_id % 7 AS STRING) AS project,
 CASE event_type WHEN 'view' THEN 'prompt-submit' WHEN 'click' THEN 'obs-append' WHEN 'purchase' THEN 'manual-add' WHEN 'signup' THEN 'accept' ELSE 'distill' END AS event,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'overwrite' ELSE 'create' END WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'fail' ELSE 'ok' END ELSE '' END AS mode,
 CASE WHEN event_type = 'view' THEN 'q' || CAST(event_id % 50 AS STRING) ELSE '' END AS query, event_type = 'view' AND event_id % 5 = 0 AS empty, event_id % 19 = 0 AS suppressed, event_id % 9000 AS inject_bytes FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=table(spark, sf_dir, name))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a single file (one row group, so one task) is dealt out first, since every use works on its texts; a folder of files is read as it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f.getPath().getName() for f in fs.listStatus(path)]
    src = table(spark, sf_dir, "documents")
    if sum(n.endswith(".parquet") for n in files) == 1:
        src = src.repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(MEMORIES.replace("FROM documents", "FROM {src}"), src=src)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "conversations", OBSERVATIONS)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", AUDIT)


def with_sql(body: str, recursive: bool = False, **extra: str) -> str:
    """Oracle text: the derived tables and further CTEs that ``body`` names, and then ``body``."""
    ctes = {"memories": MEMORIES, "observations": OBSERVATIONS, "audit": AUDIT} | extra
    used = {k: v for k, v in ctes.items() if k in body or any(k in x for x in extra.values())}
    if not used:
        return body
    return ("WITH " + "RECURSIVE " * recursive + ", ".join(f"{k} AS ({v})" for k, v in used.items()) + " " + body).replace("STRING", "VARCHAR")
