"""Plain reads of the engine's tables: listings, full views, ledgers, lookups of many keys at once, and what an index lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVATIONS, CANDIDATES, TRACES = 50, 50, 20


def observations(obs: DataFrame, session, limit: int = OBSERVATIONS) -> DataFrame:
    """A session's observations, oldest first."""
    return obs.where(F.col("session_id") == session).orderBy("created_at", "id").limit(limit)


def candidates(cands: DataFrame, status: str = "", session=None, project: str = "", limit: int = CANDIDATES) -> DataFrame:
    """Candidates, oldest first; each filter that is given holds."""
    out = cands if not status else cands.where(F.col("status") == status)
    out = out if session is None else out.where(F.col("session_id") == session)
    out = out if not project else out.where(F.col("project") == project)
    return out.orderBy("created_at", "id").limit(limit)


def newest(df: DataFrame, limit: int = TRACES) -> DataFrame:
    """The newest rows (created_at, then id)."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def by_refs(mem: DataFrame, refs: DataFrame, *take: str) -> DataFrame:
    """(ref, id, ...): memories by id or, failing that, by content hash. refs: ref (text)."""
    r = refs.select("ref").distinct()
    by_id = mem.select(F.col("id").cast("string").alias("ref"), F.struct("id", *take).alias("i"))
    by_hash = mem.groupBy(F.col("content_hash").alias("ref")).agg(F.min(F.struct("id", *take)).alias("h"))
    j = r.join(by_id, "ref", "left").join(by_hash, "ref", "left").withColumn("m", F.coalesce("i", "h")).where("m is not null")
    return j.select("ref", "m.id", *[F.col(f"m.{c}").alias(c) for c in take])


def trace_view(traces: DataFrame, items: DataFrame) -> DataFrame:
    """Traces (id, ...) with their items by ordinal, as one array. items: trace_id, ordinal and further columns."""
    cols = [c for c in items.columns if c not in ("trace_id", "ordinal")]
    per = items.groupBy(F.col("trace_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", *cols))).alias("items"))
    return traces.join(per, "id", "left")


def memory_view(mem: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Memories with n_tags, n_links and grade, the strongest of their links. links: memory_id, grade."""
    t = tags.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n_tags"))
    k = links.groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n_links"), F.min("grade").alias("grade"))
    return mem.join(t, "id", "left").join(k, "id", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0))).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def recent_items(items: DataFrame, traces: DataFrame, memory, limit: int = TRACES) -> DataFrame:
    """In which traces a memory came up, newest first."""
    t = traces.select(F.col("id").alias("trace_id"), "created_at", "outcome")
    return items.where(F.col("memory_id") == memory).join(t, "trace_id").orderBy(F.desc("created_at"), F.desc("trace_id")).limit(limit)


def decisions(log: DataFrame, candidates_: DataFrame) -> DataFrame:
    """Decisions on the given candidates (id) in the order they were made, with n, the place of each."""
    j = log.join(candidates_.select(F.col("id").alias("candidate_id")).distinct(), "candidate_id")
    return j.withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy("created_at", "idempotency_key")))


def bundle_view(items: DataFrame, obs: DataFrame, archives: DataFrame) -> DataFrame:
    """(bundle_id, ordinal, id, summary, byte_size): a bundle's observations in order; an archive that is not known has no bytes."""
    o = obs.select(F.col("id").cast("string").alias("id"), "summary", "archive_hash")
    return items.select("bundle_id", "ordinal", "id").join(o, "id").join(archives, "archive_hash", "left").select("bundle_id", "ordinal", "id", "summary", F.coalesce("byte_size", F.lit(0)).alias("byte_size"))


def source_heads(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, generation, last_seq) of sources; an unknown one is at generation 1, number 0."""
    return wanted.select("source_id").distinct().join(sources.select("source_id", "generation", "last_seq"), "source_id", "left").select("source_id", F.coalesce("generation", F.lit(1)).alias("generation"), F.coalesce("last_seq", F.lit(0)).alias("last_seq"))


def unsigned(mem: DataFrame, signatures: DataFrame) -> DataFrame:
    """Memories without a signature: what a backfill has to sign. signatures: id."""
    return mem.join(signatures.select("id"), "id", "left_anti")


def upsert_meta(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value pairs after writing ``new`` (key, value, ord): the last of a key counts."""
    n = new.groupBy("key").agg(F.max_by("value", "ord").alias("n"))
    return meta.join(n, "key", "full_outer").select("key", F.coalesce("n", "value").alias("value"))


def prune_claims(claims: DataFrame, now: int, keep: int) -> DataFrame:
    """Claims of the last ``keep`` seconds."""
    return claims.where(F.col("ts") >= now - keep)
