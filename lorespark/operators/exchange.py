"""Interchange with other libraries: records merged into memories as a lattice (import) or by time (sync), their tags, superseding references and evidence links.

Records: ord, content, content_hash, kind, project, salience, access_count, created_at, updated_at, last_seen_at, expires_at, provenance, channel, origin_device,
tags map<string,array<string>>, superseded struct<hash,project>. Memories: the same columns with id and superseded_by instead of ord, tags and superseded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import grade

KEY = ["content_hash", "project"]
SLACK_SECONDS = 2
CHANNELS = ("user", "agent", "tool", "import")


def channel(c: Column) -> Column:
    """A known channel in lower case; '' for none and for unknown ones."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin(*CHANNELS), low).otherwise("")


def incoming(records: DataFrame) -> DataFrame:
    """Records whose content is not blank, trimmed, with the hash and kind they lack."""
    r = records.withColumn("content", T.strip(F.coalesce("content", F.lit("")))).where("content <> ''")
    own = F.when(F.coalesce("content_hash", F.lit("")) == "", T.content_hash(F.col("content"))).otherwise(F.col("content_hash"))
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "fact").otherwise(F.col("kind"))
    return r.withColumn("content_hash", own).withColumn("kind", kind).withColumn("channel", channel(F.col("channel")))


def _expiry(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def import_records(local: DataFrame, records: DataFrame, new_id: Column) -> DataFrame:
    """Memories after an import, one row per (content_hash, project), and was: merged, inserted or kept.

    Idempotent, and independent of order but for what is taken from the local side first: kind the least; salience, access_count, updated_at, last_seen_at the most; created_at the
    least; expires_at null if any is, else the most; content, provenance and channel the local ones, else the first that is there. new_id: a Column over ord and KEY.
    """
    r = incoming(records)
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("ord"))).alias(c)
    most = ["salience", "access_count", "updated_at", "last_seen_at"]
    r = r.groupBy(*KEY).agg(
        F.min("ord").alias("ord"), F.min_by("content", "ord").alias("content"), F.min("kind").alias("kind"), *[F.max(c).alias(c) for c in most], F.min("created_at").alias("created_at"),
        F.when(F.count("*") == F.count("expires_at"), F.max("expires_at")).alias("expires_at"), first("provenance", F.col("provenance").isNotNull()), first("channel", F.col("channel") != ""),
    )
    n = r.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in r.columns if c not in KEY], F.lit(True).alias("n_row"))
    j = local.withColumn("o_row", F.lit(True)).join(n, KEY, "full_outer")
    had, has = F.col("o_row").isNotNull(), F.col("n_row").isNotNull()
    either = lambda c, f: F.when(had & has, f(F.col(c), F.col(f"n_{c}"))).when(had, F.col(c)).otherwise(F.col(f"n_{c}")).alias(c)
    out = j.withColumn("ord", F.col("n_ord"))
    return out.select(
        *KEY, F.when(had, F.col("id")).otherwise(new_id).alias("id"), either("content", lambda a, b: a), either("kind", F.least), *[either(c, F.greatest) for c in most], either("created_at", F.least),
        either("expires_at", _expiry), either("provenance", F.coalesce), F.coalesce(either("channel", lambda a, b: F.when(a == "", b).otherwise(a)), F.lit("")).alias("channel"),
        F.col("superseded_by"), F.when(had & has, "merged").when(has, "inserted").otherwise("kept").alias("was"),
    )


def sync_records(local: DataFrame, records: DataFrame, new_id: Column, slack: int = SLACK_SECONDS) -> DataFrame:
    """Memories after a sync and was: inserted, remote (it is newer by over ``slack`` seconds: its content and time win), local (likewise: nothing but an absent provenance is
    taken), conflict (neither: local content and time, the rest as a lattice) or kept. device: where the record came from. Of records that repeat a key the newest is taken."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("updated_at"), "ord")
    r = incoming(records).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "tags", "superseded")
    n = r.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in r.columns if c not in KEY], F.lit(True).alias("n_row"))
    j = local.withColumn("o_row", F.lit(True)).join(n, KEY, "full_outer")
    had, has, gap = F.col("o_row").isNotNull(), F.col("n_row").isNotNull(), F.col("n_updated_at") - F.col("updated_at")
    was = F.when(~has, "kept").when(~had, "inserted").when(gap > slack, "remote").when(gap < -slack, "local").otherwise("conflict")
    j = j.withColumn("was", was).withColumn("ord", F.col("n_ord"))
    mine, theirs = F.col("was").isin("kept", "local"), F.col("was") == "inserted"
    join = lambda c, f: F.when(mine, F.col(c)).when(theirs, F.col(f"n_{c}")).otherwise(f(F.col(c), F.col(f"n_{c}"))).alias(c)
    win = lambda c: F.when(F.col("was").isin("remote", "inserted"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        *KEY, F.when(had, F.col("id")).otherwise(new_id).alias("id"), win("content"), join("kind", F.least), join("salience", F.greatest), join("access_count", F.greatest), win("updated_at"),
        join("last_seen_at", F.greatest), join("created_at", F.least), join("expires_at", _expiry), F.coalesce("provenance", "n_provenance").alias("provenance"),
        join("channel", lambda a, b: F.when(a == "", b).otherwise(a)), F.col("superseded_by"), "was", F.col("n_origin_device").alias("device"),
    )


def merged_tags(tags: DataFrame, merged: DataFrame, records: DataFrame) -> DataFrame:
    """(memory_id, key, value): the union of local tags and those of records, each once; a conflict of a sync is marked by ``sync = conflict:device``."""
    ids = merged.select(*KEY, F.col("id").alias("memory_id"))
    r = incoming(records).select(*KEY, F.explode("tags").alias("key", "vs")).select(*KEY, "key", F.explode("vs").alias("value"))
    out = tags.select("memory_id", "key", "value").unionByName(r.join(ids, KEY).select("memory_id", "key", "value"))
    if "device" in merged.columns:
        mark = F.concat(F.lit("conflict:"), F.coalesce("device", F.lit("")))
        out = out.unionByName(merged.where("was = 'conflict'").select(F.col("id").alias("memory_id"), F.lit("sync").alias("key"), mark.alias("value")))
    return out.distinct()


def superseding(merged: DataFrame, records: DataFrame) -> DataFrame:
    """(id, superseded_by, resolved) of records that name a superseding memory by hash and project: found among all merged memories; one that is nowhere or is the record itself is
    not resolved. The last such record of a key counts."""
    r = incoming(records).where("superseded.hash <> ''").groupBy(*KEY).agg(F.max_by("superseded", "ord").alias("s"))
    ids = merged.select(*KEY, "id")
    target = ids.select(F.col("content_hash").alias("t_hash"), F.col("project").alias("t_project"), F.col("id").alias("target"))
    j = r.join(ids, KEY).join(target, (F.col("s.hash") == F.col("t_hash")) & (F.col("s.project") == F.col("t_project")), "left")
    ok = F.coalesce(F.col("target") != F.col("id"), F.lit(False))
    return j.select("id", F.when(ok, F.col("target")).alias("superseded_by"), ok.alias("resolved"))


def superseded(merged: DataFrame, refs: DataFrame) -> DataFrame:
    """``merged`` with resolved references written over what was there."""
    r = refs.where("resolved").select("id", F.col("superseded_by").alias("_s"))
    return merged.join(r, "id", "left").withColumn("superseded_by", F.coalesce("_s", "superseded_by")).drop("_s")


def counts(merged: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: records by outcome (was), skipped ones and unresolved references."""
    was = merged.agg(*[F.count_if(F.col("was") == w).alias(w) for w in ("inserted", "merged", "remote", "local", "conflict")])
    skipped = records.agg(F.count_if(T.strip(F.coalesce("content", F.lit(""))) == "").alias("skipped"))
    return was.join(F.broadcast(skipped)).join(F.broadcast(refs.agg(F.count_if(~F.col("resolved")).alias("unresolved"))))


def linked(links: DataFrame, incoming_links: DataFrame, observations: DataFrame) -> DataFrame:
    """Evidence links of memories with those of records added, state: old, linked or skipped.

    A link without an event_uid is skipped: nothing can be checked by it. Where an observation of that uid is here, its id, and what it knows of archive, locator, sequence and time,
    take the place of the record's. A link that then has neither id nor archive is skipped. An unknown grade is told from what is there. A (memory_id, evidence_id) that is there stays.
    links: memory_id, evidence_id, event_uid, archive_hash, raw_locator, grade, seq, occurred_at_ns. observations: id, event_uid, archive_hash, raw_ref, source_seq, occurred_at_ns.
    """
    cols = ["memory_id", "evidence_id", "event_uid", "archive_hash", "raw_locator", "grade", "seq", "occurred_at_ns"]
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    o = observations.where("event_uid <> ''").select("event_uid", F.col("id").cast("string").alias("o_id"), said("archive_hash").alias("o_archive"), said("raw_ref").alias("o_raw"), F.when(F.col("source_seq") > 0, F.col("source_seq")).alias("o_seq"), F.when(F.col("occurred_at_ns") != 0, F.col("occurred_at_ns")).alias("o_at"))
    n = incoming_links.withColumn("event_uid", F.trim(F.coalesce("event_uid", F.lit("")))).join(o, "event_uid", "left")
    n = n.withColumn("evidence_id", F.coalesce("o_id", F.trim("evidence_id"), F.lit(""))).withColumn("archive_hash", F.coalesce("o_archive", F.trim("archive_hash"), F.lit("")))
    n = n.withColumn("raw_locator", F.coalesce("o_raw", F.trim("raw_locator"), F.lit(""))).withColumn("seq", F.coalesce("o_seq", "seq")).withColumn("occurred_at_ns", F.coalesce("o_at", "occurred_at_ns"))
    g = F.upper(F.trim(F.coalesce("grade", F.lit(""))))
    n = n.withColumn("grade", F.when(g.isin("A", "B", "C"), g).otherwise(grade(F.col("event_uid"), F.col("archive_hash"))))
    bad = (F.col("event_uid") == "") | ((F.col("evidence_id") == "") & (F.col("archive_hash") == ""))
    n = n.select(*cols, F.when(bad, "skipped").otherwise("linked").alias("state"), F.lit(1).alias("side"))
    both = links.select(*cols, F.lit("old").alias("state"), F.lit(0).alias("side")).unionByName(n)
    w = Window.partitionBy("memory_id", "evidence_id", F.col("state") == "skipped").orderBy("side", "event_uid", "archive_hash", "raw_locator", "seq")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1 or state = 'skipped'").select(*cols, "state")
