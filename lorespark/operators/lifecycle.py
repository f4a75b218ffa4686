"""Writes as merges of tables: upsert, retention, export. Each returns the new table or the decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.decay import decay_days

IDLE_DAYS, LEAST_SALIENCE, KEEP_OBS = 30, 0.2, 50_000


def upsert(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Merge on (content_hash, project). A hit takes the new content, tool, source and expiry (null without one), keeps kind, channel and
    created_at, counts an access and the larger salience, and keeps its provenance where the new one is null. Both: the merge columns."""
    k = ["content_hash", "project"]
    n = new.select(*k, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in k], F.lit(True).alias("n_row"))
    j = old.withColumn("o_row", F.lit(True)).join(n, k, "full_outer")
    hit = F.col("n_row").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    keep = lambda c: F.when(F.col("o_row").isNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    both = hit & F.col("o_row").isNotNull()
    return j.select(
        *k, keep("id"), pick("content"), keep("kind"), keep("channel"), keep("created_at"), pick("expires_at"), pick("origin_tool"), pick("source"),
        F.greatest("salience", "n_salience").alias("salience"), F.coalesce("n_provenance", "provenance").alias("provenance"),
        F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(hit, F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(both, F.col("access_count") + 1).when(hit, F.lit(0)).otherwise(F.col("access_count")).alias("access_count"),
    )


def gc_memories(mem: DataFrame, now: int, idle_days: int = IDLE_DAYS, least: float = LEAST_SALIENCE) -> DataFrame:
    """``mem`` with fate: expired, decayed (unseen for long and faded) or kept. Superseded rows are treated alike."""
    faded = (F.col("last_seen_at") < now - idle_days * 86400) & (decay_days(F.col("salience"), F.col("last_seen_at"), F.col("access_count"), now) < least)
    return mem.withColumn("fate", F.when(F.col("expires_at") <= now, "expired").when(faded, "decayed").otherwise("kept"))


def gc_observations(obs: DataFrame, referenced: DataFrame, now: int, max_age: int, keep: int = KEEP_OBS) -> DataFrame:
    """Observations that stay. Those that evidence refers to, by id or by a non-empty event_uid, always do; of the others the old ones go, and then the oldest until ``keep`` are left
    in all. obs: id, event_uid, created_at; referenced: obs_id, event_uid."""
    ids = referenced.select(F.col("obs_id").alias("id")).where("id is not null").distinct()
    uids = referenced.select("event_uid").where("event_uid <> ''").distinct()
    held = obs.join(ids, "id", "left_semi").unionByName(obs.join(ids, "id", "left_anti").join(uids, "event_uid", "left_semi").select(*obs.columns))
    free = obs.join(ids, "id", "left_anti").join(uids, "event_uid", "left_anti").select(*obs.columns).where(F.col("created_at") >= now - max_age)
    room = max(0, keep - held.count())
    return held.unionByName(free.orderBy(F.desc("created_at"), F.desc("id")).limit(room))


def gc_candidates(cand: DataFrame, now: int) -> DataFrame:
    """Pending for over 14 days: expired. Accepted over 90 days ago: gone. cand: status, created_at, decided_at."""
    out = cand.withColumn("status", F.when((F.col("status") == "pending") & (F.col("created_at") < now - 14 * 86400), "expired").otherwise(F.col("status")))
    return out.where(~((F.col("status") == "accepted") & F.coalesce(F.col("decided_at") < now - 90 * 86400, F.lit(False))))


def export_records(mem: DataFrame, tags: DataFrame) -> DataFrame:
    """Interchange rows: tags folded to key -> sorted values, the superseding row by (hash, project). Ordered writing is the sink's."""
    folded = tags.groupBy("memory_id", "key").agg(F.array_sort(F.collect_set("value")).alias("v")).groupBy("memory_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("tags"))
    target = mem.select(F.col("id").alias("superseded_by"), F.struct(F.col("content_hash").alias("hash"), "project").alias("superseded"))
    return mem.join(target, "superseded_by", "left").join(folded.withColumnRenamed("memory_id", "id"), "id", "left")


def touch(mem: DataFrame, used: DataFrame, now: int) -> DataFrame:
    n = used.groupBy("id").agg(F.count("*").alias("uses"))
    return mem.join(n, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("uses", F.lit(0))).withColumn("last_seen_at", F.when(F.col("uses") > 0, F.lit(now)).otherwise(F.col("last_seen_at"))).drop("uses")


def forget(mem: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the ids in ``gone``, and child tables (memory_id) without rows of theirs."""
    left = mem.join(gone.select("id"), "id", "left_anti")
    ids = left.select(F.col("id").alias("memory_id"))
    return left, {k: c.join(ids, "memory_id", "left_semi") for k, c in children.items()}


def newest(df: DataFrame, by: str, n: int = 200) -> DataFrame:
    """The newest ``n`` of each ``by``, oldest of them first."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("id"))
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("back")))).drop("back")


def ingest(mem: DataFrame, items: DataFrame, source: str, now: int, new_id: Column, allowed: tuple[str, ...] = ("ingest", "import", "manual")) -> DataFrame:
    """Memories after taking in Markdown items (id of the file, line, text, project) as facts: merged by content and project, with their file and line as provenance. A source that is not
    allowed is an error. new_id: a Column over the merge columns."""
    if source not in allowed:
        raise ValueError(f"source {source!r} is not one of {allowed}")
    w = Window.partitionBy("content_hash", "project").orderBy("file", "line")
    n = items.select(F.col("id").cast("string").alias("file"), "line", F.col("text").alias("content"), "project").withColumn("content_hash", T.content_hash(F.col("content")))
    n = n.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    n = n.select(
        "content_hash", "project", new_id.alias("id"), "content", F.lit("fact").alias("kind"), F.lit("import").alias("channel"), F.lit(now).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("expires_at"),
        F.lit("ingest").alias("origin_tool"), F.lit(source).alias("source"), F.lit(0.5).alias("salience"), F.to_json(F.struct("file", "line")).alias("provenance"),
    )
    return upsert(mem, n, now)


def label_legacy(mem: DataFrame, marks: DataFrame, mark: str, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """A one-time labelling: rows without ``column`` get ``value``, and the mark is set; where it is set before, nothing changes. marks: mark."""
    if not marks.where(F.col("mark") == mark).isEmpty():
        return mem, marks
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    return mem.withColumn(column, F.when(blank, value).otherwise(F.col(column))), marks.unionByName(mem.sparkSession.createDataFrame([(mark,)], "mark string"))


#: What is said of rows from before evidence was kept.
LEGACY = (("memory", "legacy/no_original_evidence"), ("observation", "legacy_unpositioned"))


def mark_legacy(mem: DataFrame, obs: DataFrame, marks: DataFrame, version: int, now: int) -> tuple[DataFrame, int]:
    """Marks (entity_type, entity_id, mark, marked_at) with one for each memory and observation there is, and the version behind it. The rows themselves are not touched: no place, archive or time is made up for them. From version 1 on nothing
    is marked, so rows that came later never are; a mark that is there stays as it is. mem, obs: id."""
    if version >= 1:
        return marks, version
    new = None
    for (kind, mark), rows in zip(LEGACY, (mem, obs), strict=True):
        part = rows.select(F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit(mark).alias("mark"), F.lit(now).cast("bigint").alias("marked_at")).distinct()
        new = part if new is None else new.unionByName(part)
    return marks.unionByName(new.join(marks, ["entity_type", "entity_id", "mark"], "left_anti").select(*marks.columns)), 1


def saved_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """(memory_id, key, value) with new ones added, each once."""
    return tags.unionByName(new.select(*tags.columns)).distinct()
