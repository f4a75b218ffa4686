"""Queries of the write path: interchange, candidates, promotion, feedback. Inputs are derived from the driver's tables alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exchange, extraction, lifecycle, promotion
from ..operators.evidence import canonical_role
from .registry import _GRADE, _ITEMS, _ROLE, _TAGS, ORACLES, _hashed_once, _items, _tags, query
from .scratch import written
from .sql import HASH
from .tables import NOW, memories, observations

# ---- interchange -----------------------------------------------------------------------------------

_BASE = f"SELECT *, {HASH} AS content_hash FROM memories"
_REFS = "SELECT b.content_hash, b.project, max(b.id) AS by_id, arg_max(t.content_hash, b.id) AS s_hash, arg_max(t.project, b.id) AS s_project FROM base b JOIN base t ON b.superseded_by = t.id WHERE b.id % 3 <> 1 GROUP BY 1, 2"
_LOCAL = "SELECT content_hash, project, min(id) AS id, min(content) AS content, max(salience) AS salience, max(access_count) AS access_count, max(updated_at) AS updated_at, max(last_seen_at) AS last_seen_at, min(created_at) AS created_at, min(kind) AS kind, max(expires_at) AS expires_at, CASE WHEN min(id) % 4 <> 0 THEN 'p' || min(id) END AS provenance, CASE WHEN min(id) % 3 = 0 THEN '' ELSE 'user' END AS channel, max(superseded_by) AS superseded_by FROM base WHERE id % 3 <> 0 GROUP BY 1, 2"
_RECORDS = """SELECT g.content_hash AS own_hash, CASE WHEN ord % 17 = 3 THEN '' ELSE g.content_hash END AS content_hash, g.project, ord, CASE WHEN ord % 29 = 1 THEN '  ' ELSE content END AS content, salience, access_count, updated_at, last_seen_at, created_at, CASE WHEN ord % 13 = 2 THEN '' ELSE kind END AS kind, expires_at, 'r' || ord AS provenance,
 CASE ord % 5 WHEN 0 THEN 'robot' WHEN 1 THEN ' Agent ' WHEN 2 THEN '' ELSE 'import' END AS channel, 'dev' || (ord % 3) AS origin_device, coalesce(s_hash, '') AS s_hash, CASE WHEN ord % 4 = 2 THEN 'nowhere' ELSE coalesce(s_project, '') END AS s_project
 FROM (SELECT content_hash, project, min(id) AS ord, min(content) AS content, max(salience) / 2 AS salience, max(access_count) + 1 AS access_count, max(updated_at) + min(id) % 7 - 3 AS updated_at, max(last_seen_at) AS last_seen_at, min(created_at) AS created_at, max(kind) AS kind, max(expires_at) AS expires_at FROM base WHERE id % 3 <> 1 GROUP BY 1, 2) g LEFT JOIN refs_of r ON r.content_hash = g.content_hash AND r.project = g.project"""
_KEPT = "SELECT * REPLACE (own_hash AS content_hash, CASE WHEN kind = '' THEN 'fact' ELSE kind END AS kind, CASE lower(trim(channel)) WHEN 'agent' THEN 'agent' WHEN 'import' THEN 'import' ELSE '' END AS channel, regexp_replace(regexp_replace(content, '^[\\s\\x{85}\\x{A0}\\x{3000}]+', ''), '[\\s\\x{85}\\x{A0}\\x{3000}]+$', '') AS content) FROM records WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''"
_EITHER = "CASE WHEN l.id IS NOT NULL AND r.ord IS NOT NULL THEN {f} ELSE coalesce(l.{c}, r.{c}) END AS {c}"
_JOINED = ", ".join(_EITHER.format(c=c, f=f"{f}(l.{c}, r.{c})") for f, c in (("least", "kind"), ("greatest", "salience"), ("greatest", "access_count"), ("greatest", "last_seen_at"), ("least", "created_at")))
_EXPIRY = "CASE WHEN l.expires_at IS NOT NULL AND r.expires_at IS NOT NULL THEN greatest(l.expires_at, r.expires_at) END"
_CHANNEL = _EITHER.format(c="channel", f="CASE WHEN l.channel = '' THEN r.channel ELSE l.channel END")
_ID = "coalesce(l.id, 1000000000 + r.ord) AS id"
_SIDES = {
    "base": _BASE, "refs_of": _REFS, "loc": _LOCAL, "records": _RECORDS, "kept": _KEPT,
    "imported": f"SELECT coalesce(l.content_hash, r.content_hash) AS content_hash, coalesce(l.project, r.project) AS project, {_ID}, coalesce(l.content, r.content) AS content, {_JOINED}, {_EITHER.format(c='updated_at', f='greatest(l.updated_at, r.updated_at)')}, {_EITHER.format(c='expires_at', f=_EXPIRY)}, coalesce(l.provenance, r.provenance) AS provenance, {_CHANNEL}, l.superseded_by, CASE WHEN r.ord IS NULL THEN 'kept' WHEN l.id IS NULL THEN 'inserted' ELSE 'merged' END AS was, r.ord FROM loc l FULL JOIN kept r ON l.content_hash = r.content_hash AND l.project = r.project",
    "judged_sync": "SELECT l.id AS l_id, r.ord AS r_ord, CASE WHEN r.ord IS NULL THEN 'kept' WHEN l.id IS NULL THEN 'inserted' WHEN r.updated_at - l.updated_at > 2 THEN 'remote' WHEN r.updated_at - l.updated_at < -2 THEN 'local' ELSE 'conflict' END AS was FROM loc l FULL JOIN kept r ON l.content_hash = r.content_hash AND l.project = r.project",
    "synced": "SELECT coalesce(l.content_hash, r.content_hash) AS content_hash, coalesce(l.project, r.project) AS project, coalesce(l.id, 1000000000 + r.ord) AS id, was, "
    + ", ".join(f"CASE WHEN was IN ('remote', 'inserted') THEN r.{c} ELSE l.{c} END AS {c}" for c in ("content", "updated_at")) + ", "
    + ", ".join(f"CASE WHEN was IN ('kept', 'local') THEN l.{c} WHEN was = 'inserted' THEN r.{c} ELSE {f} END AS {c}" for c, f in (("kind", "least(l.kind, r.kind)"), ("salience", "greatest(l.salience, r.salience)"), ("access_count", "greatest(l.access_count, r.access_count)"), ("last_seen_at", "greatest(l.last_seen_at, r.last_seen_at)"), ("created_at", "least(l.created_at, r.created_at)"), ("expires_at", _EXPIRY), ("channel", "CASE WHEN l.channel = '' THEN r.channel ELSE l.channel END")))
    + ", coalesce(l.provenance, r.provenance) AS provenance, r.origin_device AS device FROM judged_sync j LEFT JOIN loc l ON l.id = j.l_id LEFT JOIN kept r ON r.ord = j.r_ord",
    "tag_records": "SELECT content_hash, project, 'area' AS key, 'b' || (ord % 5) AS value FROM kept UNION ALL SELECT content_hash, project, 'lang', 'l' || (ord % 3) FROM kept",
    "pointed": "SELECT i.id, t.id AS target FROM kept r JOIN imported i ON i.content_hash = r.content_hash AND i.project = r.project LEFT JOIN imported t ON t.content_hash = r.s_hash AND t.project = r.s_project WHERE r.s_hash <> ''",
}


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    b = _hashed_once(memories(spark, d))
    key = ["content_hash", "project"]
    agg = lambda df, sal, acc, upd, kind, *more: df.groupBy(*key).agg(F.min("id").alias("id"), F.min("content").alias("content"), sal.alias("salience"), acc.alias("access_count"), upd.alias("updated_at"), F.max("last_seen_at").alias("last_seen_at"), F.min("created_at").alias("created_at"), kind.alias("kind"), F.max("expires_at").alias("expires_at"), *more)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    loc = agg(b.where("id % 3 <> 0"), F.max("salience"), F.max("access_count"), F.max("updated_at"), F.min("kind"), F.max("superseded_by").alias("superseded_by"))
    loc = loc.withColumn("provenance", F.when(F.col("id") % 4 != 0, name("p", F.col("id")))).withColumn("channel", F.when(F.col("id") % 3 == 0, "").otherwise("user"))
    target = b.select(F.col("id").alias("superseded_by"), F.struct(F.col("content_hash").alias("hash"), "project").alias("s"))
    refs = b.where("id % 3 <> 1").join(target, "superseded_by").groupBy(*key).agg(F.max_by("s", "id").alias("s"))
    r = agg(b.where("id % 3 <> 1"), F.max("salience") / 2, F.max("access_count") + 1, F.max("updated_at") + F.min("id") % 7 - 3, F.max("kind")).join(refs, key, "left").withColumnRenamed("id", "ord")
    o = F.col("ord")
    project = F.when(o % 4 == 2, "nowhere").otherwise(F.col("s.project"))
    r = r.withColumn("superseded", F.when(F.col("s").isNotNull(), F.struct(F.col("s.hash").alias("hash"), project.alias("project")))).drop("s")
    r = r.withColumn("content_hash", F.when(o % 17 == 3, "").otherwise(F.col("content_hash"))).withColumn("content", F.when(o % 29 == 1, "  ").otherwise(F.col("content"))).withColumn("kind", F.when(o % 13 == 2, "").otherwise(F.col("kind")))
    said = F.when(o % 5 == 0, "robot").when(o % 5 == 1, " Agent ").when(o % 5 == 2, "").otherwise("import")
    tags = F.create_map(F.lit("area"), F.array(name("b", o % 5)), F.lit("lang"), F.array(name("l", o % 3)))
    return loc, r.withColumn("provenance", name("r", o)).withColumn("channel", said).withColumn("origin_device", name("dev", o % 3)).withColumn("tags", tags)


def _new() -> F.Column:
    return F.col("ord") + F.lit(1_000_000_000)


@query("SELECT content_hash, project, id, content, kind, salience, access_count, updated_at, last_seen_at, created_at, expires_at, provenance, channel, superseded_by, was FROM imported", **_SIDES)
def import_lattice_merge(spark, d):
    return exchange.import_records(*_sides(spark, d), _new())


@query("SELECT memory_id, key, value FROM tags WHERE memory_id IN (SELECT id FROM loc) UNION SELECT i.id, key, value FROM tag_records JOIN imported i USING (content_hash, project)", tags=_TAGS, **_SIDES)
def import_tag_union(spark, d):
    loc, rec = _sides(spark, d)
    tags = _tags(memories(spark, d)).join(loc.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return exchange.merged_tags(tags, exchange.import_records(loc, rec, _new()), rec)


@query("SELECT i.id, CASE WHEN p.target <> p.id THEN p.target ELSE i.superseded_by END AS superseded_by, CASE WHEN p.id IS NULL THEN NULL ELSE coalesce(p.target <> p.id, false) END AS resolved FROM imported i LEFT JOIN pointed p ON p.id = i.id", **_SIDES)
def import_superseding(spark, d):
    loc, rec = _sides(spark, d)
    m = written(exchange.import_records(loc, rec, _new()).select(*exchange.KEY, "id", "superseded_by"), "imported")
    refs = written(exchange.superseding(m, rec), "refs")
    return exchange.superseded(m, refs).select("id", "superseded_by").join(refs.select("id", "resolved"), "id", "left")


@query("SELECT count(*) FILTER (was = 'inserted') AS inserted, count(*) FILTER (was = 'merged') AS merged, count(*) FILTER (was = 'remote') AS remote, count(*) FILTER (was = 'local') AS local, count(*) FILTER (was = 'conflict') AS conflict, (SELECT count(*) FROM records) - (SELECT count(*) FROM kept) AS skipped, (SELECT count(*) FROM pointed WHERE target IS NULL OR target = id) AS unresolved FROM imported", **_SIDES)
def import_counts(spark, d):
    loc, rec = _sides(spark, d)
    m = exchange.import_records(loc, rec, _new())
    return exchange.counts(m, rec, exchange.superseding(m, rec))


@query("SELECT content_hash, project, id, content, kind, salience, access_count, updated_at, last_seen_at, created_at, expires_at, provenance, channel, was, device FROM synced", **_SIDES)
def sync_three_way(spark, d):
    return exchange.sync_records(*_sides(spark, d), _new()).drop("superseded_by")


@query("SELECT memory_id, key, value FROM tags WHERE memory_id IN (SELECT id FROM loc) UNION SELECT s.id, key, value FROM tag_records JOIN synced s USING (content_hash, project) UNION SELECT id, 'sync', 'conflict:' || device FROM synced WHERE was = 'conflict'", tags=_TAGS, **_SIDES)
def sync_conflict_tags(spark, d):
    loc, rec = _sides(spark, d)
    tags = _tags(memories(spark, d)).join(loc.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    return exchange.merged_tags(tags, exchange.sync_records(loc, rec, _new()), rec)


_LINK = {
    "items": _ITEMS,
    "ledger": "SELECT 'o' || id AS id, 'e' || id AS event_uid, CASE WHEN id % 3 = 0 THEN '' ELSE 'arc' || (id % 5) END AS archive_hash, CASE WHEN id % 4 = 0 THEN '' ELSE 'seg' || id || '#1' END AS raw_ref, id % 6 AS source_seq, id * 1000 % 7000 AS occurred_at_ns FROM memories WHERE id % 2 = 0",
    "have": "SELECT candidate_id AS memory_id, evidence_id, event_uid, archive AS archive_hash, '' AS raw_locator, 'C' AS grade, seq::BIGINT AS seq, 0::BIGINT AS occurred_at_ns FROM items WHERE seq = 0",
    "come": "SELECT candidate_id AS memory_id, CASE WHEN candidate_id % 8 = 1 THEN '' ELSE evidence_id END AS evidence_id, event_uid, archive AS archive_hash, 'far' AS raw_locator, CASE seq WHEN 1 THEN ' b ' ELSE '?' END AS grade, seq::BIGINT AS seq, 5::BIGINT AS occurred_at_ns FROM items",
    "met": "SELECT memory_id, coalesce(o.id, c.evidence_id) AS evidence_id, c.event_uid, coalesce(nullif(o.archive_hash, ''), c.archive_hash) AS archive_hash, coalesce(nullif(o.raw_ref, ''), c.raw_locator) AS raw_locator, c.grade AS said, CASE WHEN o.source_seq > 0 THEN o.source_seq ELSE c.seq END AS seq, CASE WHEN o.occurred_at_ns <> 0 THEN o.occurred_at_ns ELSE c.occurred_at_ns END AS occurred_at_ns FROM come c LEFT JOIN ledger o ON c.event_uid <> '' AND o.event_uid = c.event_uid",
    "told": "SELECT *, CASE WHEN upper(trim(said)) IN ('A', 'B', 'C') THEN upper(trim(said)) WHEN event_uid <> '' AND archive_hash <> '' THEN 'A' WHEN event_uid <> '' OR archive_hash <> '' THEN 'B' ELSE 'C' END AS grade, CASE WHEN event_uid = '' OR evidence_id = '' AND archive_hash = '' THEN 'skipped' ELSE 'linked' END AS state FROM met",
    "every": "SELECT memory_id, evidence_id, event_uid, archive_hash, raw_locator, grade, seq, occurred_at_ns, 'old' AS state, 0 AS side FROM have UNION ALL SELECT memory_id, evidence_id, event_uid, archive_hash, raw_locator, grade, seq, occurred_at_ns, state, 1 FROM told",
}


@query("SELECT memory_id, evidence_id, event_uid, archive_hash, raw_locator, grade, seq, occurred_at_ns, state FROM (SELECT *, row_number() OVER (PARTITION BY memory_id, evidence_id, state = 'skipped' ORDER BY side, event_uid, archive_hash, raw_locator, seq) AS n FROM every) WHERE n = 1 OR state = 'skipped'", **_LINK)
def evidence_link_merge(spark, d):
    m = memories(spark, d)
    return exchange.linked(_have(m), _come(m), _ledger(m))


def _ledger(m: DataFrame) -> DataFrame:
    i = F.col("id")
    txt = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return m.where("id % 2 = 0").select(txt("o", i).alias("id"), txt("e", i).alias("event_uid"), F.when(i % 3 == 0, "").otherwise(txt("arc", i % 5)).alias("archive_hash"), F.when(i % 4 == 0, "").otherwise(F.concat(txt("seg", i), F.lit("#1"))).alias("raw_ref"), (i % 6).alias("source_seq"), (i * 1000 % 7000).alias("occurred_at_ns"))


def _have(m: DataFrame) -> DataFrame:
    return _items(m).where("seq = 0").select(F.col("candidate_id").alias("memory_id"), "evidence_id", "event_uid", F.col("archive").alias("archive_hash"), F.lit("").alias("raw_locator"), F.lit("C").alias("grade"), F.col("seq").cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("occurred_at_ns"))


def _come(m: DataFrame) -> DataFrame:
    eid = F.when(F.col("candidate_id") % 8 == 1, "").otherwise(F.col("evidence_id"))
    return _items(m).select(F.col("candidate_id").alias("memory_id"), eid.alias("evidence_id"), "event_uid", F.col("archive").alias("archive_hash"), F.lit("far").alias("raw_locator"), F.when(F.col("seq") == 1, " b ").otherwise("?").alias("grade"), F.col("seq").cast("bigint").alias("seq"), F.lit(5).cast("bigint").alias("occurred_at_ns"))


# ---- candidates ------------------------------------------------------------------------------------

_PROMOTE = {
    "base": _BASE,
    "items": _ITEMS,
    "cands": f"SELECT id, id % 50 AS session_id, CASE WHEN kind = 'rule' THEN 'fact' ELSE kind END AS kind, content, content_hash, project, CASE id % 4 WHEN 2 THEN 'accepted' WHEN 3 THEN 'rejected' ELSE CASE WHEN id % 19 = 0 THEN 'expired' ELSE 'pending' END END AS status, id % 3 AS revision, CASE WHEN id % 7 = 0 THEN 1.5 ELSE salience END AS salience, CASE WHEN id % 4 = 2 THEN id END AS memory_id, CASE WHEN id % 4 >= 2 THEN {NOW} - 5 END AS decided_at, created_at FROM base",
    "asked": "SELECT id, CASE id % 5 WHEN 0 THEN -1 WHEN 1 THEN id % 3 ELSE id % 3 + id % 2 END AS expected FROM base WHERE id % 5 <> 4 UNION ALL SELECT -5, -1",
    "ruled": "SELECT a.id, a.expected, c.* EXCLUDE (id), CASE WHEN status IS NULL THEN 'missing' WHEN status NOT IN ('pending', '{done}') THEN 'closed' WHEN expected >= 0 AND expected <> revision THEN 'conflict' WHEN status = '{done}' THEN 'already' ELSE 'commit' END AS outcome FROM asked a LEFT JOIN cands c ON c.id = a.id",
    "lib": "SELECT content_hash, project, min(id) AS id, min(content) AS content, min(kind) AS kind, max(salience) AS salience, max(access_count) AS access_count, max(adopted_count) AS adopted_count, max(updated_at) AS updated_at, max(last_seen_at) AS last_seen_at, min(created_at) AS created_at, 'user' AS source FROM base WHERE id % 3 = 0 GROUP BY 1, 2",
    "won": "SELECT content_hash, project, count(*) AS n, min(id) AS first, arg_max(content, id) AS content, arg_min(kind, id) AS kind, max(CASE WHEN salience > 0 AND salience <= 1 THEN salience ELSE 0.5 END) AS salience FROM ruled WHERE outcome = 'commit' GROUP BY 1, 2",
    "mem_after": f"SELECT coalesce(l.id, 1000000000 + w.first) AS id, coalesce(w.content, l.content) AS content, coalesce(l.content_hash, w.content_hash) AS content_hash, coalesce(l.project, w.project) AS project, coalesce(l.kind, w.kind) AS kind, CASE WHEN w.n IS NULL THEN l.salience ELSE greatest(l.salience, w.salience) END AS salience, CASE WHEN l.id IS NULL THEN w.n - 1 ELSE l.access_count + coalesce(w.n, 0) END AS access_count, coalesce(l.adopted_count, 0) + coalesce(w.n, 0) AS adopted_count, CASE WHEN w.n IS NULL THEN l.updated_at ELSE {NOW} END AS updated_at, CASE WHEN w.n IS NULL THEN l.last_seen_at ELSE {NOW} END AS last_seen_at, coalesce(l.created_at, {NOW}) AS created_at, CASE WHEN w.n IS NULL THEN l.source ELSE 'distill-accept' END AS source FROM lib l FULL JOIN won w ON l.content_hash = w.content_hash AND l.project = w.project",
    "cand_after": f"SELECT c.* REPLACE (CASE WHEN r.id IS NULL THEN c.status ELSE 'accepted' END AS status, CASE WHEN r.id IS NULL THEN c.decided_at ELSE {NOW} END AS decided_at, CASE WHEN r.id IS NULL THEN c.memory_id ELSE m.id END AS memory_id, CASE WHEN r.id IS NULL THEN c.revision ELSE c.revision + 1 END AS revision) FROM cands c LEFT JOIN (SELECT id FROM ruled WHERE outcome = 'commit') r ON r.id = c.id LEFT JOIN mem_after m ON m.content_hash = c.content_hash AND m.project = c.project",
    "hashes": f"SELECT candidate_id, sha256(string_agg(line || chr(10), '' ORDER BY line || chr(10))) AS h FROM (SELECT candidate_id, event_uid || '|' || evidence_id || '|' || archive || '|' || {_GRADE} || '|' || {_ROLE} || '|' || seq AS line FROM items) GROUP BY 1",
}
_ACCEPT = _PROMOTE | {"ruled": _PROMOTE["ruled"].replace("{done}", "accepted")}
_REJECT = _PROMOTE | {"ruled": _PROMOTE["ruled"].replace("{done}", "rejected")}


def _promote(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, requests, the library, evidence items."""
    b = _hashed_once(memories(spark, d))
    i = F.col("id")
    status = F.when(i % 4 == 2, "accepted").when(i % 4 == 3, "rejected").when(i % 19 == 0, "expired").otherwise("pending")
    c = b.select("id", (i % 50).alias("session_id"), F.when(F.col("kind") == "rule", "fact").otherwise(F.col("kind")).alias("kind"), "content", "content_hash", "project", status.alias("status"), (i % 3).alias("revision"), F.when(i % 7 == 0, 1.5).otherwise(F.col("salience")).alias("salience"), F.when(i % 4 == 2, i).alias("memory_id"), F.when(i % 4 >= 2, F.lit(NOW - 5)).alias("decided_at"), "created_at")
    expected = F.when(i % 5 == 0, -1).when(i % 5 == 1, i % 3).otherwise(i % 3 + i % 2).cast("bigint")
    asked = b.where("id % 5 <> 4").select("id", expected.alias("expected")).unionByName(spark.range(1).select(F.lit(-5).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("expected")))
    most = lambda *cs: [F.max(x).alias(x) for x in cs]
    lib = b.where("id % 3 = 0").groupBy("content_hash", "project").agg(F.min("id").alias("id"), F.min("content").alias("content"), F.min("kind").alias("kind"), *most("salience", "access_count", "adopted_count", "updated_at", "last_seen_at"), F.min("created_at").alias("created_at"), F.lit("user").alias("source"))
    return c, asked, lib, _items(memories(spark, d))


def _first() -> F.Column:
    return F.col("first") + F.lit(1_000_000_000)


@query("SELECT id, outcome FROM ruled", **_ACCEPT)
def accept_outcomes(spark, d):
    c, asked, _, _ = _promote(spark, d)
    return promotion.judge(c, asked, "accepted").select("id", "outcome")


@query("SELECT id, status, decided_at, memory_id, revision FROM cand_after", **_ACCEPT)
def accept_candidates(spark, d):
    c, asked, lib, _ = _promote(spark, d)
    return promotion.accept(c, asked, lib, NOW, _first())[0].select("id", "status", "decided_at", "memory_id", "revision")


@query("SELECT id, content_hash, project, content, kind, salience, access_count, adopted_count, updated_at, last_seen_at, created_at, source FROM mem_after", **_ACCEPT)
def accept_memories(spark, d):
    c, asked, lib, _ = _promote(spark, d)
    return promotion.accept(c, asked, lib, NOW, _first())[1]


@query("SELECT id, status, decided_at, memory_id, revision FROM cand_after", **(_ACCEPT | {"asked": "SELECT id, revision AS expected FROM base_cands WHERE status = 'accepted'", "base_cands": _PROMOTE["cands"], "cands": "SELECT * FROM base_cands"}))
def accept_replay(spark, d):
    """Accepting again what is accepted changes no candidate."""
    c, _, lib, _ = _promote(spark, d)
    asked = c.where("status = 'accepted'").select("id", F.col("revision").alias("expected"))
    return promotion.accept(c, asked, lib, NOW, _first())[0].select("id", "status", "decided_at", "memory_id", "revision")


_KEYED = "sha256(r.id || '|' || revision || '|{action}|' || coalesce(h, sha256('')))"


@query(f"SELECT r.id AS candidate_id, revision, coalesce(h, sha256('')) AS evidence_hash, 'human_accept' AS action, 'human' AS actor, {_KEYED.format(action='human_accept')} AS idempotency_key, memory_id FROM ruled r LEFT JOIN hashes ON candidate_id = r.id WHERE outcome IN ('commit', 'already')", **_ACCEPT)
def accept_decisions(spark, d):
    c, asked, _, items = _promote(spark, d)
    new = promotion.decisions(promotion.judge(c, asked, "accepted"), items, "human_accept")
    return promotion.append_decisions(promotion.append_decisions(new.where("false"), new), new)


@query(f"SELECT c.id, CASE WHEN r.id IS NULL THEN status ELSE 'rejected' END AS status, CASE WHEN r.id IS NULL THEN decided_at ELSE {NOW} END AS decided_at, CASE WHEN r.id IS NULL THEN revision ELSE revision + 1 END AS revision FROM cands c LEFT JOIN (SELECT id FROM ruled WHERE outcome = 'commit') r ON r.id = c.id", **_REJECT)
def reject_candidates(spark, d):
    c, asked, _, _ = _promote(spark, d)
    return promotion.reject(c, asked, NOW).select("id", "status", "decided_at", "revision")


@query("SELECT memory_id AS src, id AS dst, 'derived_from' AS rel FROM cand_after WHERE status = 'accepted' AND memory_id IS NOT NULL", **_ACCEPT)
def derived_edges(spark, d):
    c, asked, lib, _ = _promote(spark, d)
    return promotion.derived(promotion.accept(c, asked, lib, NOW, _first())[0])


_AUTO = """SELECT c.id AS candidate_id, c.revision, coalesce(h, sha256('')) AS evidence_hash, CASE WHEN kind IN ('decision', 'preference') OR kind = 'fact' AND project = '' THEN 'human_accept'
 WHEN kind = 'fact' AND da OR kind = 'pitfall' AND coalesce(er AND re AND eb AND rb, false) THEN 'auto_commit' ELSE 'defer' END AS action FROM cands c LEFT JOIN (SELECT candidate_id, bool_or(role = 'direct' AND grade = 'A') AS da, bool_or(role = 'error') AS er, bool_or(role = 'resolution') AS re, bool_or(role = 'error' AND grade <> 'C') AS eb, bool_or(role = 'resolution' AND grade <> 'C') AS rb FROM (SELECT candidate_id, """ + _ROLE + " AS role, " + _GRADE + " AS grade FROM items) GROUP BY 1) e ON e.candidate_id = c.id LEFT JOIN hashes x ON x.candidate_id = c.id WHERE status = 'pending'"


@query("SELECT candidate_id, revision, evidence_hash, action, sha256(candidate_id || '|' || revision || '|' || action || '|' || evidence_hash) AS idempotency_key FROM auto_log", auto_log=_AUTO, **_ACCEPT)
def auto_commit_log(spark, d):
    c, _, _, items = _promote(spark, d)
    cands = c.withColumn("scope", F.lit("project")).withColumn("task_state", F.lit(""))
    return promotion.auto_commit(cands, items)[1].select("candidate_id", "revision", "evidence_hash", "action", "idempotency_key")


@query("SELECT c.id, status, revision FROM cand_after c", auto_log=_AUTO, **(_ACCEPT | {"asked": "SELECT candidate_id AS id, revision AS expected FROM auto_log WHERE action = 'auto_commit'"}))
def auto_commit_candidates(spark, d):
    c, _, lib, items = _promote(spark, d)
    asked, _ = promotion.auto_commit(c.withColumn("scope", F.lit("project")).withColumn("task_state", F.lit("")), items)
    return promotion.accept(c, asked, lib, NOW, _first())[0].select("id", "status", "revision")


_NEW_CANDS = "SELECT id AS ord, 1000000000 + id AS id, id // 2 % 50 AS session_id, CASE WHEN id % 11 = 0 THEN 'rule' ELSE 'fact' END AS kind, CASE WHEN id % 13 = 0 THEN ' ' ELSE content END AS content, content_hash FROM base"
_INSERTED = {
    "news": _NEW_CANDS,
    "fit": "SELECT *, trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND kind <> 'rule' AS ok FROM news",
    "open_ones": "SELECT session_id, content_hash, arg_max(id, {'c': created_at, 'i': id}) AS have FROM cands WHERE status IN ('pending', 'accepted') GROUP BY 1, 2",
    "leads": "SELECT session_id, content_hash, min(ord) AS lead, arg_min(id, ord) AS lead_id FROM fit WHERE ok GROUP BY 1, 2",
}


@query("SELECT ord, CASE WHEN NOT ok THEN 'invalid' WHEN have IS NULL AND lead = ord THEN 'created' ELSE 'merged' END AS state, CASE WHEN ok THEN coalesce(have, lead_id) END AS id FROM fit f LEFT JOIN open_ones USING (session_id, content_hash) LEFT JOIN leads USING (session_id, content_hash)", **_INSERTED, **_ACCEPT)
def candidate_insert(spark, d):
    c, _, _, _ = _promote(spark, d)
    i = F.col("id")
    new = memories(spark, d).select(i.alias("ord"), (i + 1_000_000_000).alias("id"), F.expr("id div 2 % 50").alias("session_id"), F.when(i % 11 == 0, "rule").otherwise("fact").alias("kind"), F.when(i % 13 == 0, " ").otherwise(F.col("content")).alias("content"))
    return promotion.insert_candidates(c, new)


@query("SELECT candidate_id, evidence_id, event_uid, evidence_role FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, evidence_id, evidence_role ORDER BY side, event_uid) AS n FROM (SELECT candidate_id, evidence_id, event_uid, role AS evidence_role, 0 AS side FROM items WHERE seq < 2 UNION ALL SELECT candidate_id, evidence_id, 'n' || event_uid, CASE WHEN candidate_id % 2 = 0 THEN 'direct' ELSE role END, 1 FROM items)) WHERE n = 1", items=_ITEMS)
def candidate_evidence_merge(spark, d):
    i = _items(memories(spark, d))
    have = i.where("seq < 2").select("candidate_id", "evidence_id", "event_uid", F.col("role").alias("evidence_role"))
    new = i.select("candidate_id", "evidence_id", F.concat(F.lit("n"), "event_uid").alias("event_uid"), F.when(F.col("candidate_id") % 2 == 0, "").otherwise(F.col("role")).alias("evidence_role"))
    return promotion.merge_candidate_evidence(have, new)


_LOADED = {
    "items": _ITEMS,
    "ledger": _LINK["ledger"],
    "cand_links": "SELECT candidate_id, CASE seq WHEN 0 THEN 'o' || candidate_id WHEN 1 THEN '' ELSE 'x' || candidate_id END AS evidence_id, event_uid, archive AS archive_hash, role AS evidence_role, seq::BIGINT AS source_seq FROM items",
    "loaded": "SELECT candidate_id, coalesce(o.id, u.id, l.evidence_id) AS evidence_id, CASE WHEN l.event_uid = '' THEN coalesce(o.event_uid, u.event_uid, '') ELSE l.event_uid END AS event_uid, CASE WHEN l.archive_hash = '' THEN coalesce(CASE WHEN o.id IS NOT NULL THEN o.archive_hash ELSE u.archive_hash END, '') ELSE l.archive_hash END AS archive, evidence_role AS role, CASE WHEN coalesce(o.source_seq, u.source_seq) > 0 THEN coalesce(o.source_seq, u.source_seq) ELSE l.source_seq END AS seq, coalesce(o.occurred_at_ns, u.occurred_at_ns, 0) AS occurred_at, coalesce(o.raw_ref, u.raw_ref, '') AS raw FROM cand_links l LEFT JOIN ledger o ON o.id = l.evidence_id LEFT JOIN ledger u ON l.event_uid <> '' AND u.event_uid = l.event_uid WHERE NOT (l.evidence_id = '' AND l.event_uid = '')",
    "graded_items": "SELECT * EXCLUDE (raw), CASE WHEN raw <> '' THEN raw WHEN archive = '' THEN '' WHEN seq > 0 THEN archive || '#' || seq ELSE archive END AS locator, CASE WHEN event_uid <> '' AND archive <> '' THEN 'A' WHEN event_uid <> '' OR archive <> '' THEN 'B' ELSE 'C' END AS grade FROM loaded",
}


def _loaded(spark, d) -> DataFrame:
    m = memories(spark, d)
    own = F.col("candidate_id").cast("string")
    eid = F.when(F.col("seq") == 0, F.concat(F.lit("o"), own)).when(F.col("seq") == 1, "").otherwise(F.concat(F.lit("x"), own))
    links = _items(m).select("candidate_id", eid.alias("evidence_id"), "event_uid", F.col("archive").alias("archive_hash"), F.col("role").alias("evidence_role"), F.col("seq").cast("bigint").alias("source_seq"))
    return promotion.load_evidence(links, _ledger(m))


@query("SELECT candidate_id, evidence_id, event_uid, archive, role, seq, occurred_at, locator, grade FROM graded_items", **_LOADED)
def evidence_loading(spark, d):
    return _loaded(spark, d)


@query("SELECT memory_id, evidence_id, event_uid, archive, locator, grade, seq, occurred_at FROM (SELECT memory_id, g.*, row_number() OVER (PARTITION BY memory_id, evidence_id ORDER BY candidate_id, role) AS n FROM graded_items g JOIN (SELECT id, memory_id FROM cand_after WHERE status = 'accepted' AND memory_id IS NOT NULL) a ON a.id = candidate_id) WHERE n = 1", **(_ACCEPT | _LOADED))
def accepted_evidence_links(spark, d):
    c, asked, lib, _ = _promote(spark, d)
    return promotion.accepted_links(promotion.accept(c, asked, lib, NOW, _first())[0], _loaded(spark, d))


_BARE = "CASE WHEN trim({c}) <> '' THEN substr(regexp_replace(trim({c}), '^(evt_)?(ev_)?', ''), 1, 8) END"


@query(
    "SELECT b.id, '{\"preview\":\"' || coalesce(p.line, 'candidate:' || substr(b.id::VARCHAR, 1, 8)) || '\",\"source\":\"commit\"}' AS provenance FROM base b LEFT JOIN (SELECT candidate_id, substr('证据' || count(*) || '条·' || min(grade) || '级' || coalesce('·' || arg_min(token, spot) || CASE WHEN count(*) > 1 THEN '+' || (count(*) - 1) ELSE '' END, ''), 1, 40) AS line FROM pieces GROUP BY 1) p ON p.candidate_id = b.id",
    base=_BASE,
    pieces=f"SELECT candidate_id, key, min(spot) AS spot, arg_min(grade, spot) AS grade, arg_min(token, spot) AS token FROM (SELECT candidate_id, grade, {{'o': occurred_at, 's': seq, 'e': event_uid, 'l': evidence_id}} AS spot, CASE WHEN event_uid <> '' THEN 'e:' || event_uid WHEN archive <> '' THEN 'a:' || archive WHEN locator <> '' THEN 'r:' || locator ELSE 'idx:' || evidence_id END AS key, coalesce({_BARE.format(c='event_uid')}, {_BARE.format(c='archive')}, {_BARE.format(c='locator')}) AS token FROM graded_items) GROUP BY 1, 2",
    **_LOADED,
)
def commit_provenance(spark, d):
    return promotion.commit_provenance(memories(spark, d), _loaded(spark, d))


_COMMIT = _ACCEPT | {
    "prov_of": ORACLES["commit_provenance"],
    "shelved": "SELECT id, 'manual' AS origin_tool, CASE WHEN id % 2 = 0 THEN 'user' ELSE '' END AS channel, CASE WHEN id % 9 = 0 THEN 'kept' WHEN id % 9 = 3 THEN '' END AS provenance, NULL::BIGINT AS last_adopted_at FROM lib",
    "told": "SELECT r.id, r.content_hash, r.project, r.memory_id, CASE WHEN outcome = 'already' AND l.id IS NULL THEN 'lost' ELSE outcome END AS outcome FROM ruled r LEFT JOIN lib l ON l.id = r.memory_id",
    "come": "SELECT t.id, m.id AS memory_id, outcome FROM told t JOIN mem_after m ON t.content_hash = m.content_hash AND t.project = m.project WHERE outcome = 'commit' UNION ALL SELECT id, memory_id, outcome FROM told WHERE outcome = 'already'",
    "given_prov": "SELECT c.memory_id AS id, arg_min(p.provenance, c.id) AS p, bool_or(outcome = 'commit') AS hit FROM come c JOIN prov_of p ON p.id = c.id GROUP BY 1",
}


def _committed(spark, d) -> promotion.Commit:
    c, asked, lib, _ = _promote(spark, d)
    i = F.col("id")
    lib = lib.withColumns({"origin_tool": F.lit("manual"), "channel": F.when(i % 2 == 0, "user").otherwise(""), "provenance": F.when(i % 9 == 0, "kept").when(i % 9 == 3, ""), "last_adopted_at": F.lit(None).cast("bigint")})
    links = spark.createDataFrame([], "memory_id bigint, evidence_id string, event_uid string, archive string, locator string, grade string, seq bigint, occurred_at bigint")
    log = spark.createDataFrame([], "candidate_id bigint, revision bigint, evidence_hash string, action string, actor string, idempotency_key string, memory_id bigint")
    return promotion.commit(c, asked, lib, _loaded(spark, d), links, spark.createDataFrame([], "src bigint, dst bigint, rel string"), log, NOW, _first())


@query(f"SELECT m.id, m.content_hash, m.adopted_count, CASE WHEN g.hit THEN 'distill' ELSE origin_tool END AS origin_tool, CASE WHEN s.id IS NULL THEN 'agent' ELSE channel END AS channel, CASE WHEN coalesce(provenance, '') = '' THEN coalesce(g.p, provenance) ELSE provenance END AS provenance, CASE WHEN g.hit THEN {NOW} ELSE last_adopted_at END AS last_adopted_at FROM mem_after m LEFT JOIN shelved s ON s.id = m.id LEFT JOIN given_prov g ON g.id = m.id", **_COMMIT)
def committed_memories(spark, d):
    return _committed(spark, d).memories.select("id", "content_hash", "adopted_count", "origin_tool", "channel", "provenance", "last_adopted_at")


@query("SELECT id, outcome FROM told", **_COMMIT)
def commit_outcomes(spark, d):
    return _committed(spark, d).outcomes


@query("SELECT DISTINCT memory_id AS src, id AS dst, 'derived_from' AS rel FROM come", **_COMMIT)
def commit_edges(spark, d):
    return _committed(spark, d).edges


@query(f"SELECT 'memory' AS entity_type, id::VARCHAR AS entity_id, 'legacy/no_original_evidence' AS mark, CASE WHEN id % 5 = 0 THEN 7 ELSE {NOW} END AS marked_at FROM memories UNION ALL SELECT DISTINCT 'observation', id::VARCHAR, 'legacy_unpositioned', {NOW} FROM observations")
def migration_marks(spark, d):
    m = memories(spark, d)
    had = m.where("id % 5 = 0").select(F.lit("memory").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.lit(lifecycle.LEGACY[0][1]).alias("mark"), F.lit(7).cast("bigint").alias("marked_at"))
    marks, version = lifecycle.mark_legacy(m, observations(spark, d), had, 0, NOW)
    return lifecycle.mark_legacy(m.limit(0), observations(spark, d).limit(0), marks, version, NOW + 1)[0]


# ---- feedback, attribution, channels ---------------------------------------------------------------

_FEEDBACK = {
    "shown": "SELECT id // 4 AS trace_id, id AS memory_id, CASE id % 6 WHEN 0 THEN 'adopted' WHEN 1 THEN 'negative' ELSE '' END AS feedback FROM memories",
    "given": "SELECT id AS ord, id // 4 AS trace_id, CASE WHEN id % 9 = 4 THEN substr(id::VARCHAR, 1, 1) WHEN id % 10 = 7 THEN 'none' ELSE id::VARCHAR END AS memory, CASE id % 5 WHEN 0 THEN ' Adopted' WHEN 1 THEN 'liked' WHEN 2 THEN 'negative' ELSE 'adopted' END AS feedback FROM memories UNION ALL SELECT 1000000000 + id, id // 4, id::VARCHAR, 'negative' FROM memories WHERE id % 3 = 0",
    "cleaned": "SELECT ord, trace_id, memory, lower(trim(feedback)) AS feedback FROM given",
    "sought": "SELECT ord, any_value(c.trace_id) AS trace_id, any_value(c.feedback) AS feedback, count(*) FILTER (starts_with(memory_id::VARCHAR, memory)) AS n, min(memory_id::VARCHAR) FILTER (starts_with(memory_id::VARCHAR, memory)) AS m, arg_min(s.feedback, memory_id::VARCHAR) FILTER (starts_with(memory_id::VARCHAR, memory)) AS was FROM cleaned c LEFT JOIN shown s ON s.trace_id = c.trace_id GROUP BY ord",
    "sorted_out": "SELECT *, CASE WHEN feedback NOT IN ('adopted', 'negative') THEN 'unknown' WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'ambiguous' END AS bad FROM sought",
    "told": "SELECT ord, trace_id, m, coalesce(bad, CASE WHEN was = '' AND row_number() OVER w = 1 THEN feedback WHEN feedback = CASE WHEN was <> '' THEN was ELSE first(feedback) OVER w END THEN 'same' ELSE 'flip' END) AS outcome FROM sorted_out WINDOW w AS (PARTITION BY trace_id, m, bad IS NULL ORDER BY ord)",
}


def _feedback(spark, d):
    m = memories(spark, d)
    i = F.col("id")
    trace = F.expr("id div 4")
    items = m.select(trace.alias("trace_id"), i.alias("memory_id"), F.when(i % 6 == 0, "adopted").when(i % 6 == 1, "negative").otherwise("").alias("feedback"))
    text = i.cast("string")
    one = m.select(i.alias("ord"), trace.alias("trace_id"), F.when(i % 9 == 4, F.substring(text, 1, 1)).when(i % 10 == 7, "none").otherwise(text).alias("memory"), F.when(i % 5 == 0, " Adopted").when(i % 5 == 1, "liked").when(i % 5 == 2, "negative").otherwise("adopted").alias("feedback"))
    two = m.where("id % 3 = 0").select((i + 1_000_000_000).alias("ord"), trace.alias("trace_id"), text.alias("memory"), F.lit("negative").alias("feedback"))
    return promotion.feedback(items, one.unionByName(two), m, NOW)


@query("SELECT ord, outcome, m FROM told", **_FEEDBACK)
def feedback_outcomes(spark, d):
    return _feedback(spark, d)[2]


@query("SELECT s.trace_id, s.memory_id, coalesce(t.outcome, s.feedback) AS feedback FROM shown s LEFT JOIN (SELECT * FROM told WHERE outcome IN ('adopted', 'negative')) t ON t.trace_id = s.trace_id AND t.m = s.memory_id::VARCHAR", **_FEEDBACK)
def feedback_items(spark, d):
    return _feedback(spark, d)[0]


@query(f"SELECT id, adopted_count + coalesce(n, 0) AS adopted_count, access_count + coalesce(n, 0) AS access_count, CASE WHEN n > 0 THEN {NOW} END AS last_adopted_at, CASE WHEN n > 0 THEN {NOW} ELSE last_seen_at END AS last_seen_at FROM memories LEFT JOIN (SELECT m, count(*) AS n FROM told WHERE outcome = 'adopted' GROUP BY m) ON m = id::VARCHAR", **_FEEDBACK)
def adopted_memories(spark, d):
    return _feedback(spark, d)[1].select("id", "adopted_count", "access_count", "last_adopted_at", "last_seen_at")


_FACTS = "SELECT DISTINCT ON (session_id) session_id AS fact_id, [session_id * 1000, session_id * 1000 + 1 + session_id % 4, -1] AS obs_ids, CASE session_id % 4 WHEN 0 THEN 'Assistant' WHEN 1 THEN 'robot' ELSE '' END AS attributed_to FROM observations"


@query("SELECT fact_id, coalesce(CASE WHEN max(s = 'user') THEN 'user' WHEN count(s) > 0 THEN 'assistant' END, any_value(CASE WHEN lower(attributed_to) IN ('user', 'assistant') THEN lower(attributed_to) ELSE '' END)) AS attributed_to FROM (SELECT fact_id, attributed_to, unnest(obs_ids) AS id FROM facts) LEFT JOIN (SELECT id, CASE event WHEN 'user-prompt' THEN 'user' WHEN 'stop' THEN 'assistant' END AS s FROM spoken) USING (id) GROUP BY fact_id", facts=_FACTS, spoken="SELECT id, CASE WHEN event = 'assistant-reply' THEN 'stop' ELSE event END AS event FROM observations WHERE id % 3 <> 0")
def fact_attribution(spark, d):
    o = observations(spark, d)
    s = F.col("session_id")
    facts = o.select("session_id").distinct().select(s.alias("fact_id"), F.array(s * 1000, s * 1000 + 1 + s % 4, F.lit(-1).cast("bigint")).alias("obs_ids"), F.when(s % 4 == 0, "Assistant").when(s % 4 == 1, "robot").otherwise("").alias("attributed_to"))
    spoken = o.where("id % 3 <> 0").select("id", F.when(F.col("event") == "assistant-reply", "stop").otherwise(F.col("event")).alias("event"))
    return promotion.attribution(facts, spoken, extraction.speaker)


@query("SELECT id, CASE id % 4 WHEN 0 THEN '[\"a\",\"b\",\"n' || (id % 3) || '\",\"c\"]' WHEN 1 THEN '[\"n' || (id % 3) || '\",\"c\"]' ELSE '[\"b\",\"n' || (id % 3) || '\",\"c\"]' END AS ids FROM memories")
def merged_observation_ids(spark, d):
    i = F.col("id")
    old = F.when(i % 4 == 0, '["a","b"]').when(i % 4 == 1, "not json").otherwise('["b"]')
    new = F.to_json(F.array(F.lit(""), F.concat(F.lit("n"), (i % 3).cast("string")), F.lit("c")))
    return memories(spark, d).select("id", promotion.merge_ids(old, new).alias("ids"))


_SAID = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Tool' WHEN 2 THEN 'robot' ELSE '' END"


@query(f"SELECT id, CASE WHEN lower(trim({_SAID})) = 'tool' THEN 'tool' WHEN id % 7 IN (0, 1, 2, 3) THEN 'agent' WHEN id % 7 IN (4, 5) THEN 'import' ELSE 'user' END AS channel, CASE WHEN lower(trim({_SAID})) = 'tool' THEN 'tool' WHEN id % 3 = 0 THEN 'tool' WHEN id % 3 = 1 THEN 'user' ELSE 'agent' END AS obs_channel, CASE lower(trim(kind)) WHEN 'fact' THEN 'context' ELSE 'direct' END AS role FROM memories")
def default_channels(spark, d):
    i = F.col("id")
    said = F.when(i % 5 == 1, " Tool").when(i % 5 == 2, "robot").otherwise("")
    source = F.element_at(F.array(*map(F.lit, ("llm", "distill", "distill-accept", "harness-summary", "ingest", "import", "cli"))), (i % 7 + 1).cast("int"))
    event = F.when(i % 3 == 0, "post-tool-use").when(i % 3 == 1, "user-prompt").otherwise("stop")
    role = canonical_role(F.when(F.col("kind") == "fact", "Witness").otherwise(" DIRECT"))
    return memories(spark, d).select("id", promotion.default_channel(said, source).alias("channel"), promotion.observation_channel(event, said).alias("obs_channel"), role.alias("role"))

