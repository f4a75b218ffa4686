"""Queries of session context, plain reads, and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import capture, context, dedup, evaluation, listing, retrieval, supply
from ..operators.evidence import grade
from .capture_queries import _BUNDLES, _bundle_inputs, _txt
from .registry import _CAND, _GRADE, _ITEMS, _LEXICON, _TAGS, _cands, _decayed, _hashed, _items, _questions, _tags, _term_pairs, _with_hash, query
from .sql import HASH, VISIBLE, fused
from .tables import NOW, audit, memories, observations, table

# ---- session context -------------------------------------------------------------------------------

_CODES = "'" + context.code_table().replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT {_CODES} || coalesce(string_agg(content || chr(10), '' ORDER BY project, content, id), '') AS text FROM (SELECT *, sum(length(content) + 1) OVER (ORDER BY project, content, id ROWS UNBOUNDED PRECEDING) AS total FROM memories WHERE kind = 'rule' OR (project = '' AND salience >= 0.8)) WHERE total <= 2048")
def notes_text(spark, d):
    return context.notes_text(memories(spark, d))


_LIMIT, _BUDGET = 3, 420
_FLAT = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
_LINE = "'- [' || kind || '] mem:' || substr(id::VARCHAR, 1, 8) || ' ' || CASE WHEN length(flat) > {k} THEN substr(flat, 1, {k}) || '…' ELSE flat END || ' · ' || CASE WHEN project = '' THEN 'global' ELSE 'project:' || project END || chr(10)"
_OPENING = {
    "live_rows": f"SELECT *, {_FLAT} AS flat FROM memories WHERE {VISIBLE}",
    "homes": "SELECT DISTINCT project AS home FROM memories WHERE project <> ''",
    "rule_pool": "SELECT *, 0 AS section, row_number() OVER (ORDER BY salience DESC, last_seen_at DESC, updated_at DESC, id) AS r FROM live_rows WHERE project = '' AND kind = 'rule'",
    "global_pool": "SELECT *, 1 AS section, row_number() OVER (ORDER BY salience DESC, last_seen_at DESC, updated_at DESC, id) AS r FROM live_rows WHERE project = ''",
    "own_pool": "SELECT *, 2 AS section, row_number() OVER (PARTITION BY project ORDER BY salience DESC, last_seen_at DESC, updated_at DESC, id) AS r FROM live_rows WHERE project <> ''",
    "every_pool": "SELECT home, p.* FROM homes, (SELECT * FROM rule_pool WHERE r <= 12 UNION ALL SELECT * FROM global_pool WHERE r <= 12) p UNION ALL SELECT home, p.* FROM homes JOIN own_pool p ON project = home WHERE r <= 12",
    "once_pool": "SELECT *, row_number() OVER (PARTITION BY home, section ORDER BY r) AS place FROM (SELECT *, row_number() OVER (PARTITION BY home, id ORDER BY section) AS nth FROM every_pool) WHERE nth = 1",
    "lined": f"SELECT *, length({_LINE.format(k=120)}) AS cost, list_transform(range(0, 121), lambda k: length({_LINE.format(k='k::BIGINT')})) AS short, row_number() OVER (PARTITION BY home ORDER BY section, place) AS i, count(*) OVER (PARTITION BY home, section) AS many, CASE section WHEN 0 THEN 15 WHEN 1 THEN 6 ELSE 7 END AS title, CASE section WHEN 1 THEN 1 ELSE {_LIMIT} END AS cap FROM once_pool",
    "stepped(home, i, id, section, rem, used, n, rank, lead_id, lead_short, got, why, squeezed)": "SELECT home, 0::BIGINT, NULL::BIGINT, -1, " + str(_BUDGET) + "::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT[], 0::BIGINT, '', NULL::BIGINT FROM homes UNION ALL SELECT home, i, id, section, rem - CASE WHEN is_last THEN CASE WHEN chars IS NOT NULL THEN title + lead_short[chars + 1] WHEN n > 0 THEN used ELSE 0 END ELSE 0 END, used, n, rank + CASE WHEN is_last AND chars IS NOT NULL THEN 1 ELSE got::BIGINT END, lead_id, lead_short, CASE WHEN got = 1 THEN rank + 1 ELSE 0 END, why, CASE WHEN is_last THEN chars END FROM (SELECT *, CASE WHEN n = 0 AND title <= rem THEN list_max(list_filter(range(0, 121), lambda k: lead_short[k + 1] <= rem - title)) END AS chars FROM (SELECT home, i, id, section, title, rem, rank, is_last, lead_id, lead_short, ok::INT AS got, n0 + ok::INT AS n, used0 + CASE WHEN ok THEN cost ELSE 0 END AS used, CASE WHEN title > rem THEN 'budget' WHEN n0 >= cap THEN 'limit' WHEN used0 + cost > rem THEN 'budget' ELSE '' END AS why FROM (SELECT l.home, l.i, l.id, l.section, l.title, l.cap, l.cost, s.rem, s.rank, l.place = l.many AS is_last, CASE WHEN l.place = 1 THEN l.id ELSE s.lead_id END AS lead_id, CASE WHEN l.place = 1 THEN l.short ELSE s.lead_short END AS lead_short, CASE WHEN l.place = 1 THEN 0 ELSE s.n END AS n0, CASE WHEN l.place = 1 THEN l.title ELSE s.used END AS used0, (CASE WHEN l.place = 1 THEN 0 ELSE s.n END) < l.cap AND (CASE WHEN l.place = 1 THEN l.title ELSE s.used END) + l.cost <= s.rem AND l.title <= s.rem AS ok FROM stepped s JOIN lined l ON l.home = s.home AND l.i = s.i + 1)))",
    "cuts": "SELECT home, section, lead_id, squeezed, rank FROM stepped WHERE squeezed IS NOT NULL",
}


@query("SELECT l.home AS project, l.id, ['hard_rule', 'global', 'project'][l.section + 1] AS section, (CASE WHEN c.lead_id IS NOT NULL THEN c.rank ELSE s.got END)::INTEGER AS injection_rank, CASE WHEN c.lead_id IS NOT NULL THEN '' ELSE s.why END AS drop_reason, CASE WHEN c.lead_id IS NOT NULL THEN l.short[c.squeezed + 1] WHEN s.got > 0 THEN l.cost END AS chars FROM lined l JOIN stepped s ON s.home = l.home AND s.i = l.i LEFT JOIN cuts c ON c.home = l.home AND c.lead_id = l.id", recursive=True, **_OPENING)
def session_opening(spark, d):
    m = memories(spark, d)
    pool = context.opening_pool(m, m.where("project <> ''"), NOW, _LIMIT)
    out = context.opening(pool, _BUDGET, _LIMIT)
    return out.withColumn("chars", F.length("line").cast("bigint")).drop("line")


@query("SELECT project, '[待裁决] 本工程 ' || count(*) || ' 条 pending 候选（隔离区，不进检索）' AS line FROM cand WHERE status = 'pending' AND project <> '' GROUP BY project", cand=_CAND)
def pending_notices(spark, d):
    p = _cands(memories(spark, d)).where("status = 'pending'").groupBy("project").agg(F.count("*").alias("pending"))
    return context.pending_line(p)


_TRACE = "SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE 's' || (id % 30) END AS session_id, ['session_start', 'pre_compact', 'run'][id % 3 + 1] AS gate_reason, created_at, 'injected' AS outcome FROM memories"
_SHOWN = "SELECT (id * 7 + k) % (SELECT count(*) FROM memories) AS trace_id, id AS memory_id, k AS ordinal, CASE WHEN (id + k) % 3 = 0 THEN 0 ELSE k + 1 END AS injection_rank FROM memories, (VALUES (0), (1)) t(k)"


def _traces(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    reason = F.element_at(F.array(*map(F.lit, ("session_start", "pre_compact", "run"))), (i % 3 + 1).cast("int"))
    t = m.select("id", F.when(i % 11 == 0, "").otherwise(_txt("s", i % 30)).alias("session_id"), reason.alias("gate_reason"), "created_at", F.lit("injected").alias("outcome"))
    n = m.count()
    k = F.col("ordinal")
    x = m.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).select(((i * 7 + k) % n).alias("trace_id"), i.alias("memory_id"), "ordinal", F.when((i + k) % 3 == 0, 0).otherwise(k + 1).alias("injection_rank"))
    return t, x


@query("SELECT DISTINCT session_id, m.id FROM traces t JOIN shown x ON x.trace_id = t.id JOIN memories m ON m.id = x.memory_id WHERE gate_reason IN ('session_start', 'pre_compact') AND session_id <> '' AND injection_rank > 0 AND m.kind = 'rule'", traces=_TRACE, shown=_SHOWN)
def session_injected_rules(spark, d):
    m = memories(spark, d)
    return context.injected_rules(*_traces(m), m)


@query("SELECT session_id, id, g.id2 IS NOT NULL AS noted FROM (SELECT 's' || (id % 30) AS session_id, id, kind FROM memories WHERE id % 2 = 1) h LEFT JOIN (SELECT DISTINCT t.session_id AS s2, x.memory_id AS id2 FROM traces t JOIN shown x ON x.trace_id = t.id WHERE gate_reason IN ('session_start', 'pre_compact') AND session_id <> '' AND injection_rank > 0) g ON s2 = session_id AND id2 = id AND kind = 'rule'", traces=_TRACE, shown=_SHOWN)
def noted_hits(spark, d):
    m = memories(spark, d)
    hits = m.where("id % 2 = 1").select(_txt("s", F.col("id") % 30).alias("session_id"), "id", "kind")
    return context.noted(hits, context.injected_rules(*_traces(m), m)).select("session_id", "id", "noted")


@query("SELECT id, CASE id % 4 WHEN 0 THEN '{\"precise\":0.5,\"fuzzy\":0.25}' WHEN 1 THEN '{\"broad\":0.125}' WHEN 2 THEN '{}' ELSE '{\"precise\":0.5,\"broad\":0.125}' END AS signals, CASE id % 4 WHEN 0 THEN 'p+f' WHEN 1 THEN 'b' WHEN 2 THEN CASE WHEN project = '' THEN 'global' ELSE 'project:' || project END ELSE 'p+b' END AS provenance FROM memories")
def hit_signals(spark, d):
    i = F.col("id") % 4
    p, b, f = F.when(i.isin(0, 3), 0.5).otherwise(0.0), F.when(i.isin(1, 3), 0.125).otherwise(0.0), F.when(i == 0, 0.25).otherwise(0.0)
    return memories(spark, d).select("id", supply.signals_json(p, b, f).alias("signals"), supply.fallback_provenance(F.col("project"), p, b, f).alias("provenance"))


# ---- plain reads -----------------------------------------------------------------------------------


@query("SELECT id, summary, created_at FROM observations WHERE session_id = (SELECT min(session_id) FROM observations) ORDER BY created_at, id LIMIT 50")
def session_observations(spark, d):
    o = observations(spark, d)
    return listing.observations(o, o.agg(F.min("session_id")).first()[0]).select("id", "summary", "created_at")


@query("SELECT id, status, project FROM (SELECT *, id % 20 AS session_id FROM cand) WHERE status = 'pending' AND project = 'src1' ORDER BY created_at, id LIMIT 50", cand=_CAND)
def candidate_listing(spark, d):
    return listing.candidates(_cands(memories(spark, d)), "pending", None, "src1").select("id", "status", "project")


@query("SELECT id, session_id, created_at FROM traces ORDER BY created_at DESC, id DESC LIMIT 20", traces=_TRACE)
def newest_traces(spark, d):
    return listing.newest(_traces(memories(spark, d))[0]).select("id", "session_id", "created_at")


@query("SELECT r.ref, m.id, m.kind FROM (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN content_hash WHEN id % 3 = 1 THEN id::VARCHAR ELSE 'gone' || id END AS ref FROM base WHERE id % 5 = 0) r JOIN (SELECT id::VARCHAR AS ref, id, kind FROM base UNION ALL SELECT content_hash, min(id), arg_min(kind, id) FROM base GROUP BY content_hash) m ON m.ref = r.ref", base=f"SELECT id, kind, {HASH} AS content_hash FROM memories")
def reference_lookup(spark, d):
    m = _hashed(memories(spark, d))
    i = F.col("id")
    refs = m.where(i % 5 == 0).select(F.when(i % 3 == 0, F.col("content_hash")).when(i % 3 == 1, i.cast("string")).otherwise(_txt("gone", i)).alias("ref"))
    return listing.by_refs(m, refs, "kind")


@query("SELECT t.id, t.session_id, string_agg(ordinal || ':' || memory_id || ':' || injection_rank, ',' ORDER BY ordinal, memory_id, injection_rank) AS items FROM traces t LEFT JOIN shown ON trace_id = t.id GROUP BY ALL", traces=_TRACE, shown=_SHOWN)
def trace_details(spark, d):
    v = listing.trace_view(*_traces(memories(spark, d)))
    flat = F.transform("items", lambda x: F.concat_ws(":", x["ordinal"].cast("string"), x["memory_id"].cast("string"), x["injection_rank"].cast("string")))
    return v.select("id", "session_id", F.array_join(flat, ",").alias("items"))


@query(f"SELECT m.id, coalesce(t.n, 0) AS n_tags, coalesce(l.n, 0) AS n_links, l.grade FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n FROM tags WHERE memory_id % 3 > 0 GROUP BY 1) t ON t.memory_id = m.id LEFT JOIN (SELECT candidate_id, count(*) AS n, min({_GRADE}) AS grade FROM items GROUP BY 1) l ON candidate_id = m.id", tags=_TAGS, items=_ITEMS)
def memory_details(spark, d):
    m = memories(spark, d)
    links = _items(m).select(F.col("candidate_id").alias("memory_id"), grade(F.col("event_uid"), F.col("archive")).alias("grade"))
    return listing.memory_view(m, _tags(m).where("memory_id % 3 > 0"), links).select("id", "n_tags", "n_links", "grade")


@query("SELECT trace_id, ordinal, t.created_at FROM shown JOIN traces t ON t.id = trace_id WHERE memory_id = 6 ORDER BY t.created_at DESC, trace_id DESC LIMIT 20", traces=_TRACE, shown=_SHOWN)
def memory_trace_items(spark, d):
    t, x = _traces(memories(spark, d))
    return listing.recent_items(x, t, 6).select("trace_id", "ordinal", "created_at")


@query("SELECT candidate_id, k, n FROM (SELECT candidate_id, k, row_number() OVER (PARTITION BY candidate_id ORDER BY at, k) AS n FROM (SELECT id // 3 AS candidate_id, 'k' || id AS k, created_at AS at FROM memories)) WHERE candidate_id % 2 = 0".replace(" AS at", " AS made").replace("ORDER BY at,", "ORDER BY made,"))
def decision_listing(spark, d):
    log = memories(spark, d).select(F.expr("id div 3").alias("candidate_id"), _txt("k", F.col("id")).alias("idempotency_key"), "created_at")
    asked = log.where("candidate_id % 2 = 0").select(F.col("candidate_id").alias("id"))
    return listing.decisions(log, asked).select("candidate_id", F.col("idempotency_key").alias("k"), "n")


@query("SELECT b.id AS bundle_id, t.pos::INTEGER AS ordinal, t.id::VARCHAR AS id, 's' || t.id AS summary, coalesce(a.byte_size, 0) AS byte_size FROM taken t JOIN built b USING (source_id) LEFT JOIN archived a USING (archive_hash)", **_BUNDLES)
def bundle_details(spark, d):
    src, o, a = _bundle_inputs(spark, d)
    return listing.bundle_view(capture.next_bundles(src, o, a)[1], o.withColumn("summary", _txt("s", F.col("id"))), a)


@query("SELECT w.source_id, coalesce(s.generation, 1) AS generation, coalesce(s.last_seq, 0) AS last_seq FROM (SELECT DISTINCT source_id FROM sources UNION SELECT -1) w LEFT JOIN (SELECT * FROM sources WHERE source_id % 2 = 0) s USING (source_id)", **_BUNDLES)
def source_head(spark, d):
    src = _bundle_inputs(spark, d)[0]
    wanted = src.select("source_id").unionByName(spark.range(1).select(F.lit(-1).cast(src.schema["source_id"].dataType).alias("source_id")))
    return listing.source_heads(wanted, src.where("source_id % 2 = 0"))


@query("SELECT id FROM memories WHERE id % 3 <> 0")
def unsigned_memories(spark, d):
    m = memories(spark, d)
    return listing.unsigned(m, m.where("id % 3 = 0")).select("id")


@query("SELECT key, coalesce(n.v, m.v) AS value FROM (SELECT 'k' || (id % 20) AS key, max(id)::VARCHAR AS v FROM memories WHERE id % 2 = 0 GROUP BY 1) m FULL JOIN (SELECT 'k' || (id % 30) AS key, arg_max('n' || id, id) AS v FROM memories WHERE id % 5 = 1 GROUP BY 1) n USING (key)")
def meta_pairs(spark, d):
    m = memories(spark, d)
    i = F.col("id")
    old = m.where("id % 2 = 0").groupBy(_txt("k", i % 20).alias("key")).agg(F.max("id").cast("string").alias("value"))
    return listing.upsert_meta(old, m.where("id % 5 = 1").select(_txt("k", i % 30).alias("key"), _txt("n", i).alias("value"), i.alias("ord")))


@query(f"SELECT id AS key, last_seen_at AS ts FROM memories WHERE last_seen_at >= {NOW} - 30 * 86400")
def live_claims(spark, d):
    return listing.prune_claims(memories(spark, d).select(F.col("id").alias("key"), F.col("last_seen_at").alias("ts")), NOW, 30 * 86400)


# ---- evaluation ------------------------------------------------------------------------------------


@query("SELECT project, string_agg(event || '=' || n, ',' ORDER BY event) AS by_event FROM (SELECT project, event, count(*) AS n FROM audit GROUP BY ALL) GROUP BY project")
def audit_by_event(spark, d):
    m = evaluation.audit_maps(audit(spark, d), "project")
    flat = F.transform(F.map_entries("by_event"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("project", F.array_join(flat, ",").alias("by_event"))


_LEVEL = "CASE WHEN {v} IS NULL THEN 'INFO' WHEN {v} < {a} THEN 'PASS' WHEN {v} <= {b} THEN 'WARN' ELSE 'FAIL' END"
_SINCE = NOW - 200 * 86400
_RULES = {
    "acts": "SELECT count(*) AS r1, floor(avg(ms) FILTER (event IN ('prompt-submit', 'session-start')))::BIGINT AS r3, count(*) FILTER (event = 'manual-add') AS r4, count(*) FILTER (event = 'obs-append') AS r5, floor(avg(ms) FILTER (event = 'stop'))::BIGINT AS r10, count(*) FILTER (event = 'distill') AS d, count(*) FILTER (event = 'distill' AND mode = 'fail') AS r12, (max(inject_bytes) FILTER (event IN ('prompt-submit', 'session-start', 'pre-compact')))::BIGINT AS r13 FROM audit",
    "shelf": "SELECT project, count(*) AS size FROM (SELECT 'p' || (id % 9) AS project FROM memories WHERE id % 9 <> 2) GROUP BY project",
    "warm": "SELECT floor((sum(n) - sum(e)) * 100 / sum(n))::BIGINT AS r2 FROM (SELECT project, count(*) AS n, count(*) FILTER (empty) AS e FROM audit WHERE event = 'prompt-submit' GROUP BY project) JOIN shelf USING (project) WHERE size >= 20",
    "queue_of": "SELECT id, 'p' || (id % 9) AS project, CASE WHEN id % 13 = 0 THEN 'pending' ELSE 'accepted' END AS status, CASE WHEN id % 26 = 0 THEN 'Shell {x' WHEN id % 39 = 0 THEN 'see {\"type\":1}' ELSE content END AS content, created_at FROM memories",
    "stuck": f"SELECT coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM queue_of WHERE status = 'pending' GROUP BY project)), 0) AS r8, (SELECT count(*) FROM queue_of WHERE status = 'pending' AND id % 26 * (id % 39) = 0 AND created_at > {_SINCE}) AS r9",
}
_RULE_ROWS = [
    ("R1", "r1", "CASE WHEN r1 >= 1 THEN 'PASS' ELSE 'FAIL' END"), ("R2", "r2", "CASE WHEN r2 IS NULL THEN 'INFO' WHEN r2 >= 30 THEN 'PASS' WHEN r2 >= 10 THEN 'WARN' ELSE 'FAIL' END"), ("R3", "r3", _LEVEL.format(v="r3", a=50, b=200)),
    ("R4", "r4", "CASE WHEN r4 >= 1 THEN 'PASS' WHEN r6 >= 20 THEN 'WARN' ELSE 'INFO' END"), ("R5", "r5", "CASE WHEN r5 >= 1 THEN 'PASS' ELSE 'WARN' END"), ("R6", "r6", "CASE WHEN r6 < 1000000 THEN 'WARN' ELSE 'PASS' END"),
    ("R7", "2", "'WARN'"), ("R8", "r8", _LEVEL.format(v="r8", a=6, b=15)), ("R9", "r9", _LEVEL.format(v="r9", a=1, b=3)), ("R10", "r10", _LEVEL.format(v="r10", a=1000, b=3000)), ("R11", "1500", "'WARN'"),
    ("R12", "r12", "CASE WHEN r12 > 3 THEN 'FAIL' WHEN r12 > 0 OR d = 0 THEN 'WARN' ELSE 'PASS' END"), ("R13", "r13", _LEVEL.format(v="r13", a=3601, b=8000)), ("R14", "1000", "'PASS'"),
]


@query("SELECT r.rule, r.value, r.status FROM (SELECT unnest([" + ", ".join(f"{{'rule': '{r}', 'value': ({v})::BIGINT, 'status': {s}}}" for r, v, s in _RULE_ROWS) + "]) AS r FROM acts, warm, stuck, (SELECT coalesce(sum(size), 0)::BIGINT AS r6 FROM shelf))", **_RULES)
def ops_rules(spark, d):
    m = memories(spark, d)
    i = F.col("id")
    lib = m.where("id % 9 <> 2").select(_txt("p", i % 9).alias("project"))
    cands = m.select("id", _txt("p", i % 9).alias("project"), F.when(i % 13 == 0, "pending").otherwise("accepted").alias("status"), F.when(i % 26 == 0, "Shell {x").when(i % 39 == 0, 'see {"type":1}').otherwise(F.col("content")).alias("content"), "created_at")
    return evaluation.ops_rules(audit(spark, d), lib, cands, NOW, _SINCE, 1_000_000, 2, 1500 * 4096, 1000)


@query("SELECT qid, hits, n_gold, CASE WHEN n_gold = 0 THEN 0 ELSE hits / n_gold END AS ratio, row_number() OVER (ORDER BY CASE WHEN n_gold = 0 THEN 0 ELSE hits / n_gold END, qid)::INTEGER AS place FROM (SELECT id AS qid, id % 4 AS hits, id % 5 AS n_gold FROM memories) ORDER BY place LIMIT 60")
def worst_first(spark, d):
    r = memories(spark, d).select(F.col("id").alias("qid"), (F.col("id") % 4).alias("hits"), (F.col("id") % 5).alias("n_gold"))
    top = evaluation.worst_first(r).limit(60)  # a report of the worst
    return top.withColumn("place", F.row_number().over(Window.orderBy("ratio", "qid")))


_SWEEP = {
    "named": "SELECT term, CASE WHEN unicode(term[1]) % 3 = 0 THEN '' ELSE 'c' || (unicode(term[1]) % 7) END AS label FROM terms",
    "every_pair": "SELECT x.term AS a, y.term AS b, x.label <> '' AND x.label = y.label AS same FROM named x JOIN named y ON x.term < y.term",
    "valued": "SELECT p.a, p.b, same, coalesce(sim, 0) AS sim FROM every_pair p LEFT JOIN sims s ON s.a = p.a AND s.b = p.b",
    "tried": "SELECT th AS threshold, count(*) FILTER (same AND sim >= th) AS tp, count(*) FILTER (NOT same AND sim >= th) AS fp, count(*) FILTER (same AND sim < th) AS fn FROM valued, (VALUES (0.0::DOUBLE), (0.3), (0.5), (0.7)) t(th) GROUP BY th",
}


@query("SELECT 8 AS k, threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 9) AS f1 FROM tried", recursive=True, **_LEXICON, **_SWEEP)
def calibration_sweep(spark, d):
    pairs, terms = _term_pairs(spark, d)
    c = F.ascii("term")
    named = terms.select("term", F.when(c % 3 == 0, "").otherwise(_txt("c", c % 7)).alias("label"))
    out = evaluation.sweep(pairs.withColumn("k", F.lit(dedup.HITS)), named, [0.0, 0.3, 0.5, 0.7])
    return out.withColumns({x: F.round(x, 9) for x in ("precision", "recall", "f1")})


@query("SELECT id AS file, length(content) AS chars, 300 AS max_chars, greatest(0, length(content) - 300) AS over, n AS library_memories FROM memories JOIN (SELECT project, count(*) AS n FROM memories GROUP BY project) USING (project)")
def level_one_budget(spark, d):
    m = memories(spark, d)
    return evaluation.budget(m.select(F.col("id").alias("file"), "project", F.col("content").alias("text")), m, 300)


@query("SELECT ord, string_agg(ref || '=' || coalesce(c, '?'), ';' ORDER BY p) AS contents FROM (SELECT event_id AS ord, p, ref, md5(m.content) AS c FROM (SELECT event_id, p, CASE p WHEN 0 THEN (event_id % 97)::VARCHAR ELSE 'gone' END AS ref FROM events, (VALUES (0), (1)) t(p) WHERE event_id > (SELECT max(event_id) FROM events) - 10) LEFT JOIN memories m ON m.id::VARCHAR = ref) GROUP BY ord")
def audit_contents(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.array((F.col("event_id") % 97).cast("string"), F.lit("gone")).alias("refs"))
    v = evaluation.audit_view(a, _hashed(memories(spark, d)))
    flat = F.transform("contents", lambda x: F.concat(x["ref"], F.lit("="), F.coalesce(F.md5(x["content"]), F.lit("?"))))
    return v.select("ord", F.array_join(flat, ";").alias("contents"))


@query("SELECT q.qid, sha256(query) AS query_hash, coalesce(string_agg(hash, ',' ORDER BY rank), '') AS hashes FROM q LEFT JOIN (SELECT qid, rank, hash FROM fused JOIN hashed USING (id)) f ON f.qid = q.qid GROUP BY q.qid, query", hashed=f"SELECT id, {HASH} AS hash FROM memories", **fused(5))
def evaluation_receipts(spark, d):
    q, m = _questions(spark, d), memories(spark, d)
    hits = _with_hash(retrieval.fused(m, q, _decayed(), retrieval.visible(NOW), 5), m)
    return evaluation.evidence_of(q, hits).withColumn("hashes", F.array_join("hashes", ","))


@query("SELECT sum(n)::BIGINT AS rows, sha256(string_agg(p, chr(10) ORDER BY b)) AS fingerprint FROM (SELECT substr(h, 1, 2) AS b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS p FROM (SELECT sha256('{\"id\":' || id || ',\"kind\":\"' || kind || '\"}') AS h FROM memories) GROUP BY 1)")
def dataset_fingerprint(spark, d):
    return evaluation.fingerprint(memories(spark, d), "id", "kind")


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, greatest(1, count(*) OVER () // 40) AS step FROM memories) WHERE i % step = 0 ORDER BY id LIMIT 40")
def even_sample(spark, d):
    return evaluation.every_nth(memories(spark, d).select("id"), 40, "id")
