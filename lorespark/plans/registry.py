"""Registered queries of the engine and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash as M
from ..functions import text as T
from ..functions.decay import decay_days, decay_frac
from ..functions.patterns import holding
from ..operators import dedup, evaluation, evidence, extraction, lifecycle, retrieval, supply
from ..sources import readers
from .scratch import written
from .sql import DAYS, DECAY, FOLDED, HASH, NORM, VISIBLE, bm25, fused, with_parts
from .tables import NOW, audit, memories, observations, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False, **extra: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_parts(sql, recursive, **extra)
        return f

    return add


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every benchmark item as a query."""
    return table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _decayed() -> F.Column:
    return F.round(decay_days(F.col("salience"), F.col("last_seen_at"), F.col("access_count"), NOW), 12)


def _hashed(mem: DataFrame) -> DataFrame:
    return mem.withColumn("content_hash", T.content_hash(F.col("content")))


def _hashed_once(mem: DataFrame) -> DataFrame:
    """``_hashed`` written: several readers, and filters on the hash, do not hash the texts again."""
    return written(_hashed(mem), "hashed")


def _with_hash(hits: DataFrame, mem: DataFrame) -> DataFrame:
    """Hits with the hash of their memory's content."""
    return retrieval.looked_up(hits, mem, "content").withColumn("hash", T.content_hash(F.col("content"))).drop("content")


# ---- text ------------------------------------------------------------------------------------------


@query(f"SELECT {HASH} AS content_hash, project, min(id) AS first_id, count(*) AS copies, max(salience) AS salience FROM memories GROUP BY ALL")
def content_hash_dedup(spark, d):
    m = _hashed(memories(spark, d))
    return m.groupBy("content_hash", "project").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("salience").alias("salience"))


def _scrubbed(c: str) -> str:
    for p, to in T.SCRUB:
        c = f"regexp_replace({c}, '{p}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return c


def _scrub_sql() -> str:
    c = _scrubbed("coalesce(text, '')")
    return f"SELECT doc_id, md5({c}) AS scrubbed_md5, length({c}) AS n FROM documents"


@query(_scrub_sql())
def secret_scrub(spark, d):
    t = T.scrub(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("scrubbed_md5"), F.length(t).cast("bigint").alias("n"))


_NEG = " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{w.replace(chr(39), chr(39) * 2)}', ''))) // {len(w)}" for w in T.NEGATIONS)


@query(f"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '[0-9]+'))), ',') AS digit_runs, ({_NEG})::INTEGER AS negations FROM memories")
def merge_guards(spark, d):
    c = F.col("content")
    return memories(spark, d).select("id", F.array_join(F.array_sort(T.digits(c)), ",").alias("digit_runs"), T.negation_count(c).alias("negations"))


@query(f"SELECT id, len(regexp_extract_all({FOLDED.format(c='content')}, '\\p{{Han}}+|[\\p{{L}}\\p{{Nd}}]+'))::INTEGER AS n_terms, len(list_distinct(regexp_extract_all({FOLDED.format(c='content')}, '\\p{{Han}}+|[\\p{{L}}\\p{{Nd}}]+')))::INTEGER AS n_distinct FROM memories")
def index_term_counts(spark, d):
    t = memories(spark, d).select("id", T.index_terms(F.col("content")).alias("t"))
    return t.select("id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))


_QSTOP = ", ".join(f"'{w}'" for w in T.STOP_IDENTIFIERS)
_QSOCIAL = ", ".join(f"'{w}'" for w in dict.fromkeys(T.SOCIAL))
_QSHORT = ", ".join(f"'{w}'" for w in T.TECH_SHORT)
_CUT = "regexp_replace(regexp_replace(lower(t), '^[._\\-/:]+', ''), '[._\\-/:]+$', '')"
#: A query's gate, deep wish, identifiers and terms (of texts whose Han runs, if any, are single pairs at most).
_ANALYSIS = {
    "asked_ident": f"SELECT qid, list_filter(list_transform(regexp_extract_all(query, '[A-Za-z0-9_.\\-/:]{{2,}}'), lambda t: {_CUT}), lambda t: length(t) >= 2 AND regexp_matches(t, '[a-z]') AND t NOT IN ({_QSTOP})) AS ids FROM q",
    "asked_terms": f"SELECT qid, list_filter(list_transform(regexp_extract_all(query, '[\\x{{4e00}}-\\x{{9fff}}]+|[A-Za-z0-9_.\\-/:]+'), lambda t: {_CUT}), lambda t: length(t) >= 2 AND t NOT IN ({_QSTOP})) AS ts FROM q",
    "first_seen": "SELECT qid, kind, string_agg(t, ' ' ORDER BY i) AS joined FROM (SELECT qid, kind, t, min(i) AS i FROM (SELECT qid, 'i' AS kind, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM asked_ident UNION ALL SELECT qid, 't', unnest(ts), generate_subscripts(ts, 1) FROM asked_terms) GROUP BY ALL) GROUP BY ALL",
    "asked": f"SELECT qid, query, regexp_replace(lower(query), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS body, list_filter(string_split_regex(lower(query), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda t: t <> '') AS ws FROM q",
    "gates": f"SELECT qid, query, CASE WHEN body = '' THEN 'empty' WHEN len(ws) > 0 AND len(list_filter(ws, lambda t: t NOT IN ({_QSOCIAL}))) = 0 THEN 'pleasantry' WHEN length(body) <= 1 OR length(body) = 2 AND NOT regexp_matches(body, '[a-z0-9]') AND body NOT IN ({_QSHORT}) THEN 'short_no_tech' ELSE 'run' END AS gate FROM asked",
}
#: Benchmark texts and short ones that the gate tells apart.
_SHORT_ASKED = [(-1, ""), (-2, " ！"), (-3, "ok thanks"), (-4, "嗯"), (-5, "天气"), (-6, "报错"), (-7, "x"), (-8, "详细查 mem.db and CGO_ENABLED=0 in the tool")]


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).unionByName(spark.createDataFrame(_SHORT_ASKED, "qid long, query string").withColumn("qid", F.col("qid").cast(table(spark, d, "benchmark").schema["item_id"].dataType)))


@query(
    f"SELECT g.qid, gate, regexp_matches(query, '{'|'.join(T.DEEP)}') AS deep, coalesce(i.joined, '') AS identifiers, coalesce(t.joined, '') AS terms FROM gates g LEFT JOIN first_seen i ON i.qid = g.qid AND i.kind = 'i' LEFT JOIN first_seen t ON t.qid = g.qid AND t.kind = 't'",
    **_ANALYSIS,
    q="SELECT item_id AS qid, text AS query FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _SHORT_ASKED if "详" not in t) + ")",
)
def query_analysis(spark, d):
    q = F.col("query")
    asked = _gated(spark, d).where("qid <> -8")
    return asked.select("qid", T.query_gate(q).alias("gate"), T.wants_deep(q).alias("deep"), F.array_join(T.identifiers(q), " ").alias("identifiers"), F.array_join(T.query_terms(q), " ").alias("terms"))


# ---- retrieval -------------------------------------------------------------------------------------

_TOP = "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bm25, id)::INTEGER AS rank, bm25 FROM hits"


@query(f"SELECT qid, id, rank, round(bm25, 6) AS bm25 FROM ({_TOP}) WHERE rank <= 10")
def bm25_topk(spark, d):
    hits = retrieval.ranked(memories(spark, d).select("id", "content"), _questions(spark, d), 10)
    return retrieval.top(hits, 10, F.col("bm25"), F.col("id")).select("qid", "id", "rank", F.round("bm25", 6).alias("bm25"))


@query("SELECT qid, id, rank, round(score, 9) AS score, exact, routes FROM fused", **fused(10))
def rrf_fused_search(spark, d):
    out = retrieval.fused(memories(spark, d), _questions(spark, d), _decayed(), retrieval.visible(NOW))
    return out.withColumn("score", F.round("score", 9)).drop("precise", "broad", "fuzzy")


_OBS_TOP = "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY bm25, created_at DESC, id)::INTEGER AS rank, bm25, event FROM hits_o JOIN observations USING (id)"


@query(f"SELECT qid, id, rank, round(bm25, 6) AS bm25, event AS kind FROM ({_OBS_TOP}) WHERE rank <= 10")
def observation_search(spark, d):
    return retrieval.observation_search(observations(spark, d), _questions(spark, d)).withColumn("bm25", F.round("bm25", 6))


@query(
    f"SELECT qid, id, rank, layer FROM (SELECT qid, id, layer, row_number() OVER (PARTITION BY qid ORDER BY rank, layer, id)::INTEGER AS rank FROM (SELECT qid, id, rank, 'memory' AS layer FROM fused UNION ALL SELECT qid, id, rank, 'observation' FROM ({_OBS_TOP}) WHERE rank <= 10)) WHERE rank <= 10",
    **fused(10),
)
def layered_search(spark, d):
    return retrieval.search("both", memories(spark, d), observations(spark, d), _questions(spark, d), _decayed(), retrieval.visible(NOW))


@query(f"SELECT id, kind, project, salience, last_seen_at FROM memories WHERE {VISIBLE} AND project IN ('src1', '') ORDER BY salience DESC, last_seen_at DESC, updated_at DESC, id LIMIT 50")
def scope_visibility_list(spark, d):
    return retrieval.listing(memories(spark, d), NOW, "current", "src1", "all", 50).select("id", "kind", "project", "salience", "last_seen_at")


_TAGS = "SELECT id AS memory_id, 'area' AS key, 'a' || (id % 4) AS value FROM memories UNION ALL SELECT id, 'lang', 'l' || (id % 3) FROM memories"


def _tags(m: DataFrame) -> DataFrame:
    tag = lambda k, p, n: m.select(F.col("id").alias("memory_id"), F.lit(k).alias("key"), F.concat(F.lit(p), (F.col("id") % n).cast("string")).alias("value"))
    return tag("area", "a", 4).unionByName(tag("lang", "l", 3))


@query("SELECT id, kind, project FROM memories WHERE EXISTS (SELECT 1 FROM tags WHERE memory_id = id AND key = 'area' AND value = 'a1') AND EXISTS (SELECT 1 FROM tags WHERE memory_id = id AND key = 'lang' AND value = 'l2')", tags=_TAGS)
def tag_filtered_list(spark, d):
    m = memories(spark, d)
    return retrieval.with_tags(m, _tags(m), {"area": "a1", "lang": "l2"}).select("id", "kind", "project")


@query("SELECT p.prefix, count(m.id) AS n, CASE WHEN max((m.id::VARCHAR = p.prefix)::INT) = 1 THEN p.prefix WHEN count(m.id) = 1 THEN min(m.id::VARCHAR) END AS id, CASE WHEN max((m.id::VARCHAR = p.prefix)::INT) = 1 THEN 'exact' WHEN count(m.id) = 1 THEN 'unique' WHEN count(m.id) = 0 THEN 'none' ELSE 'ambiguous' END AS state FROM (SELECT (doc_id % 130)::VARCHAR AS prefix FROM documents UNION SELECT 'x') p LEFT JOIN memories m ON starts_with(m.id::VARCHAR, p.prefix) GROUP BY p.prefix")
def id_prefix_resolution(spark, d):
    want = table(spark, d, "documents").select((F.col("doc_id") % 130).cast("string").alias("prefix")).distinct().union(spark.range(1).select(F.lit("x")))
    return retrieval.resolve_prefix(memories(spark, d), want)


@query("SELECT id, file, line FROM (SELECT id, project, created_at, 'f' || (id % 9) || '.md' AS file, CASE WHEN id % 7 <> 0 THEN id % 50 END AS line FROM memories WHERE id % 10 <> 0) WHERE file IN ('f1.md', 'f4.md') ORDER BY project, line NULLS FIRST, created_at DESC, id LIMIT 200")
def assets_by_file(spark, d):
    prov = F.when(F.col("id") % 10 == 0, "not json").otherwise(F.to_json(F.struct(F.concat(F.lit("f"), (F.col("id") % 9).cast("string"), F.lit(".md")).alias("file"), F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("line"))))
    return retrieval.assets_by_file(memories(spark, d).withColumn("provenance", prov), ["f1.md", "f4.md"]).select("id", "file", "line")


@query("SELECT qid, CASE WHEN len(more) > 0 THEN query || ' ' || array_to_string(more, ' ') ELSE query END AS query FROM (SELECT q.qid, q.query, list_sort(list_distinct(list(s.standard) FILTER (WHERE s.standard IS NOT NULL AND NOT contains(lower(q.query), s.standard)))) AS more FROM q LEFT JOIN s ON contains(lower(q.query), s.alias) GROUP BY ALL)", s="SELECT * FROM (VALUES ('the', 'article'), ('of', 'origin'), ('de', 'article'), ('zu', 'towards')) t(alias, standard)")
def synonym_expansion(spark, d):
    lines = spark.createDataFrame([(0, "# words"), (1, "article = the, de"), (2, "origin = of"), (3, "! off = and"), (4, "towards = zu"), (5, "[other]"), (6, "never = a")], "line int, value string")
    return retrieval.expand(_questions(spark, d).withColumn("project", F.lit("src1")), readers.parse_synonyms(lines)).select("qid", "query")


# ---- lifecycle -------------------------------------------------------------------------------------


@query(f"SELECT id, round({DECAY}, 9) AS decayed, round({DECAY.replace('* d)', '* x)').replace('+ d)', '+ x)')}, 9) AS decayed_frac FROM (SELECT *, {DAYS} AS d, greatest(0, {NOW} - last_seen_at) / 86400.0 AS x FROM memories)")
def decay_ranking(spark, d):
    args = (F.col("salience"), F.col("last_seen_at"), F.col("access_count"), NOW)
    return memories(spark, d).select("id", F.round(decay_days(*args), 9).alias("decayed"), F.round(decay_frac(*args), 9).alias("decayed_frac"))


@query(f"SELECT id, CASE WHEN expires_at <= {NOW} THEN 'expired' WHEN last_seen_at < {NOW} - 30 * 86400 AND {DECAY} < 0.2 THEN 'decayed' ELSE 'kept' END AS fate FROM (SELECT *, {DAYS} AS d FROM memories)")
def gc_memories(spark, d):
    return lifecycle.gc_memories(memories(spark, d), NOW).select("id", "fate")


_REF = "SELECT CASE WHEN id % 9 = 0 THEN id END AS obs_id, CASE WHEN id % 9 = 0 THEN '' ELSE 'e' || id END AS event_uid FROM observations WHERE id % 9 = 0 OR id % 14 = 3"
_OBS_UID = "SELECT id, session_id, created_at, CASE WHEN id % 5 = 0 THEN '' ELSE 'e' || id END AS event_uid FROM observations"
_OBS_KEEP = 500


@query(
    f"SELECT id, session_id, created_at FROM held UNION ALL SELECT id, session_id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM ob WHERE id NOT IN (SELECT id FROM held) AND created_at >= {NOW} - 40 * 86400) WHERE r <= {_OBS_KEEP} - (SELECT count(*) FROM held)",
    refs=_REF, ob=_OBS_UID, held="SELECT * FROM ob WHERE id IN (SELECT obs_id FROM refs WHERE obs_id IS NOT NULL) OR event_uid <> '' AND event_uid IN (SELECT event_uid FROM refs)",
)
def gc_observations(spark, d):
    uid = lambda c: F.when(c, "").otherwise(F.concat(F.lit("e"), F.col("id").cast("string")))
    o = observations(spark, d).select("id", "session_id", "created_at", uid(F.col("id") % 5 == 0).alias("event_uid"))
    nine = F.col("id") % 9 == 0
    refs = o.where(nine | (F.col("id") % 14 == 3)).select(F.when(nine, F.col("id")).alias("obs_id"), uid(nine).alias("event_uid"))
    return lifecycle.gc_observations(o, refs, NOW, 40 * 86400, _OBS_KEEP).select("id", "session_id", "created_at")


_CAND = "SELECT id, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS status, project, created_at, CASE WHEN id % 3 <> 0 THEN created_at + 86400 END AS decided_at FROM memories"


def _cands(m: DataFrame) -> DataFrame:
    return m.select("id", F.when(F.col("id") % 3 == 0, "pending").when(F.col("id") % 3 == 1, "accepted").otherwise("rejected").alias("status"), "project", "created_at", F.when(F.col("id") % 3 != 0, F.col("created_at") + 86400).alias("decided_at"))


@query(f"SELECT id, CASE WHEN status = 'pending' AND created_at < {NOW} - 14 * 86400 THEN 'expired' ELSE status END AS status FROM cand WHERE NOT (status = 'accepted' AND decided_at < {NOW} - 90 * 86400)", cand=_CAND)
def gc_candidates(spark, d):
    return lifecycle.gc_candidates(_cands(memories(spark, d)), NOW).select("id", "status")


@query("SELECT project, count(*) AS pending, max(count(*)) OVER () AS most FROM cand WHERE status = 'pending' GROUP BY project", cand=_CAND)
def pending_by_project(spark, d):
    p = _cands(memories(spark, d)).where("status = 'pending'").groupBy("project").agg(F.count("*").alias("pending"))
    return p.join(F.broadcast(p.agg(F.max("pending").alias("most"))))


_SIDES = {
    "base": f"SELECT *, {HASH} AS content_hash FROM memories",
    "loc": "SELECT content_hash, project, min(id) AS id, min(content) AS content, max(salience) AS salience, max(access_count) AS access_count, max(updated_at) AS updated_at, max(last_seen_at) AS last_seen_at, min(created_at) AS created_at, min(kind) AS kind, max(expires_at) AS expires_at FROM base WHERE id % 3 <> 0 GROUP BY 1, 2",
    "rem": "SELECT content_hash, project, min(id) AS id, min(content) AS content, max(salience) / 2 AS salience, max(access_count) + 1 AS access_count, max(updated_at) + min(id) % 7 - 3 AS updated_at, max(last_seen_at) AS last_seen_at, min(created_at) AS created_at, max(kind) AS kind, max(expires_at) AS expires_at FROM base WHERE id % 3 <> 1 GROUP BY 1, 2",
}


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    b = _hashed_once(memories(spark, d))
    agg = lambda df, sal, acc, upd, kind: df.groupBy("content_hash", "project").agg(F.min("id").alias("id"), F.min("content").alias("content"), sal.alias("salience"), acc.alias("access_count"), upd.alias("updated_at"), F.max("last_seen_at").alias("last_seen_at"), F.min("created_at").alias("created_at"), kind.alias("kind"), F.max("expires_at").alias("expires_at"))
    return agg(b.where("id % 3 <> 0"), F.max("salience"), F.max("access_count"), F.max("updated_at"), F.min("kind")), agg(b.where("id % 3 <> 1"), F.max("salience") / 2, F.max("access_count") + 1, F.max("updated_at") + F.min("id") % 7 - 3, F.max("kind"))


@query(f"SELECT content_hash, project, coalesce(l.id, r.id) AS id, coalesce(r.content, l.content) AS content, CASE WHEN r.id IS NOT NULL THEN r.expires_at ELSE l.expires_at END AS expires_at, greatest(l.salience, r.salience) AS salience, CASE WHEN r.id IS NULL THEN l.access_count WHEN l.id IS NULL THEN 0 ELSE l.access_count + 1 END AS access_count, CASE WHEN r.id IS NOT NULL THEN {NOW} ELSE l.updated_at END AS updated_at, coalesce(l.kind, r.kind) AS kind FROM loc l FULL JOIN rem r USING (content_hash, project)", **_SIDES)
def upsert_memories(spark, d):
    loc, rem = (s.withColumns({c: F.lit("") for c in ("channel", "origin_tool", "source", "provenance")}) for s in _sides(spark, d))
    return lifecycle.upsert(loc, rem, NOW).select("content_hash", "project", "id", "content", "expires_at", "salience", "access_count", "updated_at", "kind")


@query("SELECT m.id, m.content_hash, t.content_hash AS superseded_hash, (SELECT string_agg(key || '=' || value, ';' ORDER BY key, value) FROM tags WHERE memory_id = m.id) AS tag_list FROM base m LEFT JOIN base t ON m.superseded_by = t.id", tags=_TAGS, base=_SIDES["base"])
def export_records(spark, d):
    m = _hashed(memories(spark, d))
    e = lifecycle.export_records(m, _tags(m))
    flat = F.flatten(F.transform(F.map_entries("tags"), lambda kv: F.transform(kv["value"], lambda v: F.concat(kv["key"], F.lit("="), v))))
    return e.select("id", "content_hash", F.col("superseded.hash").alias("superseded_hash"), F.array_join(flat, ";").alias("tag_list"))


@query("SELECT session_id, id, place FROM (SELECT session_id, id, created_at, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n, (least(n, 3) - back + 1)::INTEGER AS place FROM observations) WHERE back <= 3")
def newest_observations(spark, d):
    return lifecycle.newest(observations(spark, d), "session_id", 3).select("session_id", "id", "place")


@query(f"SELECT id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n > 0 THEN {NOW} ELSE last_seen_at END AS last_seen_at FROM memories LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) ON doc_id = id")
def touch_counters(spark, d):
    return lifecycle.touch(memories(spark, d), table(spark, d, "labels").select(F.col("doc_id").alias("id")), NOW).select("id", "access_count", "last_seen_at")


@query("SELECT memory_id, key, value FROM tags WHERE memory_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)", tags=_TAGS)
def forget_cascade(spark, d):
    m = memories(spark, d)
    return lifecycle.forget(m, {"tags": _tags(m)}, table(spark, d, "labels").select(F.col("doc_id").alias("id")))[1]["tags"]


_DIGITS = "list_distinct(regexp_extract_all(content, '[0-9]+'))"
_NEAR = {
    "texts": f"SELECT id, project, content, length(content) AS n, array_to_string(regexp_extract_all(content, '[0-9]+'), ',') AS runs, ({_NEG})::INTEGER AS negations FROM memories WHERE length(content) >= 10",
    "reps": "SELECT min(id) AS id, project, content, any_value(n) AS n, any_value(runs) AS runs, any_value(negations) AS negations FROM texts GROUP BY project, content",
    "firsts": "SELECT id, string_agg(t, ',' ORDER BY i) AS runs FROM (SELECT id, t, min(i) AS i FROM (SELECT id, unnest(string_split(runs, ',')) AS t, generate_subscripts(string_split(runs, ','), 1) AS i FROM reps) GROUP BY ALL) GROUP BY id",
    "signed": "SELECT s.id, s.k, s.v, r.project, r.n, r.negations, f.runs FROM sig_m s JOIN reps r USING (id) JOIN firsts f USING (id)",
    "near": "SELECT a.id AS a, b.id AS b, count(*) / 64 AS sim FROM signed a JOIN signed b ON a.k = b.k AND a.v = b.v AND a.project = b.project AND a.negations = b.negations AND a.runs = b.runs AND a.id < b.id WHERE greatest(a.n, b.n) <= 3 * least(a.n, b.n) GROUP BY ALL HAVING count(*) >= 45 UNION ALL SELECT r.id, t.id, 1.0 FROM reps r JOIN texts t ON r.project = t.project AND r.content = t.content AND r.id <> t.id",
    "both_ways": "SELECT a, b FROM near UNION ALL SELECT b, a FROM near",
    "reach(a, b)": "SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a",
    "low": "SELECT a AS id, least(a, min(b)) AS cluster FROM reach GROUP BY a",
    "stays": "SELECT cluster, first(id ORDER BY salience DESC, access_count DESC, created_at, id) AS survivor FROM low JOIN memories USING (id) GROUP BY cluster",
}


@query("SELECT id, cluster, survivor, CASE WHEN id <> survivor THEN survivor END AS superseded_by FROM low JOIN stays USING (cluster)", recursive=True, **_NEAR)
def consolidate_survivors(spark, d):
    return dedup.consolidate(memories(spark, d))


@query("SELECT a, b, round(sim, 9) AS sim FROM near", recursive=True, **_NEAR)
def minhash_near_pairs(spark, d):
    return dedup.near_pairs(memories(spark, d)).withColumn("sim", F.round("sim", 9))


@query("SELECT DISTINCT coalesce(survivor, memory_id) AS memory_id, key, value FROM tags LEFT JOIN (SELECT id, survivor FROM low JOIN stays USING (cluster)) ON id = memory_id", recursive=True, tags=_TAGS, **_NEAR)
def consolidated_tags(spark, d):
    m = memories(spark, d)
    return dedup.move_tags(_tags(m), dedup.consolidate(m))


@query("SELECT m.id, coalesce(CASE WHEN s.survivor <> m.id THEN s.survivor END, m.superseded_by) AS superseded_by FROM memories m LEFT JOIN (SELECT id, survivor FROM low JOIN stays USING (cluster)) s ON s.id = m.id", recursive=True, **_NEAR)
def superseded_memories(spark, d):
    m = memories(spark, d)
    return dedup.supersede(m, dedup.consolidate(m)).select("id", "superseded_by")


#: The driver's texts have no Han: two runs of eight characters, by the digest of a text, stand for them.
_HAN = "数据查询内存规则决策任务文件线程"


def _han(m: DataFrame) -> DataFrame:
    digest = F.translate(F.md5("content"), "0123456789abcdef", _HAN)
    return m.withColumn("content", F.concat(F.substring(digest, 1, 8), F.lit(" "), F.substring(digest, 9, 8)))


_LEXICON = {
    "han": f"SELECT *, substr(t, 1, 8) AS x, substr(t, 9, 8) AS y FROM (SELECT id, project, expires_at, superseded_by, salience, last_seen_at, access_count, translate(md5(content), '0123456789abcdef', '{_HAN}') AS t FROM memories)",
    "pairs_at": "SELECT id, unnest(list_concat(list_transform(range(1, 8), lambda i: substr(x, i, 2)), list_transform(range(1, 8), lambda i: substr(y, i, 2)))) AS term FROM han",
    "held": "SELECT id, term, count(*)::DOUBLE AS f FROM pairs_at GROUP BY ALL",
    "dft": "SELECT term, count(*) AS df FROM held GROUP BY term",
    "terms": f"SELECT term, count(*) AS freq FROM held WHERE term NOT IN ({', '.join(repr(w) for w in dedup.GENERIC)}) GROUP BY term HAVING count(*) >= 2 ORDER BY freq DESC, term LIMIT 200",
    "scored": f"SELECT term, id, round(-(CASE WHEN ln(((SELECT count(*) FROM han) - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln(((SELECT count(*) FROM han) - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2), 9) AS bm25, round({DECAY}, 12) AS decayed, salience, last_seen_at FROM held JOIN dft USING (term) JOIN terms USING (term) JOIN (SELECT *, {DAYS} AS d FROM han WHERE {VISIBLE} AND project = 'src1') USING (id)",
    "found": "SELECT term, id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY bm25, decayed DESC, salience DESC, last_seen_at DESC, id) AS r FROM scored) WHERE r <= 8",
    "lib": "SELECT count(*) AS n FROM han WHERE project = 'src1'",
    "sizes": "SELECT term, count(*) AS n FROM found GROUP BY term HAVING (SELECT n FROM lib) < 20 OR count(*) <= floor((SELECT n FROM lib) * 0.3)",
    "sims": "SELECT a.term AS a, b.term AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS sim FROM found a JOIN found b ON a.id = b.id AND a.term < b.term JOIN sizes x ON x.term = a.term JOIN sizes y ON y.term = b.term GROUP BY a.term, b.term",
    "links": "SELECT a, b FROM sims WHERE sim >= 0.5 UNION ALL SELECT b, a FROM sims WHERE sim >= 0.5",
    "reach(a, b)": "SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a",
    "low": "SELECT a AS term, least(a, min(b)) AS cluster FROM reach GROUP BY a",
    "best": "SELECT cluster, first(term ORDER BY freq DESC, length(term) DESC, term) AS standard FROM low JOIN terms USING (term) GROUP BY cluster",
}


#: The whole texts in Han: a letter each for a to z, so that a repeated phrase is a repeated run.
_LETTERS, _HAN_LETTERS = "abcdefghijklmnopqrstuvwxyz", _HAN + "部署回滚缓库锁重试分"


@query(f"SELECT term, count(*) AS freq FROM (SELECT DISTINCT id, unnest(flatten(list_transform(regexp_extract_all(translate(lower(content), '{_LETTERS}', '{_HAN_LETTERS}'), '\\p{{Han}}+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS term FROM memories) WHERE term NOT IN ({', '.join(repr(w) for w in dedup.GENERIC)}) GROUP BY term HAVING count(*) >= 2 ORDER BY freq DESC, term LIMIT 200")
def lexicon_bigrams(spark, d):
    return dedup.lexicon_bigrams(memories(spark, d).withColumn("content", F.translate(F.lower("content"), _LETTERS, _HAN_LETTERS)))


def _term_pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    m = _han(memories(spark, d))
    terms = written(dedup.lexicon_bigrams(m), "terms")
    mine = F.col("project") == "src1"
    hits = retrieval.fused(m, terms.select(F.col("term").alias("qid"), F.col("term").alias("query")), _decayed(), retrieval.visible(NOW) & mine, dedup.HITS)
    return dedup.term_pairs(hits.select(F.col("qid").alias("term"), "id"), m.where(mine).count()), terms


@query("SELECT term, standard FROM low JOIN best USING (cluster)", recursive=True, **_LEXICON)
def lexicon_clusters(spark, d):
    """Clusters of the library's frequent Han pairs by the top hits of their own searches in one project."""
    return dedup.lexicon_clusters(*_term_pairs(spark, d))


@query("SELECT a, b, round(sim, 9) AS sim FROM sims WHERE sim >= 0.4 AND sim < 0.5", recursive=True, **_LEXICON)
def lexicon_review(spark, d):
    return dedup.lexicon_review(_term_pairs(spark, d)[0]).withColumn("sim", F.round("sim", 9))


# ---- evaluation ------------------------------------------------------------------------------------

_LIVE = "NOT suppressed"
_WRITE = "event IN ('manual-add', 'manual-forget')"
_SUMMARY = f"""count(*) AS total, count(*) FILTER (empty) AS empty, count(*) FILTER (empty) / count(*) AS empty_rate, avg(ms) AS avg_ms, count(*) FILTER (trim(query) <> '') AS with_query, count(*) FILTER (suppressed) AS suppressed,
 count(*) FILTER ({_LIVE} AND event NOT IN ('accept', 'reject', 'distill', 'manual-add', 'manual-forget', 'obs-append', 'post-tool-use', 'stop', 'session-end')) AS retrievals, count(*) FILTER ({_LIVE} AND ({_WRITE} OR event = 'accept')) AS writes,
 count(*) FILTER ({_LIVE} AND event = 'obs-append') AS observations, count(*) FILTER ({_LIVE} AND event = 'distill' AND mode = 'ok') AS distill_ok, count(*) FILTER ({_LIVE} AND event = 'distill' AND mode = 'fail') AS distill_fail,
 count(*) FILTER ({_LIVE} AND event = 'accept') AS accepts, count(*) FILTER ({_LIVE} AND event = 'reject') AS rejects, count(*) FILTER ({_LIVE} AND (({_WRITE} AND mode = 'create') OR event = 'accept')) AS creates, count(*) FILTER ({_LIVE} AND {_WRITE} AND mode = 'overwrite') AS overwrites"""


@query(f"SELECT project, {_SUMMARY} FROM audit GROUP BY project")
def audit_summary(spark, d):
    return evaluation.audit_summary(audit(spark, d), "project")


_SEEN = "(observations > 0 OR distill_ok > 0 OR distill_fail > 0)"


@query(f"SELECT session_id, retrievals, writes, CASE WHEN total = 0 THEN 'unused' WHEN retrievals = 0 AND writes = 0 AND accepts = 0 AND {_SEEN} THEN 'observed_not_accepted' WHEN retrievals = 0 THEN 'write_only' WHEN writes = 0 AND accepts = 0 AND {_SEEN} THEN 'read_only_observed' WHEN writes = 0 THEN 'read_only' ELSE 'both' END AS verdict FROM (SELECT session_id, {_SUMMARY} FROM audit WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY session_id)")
def activity_verdict(spark, d):
    recent = evaluation.activity(audit(spark, d), since=F.lit("2024-01-25").cast("timestamp"))
    return evaluation.activity_verdict(evaluation.audit_summary(recent, "session_id")).select("session_id", "retrievals", "writes", "verdict")


@query("SELECT query, min(event_id) AS first FROM audit WHERE empty AND trim(query) <> '' GROUP BY query ORDER BY first LIMIT 10")
def empty_queries(spark, d):
    return evaluation.empty_queries(audit(spark, d), 10)


@query("SELECT a.project, n, empty, floor((n - empty) * 100 / n)::BIGINT AS rate, CASE WHEN coalesce(size, 0) < 20 THEN 'COLD' WHEN floor((n - empty) * 100 / n) >= 30 THEN 'PASS' WHEN floor((n - empty) * 100 / n) >= 10 THEN 'WARN' ELSE 'FAIL' END AS status FROM (SELECT project, count(*) AS n, count(*) FILTER (empty) AS empty FROM audit WHERE event = 'prompt-submit' GROUP BY project) a LEFT JOIN (SELECT project, count(*) AS size FROM (SELECT 'p' || (id % 9) AS project FROM memories WHERE id % 9 <> 2) GROUP BY project) l ON a.project = l.project")
def hit_rate_by_project(spark, d):
    lib = memories(spark, d).where("id % 9 <> 2").select(F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("project"))
    return evaluation.hit_rate(audit(spark, d), lib)


@query(f"SELECT 'total' AS grp, 'total' AS name, count(*) AS n FROM memories UNION ALL SELECT 'total', 'live', count(*) FROM memories WHERE superseded_by IS NULL UNION ALL SELECT 'total', 'superseded', count(*) FROM memories WHERE superseded_by IS NOT NULL UNION ALL SELECT 'total', 'expired', count(*) FROM memories WHERE expires_at <= {NOW} UNION ALL SELECT 'kind', kind, count(*) FROM memories GROUP BY kind UNION ALL SELECT 'project', CASE WHEN project = '' THEN '(global)' ELSE project END, count(*) FROM memories GROUP BY 2")
def library_stats(spark, d):
    return evaluation.library_stats(memories(spark, d), NOW)


@query("SELECT DISTINCT kind, project FROM memories WHERE adopted_count > 0")
def adopted_subjects(spark, d):
    return memories(spark, d).where("adopted_count > 0").select("kind", "project").distinct()


def _gold(spark, d) -> DataFrame:
    """Documents that hold a benchmark passage word for word, by the first 12 marks of their hash."""
    doc = memories(spark, d).select("content")
    b = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("qid"), "text")
    return holding(doc, "content", b, "text").select("qid", F.substring(T.content_hash(F.col("content")), 1, 12).alias("prefix")).distinct()


_RECALL = "SELECT g.qid, g.n_gold, coalesce(h.hits, 0) AS hits, round(coalesce(h.hits, 0) / g.n_gold, 9) AS recall, round(coalesce(1.0 / h.first, 0), 9) AS rr, coalesce(h.found, 0) = g.n_gold AS strict FROM (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid) g LEFT JOIN (SELECT r.qid, count(DISTINCT rank) AS hits, min(rank) AS first, count(DISTINCT prefix) AS found FROM placed r JOIN gold ON r.qid = gold.qid AND starts_with(r.hash, gold.prefix) GROUP BY r.qid) h ON g.qid = h.qid"
_GOLD = {
    "hashed": f"SELECT id, content, {HASH} AS hash FROM memories",
    "gold": "SELECT DISTINCT item_id AS qid, substr(hash, 1, 12) AS prefix FROM hashed JOIN benchmark ON contains(content, text)",
    "placed": "SELECT qid, hash, rank FROM fused JOIN hashed USING (id)",
}


@query(_RECALL, **_GOLD, **fused(10))
def recall_at_k(spark, d):
    m = memories(spark, d)
    ranked = _with_hash(retrieval.fused(m, _questions(spark, d), _decayed(), retrieval.visible(NOW)), m).select("qid", "hash", "rank")
    return evaluation.recall_at_k(ranked, _gold(spark, d), 10).withColumns({"recall": F.round("recall", 9), "rr": F.round("rr", 9)})


@query("SELECT count(*) AS queries, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr, round(avg((hits = 0)::INT), 9) AS empty_rate, round(avg(strict::INT), 9) AS strict_all FROM (" + _RECALL + ")", **_GOLD, **fused(10))
def retrieval_quality(spark, d):
    out = evaluation.macro(recall_at_k(spark, d))
    return out.select("queries", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


_LABELLED = f"SELECT l.doc_id AS qid, CASE WHEN quality = 1 THEN substr({HASH}, 1, 12) WHEN toxic = 1 THEN '000000000000' ELSE '' END AS prefix FROM labels l JOIN memories m ON l.doc_id = m.id"


@query("SELECT qid, CASE WHEN max(prefix) = '' THEN 'empty_gold' ELSE 'unknown_gold' END AS reason FROM labelled GROUP BY qid HAVING max(prefix) IN ('', '000000000000')", labelled=_LABELLED)
def invalid_gold_report(spark, d):
    m = written(_hashed(memories(spark, d)).select("id", F.col("content_hash").alias("hash")), "hashes")
    g = table(spark, d, "labels").join(m, F.col("doc_id") == F.col("id"))
    prefix = F.when(F.col("quality") == 1, F.substring("hash", 1, 12)).when(F.col("toxic") == 1, "000000000000").otherwise("")
    return evaluation.invalid_gold(g.select(F.col("doc_id").alias("qid"), prefix.alias("prefix")), m)


@query("SELECT candidates, fragments, avg_chars, phrases - found AS missed, candidates - matched AS extra FROM (SELECT count(*) AS candidates, count(*) FILTER (regexp_matches(content, '[，、；,;]\\s*$')) AS fragments, round(avg(length(content)), 9) AS avg_chars FROM memories), (SELECT count(DISTINCT id) AS matched, count(DISTINCT text) AS found FROM memories JOIN benchmark ON contains(content, text)), (SELECT count(DISTINCT text) AS phrases FROM benchmark)")
def write_eval_metrics(spark, d):
    expected = table(spark, d, "benchmark").where("text is not null").select(F.col("text").alias("phrase"))
    return evaluation.write_eval(memories(spark, d), expected).withColumn("avg_chars", F.round("avg_chars", 9))


@query("SELECT round(avg(a), 6) AS on_recall, round(avg(b), 6) AS off_recall, round(100 * (avg(a) - avg(b)), 6) AS parity FROM (SELECT user_id, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id)")
def injection_arms(spark, d):
    arm = F.when(F.col("event_type") == "view", "on").when(F.col("event_type") == "click", "off")
    out = evaluation.arms(table(spark, d, "events").select(F.col("user_id").alias("case"), arm.alias("arm"), F.col("value").alias("recall")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("SELECT event, count(*) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.95), 6) AS p95, max(ms) AS most FROM audit WHERE ms IS NOT NULL GROUP BY event")
def latency_p95(spark, d):
    return evaluation.latency(audit(spark, d), "event").withColumns({"mean": F.round("mean", 6), "p95": F.round("p95", 6)})


SELF_SAMPLE, SELF_K = 100, 5
_SELF = {
    "library": f"SELECT id, content, {HASH} AS hash FROM memories WHERE {VISIBLE}",
    "evenly": f"SELECT id, content, hash FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, greatest(1, count(*) OVER () // {SELF_SAMPLE}) AS step FROM library) WHERE i % step = 0 ORDER BY id LIMIT {SELF_SAMPLE}",
    "q": "SELECT form || ':' || id AS qid, form, hash, CASE WHEN form = 'part' AND length(content) > 12 THEN substr(content, 1, (length(content) * 3) // 5) ELSE content END AS query FROM evenly, (VALUES ('full'), ('part')) f(form)",
    "hashes": f"SELECT id, {HASH} AS hash FROM memories",
    "each": f"SELECT q.form, q.qid, min(f.rank) AS first, count(DISTINCT f.rank) AS hits FROM q LEFT JOIN (SELECT qid, rank, hash FROM fused JOIN hashes USING (id)) f ON f.qid = q.qid AND substr(f.hash, 1, 12) = substr(q.hash, 1, 12) GROUP BY ALL",
}


@query("SELECT form, count(*) AS queries, round(avg(hits::DOUBLE), 9) AS recall, round(avg(coalesce(1 / first, 0)), 9) AS mrr, round(avg((hits = 0)::INT), 9) AS empty_rate, round(avg((hits > 0)::INT), 9) AS strict_all FROM each GROUP BY form", **_SELF, **fused(SELF_K))
def self_recall(spark, d):
    """(form, queries, recall, mrr, empty_rate, strict_all): evenly spaced memories, by id, as queries to the whole library's fused search: their full text, and its first 60 %."""
    m = _hashed(memories(spark, d))
    asked = evaluation.every_nth(m.where(retrieval.visible(NOW)).select("id", "content", "content_hash"), SELF_SAMPLE, "id")
    c = F.col("content")
    part = F.when(F.length(c) > 12, F.expr("substring(content, 1, cast(length(content) * 3 div 5 as int))")).otherwise(c)
    form = F.explode(F.array(F.struct(F.lit("full").alias("form"), c.alias("query")), F.struct(F.lit("part").alias("form"), part.alias("query"))))
    q = asked.select("id", "content_hash", form.alias("f")).select(F.concat("f.form", F.lit(":"), F.col("id").cast("string")).alias("qid"), "f.query", F.substring("content_hash", 1, 12).alias("prefix"))
    hits = retrieval.fused(m, q.select("qid", "query"), _decayed(), retrieval.visible(NOW), SELF_K)
    ranked = _with_hash(hits, m).select("qid", "hash", "rank")
    scored = written(evaluation.recall_at_k(ranked, q.select("qid", "prefix"), SELF_K), "self-recall")
    each = [evaluation.macro(scored.where(F.col("qid").startswith(f + ":"))).withColumn("form", F.lit(f)) for f in ("full", "part")]
    out = each[0].unionByName(each[1])
    return out.select("form", "queries", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "empty_rate", "strict_all")])


# ---- supply ----------------------------------------------------------------------------------------


def _trace(spark, d) -> DataFrame:
    m, q = memories(spark, d), _questions(spark, d)
    hits = retrieval.fused(m, q, _decayed(), retrieval.visible(NOW), supply.overfetch(supply.LIMIT))
    subjects = m.where("adopted_count > 3").select("kind", "project").distinct().withColumn("subject", F.lit(True))
    hits = written(retrieval.looked_up(hits, m, "content", "kind", "project"), "pooled").join(q, "qid").join(subjects, ["kind", "project"], "left")
    return supply.supply(hits.withColumn("q_project", F.lit("src1")).withColumn("noted", (F.col("kind") == "rule") & (F.col("id") % 4 == 0)))


_IDENT = "regexp_matches({low}, '(^|[^A-Za-z0-9_])' || regexp_escape(t) || '($|[^A-Za-z0-9_])')"
_TRACE = {
    **fused(24),
    **_ANALYSIS,
    "ids_terms": "SELECT i.qid, list_distinct(ids) AS ids, list_distinct(ts) AS ts FROM asked_ident i JOIN asked_terms USING (qid)",
    "subjects": "SELECT DISTINCT kind, project FROM memories WHERE adopted_count > 3",
    "pooled": "SELECT f.qid, f.id, f.rank, f.score, f.precise AS rp, f.broad AS rb, f.fuzzy AS rf, m.content, lower(m.content) AS low_text, m.kind, m.project, s.kind IS NOT NULL AS subject, m.kind = 'rule' AND m.id % 4 = 0 AS noted, ids, ts, regexp_matches(g.query, '" + "|".join(T.DEEP) + "') AS deep, g.gate FROM fused f JOIN memories m USING (id) JOIN ids_terms USING (qid) JOIN gates g ON g.qid = f.qid LEFT JOIN subjects s ON s.kind = m.kind AND s.project = m.project",
    "covered": "SELECT qid, id, count(*) FILTER (what = 'i' AND has) AS got_ids, count(*) FILTER (what = 't' AND has) AS got_terms FROM (SELECT qid, id, what, CASE WHEN what = 'i' OR regexp_matches(t, '[A-Za-z]') THEN " + _IDENT.format(low="low_text") + " ELSE contains(low_text, t) END AS has FROM (SELECT qid, id, low_text, 'i' AS what, unnest(ids) AS t FROM pooled UNION ALL SELECT qid, id, low_text, 't', unnest(ts) FROM pooled)) GROUP BY qid, id",
    "supported": f"SELECT p.*, CASE WHEN len(ids) > 0 AND got_ids = len(ids) THEN 3.0 ELSE 0 END + CASE WHEN deep THEN 3.0 ELSE 0 END + CASE WHEN subject THEN 1.5 ELSE 0 END + CASE WHEN (rp > 0)::INT + (rb > 0)::INT + (rf > 0)::INT >= 2 THEN 2.0 + 0.25 * ((rp > 0)::INT + (rb > 0)::INT + (rf > 0)::INT - 2) ELSE 0 END + CASE WHEN rp > 0 THEN 1.0 WHEN rb > 0 AND rf = 0 AND got_terms >= 3 AND got_terms * 3 >= len(ts) THEN 0.5 ELSE 0 END AS support, {NORM.replace('content', 'p.content')} AS norm, concat_ws('+', CASE WHEN rp > 0 THEN 'p' END, CASE WHEN rb > 0 THEN 'b' END, CASE WHEN rf > 0 THEN 'f' END) AS letters, trim(regexp_replace(p.content, '\\s+', ' ', 'g')) AS flat FROM pooled p LEFT JOIN covered c ON c.qid = p.qid AND c.id = p.id",
    "judged": "SELECT *, CASE WHEN gate <> 'run' THEN 'gate' WHEN support <= 0 THEN 'unsupported' WHEN noted THEN 'notes' END AS early, project NOT IN ('', 'src1') AS alien, '- [' || kind || '] mem:' || substr(id::VARCHAR, 1, 8) || ' ' || CASE WHEN length(flat) > 120 THEN substr(flat, 1, 120) || '…' ELSE flat END || CASE WHEN rb > 0 AND rp = 0 AND rf = 0 THEN '（弱相关）' ELSE '' END || ' · ' || letters || chr(10) AS line FROM supported",
    "dropped": "SELECT *, coalesce(early, CASE WHEN coalesce(max((early IS NULL AND NOT alien)::INT) OVER (PARTITION BY qid, norm ORDER BY rank, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate_content' WHEN alien THEN 'cross_project' ELSE '' END) AS dropped_for FROM judged",
    "ordered": "SELECT qid, id, project = '' AS everywhere, length(line) AS cost, row_number() OVER (PARTITION BY qid ORDER BY support DESC, score DESC, rank, id) AS i FROM dropped WHERE dropped_for = ''",
    "walk(qid, i, id, n, used, globals, place, why)": "SELECT DISTINCT qid, 0::BIGINT, NULL::BIGINT, 0, 0::BIGINT, 0, 0, '' FROM ordered UNION ALL SELECT o.qid, o.i, o.id, w.n + fits::INT, w.used + CASE WHEN fits THEN o.cost ELSE 0 END, w.globals + (fits AND o.everywhere)::INT, CASE WHEN fits THEN w.n + 1 ELSE 0 END, CASE WHEN w.n >= 3 THEN 'limit' WHEN o.everywhere AND w.globals >= 1 THEN 'scope_quota' WHEN w.used + o.cost > 1200 THEN 'budget' ELSE '' END FROM walk w JOIN ordered o ON o.qid = w.qid AND o.i = w.i + 1, LATERAL (SELECT w.n < 3 AND NOT (o.everywhere AND w.globals >= 1) AND w.used + o.cost <= 1200 AS fits)",
    "chosen": "SELECT d.qid, d.id, d.rank, support::DOUBLE AS support, CASE WHEN dropped_for <> '' THEN dropped_for ELSE why END AS drop_reason, coalesce(place, 0)::INTEGER AS injection_rank, letters AS provenance FROM dropped d LEFT JOIN walk w ON w.qid = d.qid AND w.id = d.id",
    "counted": "SELECT qid, count(*) AS raw_hits, count(*) FILTER (drop_reason IN ('', 'limit', 'scope_quota', 'budget')) AS qualified, count(*) FILTER (injection_rank > 0) AS injected FROM chosen GROUP BY qid",
}


@query("SELECT * FROM chosen", recursive=True, **_TRACE)
def supply_selection(spark, d):
    return _trace(spark, d).drop("line")


@query("SELECT g.qid, coalesce(raw_hits, 0) AS raw_hits, coalesce(qualified, 0) AS qualified, coalesce(injected, 0) AS injected, CASE WHEN gate <> 'run' THEN 'skipped_gate' WHEN raw_hits IS NULL THEN 'abstained_no_hit' WHEN injected > 0 THEN 'injected' ELSE 'abstained_low_quality' END AS outcome FROM gates g LEFT JOIN counted c USING (qid)", recursive=True, **_TRACE)
def supply_outcomes(spark, d):
    return supply.traces(_trace(spark, d), _questions(spark, d))


@query("SELECT round(avg((coalesce(good, 0) > 0)::INT) FILTER (n > 0), 9) AS supply_rate, round(sum(good) / sum(injected), 9) AS precision, round(avg((injected IS NULL)::INT) FILTER (n = 0), 9) AS abstain_rate FROM (SELECT w.qid, count(w.id) AS n, any_value(i.injected) AS injected, any_value(i.good) AS good FROM wanted w LEFT JOIN (SELECT c.qid, count(*) AS injected, count(x.id) AS good FROM chosen c LEFT JOIN wanted x ON x.qid = c.qid AND x.id = c.id WHERE injection_rank > 0 GROUP BY c.qid) i ON i.qid = w.qid GROUP BY w.qid)", recursive=True, wanted="SELECT qid, CASE WHEN qid % 3 > 0 THEN id END AS id FROM q JOIN memories ON contains(content, query) OR id % 7 = qid % 7", **_TRACE)
def supply_metrics(spark, d):
    q, m = _questions(spark, d), memories(spark, d)
    # what is alike is taken once, so the two have no row in common and each none twice
    held = written(holding(m.select("id", "content"), "content", q, "query").where("id % 7 <> qid % 7").select("qid", "id"), "held")
    alike = m.select("id", (F.col("id") % 7).alias("k")).join(q.select("qid", (F.col("qid") % 7).alias("k")), "k").select("qid", "id")
    wanted = held.unionByName(alike).select("qid", F.when(F.col("qid") % 3 > 0, F.col("id")).alias("id"))
    out = supply.metrics(_trace(spark, d), wanted)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("SELECT project, content, id, length(content) + 1 AS cost FROM (SELECT *, sum(length(content) + 1) OVER (ORDER BY project, content, id ROWS UNBOUNDED PRECEDING) AS total FROM memories WHERE kind = 'rule' OR (project = '' AND salience >= 0.8)) WHERE total <= 2048")
def notes_budget(spark, d):
    return supply.notes(memories(spark, d)).withColumn("cost", F.col("cost").cast("bigint"))


# ---- evidence --------------------------------------------------------------------------------------

_EVID = "SELECT event_id AS ord, user_id AS source_id, 1 AS generation, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || (event_id // 2) END AS event_uid, 'a' || (event_id % 17) AS archive, (event_id % 3000)::BIGINT AS bytes FROM events"


def _evid(spark, d) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + F.when(F.col("event_id") % 211 == 0, 1).otherwise(0)
    uid = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.expr("event_id div 2").cast("string")))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("source_id"), F.lit(1).alias("generation"), seq.cast("bigint").alias("seq"), uid.alias("event_uid"), F.concat(F.lit("a"), (F.col("event_id") % 17).cast("string")).alias("archive"), (F.col("event_id") % 3000).cast("bigint").alias("bytes"))


@query("SELECT ord, source_id, seq, event_uid FROM (SELECT *, row_number() OVER (PARTITION BY source_id, generation, seq ORDER BY ord) AS r FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_uid <> '' THEN event_uid ELSE '#' || ord END ORDER BY ord) AS u FROM evid) WHERE u = 1) WHERE r = 1", evid=_EVID)
def exactly_once_capture(spark, d):
    return evidence.exactly_once(_evid(spark, d)).select("ord", "source_id", "seq", "event_uid")


@query("SELECT w.ord, w.source_id, coalesce(u.ord, p.ord) AS found_ord, CASE WHEN u.ord IS NOT NULL THEN u.archive ELSE p.archive END AS found_archive FROM evid w LEFT JOIN led u ON w.event_uid <> '' AND u.event_uid = w.event_uid LEFT JOIN led p ON p.source_id = w.source_id AND p.generation = w.generation AND p.seq = w.seq", evid=_EVID, led="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, generation, seq ORDER BY ord) AS r FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_uid <> '' THEN event_uid ELSE '#' || ord END ORDER BY ord) AS u FROM evid) WHERE u = 1) WHERE r = 1")
def evidence_lookup(spark, d):
    e = _evid(spark, d)
    return evidence.lookup(e, evidence.exactly_once(e), "ord", "archive").select("ord", "source_id", "found_ord", "found_archive")


_OBS = "SELECT id, session_id, sha256(summary) AS hash, CASE WHEN seq % 3 = 0 THEN '' ELSE 'e' || (id // 2) END AS event_id FROM observations"


@query("SELECT id, session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, hash ORDER BY id) AS h FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_id <> '' THEN event_id ELSE '#' || id END ORDER BY id) AS e FROM obs) WHERE e = 1) WHERE h = 1", obs=_OBS)
def observation_append(spark, d):
    uid = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("e"), F.expr("id div 2").cast("string")))
    o = observations(spark, d).select("id", "session_id", F.sha2("summary", 256).alias("hash"), uid.alias("event_id"))
    return evidence.first_written(o, "id", ["event_id"], ["session_id", "hash"]).select("id", "session_id", "event_id")


@query("SELECT ord, source_id, seq, CASE WHEN seq = row_number() OVER (PARTITION BY source_id, generation ORDER BY seq, ord) THEN 'accepted' ELSE 'gap' END AS state FROM (SELECT * FROM evid WHERE ord % 97 <> 0)", evid=_EVID.replace(" + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END", ""))
def sequence_gaps(spark, d):
    from pyspark.sql import Window

    e = _evid(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("source_id").orderBy("ord")).cast("bigint"))
    return evidence.sequence_check(e.where("ord % 97 <> 0")).select("ord", "source_id", "seq", "state")


@query("SELECT source_id, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT *, row_number() OVER w AS pos, sum(bytes) OVER w AS total FROM evid WHERE seq > source_id % 5 WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE seq - source_id % 5 = pos AND pos <= 50 AND (total <= 65536 OR pos = 1) GROUP BY source_id", evid=_EVID.replace(" + CASE WHEN event_id % 211 = 0 THEN 1 ELSE 0 END", ""))
def bundle_windows(spark, d):
    from pyspark.sql import Window

    e = _evid(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("source_id").orderBy("ord")).cast("bigint"))
    return evidence.bundles(e.withColumn("cursor", F.col("source_id") % 5))


@query("SELECT source_id, list_reduce(list_prepend('', list(event_uid || chr(10) || archive || chr(10) || seq ORDER BY seq, event_uid, archive)), lambda tip, e: sha256(tip || chr(10) || e)) AS tip FROM evid GROUP BY source_id", evid=_EVID)
def rolling_hash_chain(spark, d):
    return evidence.hash_chain(_evid(spark, d))


@query("SELECT key, unnest(got) AS ts FROM (SELECT key, list_filter(list_reduce(list_prepend([]::BIGINT[], list_transform(list(ts ORDER BY ts), lambda t: [t])), lambda s, t: CASE WHEN len(s) = 0 OR s[-1] < t[1] - 36000 THEN list_concat(s, t) ELSE s END), lambda x: true) AS got FROM (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS ts FROM events) GROUP BY key)")
def claim_windows(spark, d):
    return evidence.claims(table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.date_trunc("second", F.col("ts"))).alias("ts")), 36000)


_ITEMS = "SELECT id AS candidate_id, CASE WHEN (id + k) % 4 = 0 THEN '' ELSE 'e' || (id + k) END AS event_uid, 'v' || k AS evidence_id, CASE WHEN (id + k) % 3 = 0 THEN '' ELSE 's' || k END AS archive, CASE (id + k) % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'error' WHEN 2 THEN 'resolution' WHEN 3 THEN 'odd' ELSE 'direct' END AS role, k AS seq FROM memories, (VALUES (0), (1), (2)) t(k) WHERE id % 6 <> k * 2"
_ROLE = "CASE WHEN role IN ('direct', 'error', 'resolution') THEN role ELSE 'context' END"
_GRADE = "CASE WHEN event_uid <> '' AND archive <> '' THEN 'A' WHEN event_uid <> '' OR archive <> '' THEN 'B' ELSE 'C' END"


def _items(m: DataFrame) -> DataFrame:
    k = m.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("id % 6 <> k * 2")
    s = F.col("id") + F.col("k")
    txt = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    role = F.when(s % 5 == 1, "error").when(s % 5 == 2, "resolution").when(s % 5 == 3, "odd").otherwise("direct")
    return k.select(F.col("id").alias("candidate_id"), F.when(s % 4 == 0, "").otherwise(txt("e", s)).alias("event_uid"), txt("v", F.col("k")).alias("evidence_id"), F.when(s % 3 == 0, "").otherwise(txt("s", F.col("k"))).alias("archive"), role.alias("role"), F.col("k").alias("seq"), s.alias("occurred_at"))


@query(
    f"""SELECT id, action, reasons, coalesce(h, sha256('')) AS evidence_hash, sha256(id || '|' || (id % 3) || '|' || action || '|' || coalesce(h, sha256(''))) AS idempotency_key FROM (SELECT *, split_part(v, ':', 1) AS action, split_part(v, ':', 2) AS reasons FROM (SELECT m.id, h, CASE WHEN m.id % 31 = 5 THEN 'conflict:conflict'
 WHEN kind IN ('decision', 'preference', 'rule') THEN 'human_accept:manual_kind' WHEN m.id % 23 = 0 THEN 'human_accept:global_scope' WHEN kind = 'fact' AND project = '' THEN 'human_accept:project_missing' WHEN kind = 'fact' AND da THEN 'auto_commit:auto_eligible'
 WHEN kind = 'fact' AND n IS NULL THEN 'defer:missing_evidence' WHEN kind = 'fact' AND NOT di THEN 'defer:missing_direct_evidence' WHEN kind = 'fact' THEN 'defer:grade_below_a'
 WHEN kind = 'pitfall' AND NOT coalesce(er, false) AND NOT coalesce(re, false) THEN 'defer:pitfall_missing_error,pitfall_missing_resolution' WHEN kind = 'pitfall' AND NOT er THEN 'defer:pitfall_missing_error' WHEN kind = 'pitfall' AND NOT re THEN 'defer:pitfall_missing_resolution'
 WHEN kind = 'pitfall' AND (NOT eb OR NOT rb) THEN 'defer:pitfall_weak_evidence' WHEN kind = 'pitfall' THEN 'auto_commit:auto_eligible' WHEN kind = 'task' AND m.id % 4 = 3 THEN 'defer:task_state_invalid' ELSE 'auto_commit:auto_eligible' END AS v
 FROM memories m LEFT JOIN ev ON ev.id = m.id))""",
    items=_ITEMS,
    graded=f"SELECT candidate_id, event_uid, evidence_id, archive, seq, {_ROLE} AS role, {_GRADE} AS grade FROM items",
    ev="SELECT candidate_id AS id, count(*) AS n, bool_or(role = 'direct' AND grade = 'A') AS da, bool_or(role = 'direct') AS di, bool_or(role = 'error') AS er, bool_or(role = 'resolution') AS re, bool_or(role = 'error' AND grade <> 'C') AS eb, bool_or(role = 'resolution' AND grade <> 'C') AS rb, sha256(string_agg(line || chr(10), '' ORDER BY line || chr(10))) AS h FROM (SELECT *, event_uid || '|' || evidence_id || '|' || archive || '|' || grade || '|' || role || '|' || seq AS line FROM graded) GROUP BY 1",
)
def commit_matrix(spark, d):
    m = memories(spark, d)
    state = F.when(F.col("id") % 4 == 0, "done").when(F.col("id") % 4 == 1, "blocked").when(F.col("id") % 4 == 2, "next").otherwise("halfway")
    c = m.select("id", (F.col("id") % 3).alias("revision"), "kind", F.when(F.col("id") % 23 == 0, "global").otherwise("project").alias("scope"), "project", state.alias("task_state"), F.when(F.col("id") % 31 == 5, " Conflict").otherwise("").alias("review_class"))
    return evidence.commit_matrix(c, _items(m))


_LINKS = f"SELECT candidate_id AS memory_id, evidence_id AS link_id, CASE WHEN event_uid = '' THEN '' ELSE 'evt_' || event_uid END AS event_uid, archive, CASE WHEN (candidate_id + seq) % 7 = 0 THEN '' ELSE 'file' || (seq % 2) || '.gz' END AS locator, {_GRADE} AS grade, candidate_id + seq AS occurred_at, seq FROM items"
_BARE = "CASE WHEN trim({c}) <> '' THEN substr(regexp_replace(trim({c}), '^(evt_)?(ev_)?', ''), 1, 8) END"


@query(
    "SELECT memory_id, substr('证据' || count(*) || '条·' || min(grade) || '级' || coalesce('·' || arg_min(token, spot) || CASE WHEN count(*) > 1 THEN '+' || (count(*) - 1) ELSE '' END, ''), 1, 40) AS line FROM pieces GROUP BY memory_id",
    items=_ITEMS, evidence_links=_LINKS,
    pieces=f"SELECT memory_id, key, min(spot) AS spot, arg_min(grade, spot) AS grade, arg_min(token, spot) AS token FROM (SELECT memory_id, grade, {{'o': occurred_at, 's': seq, 'e': event_uid}} AS spot, CASE WHEN event_uid <> '' THEN 'e:' || event_uid WHEN archive <> '' THEN 'a:' || archive WHEN locator <> '' THEN 'r:' || locator ELSE 'idx:' || link_id END AS key, coalesce({_BARE.format(c='event_uid')}, {_BARE.format(c='archive')}, {_BARE.format(c='locator')}) AS token FROM evidence_links) GROUP BY memory_id, key",
)
def evidence_provenance(spark, d):
    return evidence.provenance(_evidence_links(memories(spark, d)))


def _evidence_links(m: DataFrame) -> DataFrame:
    uid = F.when(F.col("event_uid") == "", "").otherwise(F.concat(F.lit("evt_"), F.col("event_uid")))
    locator = F.when(F.col("occurred_at") % 7 == 0, "").otherwise(F.concat(F.lit("file"), (F.col("seq") % 2).cast("string"), F.lit(".gz")))
    return _items(m).select(F.col("candidate_id").alias("memory_id"), F.col("evidence_id").alias("link_id"), uid.alias("event_uid"), "archive", locator.alias("locator"), evidence.grade(uid, F.col("archive")).alias("grade"), "occurred_at", "seq")


@query("SELECT o.session_id, max(created_at) AS newest, count(*) AS n FROM observations o LEFT JOIN (SELECT session_id, max(created_at) - 10 + session_id % 25 AS done FROM observations WHERE session_id % 3 <> 0 GROUP BY session_id) r ON o.session_id = r.session_id GROUP BY o.session_id, done HAVING max(created_at) > coalesce(done, 0)")
def sessions_needing_distill(spark, d):
    o = observations(spark, d)
    runs = o.where("session_id % 3 <> 0").groupBy("session_id").agg((F.max("created_at") - 10 + F.col("session_id") % 25).alias("finished_at")).withColumn("status", F.lit("ok"))
    return evidence.sessions_due(o, runs)


# ---- extraction and sources ------------------------------------------------------------------------


_MARKED = "SELECT conv_id AS session_id, turn AS seq, role, CASE turn % 5 WHEN 1 THEN 'TODO ' WHEN 2 THEN '决定 ' WHEN 3 THEN '偏好 ' ELSE '' END || coalesce(text, '') AS text FROM conversations"


@query(
    "SELECT session_id, seq, kind, content, 0.6::DOUBLE AS salience FROM (SELECT *, row_number() OVER (PARTITION BY kind, content ORDER BY session_id, seq) AS r FROM found WHERE kind IS NOT NULL AND NOT (kind = 'preference' AND role = 'assistant')) WHERE r = 1",
    marked=_MARKED,
    found="SELECT session_id, seq, role, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS content, CASE WHEN regexp_matches(text, '踩坑|报错|失败|坑了|不要再|(?i:\\berror\\b)') THEN 'pitfall' WHEN regexp_matches(text, '决策|决定|定为|之所以|拍板') THEN 'decision' WHEN regexp_matches(text, '偏好|默认|禁用|优先用|不要用') THEN 'preference' WHEN regexp_matches(text, '待办|还剩|下次|做到哪|(?i:\\bTODO\\b)') THEN 'task' END AS kind FROM marked WHERE role IN ('user', 'assistant') AND trim(text) <> ''",
)
def rule_distill(spark, d):
    n = F.col("turn") % 5
    mark = F.when(n == 1, "TODO ").when(n == 2, "决定 ").when(n == 3, "偏好 ").otherwise("")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("summary"))
    return extraction.rule_distill(turns)


@query("SELECT conv_id AS source_id, turn AS seq, 'text' AS kind, role, 'u' || conv_id || '-' || turn AS uid, trim(coalesce(text, ''), ' ') AS text FROM conversations")
def transcript_parse(spark, d):
    c = table(spark, d, "conversations")
    msg = F.struct("role", F.coalesce("text", F.lit("")).alias("content"))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("uuid"), msg.alias("message")))
    return readers.parse_transcript(c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("seq"), line.alias("value"))).select("source_id", "seq", "kind", "role", "uid", "text")


_FOLD_SUMMARY = "trim(regexp_replace(summary, '\\s+', ' ', 'g'))"
_REFS = "SELECT conv_id AS bundle_id, turn AS ordinal, CASE role WHEN 'user' THEN 'user-prompt' WHEN 'assistant' THEN 'assistant-text' ELSE 'note' END AS event_type, coalesce(text, '') AS summary, turn % 4 <> 3 AS ok, CASE turn % 7 WHEN 0 THEN 'full' WHEN 1 THEN '' WHEN 2 THEN 'pointer' ELSE 'summary' END AS fidelity FROM conversations"


@query(
    "SELECT r.bundle_id, md5($HEAD || coalesce(p.sections, '')) AS prompt_md5, length(coalesce(p.sections, '')) AS n FROM (SELECT DISTINCT bundle_id FROM refs) r LEFT JOIN (SELECT bundle_id, string_agg('=== ' || ['USER', 'ASSISTANT', 'OTHER'][place + 1] || ' ===' || chr(10) || body_lines || chr(10), '' ORDER BY place) AS sections FROM sections GROUP BY bundle_id) p USING (bundle_id)".replace("$HEAD", "'" + extraction.HEADER.replace("'", "''") + "'"),
    refs=_REFS,
    bodies=f"SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ordinal) AS n, {_scrubbed(_FOLD_SUMMARY)} AS flat, CASE event_type WHEN 'user-prompt' THEN 0 WHEN 'assistant-text' THEN 1 ELSE 2 END AS place FROM refs",
    shown="SELECT *, CASE WHEN length(flat) > 400 THEN substr(flat, 1, 399) || '…' ELSE flat END AS body FROM bodies WHERE ok AND fidelity IN ('full', 'summary', '')",
    once="SELECT *, row_number() OVER (PARTITION BY bundle_id, place, body ORDER BY n) AS again FROM shown",
    sections="SELECT bundle_id, place, string_agg('[' || n || '] (' || event_type || '/' || bundle_id || ') ' || body || chr(10), '' ORDER BY n) AS body_lines FROM once WHERE again = 1 GROUP BY bundle_id, place",
)
def session_prompts(spark, d):
    role = F.when(F.col("role") == "user", "user-prompt").when(F.col("role") == "assistant", "assistant-text").otherwise("note")
    n = F.col("turn") % 7
    fidelity = F.when(n == 0, "full").when(n == 1, "").when(n == 2, "pointer").otherwise("summary")
    refs = table(spark, d, "conversations").select(F.col("conv_id").alias("bundle_id"), F.col("turn").alias("ordinal"), role.alias("event_type"), F.col("conv_id").alias("session_id"), F.coalesce("text", F.lit("")).alias("summary"), (F.col("turn") % 4 != 3).alias("proposal_eligible"), fidelity.alias("fidelity"))
    return extraction.prompt(refs).select("bundle_id", F.md5("prompt").alias("prompt_md5"), (F.length("prompt") - len(extraction.HEADER)).cast("bigint").alias("n"))


_MD_HEAD, _MD_TAIL = "# Title\n- first\titem ", "\n  goes on here\n1. second [link](http://x) of the list\n```\ncode line that is no item\n```\n  indented after a fence\n> quoted line of text\n| a | table line |\n<!-- a comment line -->\n---------\n[only](http://a/link/that/is/long)\n- first\titem"
_SQL_TEXT = lambda t: " || chr(10) || ".join("'" + x.replace("'", "''").replace("\t", "' || chr(9) || '") + "'" for x in t.split("\n"))
_MD = {
    "md": f"SELECT id, {_SQL_TEXT(_MD_HEAD)} || content || {_SQL_TEXT(_MD_TAIL)} AS text FROM memories",
    "md_lines": "SELECT id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line FROM (SELECT id, string_split(text, chr(10)) AS ls FROM md)",
    "md_cut": "SELECT id, line, raw, regexp_replace(regexp_replace(raw, '^[\\s\\x{85}\\x{A0}\\x{3000}]+', ''), '[\\s\\x{85}\\x{A0}\\x{3000}]+$', '') AS t FROM md_lines",
    "md_fence": "SELECT *, regexp_matches(t, '^(```|~~~)') AS fence, sum(regexp_matches(t, '^(```|~~~)')::INT) OVER (PARTITION BY id ORDER BY line) % 2 = 1 AS code FROM md_cut",
    "md_ends": "SELECT *, fence OR code OR t = '' OR regexp_matches(t, '^(#|\\||<!--)') AS ends FROM md_fence",
    "md_more": "SELECT *, NOT ends AND coalesce(lag(NOT ends) OVER (PARTITION BY id ORDER BY line), false) AND regexp_matches(raw, '^[ \t]') AS more FROM md_ends",
    "md_group": "SELECT *, sum((NOT more)::INT) OVER (PARTITION BY id ORDER BY line) AS grp FROM md_more",
    "md_items": "SELECT id, grp, min(line) AS line, trim(string_agg(CASE WHEN more THEN t ELSE trim(regexp_replace(regexp_replace(regexp_replace(t, '^[-*+] ', ''), '^[0-9]+[.)]\\s+', ''), '^>+', '')) END, ' ' ORDER BY line)) AS text FROM md_group WHERE NOT ends GROUP BY id, grp",
}


@query("SELECT id, min(line)::INTEGER AS line, text FROM md_items WHERE length(text) BETWEEN 8 AND 500 AND length(trim(regexp_replace(text, '!?\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'))) >= 8 GROUP BY id, text", **_MD)
def markdown_ingest(spark, d):
    return readers.markdown_items(_markdown(memories(spark, d)))


def _markdown(m: DataFrame) -> DataFrame:
    return m.select("id", F.concat(F.lit(_MD_HEAD), F.col("content"), F.lit(_MD_TAIL)).alias("text"))


@query("SELECT id, CASE WHEN count(v) = 0 THEN NULL ELSE sha256(string_agg(v::VARCHAR, ',' ORDER BY k)) END AS sig_hash FROM memories LEFT JOIN sig_m USING (id) GROUP BY id")
def minhash_signatures(spark, d):
    s = memories(spark, d).select("id", M.minhash("content").alias("sig"))
    return s.select("id", F.sha2(F.array_join(F.transform("sig", lambda x: x.cast("string")), ","), 256).alias("sig_hash"))


from . import capture_queries, context_queries, index_queries, runner_queries, source_queries, write_queries  # noqa: E402,F401  (they register themselves)
