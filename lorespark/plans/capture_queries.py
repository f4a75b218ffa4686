"""Queries of the capture path: names, texts and eligibility of events, numbering, bundles, queues and run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import minhash as M
from ..operators import capture, extraction
from ..streaming import arrival
from .registry import _scrubbed, query
from .sql import STRIP
from .tables import NOW, memories, observations, table

_NUL = "chr(0)"


def _num(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _txt(p: str, c: F.Column) -> F.Column:
    return F.concat(F.lit(p), c.cast("string"))


@query(
    f"SELECT id, {STRIP.format(c='(kind || chr(10) || (id % 3) || chr(10) || content)').join(('sha256(', ')'))} AS obs_hash, 'bnd_' || substr(sha256(id || '|1|' || (id % 7) || '|' || (id % 7 + 5)), 1, 24) AS bundle, 'evt:' || substr(sha256(id || {_NUL} || 1 || {_NUL} || (id % 9) || {_NUL} || content), 1, 32) AS evt, 'hook:prompt:' || substr(sha256(project || {_NUL} || content), 1, 32) AS hook, 'tx:' || substr(sha256(project || {_NUL} || id || {_NUL} || (id % 2) || {_NUL} || content), 1, 32) AS tx, CASE WHEN id % 2 = 0 THEN 'u' || id ELSE 'evt:spool:' || substr(sha256(project || {_NUL} || (id * 10) || {_NUL} || content), 1, 32) END AS spool, substr(id::VARCHAR, 1, 8) AS short FROM memories"
)
def identity_names(spark, d):
    i, c, p = F.col("id"), F.col("content"), F.col("project")
    return memories(spark, d).select(
        "id", I.observation_hash(F.col("kind"), i % 3, c).alias("obs_hash"), I.bundle_id(i, F.lit(1), i % 7, i % 7 + 5).alias("bundle"), I.event_uid(i, F.lit(1), i % 9, c).alias("evt"), I.prompt_uid(p, c).alias("hook"),
        I.transcript_uid(p, i, i % 2, c).alias("tx"), I.spool_uid(F.when(i % 2 == 0, _txt("u", i)).otherwise(""), p, i * 10, c).alias("spool"), I.short_id(i).alias("short"),
    )


@query("SELECT session_id, substr(sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)), 1, 32) AS window_key FROM observations GROUP BY session_id")
def window_keys(spark, d):
    return observations(spark, d).groupBy("session_id").agg(I.window_key(F.collect_list(_num("id"))).alias("window_key"))


_TRIG = f"id || {_NUL} || trim(p) || {_NUL} || '/w' || {_NUL}"


@query(
    f"SELECT id, substr(sha256(CASE id % 3 WHEN 0 THEN 'post-tool-use' ELSE 'user-prompt' END || {_NUL} || {_TRIG} || CASE WHEN id % 3 = 0 THEN 'grep' || {_NUL} || CASE WHEN id % 2 = 0 THEN 'c' || id ELSE '' END || {_NUL} || CASE WHEN id % 2 = 0 THEN '' ELSE CASE WHEN length(f) > 120 THEN substr(f, 1, 120) || '…' ELSE f END || {_NUL} END ELSE '' END), 1, 32) AS key FROM keyed",
    keyed=f"SELECT id, '  ' || kind || ' ' AS p, trim(regexp_replace({_scrubbed('content')}, '\\s+', ' ', 'g')) AS f FROM memories",
)
def trigger_keys(spark, d):
    i = F.col("id")
    event = F.when(i % 3 == 0, "post-tool-use").otherwise("user-prompt")
    key = I.trigger_key(event, i, F.concat(F.lit("  "), F.col("kind"), F.lit(" ")), F.lit("/w"), F.lit(" grep"), F.when(i % 2 == 0, _txt("c", i)).otherwise(""), F.col("content"))
    return memories(spark, d).select("id", key.alias("key"))


@query("SELECT id, CASE WHEN strlen(f) <= 512 THEN f ELSE trim(substr(f, 1, list_max(list_filter(range(0, 513), lambda k: strlen(substr(f, 1, k::BIGINT)) <= 512)))) END AS summary FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(chr(7) || 'é ' || content, '[\\n\\r\\t]', ' ', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS f FROM memories)")
def bounded_summaries(spark, d):
    return memories(spark, d).select("id", I.summarize(F.concat(F.lit("\u0007é "), F.col("content"))).alias("summary"))


_EVENTS = ["user-prompt", "user.prompt", " Stop", "session-end", "assistant.final", "post-tool-use", "", "unparsed"]
_EVENT = "[" + ", ".join(f"'{e}'" for e in _EVENTS) + "][id % 8 + 1]"


def _event() -> F.Column:
    return F.element_at(F.array(*map(F.lit, _EVENTS)), (F.col("id") % 8 + 1).cast("int"))


@query(
    "SELECT id, who AS speaker, CASE WHEN event = '' THEN 'user' ELSE who END AS distill_speaker, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE event = '' OR who <> '' END AS eligible, CASE WHEN id % 4 = 0 THEN 'none' ELSE 'full' END AS fidelity, id % 6 IN (0, 1) AS residue FROM spoken",
    spoken=f"SELECT id, event, CASE WHEN lower(trim(event)) IN ('user-prompt', 'user.prompt') THEN 'user' WHEN lower(trim(event)) IN ('assistant-text', 'assistant.final', 'stop', 'session-end') THEN 'assistant' ELSE '' END AS who FROM (SELECT id, {_EVENT} AS event FROM memories)",
)
def event_eligibility(spark, d):
    i, e = F.col("id"), _event()
    meta = F.when(i % 5 == 0, '{"proposal_eligible":true,"fidelity":"full"}').when(i % 5 == 1, '{"proposal_eligible":false}').when(i % 5 == 2, '{"proposal_eligible":true,"fidelity":"pointer"}').when(i % 5 == 3, "").otherwise('{"fidelity":"summary"}')
    left = F.when(i % 6 == 0, '{"id":"x"}').when(i % 6 == 1, "  Grep {pattern").otherwise("a plain fact")
    return memories(spark, d).select("id", extraction.speaker(e).alias("speaker"), extraction.distill_speaker(e).alias("distill_speaker"), capture.distill_eligible(meta, e).alias("eligible"), capture.fidelity(F.when(i % 4 == 0, "　 ").otherwise("x")).alias("fidelity"), capture.residue(left).alias("residue"))


_HOOK = {
    "hook": "SELECT id, CASE id % 4 WHEN 0 THEN 'post-tool-use' WHEN 1 THEN 'stop' WHEN 2 THEN 'session-end' ELSE 'pre-compact' END AS event, CASE WHEN id % 3 = 0 THEN '' ELSE ' grep' END AS tool, CASE WHEN id % 5 = 0 THEN 'null' WHEN id % 5 = 1 THEN '' ELSE 'password: hunter22 ' || id END AS tin, CASE WHEN id % 7 < 3 THEN '' ELSE 'found ' || id END AS tout, CASE WHEN id % 3 = 1 THEN ' said ' || id ELSE '' END AS last, CASE WHEN id % 5 = 2 THEN 'content ' || id ELSE '' END AS body, CASE WHEN id % 2 = 0 THEN 'done' ELSE '' END AS status, CASE WHEN id % 9 = 0 THEN 'user' ELSE '' END AS reason, CASE WHEN id % 10 = 5 THEN 'Claude' ELSE 'other' END AS host FROM memories",
    "cleaned": "SELECT *, CASE WHEN tin IN ('null', '') THEN '' ELSE " + _scrubbed("trim(tin)") + " END AS ci, tout AS co, CASE WHEN lower(host) = 'claude' THEN '' WHEN trim(last) <> '' THEN trim(last) ELSE body END AS reply, concat_ws(' ', CASE WHEN status <> '' THEN 'status=' || status END, CASE WHEN reason <> '' THEN 'reason=' || reason END) AS meta FROM hook",
}


@query("SELECT id, CASE WHEN event = 'post-tool-use' THEN 'tool:' || CASE WHEN tool = '' THEN 'tool' ELSE trim(tool) END || CASE WHEN ci <> '' THEN chr(10) || ci ELSE '' END || CASE WHEN co <> '' THEN chr(10) || '→ ' || co ELSE '' END WHEN event = 'pre-compact' THEN event WHEN reply <> '' THEN reply ELSE meta END AS text, CASE WHEN event = 'post-tool-use' THEN CASE WHEN ci <> '' OR co <> '' THEN 'full' ELSE 'summary' END WHEN event = 'pre-compact' THEN 'none' WHEN reply <> '' THEN 'full' WHEN meta <> '' THEN 'summary' ELSE 'none' END AS fidelity FROM cleaned", **_HOOK)
def observation_texts(spark, d):
    i = F.col("id")
    event = F.when(i % 4 == 0, "post-tool-use").when(i % 4 == 1, "stop").when(i % 4 == 2, "session-end").otherwise("pre-compact")
    some = lambda cond, v: F.when(cond, v).otherwise("")
    got = capture.observation_text(
        event, F.when(i % 3 == 0, "").otherwise(" grep"), F.when(i % 5 == 0, "null").when(i % 5 == 1, "").otherwise(_txt("password: hunter22 ", i)), F.when(i % 7 < 3, "").otherwise(_txt("found ", i)),
        some(i % 3 == 1, _txt(" said ", i)), some(i % 5 == 2, _txt("content ", i)), some(i % 2 == 0, F.lit("done")), some(i % 9 == 0, F.lit("user")), F.when(i % 10 == 5, "Claude").otherwise("other"),
    )
    return memories(spark, d).select("id", got.alias("g")).select("id", "g.text", "g.fidelity")


_TX = {
    "recs": "SELECT id, CASE id % 5 WHEN 0 THEN 'tool-result' WHEN 1 THEN 'tool-use' WHEN 2 THEN 'assistant-text' ELSE 'user-prompt' END AS event, CASE id % 5 WHEN 0 THEN 'tool_result ok' WHEN 3 THEN CASE WHEN id % 2 = 0 THEN '<system-reminder>x</system-reminder> ' ELSE '<user_query> ask ' || id || ' </user_query> noise' END ELSE 'plain ' || content END AS body, CASE WHEN id % 2 = 0 THEN 'grep' ELSE '' END AS tool, id % 11 = 0 AS bad FROM memories",
    "cut": "SELECT id, event, bad, CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || '…' ELSE t END AS t FROM (SELECT id, event, bad, trim(" + _scrubbed("CASE WHEN event = 'tool-result' AND tool <> '' THEN 'tool_result:grep ok' ELSE body END") + ", ' ' || chr(9) || chr(10) || chr(13)) AS t FROM recs)",
    "said": "SELECT *, CASE WHEN t LIKE '%<user_query>%' THEN trim(regexp_extract(t, '<user_query>(.*?)</user_query>', 1)) ELSE trim(regexp_replace(t, '(?s)<system-reminder>.*?</system-reminder>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) END AS own FROM cut",
}


@query("SELECT id, t AS text, CASE WHEN event = 'user-prompt' AND own = '' THEN 'none' WHEN bad THEN 'pointer' ELSE 'full' END AS fidelity, event NOT IN ('tool-use', 'tool-result') AND NOT bad AND NOT (event = 'user-prompt' AND own = '') AS eligible, CASE WHEN event <> 'user-prompt' OR own = '' THEN '' WHEN length(own) > 500 THEN substr(own, 1, 500) || '…' ELSE own END AS summary FROM said", **_TX)
def transcript_events(spark, d):
    i = F.col("id")
    event = F.when(i % 5 == 0, "tool-result").when(i % 5 == 1, "tool-use").when(i % 5 == 2, "assistant-text").otherwise("user-prompt")
    ask = F.when(i % 2 == 0, "<system-reminder>x</system-reminder> ").otherwise(F.concat(F.lit("<user_query> ask "), i.cast("string"), F.lit(" </user_query> noise")))
    body = F.when(i % 5 == 0, "tool_result ok").when(i % 5 == 3, ask).otherwise(F.concat(F.lit("plain "), F.col("content")))
    got = capture.transcript_event(event, body, F.when(i % 2 == 0, "grep").otherwise(""), i % 11 == 0)
    return memories(spark, d).select("id", got.alias("g")).select("id", "g.*")


@query("SELECT id, CASE WHEN x = '' AND y = '' THEN 1.0::DOUBLE WHEN x = '' OR y = '' THEN 0.0 ELSE 1.0 END AS sim FROM (SELECT id, CASE id % 3 WHEN 0 THEN '' ELSE kind END AS x, CASE id % 5 WHEN 0 THEN ' ' ELSE kind END AS y0, trim(CASE id % 5 WHEN 0 THEN ' ' ELSE kind END) AS y FROM memories)")
def similarity_of_blanks(spark, d):
    i = F.col("id")
    x, y = F.when(i % 3 == 0, "").otherwise(F.col("kind")), F.when(i % 5 == 0, " ").otherwise(F.col("kind"))
    s = memories(spark, d).select("id", x.alias("x"), y.alias("y"), M.minhash("kind").alias("s"))
    return s.select("id", M.similarity(F.col("x"), F.col("y"), F.col("s"), F.col("s")).alias("sim"))


# ---- numbering and bundles -------------------------------------------------------------------------

_EV = "SELECT event_id AS ord, user_id AS source_id, 'u' || (event_id % 4000) AS event_uid FROM events"


@query(
    "SELECT ord, source_id, event_uid, 1 + source_id % 2 AS generation, source_id % 4 + row_number() OVER (PARTITION BY source_id ORDER BY ord) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY ord) AS n FROM ev WHERE event_uid NOT IN (SELECT event_uid FROM ev WHERE ord % 50 = 7)) WHERE n = 1",
    ev=_EV,
)
def captured_numbers(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("source_id"), _txt("u", F.col("event_id") % 4000).alias("event_uid"))
    s = e.select("source_id").distinct().select("source_id", (F.col("source_id") % 2 + 1).alias("generation"), (F.col("source_id") % 4).alias("last_seq"))
    return capture.capture_batch(s, e.where("ord % 50 = 7").select("event_uid"), e).select("ord", "source_id", "event_uid", "generation", "seq")


_ARRIVED = "SELECT ord, source_id, CASE WHEN ord % 71 = 0 THEN 2 ELSE 1 END AS generation, source_id % 3 + sum((ord % 53 <> 0 AND ord % 71 <> 0)::INT) OVER (PARTITION BY source_id ORDER BY ord) + CASE WHEN ord % 53 = 0 THEN 2 ELSE 0 END AS seq, CASE WHEN ord % 71 = 0 THEN 'generation' WHEN ord % 53 = 0 THEN 'gap' ELSE 'accepted' END AS state FROM ev"


@query("SELECT ord, source_id, generation, seq::BIGINT AS seq, state FROM arrived", ev=_EV, arrived=_ARRIVED)
def arrival_order(spark, d):
    o = F.col("ord")
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("source_id"))
    good = ((o % 53 != 0) & (o % 71 != 0)).cast("int")
    w = Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    a = e.select("ord", "source_id", F.when(o % 71 == 0, 2).otherwise(1).alias("generation"), (F.col("source_id") % 3 + F.sum(good).over(w) + F.when(o % 53 == 0, 2).otherwise(0)).cast("bigint").alias("seq"))
    s = e.select("source_id").distinct().select("source_id", F.lit(1).alias("generation"), (F.col("source_id") % 3).alias("last_seq"))
    return capture.arrivals(a, s)


_BUNDLES = {
    "rows_of": "SELECT event_id AS id, user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, 'u' || event_id AS event_uid, 'a' || (event_id % 23) AS archive_hash FROM events",
    "obs_of": "SELECT id, source_id, 1 AS generation, rn + CASE WHEN rn > 30 AND source_id % 4 = 1 THEN 1 ELSE 0 END AS seq, event_uid, archive_hash FROM rows_of",
    "archived": "SELECT DISTINCT archive_hash, substr(archive_hash, 2)::BIGINT * 200 AS byte_size FROM rows_of WHERE archive_hash <> 'a5'",
    "sources": "SELECT source_id, 1 AS generation, CASE WHEN source_id % 5 = 0 THEN 'idle' ELSE 'active' END AS status, max(seq) AS last_seq, source_id % 3 AS cursor_seq, 't' || source_id AS source_tip, 1000 - source_id % 17 AS created_at FROM obs_of GROUP BY source_id",
    "waiting": "SELECT * FROM sources WHERE status = 'active' AND last_seq > cursor_seq ORDER BY created_at, source_id LIMIT 8",
    "ahead": "SELECT o.*, w.cursor_seq, coalesce(a.byte_size, 0) AS bytes, row_number() OVER x AS pos, sum(coalesce(a.byte_size, 0)) OVER x AS total FROM obs_of o JOIN waiting w USING (source_id) LEFT JOIN archived a USING (archive_hash) WHERE o.seq > w.cursor_seq WINDOW x AS (PARTITION BY source_id ORDER BY o.seq ROWS UNBOUNDED PRECEDING)",
    "taken": "SELECT * FROM ahead WHERE seq - cursor_seq = pos AND pos <= 50 AND (total <= 65536 OR pos = 1)",
    "built": "SELECT 'bnd_' || substr(sha256(source_id || '|1|' || any_value(cursor_seq) || '|' || max(seq)), 1, 24) AS id, source_id, 1 AS generation, any_value(cursor_seq) AS after, max(seq) AS to_seq, count(*) AS n, sha256(string_agg(id || '|' || event_uid || '|' || seq || chr(10), '' ORDER BY seq)) AS evidence_hash FROM taken GROUP BY source_id",
}


def _bundle_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = F.col("source_id")
    o = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), rn.alias("rn"), _txt("u", F.col("event_id")).alias("event_uid"), _txt("a", F.col("event_id") % 23).alias("archive_hash"))
    o = o.select("id", "source_id", F.lit(1).alias("generation"), (F.col("rn") + F.when((F.col("rn") > 30) & (s % 4 == 1), 1).otherwise(0)).cast("bigint").alias("seq"), "event_uid", "archive_hash")
    a = o.select("archive_hash").distinct().where("archive_hash <> 'a5'").withColumn("byte_size", F.substring("archive_hash", 2, 9).cast("bigint") * 200)
    src = o.groupBy("source_id").agg(F.max("seq").alias("last_seq")).select("source_id", F.lit(1).alias("generation"), F.when(s % 5 == 0, "idle").otherwise("active").alias("status"), "last_seq", (s % 3).alias("cursor_seq"), _txt("t", s).alias("source_tip"), (F.lit(1000) - s % 17).alias("created_at"))
    return src, o, a


@query("SELECT id, source_id, generation, after, to_seq, n, evidence_hash FROM built", **_BUNDLES)
def next_evidence_bundles(spark, d):
    return capture.next_bundles(*_bundle_inputs(spark, d))[0]


@query("SELECT b.id AS bundle_id, t.pos::INTEGER AS ordinal, t.id::VARCHAR AS id, t.event_uid FROM taken t JOIN built b USING (source_id)", **_BUNDLES)
def bundle_items(spark, d):
    return capture.next_bundles(*_bundle_inputs(spark, d))[1]


@query("SELECT s.source_id, coalesce(b.to_seq, s.cursor_seq) AS cursor_seq FROM sources s LEFT JOIN built b USING (source_id)", **_BUNDLES)
def bundle_cursors(spark, d):
    return capture.next_bundles(*_bundle_inputs(spark, d))[2].select("source_id", "cursor_seq")


@query("SELECT source_id, CASE WHEN r THEN 2 ELSE 1 END AS generation, CASE WHEN r THEN 0 ELSE last_seq END AS last_seq, CASE WHEN r THEN '' ELSE source_tip END AS source_tip, CASE WHEN r THEN 'done' WHEN asked THEN 'refused' END AS rotated FROM (SELECT *, source_id % 2 = 0 AS asked, source_id % 2 = 0 AND last_seq <= c AS r FROM (SELECT *, CASE WHEN source_id % 3 = 0 THEN last_seq ELSE cursor_seq END AS c FROM sources))", **_BUNDLES)
def source_rotation(spark, d):
    s = _bundle_inputs(spark, d)[0].withColumn("cursor_seq", F.when(F.col("source_id") % 3 == 0, F.col("last_seq")).otherwise(F.col("cursor_seq")))
    return capture.rotate(s, s.where("source_id % 2 = 0")).select("source_id", "generation", "last_seq", "source_tip", "rotated")


_QUEUE = {
    "queue": f"SELECT id, CASE id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 2 THEN 'fail' WHEN 3 THEN 'ok' WHEN 4 THEN 'noop' WHEN 5 THEN 'backlog' ELSE 'leased' END AS status, id % 10 AS attempt, {NOW} + (id % 5 - 3) * 60 AS not_before, CASE WHEN id % 7 IN (1, 6) THEN {NOW} + (id % 4 - 2) * 30 ELSE 0 END AS lease_until, CASE WHEN id % 7 IN (1, 6) THEN 'w' || (id % 2) ELSE '' END AS lease_owner, CASE WHEN id % 7 = 3 THEN 'r' || id ELSE '' END AS last_run_id, created_at FROM memories",
    "claimed_ones": f"SELECT *, CASE WHEN id % 2 = 0 THEN status NOT IN ('ok', 'noop') AND not_before <= {NOW} AND (lease_until <= {NOW} OR lease_owner = '') END AS claimed FROM queue",
}


def _queue(spark, d) -> DataFrame:
    i = F.col("id")
    status = F.element_at(F.array(*map(F.lit, ("pending", "leased", "fail", "ok", "noop", "backlog", "leased"))), (i % 7 + 1).cast("int"))
    held = (i % 7).isin(1, 6)
    return memories(spark, d).select("id", status.alias("status"), (i % 10).alias("attempt"), (F.lit(NOW) + (i % 5 - 3) * 60).alias("not_before"), F.when(held, F.lit(NOW) + (i % 4 - 2) * 30).otherwise(0).alias("lease_until"), F.when(held, _txt("w", i % 2)).otherwise("").alias("lease_owner"), F.when(i % 7 == 3, _txt("r", i)).otherwise("").alias("last_run_id"), "created_at")


@query("SELECT id, status, created_at FROM queue WHERE status NOT IN ('ok', 'noop') ORDER BY created_at, id LIMIT 1", **_QUEUE)
def next_open_bundle(spark, d):
    return capture.next_open(_queue(spark, d)).select("id", "status", "created_at")


@query(f"SELECT id, CASE WHEN claimed THEN 'leased' ELSE status END AS status, CASE WHEN claimed THEN attempt + 1 ELSE attempt END AS attempt, CASE WHEN claimed THEN {NOW + 60} ELSE lease_until END AS lease_until, CASE WHEN claimed THEN 'me' ELSE lease_owner END AS lease_owner, claimed FROM claimed_ones", **_QUEUE)
def bundle_claims(spark, d):
    q = _queue(spark, d)
    return capture.claim(q, q.where("id % 2 = 0").select("id", F.lit("me").alias("owner")), NOW).select("id", "status", "attempt", "lease_until", "lease_owner", "claimed")


_RUN = "CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' WHEN 2 THEN 'backlog' ELSE 'odd' END"


@query(
    f"SELECT id, CASE WHEN f = 'done' THEN s ELSE status END AS status, CASE WHEN f <> 'done' OR f IS NULL THEN not_before WHEN s = 'fail' THEN {NOW} + 60 * least(8, greatest(1, attempt)) WHEN s = 'backlog' THEN {NOW} + 600 ELSE 0 END AS not_before, CASE WHEN f = 'done' THEN '' ELSE lease_owner END AS lease_owner, f AS finished FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL WHEN status = s AND last_run_id = 'r' || id THEN 'same' WHEN s <> 'odd' AND status = 'leased' AND lease_owner = 'w1' THEN 'done' ELSE 'lost' END AS f FROM (SELECT *, {_RUN} AS s FROM queue))",
    **_QUEUE,
)
def bundle_finishes(spark, d):
    i = F.col("id")
    run = F.when(i % 4 == 0, "ok").when(i % 4 == 1, "fail").when(i % 4 == 2, "backlog").otherwise("odd")
    q = _queue(spark, d)
    return capture.finish(q, q.where("id % 3 <> 0").select("id", F.lit("w1").alias("owner"), run.alias("status"), _txt("r", i).alias("run_id")), NOW).select("id", "status", "not_before", "lease_owner", "finished")


@query("SELECT id, CASE s WHEN 'noop' THEN 'noop' WHEN 'ok' THEN CASE WHEN e = 0 THEN 'ok' WHEN n = 0 THEN 'fail' ELSE 'partial' END WHEN 'partial' THEN CASE WHEN n = 0 AND e > 0 THEN 'fail' ELSE 'partial' END WHEN 'invalid' THEN 'invalid' WHEN 'backlog' THEN 'backlog' ELSE 'fail' END AS run, CASE s WHEN 'noop' THEN 'noop' WHEN 'ok' THEN CASE WHEN e = 0 THEN 'ok' WHEN n = 0 THEN 'fail' ELSE 'partial' END WHEN 'partial' THEN CASE WHEN n = 0 AND e > 0 THEN 'fail' ELSE 'partial' END WHEN 'backlog' THEN 'backlog' ELSE 'fail' END AS bundle, 60 * least(8, greatest(1, id % 12)) AS delay FROM (SELECT id, ['noop', 'ok', 'partial', 'invalid', 'backlog', 'error'][id % 6 + 1] AS s, id % 2 AS n, id % 5 % 2 AS e FROM memories)")
def run_outcomes(spark, d):
    i = F.col("id")
    s = F.element_at(F.array(*map(F.lit, ("noop", "ok", "partial", "invalid", "backlog", "error"))), (i % 6 + 1).cast("int"))
    return memories(spark, d).select("id", capture.classify(s, i % 2, i % 5 % 2).alias("o"), capture.retry_delay(i % 12).alias("delay")).select("id", "o.run", "o.bundle", "delay")


_RUNS = "SELECT id AS ord, id % 40 AS session_id, 'w' || (id % 8) AS window_key, ['ok', 'empty', 'fail', 'partial', 'skipped'][id % 5 + 1] AS status FROM memories"


def _runs(spark, d) -> DataFrame:
    i = F.col("id")
    s = F.element_at(F.array(*map(F.lit, ("ok", "empty", "fail", "partial", "skipped"))), (i % 5 + 1).cast("int"))
    return memories(spark, d).select(i.alias("ord"), (i % 40).alias("session_id"), _txt("w", i % 8).alias("window_key"), s.alias("status"))


@query("SELECT session_id, window_key FROM (SELECT DISTINCT session_id, window_key FROM runs) w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.session_id = w.session_id AND r.window_key = w.window_key AND status IN ('ok', 'empty') AND r.ord % 3 = 0)", runs=_RUNS)
def windows_to_distill(spark, d):
    r = _runs(spark, d)
    return capture.windows_due(r.select("session_id", "window_key").distinct(), r.where("ord % 3 = 0"))


@query("SELECT ord, session_id, window_key, status FROM keyed WHERE ord % 4 = 0 UNION ALL SELECT ord, session_id, window_key, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, window_key, CASE WHEN window_key = '' THEN ord END ORDER BY ord) AS n FROM keyed WHERE ord % 4 <> 0) k WHERE n = 1 AND (window_key = '' OR NOT EXISTS (SELECT 1 FROM keyed t WHERE t.ord % 4 = 0 AND t.window_key = k.window_key AND t.session_id = k.session_id))", runs=_RUNS, keyed="SELECT * REPLACE (CASE WHEN status IN ('ok', 'empty') THEN window_key ELSE '' END AS window_key) FROM runs")
def run_ledger(spark, d):
    r = _runs(spark, d)
    have = r.where("ord % 4 = 0").withColumn("window_key", F.when(F.col("status").isin("ok", "empty"), F.col("window_key")).otherwise(""))
    return capture.save_runs(have, r.where("ord % 4 <> 0"))


@query("SELECT session_id, count(*) AS sessions, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'skipped') AS skipped, sum(ord % 3)::BIGINT AS inserted, CASE WHEN count(*) FILTER (status = 'fail') = count(*) THEN 'fail' WHEN count(*) FILTER (status IN ('fail', 'partial')) > 0 THEN 'partial' WHEN count(*) FILTER (status = 'empty') = count(*) THEN 'empty' WHEN count(*) FILTER (status = 'skipped') = count(*) THEN 'skipped' ELSE 'ok' END AS status FROM runs GROUP BY session_id", runs=_RUNS)
def distill_roll_up(spark, d):
    return capture.roll_up(_runs(spark, d).withColumn("inserted", F.col("ord") % 3), "session_id")


@query("SELECT DISTINCT project FROM memories WHERE project <> '' AND project NOT IN (SELECT project FROM memories WHERE id % 16 = 1) AND project NOT IN (SELECT project FROM memories WHERE id % 64 = 3) AND project IN (SELECT project FROM memories WHERE id % 2 = 0)")
def cold_start_projects(spark, d):
    m = memories(spark, d)
    return capture.cold_start(m, m.where("id % 16 = 1"), m.where("id % 64 = 3"), m.where("id % 2 = 0"))


@query("SELECT session_id, max(created_at) AS newest FROM observations GROUP BY session_id ORDER BY newest, session_id LIMIT 5")
def sessions_on_start(spark, d):
    return capture.pending_sessions(observations(spark, d).groupBy("session_id").agg(F.max("created_at").alias("newest")))


#: A log of each user: errors ask for a rotation, signups issue what has come, the rest are events, numbered behind the last rotation asked for.
_ARRIVED = {
    "typed": "SELECT event_id AS ord, CASE event_type WHEN 'error' THEN 'rotate' WHEN 'signup' THEN 'issue' ELSE 'event' END AS kind, CASE WHEN event_type NOT IN ('error', 'signup') AND event_id % 3 > 0 THEN 'u' || (event_id // 2 - event_id % 7) END AS event_uid, CASE WHEN event_id % 97 = 5 THEN '' ELSE 's' || user_id END AS source_id FROM events",
    "met": "SELECT *, event_uid IS NOT NULL AND row_number() OVER (PARTITION BY event_uid ORDER BY ord) > 1 AS known, count(*) FILTER (kind = 'rotate') OVER (PARTITION BY source_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turned FROM typed",
    "placed_rows": "SELECT *, count(*) FILTER (kind = 'event' AND NOT known) OVER (PARTITION BY source_id, turned ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + (kind = 'event' AND ord % 41 = 0)::INT AS seq, turned + 1 AS generation FROM met",
    "logged": "SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS i FROM placed_rows WHERE NOT known AND source_id <> '' AND (kind <> 'event' OR seq > 0)",
    "stepped(source_id, i, ord, gen, last, cur, state)": "SELECT DISTINCT source_id, 0::BIGINT, NULL::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM logged UNION ALL SELECT l.source_id, l.i, l.ord, CASE WHEN st = 'done' THEN gen + 1 ELSE gen END, CASE WHEN st = 'done' THEN 0 WHEN st = 'accepted' THEN last + 1 ELSE last END, CASE WHEN st = 'done' THEN 0 WHEN st = 'issued' THEN l.seq ELSE cur END, st FROM (SELECT s.*, l.seq AS to_seq, CASE l.kind WHEN 'rotate' THEN CASE WHEN cur >= last THEN 'done' ELSE 'refused' END WHEN 'issue' THEN CASE WHEN l.generation = gen AND l.seq BETWEEN cur AND last THEN 'issued' ELSE 'refused' END ELSE CASE WHEN l.generation <> gen THEN 'generation' WHEN l.seq = last + 1 THEN 'accepted' ELSE 'gap' END END AS st FROM stepped s JOIN logged l ON l.source_id = s.source_id AND l.i = s.i + 1) s JOIN logged l ON l.source_id = s.source_id AND l.i = s.i + 1",
}


@query("SELECT p.ord, p.kind, p.source_id, p.generation, p.seq, CASE WHEN p.known THEN 'known' WHEN l.ord IS NULL THEN CASE WHEN p.kind = 'event' THEN 'accepted' ELSE 'refused' END ELSE s.state END AS state FROM placed_rows p LEFT JOIN logged l ON l.ord = p.ord LEFT JOIN stepped s ON s.ord = p.ord", recursive=True, **_ARRIVED)
def captured_log(spark, d):
    e, i, t = table(spark, d, "events"), F.col("event_id"), F.col("event_type")
    kind = F.when(t == "error", "rotate").when(t == "signup", "issue").otherwise("event")
    uid = F.when((kind == "event") & (i % 3 > 0), _txt("u", F.expr("event_id div 2 - event_id % 7")))
    rows = e.select(i.alias("ord"), kind.alias("kind"), uid.alias("event_uid"), F.when(i % 97 == 5, "").otherwise(_txt("s", F.col("user_id"))).alias("source_id"))
    before = Window.partitionBy("source_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("event_uid").isNotNull() & (F.row_number().over(Window.partitionBy("event_uid").orderBy("ord")) > 1)
    rows = rows.withColumns({"known": known, "turned": F.count_if(F.col("kind") == "rotate").over(before)})
    since = Window.partitionBy("source_id", "turned").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    event = F.col("kind") == "event"
    rows = rows.withColumns({"seq": F.count_if(event & ~F.col("known")).over(since) + (event & (F.col("ord") % 41 == 0)).cast("int"), "generation": F.col("turned") + 1})
    return arrival.captured_batch(rows.select("ord", "kind", "event_uid", "source_id", "generation", "seq")).drop("event_uid")
