"""Promotion of candidates: inserting them once, loading their evidence, accepting, rejecting and deciding by policy, and feedback on what was supplied.

A batch holds at most one request per candidate; a request's revision (-1: any) must be the candidate's. Replays change nothing but what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import minhash as M
from ..functions import text as T
from ..plans.scratch import written
from .evidence import commit_matrix, grade, key_of, provenance, set_hash
from .exchange import channel

KINDS = ("preference", "decision", "pitfall", "task", "fact")
AGENT, IMPORT = ("llm", "distill", "distill-accept", "harness-summary"), ("ingest", "import", "import-proposal")


def default_channel(explicit: Column, source: Column) -> Column:
    """The given channel, else by source: agent for distilled text, import for files, user for the rest."""
    said = channel(explicit)
    return F.when(said != "", said).when(source.isin(*AGENT), "agent").when(source.isin(*IMPORT), "import").otherwise("user")


def observation_channel(event: Column, explicit: Column) -> Column:
    """The given channel, else tool for tool calls, user for prompts, agent for the rest."""
    said = channel(explicit)
    return F.when(said != "", said).when(F.trim(event) == "post-tool-use", "tool").when(F.trim(event) == "user-prompt", "user").otherwise("agent")


def attributed(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("user", "assistant"), low).otherwise("")


def insert_candidates(cands: DataFrame, new: DataFrame) -> DataFrame:
    """(ord, state, id): created, merged (a pending or accepted candidate of the session has the content; id is its), or invalid (blank content, unknown kind).

    cands: id, session_id, content_hash, status, created_at. new: ord, id (of a new one), session_id, kind, content.
    """
    n = new.withColumn("content", T.strip(F.coalesce("content", F.lit("")))).withColumn("ok", (F.col("content") != "") & F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)))
    # read twice below: written, so that each text is trimmed and hashed once
    n = written(n.select("ord", "id", "session_id", "ok", T.content_hash(F.col("content")).alias("content_hash")), "new")
    key = ["session_id", "content_hash"]
    open_ = cands.where(F.col("status").isin("pending", "accepted")).groupBy(*key).agg(F.max_by("id", F.struct("created_at", "id")).alias("have"))
    first = n.where("ok").groupBy(*key).agg(F.min(F.struct("ord", "id")).alias("f"))
    j = n.join(open_, key, "left").join(first, key, "left")
    state = F.when(~F.col("ok"), "invalid").when(F.col("have").isNull() & (F.col("f.ord") == F.col("ord")), "created").otherwise("merged")
    return j.select("ord", state.alias("state"), F.when(F.col("ok"), F.coalesce("have", "f.id")).alias("id"))


def merge_candidate_evidence(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links of candidates with new ones added, each (candidate_id, evidence_id, evidence_role) once; a link without a role is direct."""
    role = F.when(F.coalesce("evidence_role", F.lit("")) == "", "direct").otherwise(F.col("evidence_role"))
    both = links.withColumn("side", F.lit(0)).unionByName(new.withColumn("evidence_role", role).withColumn("side", F.lit(1)))
    w = Window.partitionBy("candidate_id", "evidence_id", "evidence_role").orderBy("side", "event_uid")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "side")


def merge_ids(old: Column, new: Column) -> Column:
    """Observation ids in order of first sight, blanks left out of what is added. JSON in, JSON out; malformed old ids are none."""
    ids = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_distinct(F.concat(ids(old), F.filter(ids(new), lambda x: x != ""))))


def load_evidence(links: DataFrame, observations: DataFrame) -> DataFrame:
    """A candidate's links with what the observation knows: found by evidence_id, else by event_uid; a link with neither is left out.

    links: candidate_id, evidence_id, event_uid, archive_hash, evidence_role, source_seq. observations: id, event_uid, archive_hash, raw_ref, source_seq, occurred_at_ns. Gives
    candidate_id, evidence_id, event_uid, archive, role, seq, occurred_at, locator, grade.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    text = F.col("id").cast("string")
    o = observations.select(text.alias("o_id"), F.struct(text.alias("id"), "event_uid", "archive_hash", "raw_ref", "source_seq", "occurred_at_ns").alias("o"))
    u = observations.where("event_uid <> ''").select(F.col("event_uid").alias("u_id"), F.struct(text.alias("id"), "event_uid", "archive_hash", "raw_ref", "source_seq", "occurred_at_ns").alias("u"))
    j = links.where(~(blank("evidence_id") & blank("event_uid"))).join(o, F.col("evidence_id") == F.col("o_id"), "left").join(u, F.col("event_uid") == F.col("u_id"), "left").withColumn("f", F.coalesce("o", "u"))
    own = lambda c, alt: F.when(blank(c), F.coalesce(alt, F.lit(""))).otherwise(F.col(c))
    archive = own("archive_hash", F.col("f.archive_hash"))
    seq = F.when(F.col("f.source_seq") > 0, F.col("f.source_seq")).otherwise(F.col("source_seq"))
    j = j.select("candidate_id", F.coalesce("f.id", "evidence_id").alias("evidence_id"), own("event_uid", F.col("f.event_uid")).alias("event_uid"), archive.alias("archive"), F.col("evidence_role").alias("role"), seq.alias("seq"), F.coalesce("f.occurred_at_ns", F.lit(0)).alias("occurred_at"), F.coalesce("f.raw_ref", F.lit("")).alias("locator"))
    made = F.when(F.col("archive") == "", "").when(F.col("seq") > 0, F.concat("archive", F.lit("#"), F.col("seq").cast("string"))).otherwise(F.col("archive"))
    return j.withColumn("locator", F.when(F.col("locator") == "", made).otherwise(F.col("locator"))).withColumn("grade", grade(F.col("event_uid"), F.col("archive")))


def judge(cands: DataFrame, requests: DataFrame, done: str) -> DataFrame:
    """Requests (id, expected) with the candidate and outcome: commit, already (it is ``done``), conflict (another revision), closed, or missing."""
    j = requests.join(cands, "id", "left")
    other = (F.col("expected") >= 0) & (F.col("expected") != F.col("revision"))
    known = F.col("status").isin(done, "pending")
    return j.withColumn("outcome", F.when(F.col("status").isNull(), "missing").when(~known, "closed").when(other, "conflict").when(F.col("status") == done, "already").otherwise("commit"))


def decisions(judged: DataFrame, items: DataFrame, action: str, actor: str = "human") -> DataFrame:
    """(candidate_id, revision, evidence_hash, action, actor, idempotency_key, memory_id) of requests that commit or replay; the key is the log's, so a replay adds no row."""
    h = set_hash(items)
    d = judged.where(F.col("outcome").isin("commit", "already")).join(h.withColumnRenamed("candidate_id", "id"), "id", "left")
    d = d.withColumn("evidence_hash", F.coalesce("evidence_hash", F.sha2(F.lit(""), 256)))
    return d.select(F.col("id").alias("candidate_id"), "revision", "evidence_hash", F.lit(action).alias("action"), F.lit(actor).alias("actor"), key_of(F.col("id"), F.col("revision"), F.lit(action), F.col("evidence_hash")).alias("idempotency_key"), "memory_id")


def append_decisions(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with decisions of new idempotency keys."""
    return log.unionByName(new.dropDuplicates(["idempotency_key"]).join(log.select("idempotency_key"), "idempotency_key", "left_anti").select(*log.columns))


def accept(cands: DataFrame, requests: DataFrame, mem: DataFrame, now: int, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """Candidates and memories after accepting ``requests`` (id, expected).

    A memory of the content and project takes the content, counts an access and an adoption for each candidate, and keeps the larger salience; else one is made. The candidate's status,
    memory and revision follow; salience outside (0, 1] is 0.5. cands: id, session_id, kind, content, content_hash, project, status, revision, salience, memory_id, decided_at.
    mem: id, content, content_hash, project, kind, salience, access_count, adopted_count, updated_at, last_seen_at, created_at, source. new_id: a Column over first (candidate) and the key.
    """
    own = F.when(F.coalesce("content_hash", F.lit("")) == "", T.content_hash(F.col("content"))).otherwise(F.col("content_hash"))
    j = judge(cands.withColumn("content_hash", own), requests, "accepted").where("outcome = 'commit'")
    salience = F.when((F.col("salience") > 0) & (F.col("salience") <= 1), F.col("salience")).otherwise(0.5)
    j = j.withColumn("salience", salience)
    key = ["content_hash", "project"]
    by = j.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max_by("content", "id").alias("n_content"), F.min_by("kind", "id").alias("n_kind"), F.max("salience").alias("n_salience"))
    m = mem.withColumn("had", F.lit(True)).join(by, key, "full_outer")
    had, hit = F.col("had").isNotNull(), F.col("n").isNotNull()
    pick = lambda new, c: F.when(hit, new).otherwise(F.col(c)).alias(c)
    after = m.select(
        F.when(had, F.col("id")).otherwise(new_id).alias("id"), pick(F.col("n_content"), "content"), *key, F.when(had, F.col("kind")).otherwise(F.col("n_kind")).alias("kind"), pick(F.greatest("salience", "n_salience"), "salience"),
        F.when(had & hit, F.col("access_count") + F.col("n")).when(hit, F.col("n") - 1).otherwise(F.col("access_count")).alias("access_count"), F.when(had & hit, F.col("adopted_count") + F.col("n")).when(hit, F.col("n")).otherwise(F.col("adopted_count")).alias("adopted_count"),
        pick(F.lit(now), "updated_at"), pick(F.lit(now), "last_seen_at"), F.when(had, F.col("created_at")).otherwise(now).alias("created_at"), pick(F.lit("distill-accept"), "source"),
    )
    to = j.select("id", *key).join(after.select(*key, F.col("id").alias("_m")), key).select("id", "_m")
    done = cands.join(to, "id", "left")
    won = F.col("_m").isNotNull()
    cand = done.select(*[F.when(won, v).otherwise(F.col(c)).alias(c) if (v := {"status": F.lit("accepted"), "decided_at": F.lit(now), "memory_id": F.col("_m"), "revision": F.col("revision") + 1}.get(c)) is not None else F.col(c) for c in cands.columns])
    return cand, after


@dataclass
class Commit:
    """outcomes of the requests; candidates, memories, links (memory_evidence), edges and the decision log behind them."""

    outcomes: DataFrame
    candidates: DataFrame
    memories: DataFrame
    links: DataFrame
    edges: DataFrame
    decisions: DataFrame


def commit(cands: DataFrame, requests: DataFrame, mem: DataFrame, items: DataFrame, links: DataFrame, edges: DataFrame, log: DataFrame, now: int, new_id: Column, action: str = "human_accept", actor: str = "human") -> Commit:
    """``accept`` with all that goes with it. A memory that takes a candidate counts it, has its origin, its time of adoption and its signature; a new one has the candidate's channel, else an agent's. Where a memory has no provenance it gets that of
    the first candidate that comes to it. Evidence, the edge to the candidate and the decision are added once.

    A request for what is accepted is a replay: it adds evidence, edge, decision and missing provenance and counts nothing; where the memory is gone it is lost, and nothing is written. mem: what ``accept`` reads, and origin_tool, channel,
    provenance, last_adopted_at; items: ``load_evidence``'s; links: memory_id, evidence_id, event_uid, archive, locator, grade, seq, occurred_at; edges: src, dst, rel; log: ``decisions``' columns.
    """
    alive = mem.select(F.col("id").alias("memory_id"), F.lit(True).alias("_alive"))
    told = judge(cands, requests, "accepted").join(alive, "memory_id", "left")
    told = told.withColumn("outcome", F.when((F.col("outcome") == "already") & F.col("_alive").isNull(), "lost").otherwise(F.col("outcome"))).drop("_alive")
    after, taken = accept(cands, requests, mem, now, new_id)
    fresh = told.where("outcome = 'commit'").select("id", *([F.col("channel").alias("said")] if "channel" in cands.columns else [F.lit("").alias("said")])).join(after.select("id", "memory_id"), "id")
    replay = told.where("outcome = 'already'").select("id", F.lit("").alias("said"), "memory_id")
    came = fresh.unionByName(replay).join(commit_provenance(cands, items), "id")
    first = came.groupBy(F.col("memory_id").alias("id")).agg(F.min_by("provenance", "id").alias("_p"))
    hit = fresh.groupBy(F.col("memory_id").alias("id")).agg(F.min_by("said", "id").alias("_said"), F.lit(True).alias("_hit"))
    own = mem.select("id", "origin_tool", "channel", "provenance", "last_adopted_at", F.lit(True).alias("_old"))
    m = taken.join(own, "id", "left").join(first, "id", "left").join(hit, "id", "left")
    blank = F.coalesce("provenance", F.lit("")) == ""
    full = m.select(
        *taken.columns, F.when(F.col("_hit"), "distill").otherwise(F.col("origin_tool")).alias("origin_tool"), F.when(F.col("_old"), F.col("channel")).otherwise(default_channel(F.col("_said"), F.lit("distill"))).alias("channel"),
        F.when(blank, F.coalesce("_p", "provenance")).otherwise(F.col("provenance")).alias("provenance"), F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_adopted_at")).alias("last_adopted_at"), M.minhash("content").alias("signature"),
    )
    handed = items.where((F.trim(F.coalesce("evidence_id", F.lit(""))) != "") | (F.trim(F.coalesce("event_uid", F.lit(""))) != "")).join(came.select(F.col("id").alias("candidate_id"), "memory_id"), "candidate_id")
    key = ["memory_id", "evidence_id"]
    w = Window.partitionBy(*key).orderBy("candidate_id", "role")
    handed = handed.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(links.select(*key), key, "left_anti").select(*links.columns)
    made = came.select(F.col("memory_id").alias("src"), F.col("id").alias("dst"), F.lit("derived_from").alias("rel")).distinct().join(edges, ["src", "dst", "rel"], "left_anti")
    decided = decisions(told.drop("memory_id").join(came.select("id", "memory_id"), "id"), items, action, actor)
    return Commit(told.select("id", "outcome"), after, full, links.unionByName(handed), edges.unionByName(made.select(*edges.columns)), append_decisions(log, decided.select(*log.columns)))


def derived(judged_after: DataFrame) -> DataFrame:
    """(src, dst, rel): accepted candidates and the memories derived from them."""
    return judged_after.where("status = 'accepted' and memory_id is not null").select(F.col("memory_id").alias("src"), F.col("id").alias("dst"), F.lit("derived_from").alias("rel")).distinct()


def accepted_links(cand: DataFrame, items: DataFrame) -> DataFrame:
    """(memory_id, evidence_id, event_uid, archive, locator, grade, seq, occurred_at) that accepted candidates hand to their memories, each (memory_id, evidence_id) once."""
    j = items.join(cand.where("status = 'accepted' and memory_id is not null").select(F.col("id").alias("candidate_id"), "memory_id"), "candidate_id")
    w = Window.partitionBy("memory_id", "evidence_id").orderBy("candidate_id", "role")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("memory_id", "evidence_id", "event_uid", "archive", "locator", "grade", "seq", "occurred_at")


def commit_provenance(cand: DataFrame, items: DataFrame) -> DataFrame:
    """(id, provenance): JSON with the compact line of a candidate's evidence, else the candidate it came from."""
    p = provenance(items.select(F.col("candidate_id").alias("memory_id"), F.col("evidence_id").alias("link_id"), "event_uid", "archive", "locator", "grade", "occurred_at", "seq"))
    own = F.concat(F.lit("candidate:"), F.substring(F.trim(F.col("id").cast("string")), 1, 8))
    return cand.select("id").join(p.withColumnRenamed("memory_id", "id"), "id", "left").select("id", F.to_json(F.struct(F.coalesce("line", own).alias("preview"), F.lit("commit").alias("source"))).alias("provenance"))


def reject(cands: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Candidates after rejecting ``requests``: pending ones of the right revision are rejected and count it up."""
    j = judge(cands, requests, "rejected").where("outcome = 'commit'").select("id", F.lit(True).alias("_r"))
    won = F.col("_r").isNotNull()
    done = cands.join(j, "id", "left")
    return done.select(*[F.when(won, v).otherwise(F.col(c)).alias(c) if (v := {"status": F.lit("rejected"), "decided_at": F.lit(now), "revision": F.col("revision") + 1}.get(c)) is not None else F.col(c) for c in cands.columns])


def auto_commit(cands: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (id, expected) for what the matrix commits by itself, and decisions on all pending candidates, so that none is judged again and again."""
    d = commit_matrix(cands.where("status = 'pending'"), items)
    rev = cands.select("id", "revision")
    asked = d.where("action = 'auto_commit'").join(rev, "id").select("id", F.col("revision").alias("expected"))
    log = d.join(rev, "id").select(F.col("id").alias("candidate_id"), "revision", "evidence_hash", "action", F.lit("auto").alias("actor"), F.split("reasons", ",").alias("reasons"), "idempotency_key")
    return asked, log


def adopt(mem: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """Memories with adoptions counted: once for each row of ``used`` (id)."""
    n = used.groupBy("id").agg(F.count("*").alias("_n"))
    hit = F.col("_n").isNotNull()
    out = mem.join(n, "id", "left").withColumn("adopted_count", F.col("adopted_count") + F.coalesce("_n", F.lit(0))).withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
    return out.withColumn("last_adopted_at", F.when(hit, F.lit(now))).withColumn("last_seen_at", F.when(hit, F.lit(now)).otherwise(F.col("last_seen_at"))).drop("_n")


def feedback(items: DataFrame, given: DataFrame, mem: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trace items and memories after feedback, and the outcome of each row of ``given`` (ord, trace_id, memory (an id or what it begins with), feedback).

    Outcomes: adopted and negative are written; same repeats what is there; flip would change it and is refused, as are unknown (another word), none and ambiguous. Only a first adoption
    counts. Of rows for one item the first by ord is taken, the others are told against it. items: trace_id, memory_id, feedback ('' for none).
    """
    g = given.withColumn("feedback", F.lower(F.trim("feedback")))
    i = items.select("trace_id", F.col("memory_id").cast("string").alias("m"), F.col("feedback").alias("was"))
    j = g.join(i, "trace_id", "left").withColumn("hit", F.coalesce(F.col("m").startswith(F.col("memory")) & (F.trim("memory") != ""), F.lit(False)))
    per = j.groupBy("ord", "trace_id", "feedback").agg(F.count_if(F.col("hit")).alias("n"), F.min(F.when(F.col("hit"), F.struct("m", "was"))).alias("x"))
    known = F.col("feedback").isin("adopted", "negative")
    per = per.select("ord", "trace_id", "feedback", F.when(~known, "unknown").when(F.col("n") == 0, "none").when(F.col("n") > 1, "ambiguous").alias("bad"), F.col("x.m").alias("m"), F.col("x.was").alias("was"))
    w = Window.partitionBy("trace_id", "m", F.col("bad").isNull()).orderBy("ord")
    lead = F.when(F.col("was") != "", F.col("was")).otherwise(F.first("feedback").over(w))
    fresh = (F.col("was") == "") & (F.row_number().over(w) == 1)
    told = per.withColumn("outcome", F.coalesce("bad", F.when(fresh, F.col("feedback")).when(F.col("feedback") == lead, "same").otherwise("flip")))
    new = told.where(F.col("outcome").isin("adopted", "negative")).select("trace_id", "m", F.col("outcome").alias("_f"))
    after = items.join(new, (items.trace_id == new.trace_id) & (items.memory_id.cast("string") == new.m), "left").select(*[F.coalesce("_f", items.feedback).alias("feedback") if c == "feedback" else items[c] for c in items.columns])
    used = told.where("outcome = 'adopted'").select("m")
    ids = mem.select("id", F.col("id").cast("string").alias("m"))
    return after, adopt(mem, used.join(ids, "m").select("id"), now), told.select("ord", "outcome", "m")


def attribution(facts: DataFrame, observations: DataFrame, speaker) -> DataFrame:
    """(fact_id, attributed_to): who said a fact by its evidence, a user before an assistant; else what the fact says of itself. facts: fact_id, obs_ids, attributed_to;
    observations: id, event; speaker: a function from the event to user, assistant or ''."""
    e = facts.select("fact_id", F.explode("obs_ids").alias("id")).join(observations.select("id", speaker(F.col("event")).alias("s")), "id").where("s <> ''")
    s = e.groupBy("fact_id").agg(F.when(F.max((F.col("s") == "user").cast("int")) == 1, "user").otherwise("assistant").alias("s"))
    return facts.join(s, "fact_id", "left").select("fact_id", F.coalesce("s", attributed(F.col("attributed_to"))).alias("attributed_to"))
