"""Capture of events: their text, fidelity and eligibility, sequence numbers, sources and bundles, queues, run outcomes and the ledger of finished windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from .evidence import BUNDLE_BYTES, BUNDLE_ROWS, bundles
from .extraction import distill_speaker, eligible, one_json, windows_due  # noqa: F401  (a ledger function here too)

RAW_CHARS, SUMMARY_CHARS, SOURCES, ATTEMPTS, DELAY, BACKLOG_DELAY, LEASE = 2000, 500, 8, 8, 60, 600, 60
OPEN, CLOSED = ("pending", "leased", "fail", "partial", "backlog"), ("ok", "noop", "quarantined")
RESIDUE = ["\\{\"(id|parentId|callId|type)\"", "^\\s*(Grep|Shell|Read|Bash|Edit|Write|Glob|WebFetch|TodoWrite|MultiEdit)\\s*\\{"]


def fidelity(raw: Column) -> Column:
    """full if there is any text, else none."""
    return F.when(T.strip(F.coalesce(raw, F.lit(""))) != "", "full").otherwise("none")


def residue(content: Column) -> Column:
    """Whether a candidate's text is a tool's payload or a transcript's JSON that was taken for a fact."""
    return F.coalesce(content.rlike(RESIDUE[0]) | content.rlike(RESIDUE[1]), F.lit(False))


def distill_eligible(meta: Column, event: Column) -> Column:
    """Whether a stored observation may be distilled: by its meta JSON; a row that does not say so counts unless its event has no speaker."""
    said = F.get_json_object(meta, "$.proposal_eligible")
    ok = F.when(said.isNotNull(), said == "true").otherwise(distill_speaker(event) != "")
    return eligible(ok, F.get_json_object(meta, "$.fidelity"))


def observation_text(event: Column, tool: Column, tool_input: Column, tool_output: Column, last_message: Column, content: Column, status: Column, reason: Column, host: Column) -> Column:
    """(text, fidelity) of a host's event: a tool call with what went in and out; a stop with its reply (not from a host that sends none), else its status and reason; else its name."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    # a JSON string is the text that it says
    plain = lambda c: F.when(t(c) == "null", "").when(t(c).rlike('(?s)^".*"$'), F.coalesce(F.try_variant_get(one_json(t(c)), "$", "string"), c)).otherwise(c)
    raw = lambda c: F.substring(T.scrub(t(plain(c))), 1, RAW_CHARS)
    into, out = raw(tool_input), raw(tool_output)
    name = F.when(t(tool) == "", "tool").otherwise(t(tool))
    call = F.concat(F.lit("tool:"), name, F.when(into != "", F.concat(F.lit("\n"), into)).otherwise(""), F.when(out != "", F.concat(F.lit("\n→ "), out)).otherwise(""))
    reply = F.when(F.lower(t(host)) == "claude", "").otherwise(F.coalesce(F.when(t(last_message) != "", t(last_message)), t(content)))
    meta = F.concat_ws(" ", F.when(t(status) != "", F.concat(F.lit("status="), t(status))), F.when(t(reason) != "", F.concat(F.lit("reason="), t(reason))))
    stop, use = event.isin("stop", "session-end"), event == "post-tool-use"
    text = F.when(use, call).when(stop, F.when(reply != "", reply).otherwise(meta)).otherwise(event)
    fid = F.when(use, F.when((into != "") | (out != ""), "full").otherwise("summary")).when(stop, F.when(reply != "", "full").when(meta != "", "summary").otherwise("none")).otherwise("none")
    clean = T.strip(T.scrub(text))
    return F.struct(F.when(F.length(clean) > RAW_CHARS, F.concat(F.substring(clean, 1, RAW_CHARS), F.lit("…"))).otherwise(clean).alias("text"), fid.alias("fidelity"))


def transcript_event(event: Column, text: Column, tool: Column, unparsed: Column) -> Column:
    """(text, fidelity, eligible, summary) of a transcript record. Tool calls and lines nobody could parse give no facts; a prompt that is injected context alone has no text at all, any
    other is summed up by the user's own words."""
    named = F.when((event == "tool-result") & (F.trim(F.coalesce(tool, F.lit(""))) != ""), F.concat(F.lit("tool_result:"), F.trim(tool), F.regexp_replace(text, "^tool_result", ""))).otherwise(text)
    clean = T.strip(T.scrub(F.coalesce(named, F.lit(""))))
    clean = F.when(F.length(clean) > RAW_CHARS, F.concat(F.substring(clean, 1, RAW_CHARS), F.lit("…"))).otherwise(clean)
    said = T.user_query_text(clean)
    prompt = event == "user-prompt"
    empty = prompt & (T.strip(said) == "")
    fid = F.when(empty, "none").when(unparsed, "pointer").otherwise("full")
    ok = ~event.isin("tool-use", "tool-result") & ~unparsed & ~empty
    own = T.strip(said)
    cut = F.when(F.length(own) > SUMMARY_CHARS, F.concat(F.substring(own, 1, SUMMARY_CHARS), F.lit("…"))).otherwise(own)
    return F.struct(clean.alias("text"), fid.alias("fidelity"), ok.alias("eligible"), F.when(prompt & ~empty, cut).otherwise("").alias("summary"))


def capture_batch(sources: DataFrame, known: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` (ord, source_id, event_uid) that are new, with generation and seq: the numbers after their source's last, in order of ord. What ``known`` (event_uid) holds or the batch
    repeats is left out. sources: source_id, generation, last_seq; an unknown source begins generation 1 at 0."""
    first = Window.partitionBy("event_uid").orderBy("ord")
    fresh = events.join(known.select("event_uid").distinct(), "event_uid", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    j = fresh.join(sources.select("source_id", "generation", "last_seq"), "source_id", "left")
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))
    return j.withColumn("generation", F.coalesce("generation", F.lit(1))).withColumn("seq", F.coalesce("last_seq", F.lit(0)) + n).drop("last_seq")


def arrivals(events: DataFrame, sources: DataFrame) -> DataFrame:
    """``events`` (ord, source_id, generation, seq) with state, in order of arrival: accepted if the number follows the last accepted one, generation if it is not the source's, else gap.

    A source is one ordered log, walked once. sources: source_id, generation, last_seq.
    """
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        last, state = int(pdf["_last"].iloc[0]), []
        for same, n in zip(pdf["_same"], pdf["seq"], strict=True):
            state.append("generation" if not same else "accepted" if n == last + 1 else "gap")
            last += state[-1] == "accepted"
        return pdf.drop(columns=["_last", "_same"]).assign(state=state)

    s = sources.select("source_id", F.col("generation").alias("_g"), F.col("last_seq").alias("_last"))
    j = events.join(s, "source_id", "left").withColumn("_same", F.col("generation") == F.coalesce("_g", F.lit(1))).withColumn("_last", F.coalesce("_last", F.lit(0)).cast("bigint")).drop("_g")
    return j.select(*events.columns, "_last", "_same").groupBy("source_id").applyInPandas(walk, ", ".join([*names, "state string"]))


def backlog(sources: DataFrame, n: int = SOURCES) -> DataFrame:
    """The oldest ``n`` active sources with numbers that no bundle holds. sources: source_id, status, last_seq, cursor_seq, created_at."""
    return sources.where((F.col("status") == "active") & (F.col("last_seq") > F.col("cursor_seq"))).orderBy("created_at", "source_id").limit(n)


def next_bundles(sources: DataFrame, observations: DataFrame, archives: DataFrame, rows: int = BUNDLE_ROWS, size: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next bundle of each of the oldest backlogged sources (id, source_id, generation, after, to_seq, n, evidence_hash), its items (bundle_id, ordinal, id, event_uid), and sources
    with their cursors moved. observations: id, source_id, generation, seq, event_uid, archive_hash; archives: archive_hash, byte_size (absent: 0)."""
    b = backlog(sources).select("source_id", "generation", F.col("cursor_seq").alias("cursor"))
    o = observations.join(b, ["source_id", "generation"]).join(archives, "archive_hash", "left").withColumn("bytes", F.coalesce("byte_size", F.lit(0)))
    w = bundles(o.select("source_id", "seq", "cursor", "bytes"), rows, size).select("source_id", "from_seq", "to_seq", "n")
    inside = o.join(w, "source_id").where(F.col("seq").between(F.col("from_seq"), F.col("to_seq")))
    per = inside.groupBy("source_id", "generation", F.col("cursor").alias("after"), "to_seq", "n").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("id").cast("string").alias("id"), "event_uid"))).alias("items"))
    per = per.withColumn("id", I.bundle_id(F.col("source_id"), F.col("generation"), F.col("after"), F.col("to_seq")))
    out = per.select("id", "source_id", "generation", "after", "to_seq", "n", I.bundle_hash(F.col("items")).alias("evidence_hash"))
    items = per.select(F.col("id").alias("bundle_id"), F.posexplode("items").alias("p", "x")).select("bundle_id", (F.col("p") + 1).alias("ordinal"), "x.id", "x.event_uid")
    moved = sources.join(out.select("source_id", F.col("to_seq").alias("_to")), "source_id", "left").withColumn("cursor_seq", F.coalesce("_to", "cursor_seq")).drop("_to")
    return out, items, moved


def rotate(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Sources after rotating those in ``asked`` (source_id) to their next generation, and rotated: done, refused (numbers are left that no bundle holds) or null."""
    j = sources.join(asked.select("source_id", F.lit(True).alias("_a")).distinct(), "source_id", "left")
    done = F.coalesce("_a", F.lit(False)) & (F.col("cursor_seq") >= F.col("last_seq"))
    zero = {"generation": F.col("generation") + 1, "last_seq": F.lit(0), "cursor_seq": F.lit(0), "source_tip": F.lit("")}
    cols = [F.when(done, zero[c]).otherwise(F.col(c)).alias(c) if c in zero else F.col(c) for c in sources.columns]
    return j.select(*cols, F.when(done, "done").when(F.col("_a"), "refused").alias("rotated"))


def next_open(bundle: DataFrame) -> DataFrame:
    """The oldest bundle that is not finished; those behind it wait. bundle: id, status, created_at."""
    return bundle.where(F.col("status").isin(*OPEN)).orderBy("created_at", "id").limit(1)


def claim(bundle: DataFrame, asked: DataFrame, now: int, ttl: int = LEASE) -> DataFrame:
    """Bundles after ``asked`` (id, owner): one that is open, due, and whose lease is over or nobody's is leased and counts an attempt. claimed tells (null: not asked for)."""
    first = asked.groupBy("id").agg(F.min("owner").alias("_o"))
    j = bundle.join(first, "id", "left")
    ok = F.col("_o").isNotNull() & F.col("status").isin(*OPEN) & (F.col("not_before") <= now) & ((F.col("lease_until") <= now) | (F.col("lease_owner") == ""))
    new = {"status": F.lit("leased"), "lease_until": F.lit(now + max(1, ttl)), "lease_owner": F.when(F.col("_o") == "", "proposal").otherwise(F.col("_o")), "attempt": F.col("attempt") + 1}
    return j.select(*[F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in bundle.columns], F.when(F.col("_o").isNotNull(), ok).alias("claimed"))


def retry_delay(attempt: Column, base: int = DELAY) -> Column:
    """Seconds until the next try: the base times the attempt, at least once and at most ATTEMPTS times."""
    return F.lit(base) * F.least(F.lit(ATTEMPTS), F.greatest(F.lit(1), attempt))


def classify(status: Column, inserted: Column, errors: Column) -> Column:
    """(run, bundle) outcome of an execution by its status, what was inserted, and how many inserts failed."""
    both = lambda a, b: F.struct(F.lit(a).alias("run"), F.lit(b).alias("bundle"))
    return (
        F.when(status == "noop", both("noop", "noop"))
        .when((status == "ok") & (errors == 0), both("ok", "ok"))
        .when((status.isin("ok", "partial")) & (inserted == 0) & (errors > 0), both("fail", "fail"))
        .when(status.isin("ok", "partial"), both("partial", "partial"))
        .when(status == "invalid", both("invalid", "fail"))
        .when(status == "backlog", both("backlog", "backlog"))
        .otherwise(both("fail", "fail"))
    )


def finish(bundle: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Bundles after ``runs`` (id, owner, status, run_id): the owner of a lease ends it; a failed or partial one waits for its retry delay, a backlog for BACKLOG_DELAY. finished: done, same
    (that run has ended it so before), lost (the lease is another's) or null."""
    r = runs.select("id", F.col("owner").alias("_o"), F.col("status").alias("_s"), F.col("run_id").alias("_r"))
    j = bundle.join(r, "id", "left")
    known = F.col("_s").isin("ok", "noop", "fail", "partial", "backlog")
    same = (F.col("status") == F.col("_s")) & (F.col("last_run_id") == F.col("_r")) & (F.col("_r") != "")
    ok = known & ~same & (F.col("status") == "leased") & (F.col("lease_owner") == F.col("_o"))
    ok = F.coalesce(ok, F.lit(False))
    wait = F.when(F.col("_s").isin("fail", "partial"), now + retry_delay(F.col("attempt"))).when(F.col("_s") == "backlog", now + BACKLOG_DELAY).otherwise(0)
    new = {"status": F.col("_s"), "not_before": wait, "lease_until": F.lit(0), "lease_owner": F.lit(""), "last_run_id": F.col("_r")}
    told = F.when(F.col("_s").isNull(), F.lit(None).cast("string")).when(same, "same").when(ok, "done").otherwise("lost")
    return j.select(*[F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in bundle.columns], told.alias("finished"))


def save_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger with ``runs`` (ord, session_id, window_key, status, ...): one that did not end ok or empty is kept without its window; of several for one window the first stays."""
    key = F.when(F.col("status").isin("ok", "empty"), F.col("window_key")).otherwise("")
    new = runs.withColumn("window_key", key)
    taken = ledger.where("window_key <> ''").select("session_id", "window_key").distinct().withColumn("_t", F.lit(True))
    w = Window.partitionBy("session_id", "window_key", F.when(F.col("window_key") == "", F.col("ord"))).orderBy("ord")
    new = new.join(taken, ["session_id", "window_key"], "left").withColumn("_n", F.row_number().over(w)).where("_t is null and _n = 1")
    return ledger.unionByName(new.select(*ledger.columns))


def roll_up(reports: DataFrame, *by: str) -> DataFrame:
    """(status, sessions, failed, partial, empty, skipped, inserted) of reports (status, inserted): fail, empty and skipped if all are; partial if any failed or was partial; else ok."""
    n = lambda s: F.count_if(F.col("status") == s)
    a = reports.groupBy(*by).agg(F.count("*").alias("sessions"), n("fail").alias("failed"), n("partial").alias("partial"), n("empty").alias("empty"), n("skipped").alias("skipped"), F.sum("inserted").alias("inserted"))
    all_ = lambda c: (F.col(c) == F.col("sessions")) & (F.col(c) > 0)
    return a.withColumn("status", F.when(all_("failed"), "fail").when((F.col("failed") > 0) | (F.col("partial") > 0), "partial").when(all_("empty"), "empty").when(all_("skipped"), "skipped").otherwise("ok"))


def cold_start(projects: DataFrame, library: DataFrame, seen: DataFrame, due: DataFrame) -> DataFrame:
    """Projects to distil for the first time: they have no memory, no marker, and a session that is due. Each: project."""
    out = projects.select("project").where("project <> ''").distinct()
    for other, how in ((library, "left_anti"), (seen, "left_anti"), (due, "left_semi")):
        out = out.join(other.select("project").distinct(), "project", how)
    return out


def pending_sessions(due: DataFrame, n: int = 5) -> DataFrame:
    """The few sessions that a session's start distils on its way: the longest waiting. due: session_id, newest."""
    return due.orderBy("newest", "session_id").limit(n)
