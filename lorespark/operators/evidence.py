"""Capture, ledgers and promotion: sequence checks, exactly-once, bundles, grades, the commit matrix, provenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, BUNDLE_ROWS, BUNDLE_BYTES = 10, 50, 64 * 1024


def first_written(rows: DataFrame, order: str, *keys: list[str]) -> DataFrame:
    """Rows that repeat none written before them, by each key in turn; the first by ``order`` stays. A key with a null or blank column is no key."""
    for key in keys:
        blank = F.lit(False)
        for c in key:
            blank = blank | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
        same = [*key, F.when(blank, F.col(order))]
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(order))).where("_n = 1").drop("_n")
    return rows


def exactly_once(events: DataFrame) -> DataFrame:
    """First write wins, by event_uid and then by (source_id, generation, seq). A blank uid is none; a blank source or a number below 1 is no place. events: those and ord."""
    numbered = events.withColumn("_at", F.when(F.col("seq") > 0, F.col("seq")))
    return first_written(numbered, "ord", ["event_uid"], ["source_id", "generation", "_at"]).drop("_at")


def lookup(wanted: DataFrame, ledger: DataFrame, *take: str) -> DataFrame:
    """``wanted`` with the ``take`` columns of the ledger row of its event_uid, else of its (source_id, generation, seq); null without either. A ledger holds each key once."""
    place = ["source_id", "generation", "seq"]
    by_uid = ledger.where("event_uid <> ''").select("event_uid", F.struct(*take).alias("_u"))
    by_place = ledger.select(*place, F.struct(*take).alias("_p"))
    j = wanted.join(by_uid, "event_uid", "left").join(by_place, place, "left").withColumn("_r", F.coalesce("_u", "_p"))
    return j.select(*wanted.columns, *[F.col(f"_r.{c}").alias(f"found_{c}") for c in take])


def sequence_check(events: DataFrame) -> DataFrame:
    """state per event: accepted while numbers follow without a gap from 1, else gap: nothing after a gap is let in."""
    w = Window.partitionBy("source_id", "generation").orderBy("seq")
    return events.withColumn("state", F.when(F.col("seq") == F.row_number().over(w), "accepted").otherwise("gap"))


def bundles(events: DataFrame, rows: int = BUNDLE_ROWS, size: int = BUNDLE_BYTES) -> DataFrame:
    """The next bundle of each source: a contiguous run from its cursor, at most ``rows`` long and ``size`` bytes, one row at least.

    events: source_id, seq, cursor (last issued), bytes. A window and running sums; a source is one ordered log.
    """
    w = Window.partitionBy("source_id").orderBy("seq")
    e = events.where(F.col("seq") > F.col("cursor")).withColumn("at", F.row_number().over(w)).withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.where((F.col("seq") - F.col("cursor") == F.col("at")) & (F.col("at") <= rows) & ((F.col("total") <= size) | (F.col("at") == 1)))
    return e.groupBy("source_id").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def hash_chain(events: DataFrame) -> DataFrame:
    """(source_id, tip): sha256 over previous tip, uid, archive and seq, one line each, along the source's order."""
    row = F.array_sort(F.collect_list(F.struct("seq", "event_uid", "archive")))
    step = lambda tip, e: F.sha2(F.concat_ws("\n", tip, e["event_uid"], e["archive"], e["seq"].cast("string")), 256)
    return events.groupBy("source_id").agg(F.aggregate(row, F.lit(""), step).alias("tip"))


def claims(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, ts) of granted claims: one if no claim was granted within ``seconds`` before; refused ones do not extend the window.

    Equal times of a key are one first. What is left of a key is an ordered log and is walked once, by binary search from grant to grant.
    """
    typ = events.schema["key"].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf.ts.to_numpy())
        at, got = 0, []
        while at < len(t):
            got.append(t[at])
            at = int(np.searchsorted(t, t[at] + seconds, side="right"))
        return pd.DataFrame({"key": [pdf.key.iloc[0]] * len(got), "ts": got})

    return events.select("key", "ts").distinct().groupBy("key").applyInPandas(walk, f"key {typ}, ts bigint")


def grade(uid: Column, archive: Column) -> Column:
    have = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return F.when(have(uid) & have(archive), "A").when(have(uid) | have(archive), "B").otherwise("C")


def canonical_role(c: Column) -> Column:
    """direct, error or resolution; whatever else is context."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(low.isin("direct", "error", "resolution"), low).otherwise("context")


def _lines(items: DataFrame) -> tuple[DataFrame, Column]:
    i = items.withColumn("role", canonical_role(F.col("role"))).withColumn("grade", grade(F.col("event_uid"), F.col("archive")))
    return i, F.concat_ws("|", "event_uid", "evidence_id", "archive", "grade", "role", F.col("seq").cast("string"))


def _hash_of(line: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(line, F.lit("\n")))), ""), 256)


def set_hash(items: DataFrame) -> DataFrame:
    """(candidate_id, evidence_hash): SHA-256 over a candidate's evidence, a line each, in order."""
    i, line = _lines(items)
    return i.groupBy("candidate_id").agg(_hash_of(line).alias("evidence_hash"))


def key_of(candidate: Column, revision: Column, action: Column, evidence_hash: Column) -> Column:
    """The idempotency key of a decision."""
    return F.sha2(F.concat_ws("|", candidate.cast("string"), revision.cast("string"), action, evidence_hash), 256)


def commit_matrix(cand: DataFrame, items: DataFrame) -> DataFrame:
    """(id, action, reasons, evidence_hash, idempotency_key) of every candidate.

    cand: id, revision, kind, scope, project, task_state and, if there is one, review_class. items: candidate_id, event_uid, evidence_id, archive, role, seq. Links of unknown roles are context.
    """
    i, line = _lines(items)
    strong = F.col("grade").isin("A", "B")
    any_ = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    e = i.groupBy(F.col("candidate_id").alias("id")).agg(
        any_((F.col("role") == "direct") & (F.col("grade") == "A") & (F.trim("event_uid") != "")).alias("direct_a"), any_(F.col("role") == "direct").alias("direct"),
        any_(F.col("role") == "error").alias("error"), any_(F.col("role") == "resolution").alias("resolution"), any_((F.col("role") == "error") & strong).alias("error_b"),
        any_((F.col("role") == "resolution") & strong).alias("resolution_b"), F.count("*").alias("n"), _hash_of(line).alias("evidence_hash"),
    )
    c = cand.join(e, "id", "left")
    no = lambda x: ~F.coalesce(F.col(x), F.lit(False))
    kind, scope, state = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in ("kind", "scope", "task_state"))
    review = F.lower(F.trim(F.coalesce("review_class", F.lit("")))) if "review_class" in cand.columns else F.lit("")
    decide = (
        F.when((kind == "conflict") | (scope == "conflict") | (review == "conflict"), "conflict:conflict")
        .when(kind.isin("decision", "preference", "rule"), "human_accept:manual_kind")
        .when(scope == "global", "human_accept:global_scope")
        .when(scope == "cross_project", "human_accept:cross_project_scope")
        .when((kind == "fact") & (F.trim("project") == ""), "human_accept:project_missing")
        .when((kind == "fact") & ~no("direct_a"), "auto_commit:auto_eligible")
        .when((kind == "fact") & F.col("n").isNull(), "defer:missing_evidence")
        .when((kind == "fact") & no("direct"), "defer:missing_direct_evidence")
        .when(kind == "fact", "defer:grade_below_a")
        .when((kind == "pitfall") & no("error") & no("resolution"), "defer:pitfall_missing_error,pitfall_missing_resolution")
        .when((kind == "pitfall") & no("error"), "defer:pitfall_missing_error")
        .when((kind == "pitfall") & no("resolution"), "defer:pitfall_missing_resolution")
        .when((kind == "pitfall") & (no("error_b") | no("resolution_b")), "defer:pitfall_weak_evidence")
        .when(kind == "pitfall", "auto_commit:auto_eligible")
        .when((kind == "task") & ~state.isin("done", "blocked", "next"), "defer:task_state_invalid")
        .when(kind == "task", "auto_commit:auto_eligible")
        .otherwise("human_accept:manual_kind,unknown_kind")
    )
    action, h = F.split_part(decide, F.lit(":"), F.lit(1)), F.coalesce("evidence_hash", F.sha2(F.lit(""), 256))
    key = key_of(F.col("id"), F.col("revision"), action, h)
    return c.select("id", action.alias("action"), F.split_part(decide, F.lit(":"), F.lit(2)).alias("reasons"), h.alias("evidence_hash"), key.alias("idempotency_key"))


def provenance(links: DataFrame) -> DataFrame:
    """(memory_id, line): how many pieces of evidence, the strongest grade and a token of the first; at most 40 characters.

    A piece is told by its event_uid, else its archive, else its locator; one with none of these counts for itself. The first is the earliest (occurred_at, seq, event_uid) that has
    a token: the same name without evt_ and ev_, cut to 8 characters. links: memory_id, link_id, event_uid, archive, locator, grade, occurred_at, seq.
    """
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    key = F.coalesce(F.concat(F.lit("e:"), said("event_uid")), F.concat(F.lit("a:"), said("archive")), F.concat(F.lit("r:"), said("locator")), F.concat(F.lit("idx:"), F.col("link_id").cast("string")))
    bare = lambda c: F.when(F.regexp_replace(F.trim(c), "^(evt_)?(ev_)?", "") != "", F.substring(F.regexp_replace(F.trim(c), "^(evt_)?(ev_)?", ""), 1, 8))
    token = F.coalesce(bare("event_uid"), bare("archive"), bare("locator"))
    at = F.struct("occurred_at", "seq", F.coalesce("event_uid", F.lit("")), "link_id")
    g = F.when(F.col("grade").isin("A", "B"), F.col("grade")).otherwise("C")
    one = links.select("memory_id", key.alias("key"), at.alias("at"), token.alias("token"), g.alias("grade"))
    # a piece counts by its first link
    one = one.groupBy("memory_id", "key").agg(F.min(F.struct("at", "token", "grade")).alias("m")).select("memory_id", "m.*")
    a = one.groupBy("memory_id").agg(F.count("*").alias("n"), F.min("grade").alias("g"), F.min(F.when(F.col("token").isNotNull(), F.struct("at", "token"))).alias("f"))
    more = F.when(F.col("n") > 1, F.concat(F.lit("+"), (F.col("n") - 1).cast("string"))).otherwise("")
    line = F.concat(F.lit("证据"), F.col("n").cast("string"), F.lit("条·"), F.col("g"), F.lit("级"), F.coalesce(F.concat(F.lit("·"), F.col("f.token"), more), F.lit("")))
    return a.select("memory_id", F.substring(line, 1, 40).alias("line"))


def sessions_due(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Sessions with an observation newer than their last finished run. obs: session_id, created_at; runs: session_id, finished_at, status."""
    last = runs.where("status = 'ok'").groupBy("session_id").agg(F.max("finished_at").alias("done"))
    return obs.groupBy("session_id").agg(F.max("created_at").alias("newest"), F.count("*").alias("n")).join(last, "session_id", "left").where("newest > coalesce(done, 0)").select("session_id", "newest", "n")
