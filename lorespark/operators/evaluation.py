"""Evaluation and observability: retrieval metrics, audit summary, activity verdict, health rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import holding
from ..plans.scratch import written
from .capture import residue
from .listing import by_refs


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, n_gold, hits, recall, rr, strict): ranked: qid, hash, rank; gold: qid, prefix (of a hash). Rows of a query without hits count as empty."""
    g = gold.distinct()
    n = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    got = ranked.where(F.col("rank") <= k).join(g, "qid").where(F.col("hash").startswith(F.col("prefix")))
    rows = got.groupBy("qid").agg(F.countDistinct("rank").alias("hits"), F.min("rank").alias("first"), F.countDistinct("prefix").alias("found"))
    out = n.join(rows, "qid", "left")
    return out.select("qid", "n_gold", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("found", F.lit(0)) == F.col("n_gold")).alias("strict"))


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg((F.col("hits") == 0).cast("double")).alias("empty_rate"), F.avg(F.col("strict").cast("double")).alias("strict_all"))


def invalid_gold(gold: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, reason): queries without gold, and those of which no prefix begins a known hash."""
    g = gold.where("prefix is not null and prefix <> ''")
    hit = g.join(known.select(F.col("hash"), F.substring("hash", 1, 8).alias("k8")), F.substring("prefix", 1, 8) == F.col("k8")).where(F.col("hash").startswith(F.col("prefix"))).select("qid").distinct()
    none = gold.select("qid").distinct().join(g.select("qid").distinct(), "qid", "left_anti").withColumn("reason", F.lit("empty_gold"))
    return none.unionByName(g.select("qid").distinct().join(hit, "qid", "left_anti").withColumn("reason", F.lit("unknown_gold")))


def audit_summary(audit: DataFrame, *by: str) -> DataFrame:
    """Counters per group. Suppressed rows count in total, empty, avg_ms and with_query, and in no activity."""
    live, e = ~F.col("suppressed"), F.col("event")
    c = lambda cond: F.count_if(cond)
    other = ~e.isin("accept", "reject", "distill", "manual-add", "manual-forget", "obs-append", "post-tool-use", "stop", "session-end")
    write = e.isin("manual-add", "manual-forget")
    return audit.groupBy(*by).agg(
        F.count("*").alias("total"), c(F.col("empty")).alias("empty"), (c(F.col("empty")) / F.count("*")).alias("empty_rate"), F.avg("ms").alias("avg_ms"), c(F.trim("query") != "").alias("with_query"),
        c(F.col("suppressed")).alias("suppressed"), c(live & other).alias("retrievals"), c(live & (write | (e == "accept"))).alias("writes"), c(live & (e == "obs-append")).alias("observations"),
        c(live & (e == "distill") & (F.col("mode") == "ok")).alias("distill_ok"), c(live & (e == "distill") & (F.col("mode") == "fail")).alias("distill_fail"), c(live & (e == "accept")).alias("accepts"),
        c(live & (e == "reject")).alias("rejects"), c(live & ((write & (F.col("mode") == "create")) | (e == "accept"))).alias("creates"), c(live & write & (F.col("mode") == "overwrite")).alias("overwrites"),
    )


def audit_maps(audit: DataFrame, *by: str, of: str = "event") -> DataFrame:
    """(by, by_event): how often each event was, as a map in order of name; by another column (``of``: harness) likewise, rows without one left out."""
    n = audit.where(F.coalesce(F.col(of), F.lit("")) != "").groupBy(*by, of).agg(F.count("*").alias("n")) if of != "event" else audit.groupBy(*by, of).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(of, "n")))).alias(f"by_{of}"))


def activity_verdict(summary: DataFrame) -> DataFrame:
    """``summary`` with verdict: unused, observed_not_accepted, write_only, read_only_observed, read_only or both."""
    seen = (F.col("observations") > 0) | (F.col("distill_ok") > 0) | (F.col("distill_fail") > 0)
    idle = (F.col("writes") == 0) & (F.col("accepts") == 0)
    return summary.withColumn("verdict", F.when(F.col("total") == 0, "unused").when((F.col("retrievals") == 0) & idle & seen, "observed_not_accepted").when(F.col("retrievals") == 0, "write_only").when(idle & seen, "read_only_observed").when(F.col("writes") == 0, "read_only").otherwise("both"))


def activity(audit: DataFrame, since=None, session=None, project: str = "") -> DataFrame:
    """The rows an activity view counts: of a session, else since a time; of a project if one is named; no bench, test or pending ones."""
    out = audit if project == "" else audit.where(F.col("project") == project)
    if "source" in audit.columns:
        out = out.where(~F.coalesce(F.col("source"), F.lit("")).isin("bench", "test", "distill-pending"))
    return out.where(F.col("session_id") == session) if session is not None else out if since is None else out.where(F.col("ts") >= since)


def empty_queries(audit: DataFrame, n: int = 10) -> DataFrame:
    """Queries that found nothing, each once, in order of first sight."""
    return audit.where(F.col("empty") & (F.trim("query") != "")).groupBy("query").agg(F.min("event_id").alias("first")).orderBy("first").limit(n)


def ops_rules(audit: DataFrame, mem: DataFrame, cands: DataFrame, now: int, since: int, last_total: int | None = None, spool: int = 0, wal_bytes: int = 0, archive_bytes: int = 0) -> DataFrame:
    """(rule, value, status) of the health rules R1 to R14, PASS, WARN, FAIL or INFO.

    R1 triggers, R2 hit rate of warm projects, R3 read ms, R4 writes, R5 observations, R6 size against the last snapshot, R7 spool files, R8 most pending of a project, R9 payload residue in
    pending candidates, R10 stop ms, R11 write-ahead frames, R12 distilling, R13 injected bytes, R14 archive bytes. What is no table comes as numbers. audit: event, mode, ms, project, empty,
    inject_bytes; mem: project; cands: project, status, content, created_at. since: the window's start, in which residue counts.
    """
    e = F.col("event")
    read = e.isin("prompt-submit", "session-start")
    mean = lambda c: F.floor(F.avg(F.when(c, F.col("ms"))))
    n = lambda c: F.count_if(c)
    one = audit.agg(
        F.count("*").alias("R1"), mean(read).alias("R3"), n(e == "manual-add").alias("R4"), n(e == "obs-append").alias("R5"), mean(e == "stop").alias("R10"), n(e == "distill").alias("distills"),
        n((e == "distill") & (F.col("mode") == "fail")).alias("R12"), F.max(F.when(read | (e == "pre-compact"), F.col("inject_bytes"))).alias("R13"),
    )
    warm = hit_rate(audit, mem).where("status <> 'COLD'").agg(F.floor((F.sum("n") - F.sum("empty")) * 100 / F.sum("n")).alias("R2"))
    lib = mem.agg(F.count("*").alias("R6"))
    pending = cands.where("status = 'pending'")
    worst = pending.groupBy("project").agg(F.count("*").alias("p")).agg(F.coalesce(F.max("p"), F.lit(0)).alias("R8"))
    left = pending.agg(n(residue(F.col("content")) & (F.col("created_at") > since)).alias("R9"))
    row = one
    for other in (warm, lib, worst, left):  # one row each
        row = row.join(F.broadcast(other))
    v = lambda c: F.col(c).cast("bigint")
    level = lambda c, a, b: F.when(c.isNull(), "INFO").when(c < a, "PASS").when(c <= b, "WARN").otherwise("FAIL")
    some = lambda c, bad: F.when(c >= 1, "PASS").otherwise(bad)
    fixed = lambda x: F.lit(x).cast("bigint")
    frames = wal_bytes // 4096
    rules = [
        ("R1", v("R1"), some(v("R1"), "FAIL")), ("R2", v("R2"), F.when(v("R2").isNull(), "INFO").when(v("R2") >= 30, "PASS").when(v("R2") >= 10, "WARN").otherwise("FAIL")), ("R3", v("R3"), level(v("R3"), 50, 200)),
        ("R4", v("R4"), F.when(v("R4") >= 1, "PASS").when(v("R6") >= 20, "WARN").otherwise("INFO")), ("R5", v("R5"), some(v("R5"), "WARN")), ("R6", v("R6"), F.when(fixed(last_total).isNull(), "INFO").when(v("R6") < fixed(last_total), "WARN").otherwise("PASS")),
        ("R7", fixed(spool), level(fixed(spool), 1, 3)), ("R8", v("R8"), level(v("R8"), 6, 15)), ("R9", v("R9"), level(v("R9"), 1, 3)), ("R10", v("R10"), level(v("R10"), 1000, 3000)), ("R11", fixed(frames), level(fixed(frames), 1001, 2000)),
        ("R12", v("R12"), F.when(v("R12") > 3, "FAIL").when((v("R12") > 0) | (v("distills") == 0), "WARN").otherwise("PASS")), ("R13", v("R13"), level(v("R13"), 3601, 8000)), ("R14", fixed(archive_bytes), F.when(fixed(archive_bytes) <= 512 << 20, "PASS").otherwise("WARN")),
    ]
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), x.alias("value"), s.alias("status")) for r, x, s in rules])).alias("r")).select("r.*")


def hit_rate(audit: DataFrame, library: DataFrame, cold: int = 20) -> DataFrame:
    """(project, n, empty, rate, status): prompt hits of projects with ``cold`` memories or more; of others status is COLD. rate: whole percent."""
    p = audit.where("event = 'prompt-submit'").groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col("empty")).alias("empty"))
    size = library.groupBy("project").agg(F.count("*").alias("size"))
    rate = F.floor((F.col("n") - F.col("empty")) * 100 / F.col("n"))
    j = p.join(size, "project", "left").withColumn("rate", rate)
    return j.select("project", "n", "empty", "rate", F.when(F.coalesce("size", F.lit(0)) < cold, "COLD").when(F.col("rate") >= 30, "PASS").when(F.col("rate") >= 10, "WARN").otherwise("FAIL").alias("status"))


def library_stats(mem: DataFrame, now: int) -> DataFrame:
    """(grp, name, n): totals (live: not superseded, expired ones included), kinds and projects ('' is (global))."""
    total = mem.agg(F.count("*").alias("total"), F.count_if(F.col("superseded_by").isNull()).alias("live"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.count_if(F.col("expires_at") <= now).alias("expired"))
    total = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("grp"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in total.columns])).alias("r")).select("r.*")
    kind = mem.groupBy(F.lit("kind").alias("grp"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    project = mem.groupBy(F.lit("project").alias("grp"), F.when(F.col("project") == "", "(global)").otherwise(F.col("project")).alias("name")).agg(F.count("*").alias("n"))
    return total.unionByName(kind).unionByName(project)


def every_nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """A uniform deterministic sample of about ``n`` rows: every (count / n)-th by ``order``.

    Places are counted without moving all rows to one task: ranges of ``order`` are counted, and a row's place is its place in its range behind those before.
    """
    rows = df.count()
    step = max(1, rows // n)
    ranged = written(df.repartitionByRange(max(1, min(rows // 100_000, 10_000)), order).withColumn("_p", F.spark_partition_id()), "every-nth")
    size = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a range
    before = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    i = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_b")
    return ranged.join(F.broadcast(before), "_p").withColumn("_i", i).where(F.col("_i") % step == 0).orderBy("_i").limit(n).drop("_p", "_b", "_i")


def worst_first(results: DataFrame) -> DataFrame:
    """Results (qid, hits, n_gold) by the share of gold that was hit, least first; without gold it is 0. Ties by qid."""
    share = F.when(F.col("n_gold") == 0, 0.0).otherwise(F.col("hits") / F.col("n_gold"))
    return results.withColumn("ratio", share).orderBy("ratio", "qid")


def sweep(pairs: DataFrame, terms: DataFrame, thresholds: list[float]) -> DataFrame:
    """(k, threshold, tp, fp, fn, precision, recall, f1) of calling two terms alike from a similarity on, for each k. pairs: k, a, b, sim (pairs that are not there have 0); terms: term,
    label ('' for none). True pairs share a label."""
    t = terms.where("label <> ''")
    size = t.groupBy("label").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("bigint").alias("true_pairs"))
    n = terms.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("all_pairs"))
    a, b = (terms.select(F.col("term").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    judged = pairs.join(a, "a").join(b, "b").withColumn("same", (F.col("la") != "") & (F.col("la") == F.col("lb")))
    count = judged.select("k", "same", "sim", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("k", "threshold").agg(F.count_if(F.col("same") & (F.col("sim") >= F.col("threshold"))).alias("tp0"), F.count_if(~F.col("same") & (F.col("sim") >= F.col("threshold"))).alias("fp0"))
    one = count.join(F.broadcast(size)).join(F.broadcast(n))  # one row either
    tp = F.when(F.col("threshold") <= 0, F.col("true_pairs")).otherwise(F.col("tp0"))
    fp = F.when(F.col("threshold") <= 0, F.col("all_pairs") - F.col("true_pairs")).otherwise(F.col("fp0"))
    out = one.select("k", "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("true_pairs") - tp).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def budget(files: DataFrame, library: DataFrame, most: int = 7800) -> DataFrame:
    """(file, chars, max_chars, over, library_memories) of always-loaded files against what may be injected. files: file, project, text; library: project."""
    n = library.groupBy("project").agg(F.count("*").alias("n"))
    return files.join(n, "project", "left").select("file", F.length("text").alias("chars"), F.lit(most).alias("max_chars"), F.greatest(F.lit(0), F.length("text") - most).alias("over"), F.coalesce("n", F.lit(0)).alias("library_memories"))


def audit_view(audit: DataFrame, mem: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` audit records (ord, refs: ids or hashes), newest first, with contents: each ref's text, null if it is gone."""
    last = audit.orderBy(F.desc("ord")).limit(n)
    refs = last.select("ord", F.posexplode("refs").alias("p", "ref"))
    got = refs.join(by_refs(mem, refs.select("ref"), "content"), "ref", "left")
    per = got.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ref", "content"))), lambda r: F.struct(r["ref"].alias("ref"), r["content"].alias("content"))).alias("contents"))
    return last.join(per, "ord", "left")


def evidence_of(scores: DataFrame, hits: DataFrame) -> DataFrame:
    """Receipts of an evaluation, which hold hashes and no texts: (qid, query_hash, ranked hashes). scores: qid, query; hits: qid, hash, rank."""
    per = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hash"))), lambda r: r["hash"]).alias("hashes"))
    return scores.join(per, "qid", "left").select("qid", F.sha2("query", 256).alias("query_hash"), F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))


def fingerprint(rows: DataFrame, *cols: str) -> DataFrame:
    """(rows, fingerprint) of a dataset: SHA-256 over the sorted hashes of its rows, so that neither order nor partitions matter. Hashes are joined by their first byte first."""
    h = rows.select(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("p"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "p"))), lambda r: r["p"]), "\n"), 256).alias("fingerprint"))


def write_eval(cands: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: candidates, fragments (ending in a comma or semicolon), avg_chars, missed (expected phrases in none), extra (candidates with none)."""
    c = cands.select("id", "content")
    hit = holding(c, "content", expected.select("phrase").distinct(), "phrase").select("id", "phrase")
    a = c.agg(F.count("*").alias("candidates"), F.count_if(F.col("content").rlike("[，、；,;]\\s*$")).alias("fragments"), F.avg(F.length("content")).alias("avg_chars"))
    b = hit.agg(F.countDistinct("id").alias("matched"), F.countDistinct("phrase").alias("found"))
    n = expected.agg(F.countDistinct("phrase").alias("phrases"))
    return a.join(F.broadcast(b)).join(F.broadcast(n)).select("candidates", "fragments", "avg_chars", (F.col("phrases") - F.col("found")).alias("missed"), (F.col("candidates") - F.col("matched")).alias("extra"))


def injected_union(events: DataFrame, *by: str) -> DataFrame:
    """(by, hashes): what the events of a group injected in all, each hash once, in order. events: hashes (an array; null: none)."""
    return events.select(*by, F.explode_outer("hashes").alias("h")).groupBy(*by).agg(F.array_sort(F.collect_set("h")).alias("hashes"))


def latency(audit: DataFrame, *by: str) -> DataFrame:
    """(by, n, mean, p95, most) of ms; p95 is interpolated between the two nearest values."""
    return audit.where("ms is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.max("ms").alias("most"))


def arms(runs: DataFrame) -> DataFrame:
    """(on_recall, off_recall, parity): the mean recall with and without injection, and their difference in points. runs: case, arm, recall."""
    r = runs.groupBy("case").agg(F.max(F.when(F.col("arm") == "on", F.col("recall"))).alias("on"), F.max(F.when(F.col("arm") == "off", F.col("recall"))).alias("off"))
    return r.agg(F.avg("on").alias("on_recall"), F.avg("off").alias("off_recall"), (100 * (F.avg("on") - F.avg("off"))).alias("parity"))
