"""One step of the proposal runner over many bundles, as one plan: evidence is counted, bundles without eligible evidence end as noop, the others' prompts go to executors (the next one only where
one cannot be reached), outputs are read and repaired once, drafts become candidates with their evidence, and bundles and the run ledger are finished.

What executors say is written before it is read, so no plan asks them twice, and all names are made from bundle and attempt: a step that runs again changes nothing. There is no queue here: which
bundles are leased, and by whom, is ``capture``'s.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import capture, extraction, promotion

SALIENCE, REPAIR_CHARS = 0.6, 2000
REPAIR = "\nThe last output could not be read. Write a JSON array or one JSON object a line, and nothing else.\nLast output:\n"
SAID = "id string, executor string, output string, error string, reached boolean"
Executor = tuple[str, Callable[[str], str]]


def run_id(bundle: Column, attempt: Column) -> Column:
    return F.concat(F.lit("run_"), F.substring(F.sha2(F.concat_ws("|", bundle.cast("string"), attempt.cast("string")), 256), 1, 24))


def ask(prompts: DataFrame, executors: list[Executor]) -> DataFrame:
    """(id, executor, output, error, reached) of prompts (id, prompt), a batch of Arrow rows at a time: the first executor that can be reached answers. Any other error of it is its answer; where none can
    be reached, reached is false. A column ``only`` names the executor to ask, if there is one."""

    def one(text: str, only: str | None) -> tuple[str, str, str, bool]:
        error = ""
        for name, call in executors:
            if only is not None and name != only:
                continue
            try:
                return name, call(text), "", True
            except (extraction.Unavailable, TimeoutError) as e:
                error = str(e)
            except Exception as e:  # a bad answer is no reason to ask someone else
                return name, "", f"{type(e).__name__}: {e}", True
        return "", "", error, False

    def run(frames):
        for pdf in frames:
            got = [one(t, o) for t, o in zip(pdf.prompt, pdf.only, strict=True)]
            yield pd.DataFrame({"id": pdf.id, **{c: [g[i] for g in got] for i, c in enumerate(("executor", "output", "error", "reached"))}})

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt", (F.col("only") if "only" in prompts.columns else F.lit(None).cast("string")).alias("only")).mapInPandas(run, SAID)


def answers(prompts: DataFrame, counts: DataFrame, executors: list[Executor], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What ``ask`` gives, an output that cannot be read asked for once more of the same executor with its beginning; the second answer stands unless it cannot be given. prompts: id, prompt; counts: id, n_evidence; keep writes a table
    under a name and reads it back."""
    first = keep(ask(prompts, executors), "asked")
    bad = extraction.verdicts(first.where("reached and error = ''").join(counts, "id")).where("bad").select("id")
    again = first.join(bad, "id").join(prompts.select(F.col("id").cast("string").alias("id"), "prompt"), "id")
    text = F.concat("prompt", F.lit(REPAIR), T.scrub(F.substring(T.strip(F.col("output")), 1, REPAIR_CHARS)), F.lit("\n"))
    second = keep(ask(again.select("id", text.alias("prompt"), F.col("executor").alias("only")), executors), "repaired")
    two = second.where("reached and error = ''").select("id", F.col("output").alias("mended"))
    return first.join(two, "id", "left").withColumn("output", F.coalesce("mended", "output")).drop("mended")


def drafts_to_candidates(drafts: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of valid drafts (id, proposal_index, draft) and their links. The first piece of evidence cited gives session and project; what attributes a draft is the evidence (the user, if any of it is the user's; else the
    assistant), and only without a speaker there the draft's own word. refs: bundle_id, ordinal, evidence_id, event_uid, event_type, session_id, project, source_id, seq, archive_hash."""
    cited = drafts.select("id", "run", "proposal_index", "draft", F.posexplode("draft.evidence_idx").alias("place", "ordinal"))
    known = refs.select(F.col("bundle_id").cast("string").alias("id"), "ordinal", "evidence_id", "event_uid", "event_type", "session_id", "project", "source_id", "seq", "archive_hash")
    j = cited.join(known, ["id", "ordinal"])
    who = extraction.speaker(F.col("event_type"))
    first = F.min(F.struct("place", F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session"), F.coalesce("project", F.lit("")).alias("project")))
    c = j.groupBy("id", "run", "proposal_index").agg(F.first("draft").alias("d"), first.alias("f"), F.max(F.when(who == "user", 2).when(who == "assistant", 1).otherwise(0)).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("obs_ids"))
    name = F.concat(F.lit("cand_"), F.substring(F.sha2(F.concat_ws("|", "run", F.col("proposal_index").cast("string")), 256), 1, 24))
    clean = lambda x: T.scrub(F.col(f"d.{x}"))
    said = F.when(F.col("w") == 2, "user").when(F.col("w") == 1, "assistant").otherwise(F.col("d.attributed_to"))
    cands = c.select(
        name.alias("id"), F.col("id").alias("bundle_id"), F.col("run").alias("run_id"), "proposal_index", F.when(F.col("f.session") == "", "unknown").otherwise(F.col("f.session")).alias("session_id"), F.col("f.project").alias("project"),
        F.col("d.kind").alias("kind"), F.col("d.scope").alias("scope"), clean("content").alias("content"), clean("rationale").alias("rationale"), clean("subject_key").alias("subject_key"), clean("task_state").alias("task_state"),
        said.alias("attributed_to"), F.lit(SALIENCE).alias("salience"), "obs_ids",
    )
    links = j.join(c.select("id", "run", "proposal_index", name.alias("candidate_id")), ["id", "run", "proposal_index"])
    return cands, links.select("candidate_id", "evidence_id", "event_uid", "source_id", F.col("seq").alias("source_seq"), "archive_hash", F.lit("direct").alias("evidence_role"))


@dataclass
class Step:
    """outcomes: a row a bundle; candidates and links: what is new; runs: new rows of the run ledger; bundles: as they are behind the step."""

    outcomes: DataFrame
    candidates: DataFrame
    links: DataFrame
    runs: DataFrame
    bundles: DataFrame


def step(bundles: DataFrame, owner: str, refs: DataFrame, cands: DataFrame, runs: DataFrame, executors: list[Executor], keep: Callable[[DataFrame, str], DataFrame], now: int, header: str = extraction.HEADER) -> Step:
    """One step of all bundles that ``owner`` has leased and whose run is not in the ledger.

    A bundle whose evidence is not as many pieces as it names fails; one without eligible evidence is noop; one whose executors cannot be reached is backlog; of the others the drafts decide (``capture.classify``). Of candidates that
    repeat an open one of their session, or each other, only evidence is taken over. bundles: id, n, attempt, evidence_hash and what ``capture.finish`` reads; refs: bundle_id, ordinal, evidence_id, event_uid, event_type, session_id, project,
    source_id, seq, archive_hash, summary, proposal_eligible, fidelity; cands: id, session_id, content_hash, status, created_at; runs: run_id.
    """
    leased = bundles.where((F.col("status") == "leased") & (F.col("lease_owner") == owner)).select(F.col("id").cast("string").alias("id"), "n", "attempt", "evidence_hash", run_id(F.col("id"), F.col("attempt")).alias("run"))
    leased = leased.join(runs.select(F.col("run_id").alias("run")).distinct(), "run", "left_anti")
    ok = extraction.eligible(F.col("proposal_eligible"), F.col("fidelity"))
    session = F.min(F.when(ok & (F.trim(F.coalesce(F.col("session_id").cast("string"), F.lit(""))) != ""), F.struct("ordinal", F.col("session_id").cast("string").alias("s"))))
    have = refs.groupBy(F.col("bundle_id").cast("string").alias("id")).agg(F.count("*").alias("n_refs"), F.count_if(ok).alias("n_ok"), session.alias("first"))
    b = leased.join(have, "id", "left").na.fill(0, ["n_refs", "n_ok"])
    early = F.when((F.col("n") > 0) & (F.col("n") != F.col("n_refs")), "fail").when(F.col("n_ok") == 0, "noop")
    b = keep(b.select("id", "run", "attempt", "evidence_hash", "n_refs", F.coalesce("first.s", F.lit("")).alias("session_id"), early.alias("early")), "bundles")
    due = b.where("early is null").select("id", F.col("n_refs").cast("int").alias("n_evidence"))
    mine = refs.withColumn("bundle_id", F.col("bundle_id").cast("string")).join(due.select(F.col("id").alias("bundle_id")), "bundle_id", "left_semi")
    prompts = extraction.prompt(mine, header).select(F.col("bundle_id").alias("id"), "prompt")
    said = keep(answers(prompts, due, executors, keep), "answers")
    usable = said.where("reached and error = ''").join(due, "id")
    read = keep(extraction.read_drafts(usable), "drafts")
    verdict = extraction.verdicts(usable, read)
    valid = read.where("state = 'ok'").join(b.select("id", "run"), "id")
    rank = F.row_number().over(extraction.Window.partitionBy("id").orderBy("line"))
    new, links = drafts_to_candidates(valid.select("id", "run", rank.alias("proposal_index"), "draft"), mine)
    new = keep(new, "candidates")
    order = F.row_number().over(extraction.Window.partitionBy("session_id").orderBy("bundle_id", "proposal_index"))
    told = keep(promotion.insert_candidates(cands, new.select(F.struct("session_id", order.alias("o")).alias("ord"), "id", "session_id", "kind", "content")).select(F.col("ord.session_id").alias("session_id"), F.col("ord.o").alias("o"), "state", F.col("id").alias("kept_as")), "told")
    new = new.withColumn("o", order).join(told, ["session_id", "o"]).drop("o")
    per = new.groupBy(F.col("bundle_id").alias("id")).agg(F.count_if(F.col("state") == "created").alias("inserted"), F.count_if(F.col("state") == "merged").alias("duplicate"), F.count_if(F.col("state") == "invalid").alias("errors"))
    o = b.join(said.select("id", "executor", "error", "reached"), "id", "left").join(verdict.select("id", F.col("status").alias("exec"), "valid", "invalid"), "id", "left").join(per, "id", "left").na.fill(0, ["inserted", "duplicate", "errors", "valid", "invalid"])
    # no answer at all is a backlog, an answer that is an error a failure
    status = F.coalesce("early", F.when(~F.col("reached"), "backlog").when(F.col("error") != "", "fail").otherwise(F.col("exec")))
    end = capture.classify(status, F.col("inserted"), F.col("errors"))
    outcomes = keep(o.select("id", "run", "session_id", "attempt", "evidence_hash", F.coalesce("executor", F.lit("")).alias("executor"), end["run"].alias("status"), end["bundle"].alias("bundle_status"), "valid", "invalid", "inserted", "duplicate", F.coalesce("error", F.lit("")).alias("error")), "outcomes")
    ledger = outcomes.select(F.col("run").alias("run_id"), F.col("id").alias("bundle_id"), "session_id", "status", "executor", (F.col("valid") + F.col("invalid")).alias("generated"), "valid", "invalid", "inserted", "duplicate", "attempt", "evidence_hash", F.lit(now).cast("bigint").alias("finished_at"), "error")
    made = new.where("state = 'created'").drop("state", "kept_as")
    kept = new.where("state <> 'invalid'").select(F.col("id").alias("candidate_id"), "kept_as")
    # a repeated candidate's evidence goes to the one that stays
    moved = links.join(kept, "candidate_id").withColumn("candidate_id", F.col("kept_as")).drop("kept_as").dropDuplicates(["candidate_id", "evidence_id", "evidence_role"])
    done = capture.finish(bundles, outcomes.select("id", F.lit(owner).alias("owner"), F.col("bundle_status").alias("status"), F.col("run").alias("run_id")), now)
    return Step(outcomes, made, moved, ledger, done.drop("finished"))
