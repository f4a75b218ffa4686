"""Rule-based extraction of facts from conversation turns, and parsing of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import window_key

CONTENT_CHARS, SALIENCE, PAYLOAD_CHARS = 240, 0.6, 400
#: What a prompt asks for: the fields, and the rules for each speaker's section. A caller may give its own.
HEADER = (
    "Distil long-term memories from the evidence below. Only add; do not change or delete what is known.\n"
    "One JSON object a line and nothing else; [] if there is nothing to keep.\n"
    'Fields: {"kind":"decision|pitfall|preference|task","scope":"session|project|global","content":"one fact","rationale":"one sentence","attributed_to":"user|assistant","subject_key":"","task_state":"","evidence_idx":[1]}\n'
    "evidence_idx names lines below by number, at least one; numbers may be missing.\n"
    "Preferences, limits and intents come from USER only. ASSISTANT adds what the user has not said; an echo is nothing new. A fact of both is USER's.\n\n"
)
KINDS = ("preference", "decision", "pitfall", "task", "fact")


def rule_distill(turns: DataFrame) -> DataFrame:
    """(session_id, seq, kind, content, salience): turns that a rule matches; assistants give no preferences; each (kind, content) once a batch, the first by (session_id, seq).

    A batch is what one run distils: ``turns`` as a whole, or each value of its column ``batch``. turns: session_id, seq, role, summary.
    """
    t = turns.where(F.col("role").isin("user", "assistant") & (F.trim("summary") != "")).withColumn("kind", T.rule_kind(F.col("summary")))
    t = t.where((F.col("kind") != "") & ~((F.col("kind") == "preference") & (F.col("role") == "assistant"))).withColumn("content", F.substring(T.fields(F.col("summary")), 1, CONTENT_CHARS))
    w = Window.partitionBy(*(["batch"] if "batch" in turns.columns else []), "kind", "content").orderBy("session_id", "seq")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("session_id", "seq", "kind", "content", F.lit(SALIENCE).alias("salience"))


#: Texts of a draft on the wire; each is a string, null or absent, else the line (of an array: all of it) is no draft.
_WIRE = ("kind", "scope", "content", "rationale", "subject_key", "task_state", "attributed_to")


def one_json(c: Column) -> Column:
    """The one JSON value that a text is (variant), or null; the parser itself passes over what follows a value, but not inside both an array and an object."""
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def _readable(m: Column) -> Column:
    """Whether a JSON value (variant) is an object, or null, whose fields have the types of a draft's."""
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(m, path, "variant")), F.lit("VOID"))
    ok = kind("$.evidence_idx").isin("VOID", "ARRAY<BIGINT>", "ARRAY<VOID>")
    for name in _WIRE:
        ok = ok & kind(f"$.{name}").isin("VOID", "STRING")
    whole = F.schema_of_variant(m)
    return m.isNotNull() & ((whole == "VOID") | whole.startswith("OBJECT") & ok)


def read_drafts(outputs: DataFrame) -> DataFrame:
    """(id, line, state, draft) of a model's outputs: an output that begins with [ is one JSON array, read whole or not at all (line 0); of any other each line that is not blank is read from its
    first { to its last }. state: ok, invalid (read, but of an unknown kind or scope, without content, or without evidence in range), bad (not to be read).

    A draft's scope is the project where it names none; evidence is sorted and each once; what attributes it to none of the speakers is blank. An output without drafts gives no row. outputs: id,
    output, n_evidence.
    """
    raw = T.strip(F.coalesce("output", F.lit("")))
    listed = raw.startswith("[")
    lines = F.filter(F.transform(F.split(raw, "\n"), T.strip), lambda x: x != "")
    rows = outputs.select("id", "n_evidence", listed.alias("listed"), F.posexplode(F.when(listed, F.array(raw)).otherwise(lines)).alias("line", "part"))
    rows = rows.withColumn("v", one_json(F.when(F.col("listed"), F.col("part")).otherwise(F.regexp_extract("part", "(?s)\\{.*\\}", 0))))
    one = rows.where("not listed").select("id", "n_evidence", "line", "v", _readable(F.col("v")).alias("ok"))
    member = rows.where("listed").select("id", "n_evidence", "line", F.schema_of_variant("v").alias("kind"), F.posexplode_outer(F.try_variant_get("v", "$", "array<variant>")).alias("at", "m"))
    member = member.withColumn("fits", (F.col("at").isNotNull() & _readable(F.col("m"))) | (F.col("at").isNull() & F.coalesce(F.col("kind").startswith("ARRAY"), F.lit(False))))
    refused = member.groupBy("id").agg(F.bool_and("fits").alias("all_fit"))
    member = member.join(refused, "id")
    broken = refused.where("not all_fit").select("id", F.lit(0).alias("n_evidence"), F.lit(0).alias("line"), F.lit(None).cast("variant").alias("v"), F.lit(False).alias("ok"))
    whole = member.where("all_fit and at is not null").select("id", "n_evidence", F.col("at").alias("line"), F.col("m").alias("v"), F.lit(True).alias("ok"))
    got = one.unionByName(whole).unionByName(broken)
    said = lambda name: T.strip(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
    low = lambda name: F.lower(said(name))
    scope = F.when(low("scope") == "", "project").otherwise(low("scope"))
    cited = F.coalesce(F.try_variant_get("v", "$.evidence_idx", "array<int>"), F.array().cast("array<int>"))
    who = F.when(low("attributed_to").isin("user", "assistant"), low("attributed_to")).otherwise("")
    draft = F.struct(low("kind").alias("kind"), scope.alias("scope"), said("content").alias("content"), said("rationale").alias("rationale"), said("subject_key").alias("subject_key"), said("task_state").alias("task_state"), who.alias("attributed_to"), F.array_sort(F.array_distinct(cited)).alias("evidence_idx"))
    got = got.select("id", "n_evidence", "line", "ok", draft.alias("draft"))
    d = F.col("draft")
    within = (F.size(d["evidence_idx"]) > 0) & F.forall(d["evidence_idx"], lambda i: F.coalesce((i >= 1) & (i <= F.col("n_evidence")), F.lit(False)))
    valid = d["kind"].isin(*KINDS) & (d["content"] != "") & d["scope"].isin("session", "project", "global") & within
    return got.select("id", "line", F.when(~F.col("ok"), "bad").when(valid, "ok").otherwise("invalid").alias("state"), F.when(F.col("ok"), d).alias("draft"))


def parse_drafts(outputs: DataFrame) -> DataFrame:
    """(id, status, draft): the drafts of ``read_drafts`` that hold, a row of status bad for what cannot be read, and one of status empty for an output without any. Drafts that do not hold are left out."""
    rows = read_drafts(outputs)
    none = outputs.select("id").distinct().join(rows.select("id").distinct(), "id", "left_anti").select("id", F.lit("empty").alias("status"), F.lit(None).cast(rows.schema["draft"].dataType).alias("draft"))
    return rows.where("state <> 'invalid'").select("id", F.col("state").alias("status"), F.when(F.col("state") == "ok", F.col("draft")).alias("draft")).unionByName(none)


def verdicts(outputs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(id, status, valid, invalid, bad) of outputs by their ``read_drafts``: noop without drafts, ok, partial, or invalid; bad: nothing could be read where something was said, which is worth one repair."""
    rows = read_drafts(outputs) if rows is None else rows
    n = rows.groupBy("id").agg(F.count_if(F.col("state") == "ok").alias("valid"), F.count_if(F.col("state") != "ok").alias("invalid"), F.count_if(F.col("state") == "bad").alias("lost"))
    out = outputs.select("id").distinct().join(n, "id", "left").na.fill(0, ["valid", "invalid", "lost"])
    status = F.when(F.col("invalid") == 0, F.when(F.col("valid") == 0, "noop").otherwise("ok")).when(F.col("valid") > 0, "partial").otherwise("invalid")
    return out.select("id", status.alias("status"), "valid", "invalid", ((F.col("valid") == 0) & (F.col("lost") > 0)).alias("bad"))


def eligible(ref: Column, fidelity: Column) -> Column:
    """Whether a piece of evidence may be proposed from: it is marked so, and its text is full, a summary, or of an old row that does not say."""
    return F.coalesce(ref, F.lit(False)) & F.coalesce(F.lower(F.trim(fidelity)), F.lit("")).isin("full", "summary", "")


def speaker(event: Column) -> Column:
    """user, assistant or '' of an event type, as proposals see it."""
    e = F.lower(F.trim(F.coalesce(event, F.lit(""))))
    return F.when(e.isin("user-prompt", "user.prompt"), "user").when(e.isin("assistant-text", "assistant.final", "stop", "session-end"), "assistant").otherwise("")


def distill_speaker(event: Column) -> Column:
    """The same for distilling by rules, where an event without a type is the user's."""
    return F.when(F.trim(F.coalesce(event, F.lit(""))) == "", "user").otherwise(speaker(event))


def prompt(refs: DataFrame, header: str = HEADER, chars: int = PAYLOAD_CHARS) -> DataFrame:
    """(bundle_id, prompt): the header, then the evidence by speaker (USER, ASSISTANT, OTHER; a section without lines is left out), each line ``[n] (event/session) text``.

    n is the place in the bundle, from 1; what is not eligible or repeats a text of its speaker keeps its number and gives no line. Texts are folded, scrubbed and cut to ``chars``
    with the mark of the cut. refs: bundle_id, ordinal, event_type, session_id, summary, proposal_eligible, fidelity.
    """
    body = T.scrub(T.fields(F.col("summary")))
    body = F.when(F.length(body) > chars, F.concat(F.substring(body, 1, chars - 1), F.lit("…"))).otherwise(body)
    who = speaker(F.col("event_type"))
    t = refs.withColumn("n", F.row_number().over(Window.partitionBy("bundle_id").orderBy("ordinal"))).withColumn("body", body).withColumn("who", who)
    ok = t.where(eligible(F.col("proposal_eligible"), F.col("fidelity")))
    ok = ok.withColumn("again", F.row_number().over(Window.partitionBy("bundle_id", "who", "body").orderBy("n"))).where("again = 1")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.coalesce("event_type", F.lit("")), F.lit("/"), F.coalesce(F.col("session_id").cast("string"), F.lit("")), F.lit(") "), "body", F.lit("\n"))
    place = F.when(F.col("who") == "user", 0).when(F.col("who") == "assistant", 1).otherwise(2)
    section = ok.groupBy("bundle_id", place.alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda r: r["line"]), "").alias("lines"))
    title = F.element_at(F.array(F.lit("USER"), F.lit("ASSISTANT"), F.lit("OTHER")), F.col("place") + 1)
    text = F.concat(F.lit("=== "), title, F.lit(" ===\n"), "lines", F.lit("\n"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda r: r["text"])
    got = section.groupBy("bundle_id").agg(F.array_join(joined, "").alias("sections"))
    return refs.select("bundle_id").distinct().join(got, "bundle_id", "left").select("bundle_id", F.concat(F.lit(header), F.coalesce("sections", F.lit(""))).alias("prompt"))


def distill_with(refs: DataFrame, complete, schema: str = "bundle_id bigint, output string") -> DataFrame:
    """Run a caller's ``complete(prompt) -> str`` over the prompts of bundles, a batch of Arrow rows at a time. There is no model here; rules are the default."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(output=pdf.prompt.map(complete))[["bundle_id", "output"]]

    return prompt(refs).mapInPandas(run, schema)


class Unavailable(Exception):
    """An executor that cannot be reached, or took too long; the next one may try."""


def execute(text: str, *executors) -> tuple[str, str]:
    """(name, output) of the first executor that can be reached; executors are (name, callable). Any other error is the caller's: a bad answer is no reason to ask someone else."""
    for name, run in executors:
        try:
            return name, run(text)
        except (Unavailable, TimeoutError):
            continue
    return "none", ""


def repaired(output: str, complete, chars: int = 2000) -> str:
    """An output that can be read, as it is; else what ``complete`` makes of its beginning when asked once to write JSON lines."""
    lines = [x for x in output.strip().strip("[]").splitlines() if x.strip()]
    if output.strip() in ("", "[]") or any("{" in x and "}" in x for x in lines):
        return output
    return complete("Write this as one JSON object a line and nothing else:\n" + output[:chars])


def distill_sessions(turns: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts by rule of sessions whose window is not done, and a run for each session: ok with facts, empty without, skipped if its window is done. turns: session_id, seq, role, summary, id;
    runs: session_id, window_key, status."""
    windows = turns.groupBy("session_id").agg(window_key(F.collect_list(F.col("id").cast("string"))).alias("window_key"))
    due = windows_due(windows, runs)
    facts = rule_distill(turns.join(due.select("session_id"), "session_id", "left_semi").withColumn("batch", F.col("session_id")))
    n = facts.groupBy("session_id").agg(F.count("*").alias("inserted"))
    out = windows.join(due.select("session_id", F.lit(True).alias("_d")), "session_id", "left").join(n, "session_id", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return facts, out.select("session_id", "window_key", F.when(F.col("_d").isNull(), "skipped").when(F.col("inserted") > 0, "ok").otherwise("empty").alias("status"), "inserted")


def distill_prompt(obs: DataFrame, header: str) -> DataFrame:
    """(session_id, prompt): the header and a session's observations in order, a line ``[id] (event) summary`` each, folded and scrubbed."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] ("), "event", F.lit(") "), T.scrub(T.fields(F.col("summary"))), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("created_at", "id", line.alias("line"))))
    return obs.groupBy("session_id").agg(F.concat(F.lit(header), F.array_join(F.transform(rows, lambda r: r["line"]), "")).alias("prompt"))


def windows_due(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """``windows`` (session_id, window_key) that no run has finished: ok and empty runs occupy a window, failed, partial and skipped ones do not."""
    done = runs.where(F.col("status").isin("ok", "empty") & (F.col("window_key") != "")).select("session_id", "window_key").distinct()
    return windows.join(done, ["session_id", "window_key"], "left_anti")
