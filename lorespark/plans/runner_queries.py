"""The proposal runner's step over the conversations: a bundle a session, a deterministic executor that drafts one fact a user's line, and one to fall back on."""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import functions as F

from ..operators import extraction, runner
from .registry import _scrubbed, query
from .scratch import written
from .sql import HASH
from .tables import NOW, table

_LINE = re.compile(r"^\[(\d+)\] \(user-prompt/(\d+)\) (.*)$", re.M)


def _lines_as_facts(prompt: str) -> str:
    """One fact a user's line, of its first 40 characters. Four lines are beyond reach; three give talk first, and an array when asked again."""
    found = _LINE.findall(prompt)
    if len(found) == 4:
        raise extraction.Unavailable("too busy")
    drafts = [{"kind": "fact", "content": text[:40], "evidence_idx": [int(n)]} for n, _, text in found]
    if len(found) == 3:
        return json.dumps(drafts, indent=1) if runner.REPAIR in prompt else "I would say { something }"
    return "\n".join(json.dumps(d, ensure_ascii=False) for d in drafts)


def _from_afar(prompt: str) -> str:
    n, session, _ = _LINE.findall(prompt)[0]
    if int(session) % 5 == 0:
        raise TimeoutError("no answer")
    return json.dumps({"kind": "task", "content": f"look at session {session}", "evidence_idx": [int(n)], "scope": "planet" if int(session) % 5 == 1 else "session"})


_FLAT = _scrubbed("trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))")
_STEPS = {
    "turns_of": f"SELECT conv_id, turn, role, {_FLAT} AS body FROM conversations",
    "lines_of": "SELECT DISTINCT conv_id, CASE WHEN length(body) > 400 THEN substr(body, 1, 399) || '…' ELSE body END AS body FROM turns_of WHERE role = 'user' AND trim(body) <> ''",
    "drafted": f"SELECT conv_id, {_scrubbed('trim(substr(body, 1, 40))')} AS content FROM lines_of",
    "named_drafts": f"SELECT conv_id, count(*) AS n, count(DISTINCT {HASH}) AS fresh FROM drafted GROUP BY conv_id",
    "sessions_of": "SELECT conv_id, count(*) FILTER (trim(body) <> '') AS n_ok FROM turns_of GROUP BY conv_id",
    "stepped_runs": "SELECT s.conv_id, n_ok, coalesce(n, 0) AS n, coalesce(fresh, 0) AS fresh, CASE WHEN n_ok = 0 THEN 'mute' WHEN coalesce(n, 0) <> 4 THEN 'local' WHEN s.conv_id % 5 = 0 THEN 'none' WHEN s.conv_id % 5 = 1 THEN 'odd' ELSE 'byok' END AS way FROM sessions_of s LEFT JOIN named_drafts d USING (conv_id)",
}


@query(
    "SELECT conv_id::VARCHAR AS id, CASE way WHEN 'mute' THEN 'noop' WHEN 'none' THEN 'backlog' WHEN 'odd' THEN 'invalid' WHEN 'byok' THEN 'ok' ELSE CASE WHEN n = 0 THEN 'noop' ELSE 'ok' END END AS status, CASE way WHEN 'mute' THEN 'noop' WHEN 'none' THEN 'backlog' WHEN 'odd' THEN 'fail' WHEN 'byok' THEN 'ok' ELSE CASE WHEN n = 0 THEN 'noop' ELSE 'ok' END END AS bundle_status, CASE way WHEN 'local' THEN 'local' WHEN 'odd' THEN 'byok' WHEN 'byok' THEN 'byok' ELSE '' END AS executor, CASE way WHEN 'local' THEN n WHEN 'byok' THEN 1 ELSE 0 END AS valid, (way = 'odd')::BIGINT AS invalid, CASE way WHEN 'local' THEN fresh WHEN 'byok' THEN 1 ELSE 0 END AS inserted, CASE way WHEN 'local' THEN n - fresh ELSE 0 END AS duplicate FROM stepped_runs",
    **_STEPS,
)
def proposal_steps(spark, d):
    c, n = table(spark, d, "conversations"), itertools.count()
    i, t, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    event = F.when(F.col("role") == "user", "user-prompt").when(F.col("role") == "assistant", "assistant-text").otherwise("")
    ordinal = F.row_number().over(extraction.Window.partitionBy("conv_id").orderBy("turn"))
    name = F.concat_ws("-", i.cast("string"), t.cast("string"))
    refs = c.select(
        i.cast("string").alias("bundle_id"), ordinal.alias("ordinal"), name.alias("evidence_id"), F.concat(F.lit("u"), name).alias("event_uid"), event.alias("event_type"), i.cast("string").alias("session_id"), F.lit("p").alias("project"),
        F.lit("src").alias("source_id"), t.alias("seq"), F.lit("h").alias("archive_hash"), text.alias("summary"), (F.trim(F.regexp_replace(text, "\\s+", " ")) != "").alias("proposal_eligible"), F.lit("full").alias("fidelity"),
    )
    bundles = c.groupBy(i.cast("string").alias("id")).agg(F.count("*").cast("int").alias("n"))
    state = {"attempt": F.lit(1), "evidence_hash": F.lit("h"), "status": F.lit("leased"), "not_before": F.lit(0), "lease_until": F.lit(NOW + 60), "lease_owner": F.lit("me"), "last_run_id": F.lit("")}
    cands = spark.createDataFrame([], "id string, session_id string, content_hash string, status string, created_at bigint")
    keep = lambda df, what: written(df, f"step-{what}-{next(n)}")
    got = runner.step(bundles.withColumns(state), "me", refs, cands, spark.createDataFrame([], "run_id string"), [("local", _lines_as_facts), ("byok", _from_afar)], keep, NOW, "H\n")
    return got.outcomes.select("id", "status", "bundle_status", "executor", "valid", "invalid", "inserted", "duplicate")
