import itertools
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lorespark.operators import extraction, runner
from lorespark.plans.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests
NOW = 1000
BUNDLE = "id string, n int, attempt int, evidence_hash string, status string, not_before bigint, lease_until bigint, lease_owner string, last_run_id string"
REF = "bundle_id string, ordinal int, evidence_id string, event_uid string, event_type string, session_id string, project string, source_id string, seq bigint, archive_hash string, summary string, proposal_eligible boolean, fidelity string"
CANDS, RUNS = "id string, session_id string, content_hash string, status string, created_at bigint", "run_id string"


def draft(content, *idx, kind="fact", who=""):
    import json

    return json.dumps({"kind": kind, "content": content, "evidence_idx": list(idx), "attributed_to": who})


#: What is said to a prompt that holds a word; a list: to the first request and to the repair.
SAYS = {
    "alpha": draft("Alpha uses port 80. password=hunter2", 1, 2),
    "beta": ["no idea", "[" + draft("Beta mended", 2, who="assistant") + "]"],
    "gamma": "[]",
    "delta": draft("Delta one", 1) + "\n" + draft("bad", 9) + "\n" + draft("delta ONE.", 2),
    "broken": ["nothing", "still nothing"],
}


def local(prompt):
    if "omega" in prompt or "sigma" in prompt:
        raise extraction.Unavailable("no model")
    if "kaput" in prompt:
        raise RuntimeError("bad request")
    for word, out in SAYS.items():
        if word in prompt:
            return out if isinstance(out, str) else out["could not be read" in prompt]
    return ""


def remote(prompt):
    if "sigma" in prompt:
        raise TimeoutError("too long")
    return draft("Told from afar", 1)


def ref(bundle, ordinal, text, event="user-prompt", ok=True, session="s"):
    return (bundle, ordinal, f"{bundle}-e{ordinal}", f"u{bundle}{ordinal}", event, session, "p", "src", ordinal, "h", text, ok, "full")


@pytest.fixture
def world(spark):
    words = ["alpha", "beta", "gamma", "delta", "broken", "kaput", "omega", "sigma"]
    refs = [r for w in words for r in (ref(w, 1, f"about {w}"), ref(w, 2, f"more of {w}", "assistant-text"))]
    refs += [ref("mute", 1, "quiet", ok=False), ref("short", 1, "one of two")]
    leased = lambda i, n, owner="me": (i, n, 1, "eh", "leased", 0, NOW + 60, owner, "")
    bundles = [leased(w, 2) for w in words] + [leased("mute", 1), leased("short", 2), leased("other", 1, "you"), ("free", 1, 0, "eh", "open", 0, 0, "", "")]
    return spark.createDataFrame(bundles, BUNDLE), spark.createDataFrame(refs, REF)


def run(spark, bundles, refs, cands=None, runs=None, executors=(("local", local), ("byok", remote))):
    n = itertools.count()
    keep = lambda df, name: written(df, f"{name}-{next(n)}")
    return runner.step(bundles, "me", refs, cands or spark.createDataFrame([], CANDS), runs or spark.createDataFrame([], RUNS), list(executors), keep, NOW, "H\n")


def test_one_step_of_many_bundles(spark, world):
    got = run(spark, *world)
    o = {r.id: (r.status, r.bundle_status, r.executor, r.valid, r.invalid, r.inserted, r.duplicate) for r in got.outcomes.collect()}
    assert o == {
        "alpha": ("ok", "ok", "local", 1, 0, 1, 0), "beta": ("ok", "ok", "local", 1, 0, 1, 0), "gamma": ("noop", "noop", "local", 0, 0, 0, 0), "delta": ("partial", "partial", "local", 2, 1, 1, 1),
        "broken": ("invalid", "fail", "local", 0, 1, 0, 0), "kaput": ("fail", "fail", "local", 0, 0, 0, 0), "omega": ("ok", "ok", "byok", 1, 0, 1, 0), "sigma": ("backlog", "backlog", "", 0, 0, 0, 0),
        "mute": ("noop", "noop", "", 0, 0, 0, 0), "short": ("fail", "fail", "", 0, 0, 0, 0),
    }
    c = {r.content: r for r in got.candidates.collect()}
    assert set(c) == {"Alpha uses port 80. [redacted]", "Beta mended", "Delta one", "Told from afar"}
    assert c["Alpha uses port 80. [redacted]"].attributed_to == "user" and c["Beta mended"].attributed_to == "assistant" and c["Beta mended"].obs_ids == ["beta-e2"] and c["Delta one"].session_id == "s"
    links = {(r.candidate_id, r.evidence_id) for r in got.links.collect()}
    assert {e for i, e in links if i == c["Delta one"].id} == {"delta-e1", "delta-e2"}  # the repeated draft's evidence too
    b = {r.id: (r.status, r.not_before, r.lease_owner) for r in got.bundles.collect()}
    assert b["alpha"] == ("ok", 0, "") and b["sigma"][0] == "backlog" and b["sigma"][1] > NOW and b["delta"][1] > NOW and b["other"] == ("leased", 0, "you") and b["free"][0] == "open"


def test_a_step_that_runs_again_changes_nothing(spark, world):
    bundles, refs = world
    one = run(spark, bundles, refs)
    cands = one.candidates.select("id", "session_id", runner.T.content_hash(F.col("content")).alias("content_hash"), F.lit("pending").alias("status"), F.lit(1).cast("bigint").alias("created_at"))
    again = run(spark, bundles, refs)
    key = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert key(again.candidates, "id", "content") == key(one.candidates, "id", "content") and key(again.runs, "run_id", "status") == key(one.runs, "run_id", "status")
    # the ledger knows the runs: nothing is asked, nothing is new
    calls = spark.sparkContext.accumulator(0)

    def counted(prompt):
        calls.add(1)
        return ""

    replay = run(spark, bundles, refs, cands, one.runs.select("run_id"), [("local", counted)])
    assert replay.candidates.count() == replay.links.count() == replay.runs.count() == calls.value == 0
    # the ledger is lost, the candidates are not: they are found and only named again
    late = run(spark, bundles, refs, cands)
    assert late.candidates.count() == 0 and {r.candidate_id for r in late.links.collect()} == {r.id for r in one.candidates.collect()}


def test_each_prompt_is_asked_once_and_repaired_once(spark, world):
    calls = spark.sparkContext.accumulator(0)

    def counted(prompt):
        calls.add(1)
        return local(prompt)

    got = run(spark, *world, executors=(("local", counted),))
    assert {r.id: r.status for r in got.outcomes.collect()}["omega"] == "backlog"
    got.candidates.collect(), got.links.collect(), got.bundles.collect()
    assert calls.value == 8 + 2  # beta and broken are asked again
