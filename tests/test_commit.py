from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import capture, evaluation, lifecycle, promotion, supply

CAND = "id long, session_id long, kind string, content string, content_hash string, project string, status string, revision int, salience double, memory_id long, decided_at long, channel string, created_at long"
MEM = "id long, content string, content_hash string, project string, kind string, salience double, access_count int, adopted_count int, updated_at long, last_seen_at long, created_at long, source string, origin_tool string, channel string, provenance string, last_adopted_at long"
LINK = "memory_id long, evidence_id string, event_uid string, archive string, locator string, grade string, seq long, occurred_at long"
ITEM = LINK.replace("memory_id long", "candidate_id long") + ", role string"
LOG = "candidate_id long, revision int, evidence_hash string, action string, actor string, idempotency_key string, memory_id long"


def by(df, *cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


def test_a_commit_is_whole_and_its_replay_counts_nothing(spark):
    cand = lambda i, text, status="pending", mem=None, channel="": (i, 1, "fact", text, "", "p", status, 1, 0.7, mem, None, channel, 1)
    cands = spark.createDataFrame([cand(1, "New fact"), cand(2, "new fact."), cand(3, "Old fact", channel="user"), cand(4, "Gone", "accepted", 99), cand(5, "No memory", "accepted"), cand(6, "Kept", "accepted", 12), cand(7, "Out", "rejected")], CAND)
    cands = cands.withColumn("content_hash", T.content_hash(F.col("content")))
    mem = spark.createDataFrame([(11, "old fact", "", "p", "fact", 0.2, 1, 1, 5, 5, 5, "user", "cli", "user", "told", None), (12, "kept", "", "p", "fact", 0.2, 1, 1, 5, 5, 5, "user", "cli", "user", "", 3)], MEM).withColumn("content_hash", T.content_hash(F.col("content")))
    items = spark.createDataFrame([(c, f"e{c}", f"evt_{c}abcdefghij", "", "", "B", 1, c, "direct") for c in (1, 2, 3, 4, 6)] + [(1, "", "", "x", "", "C", 2, 9, "context")], ITEM)
    ask = spark.createDataFrame([(i, -1) for i in range(1, 9)], "id long, expected int")
    empty = lambda s: spark.createDataFrame([], s)
    one = promotion.commit(cands, ask, mem, items, empty(LINK), empty("src long, dst long, rel string"), empty(LOG), 100, F.col("first") + 1000)
    assert by(one.outcomes, "outcome") == {1: ("commit",), 2: ("commit",), 3: ("commit",), 4: ("lost",), 5: ("lost",), 6: ("already",), 7: ("closed",), 8: ("missing",)}
    m = by(one.memories, "adopted_count", "access_count", "origin_tool", "channel", "last_adopted_at")
    assert m == {1001: (2, 1, "distill", "agent", 100), 11: (2, 2, "distill", "user", 100), 12: (1, 1, "cli", "user", 3)}
    p = by(one.memories, "provenance", "signature")
    assert p[11][0] == "told" and "1abcdefg" in p[1001][0] and "6abcdefg" in p[12][0] and len(p[1001][1]) == 64
    assert sorted((r.memory_id, r.evidence_id) for r in one.links.collect()) == [(11, "e3"), (12, "e6"), (1001, "e1"), (1001, "e2")]
    assert sorted((r.src, r.dst) for r in one.edges.collect()) == [(11, 3), (12, 6), (1001, 1), (1001, 2)]
    assert {r.candidate_id for r in one.decisions.collect()} == {1, 2, 3, 6}
    back = one.memories.select(*[c.split()[0] for c in MEM.split(", ")])
    two = promotion.commit(one.candidates, ask, back, items, one.links, one.edges, one.decisions, 200, F.col("first") + 1000)
    assert {r.outcome for r in two.outcomes.where("id in (1, 2, 3, 6)").collect()} == {"already"}
    assert by(two.memories, "adopted_count", "access_count", "provenance", "last_adopted_at") == by(one.memories, "adopted_count", "access_count", "provenance", "last_adopted_at")
    assert two.links.count() == 4 and two.edges.count() == 4


def test_rows_of_old_are_marked_once_and_not_touched(spark):
    ids, marks = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([("memory", "1", "legacy/no_original_evidence", 5)], "entity_type string, entity_id string, mark string, marked_at long")
    got, version = lifecycle.mark_legacy(ids, ids.limit(1), marks, 0, 9)
    assert version == 1 and sorted((r.entity_type, r.entity_id, r.marked_at) for r in got.collect()) == [("memory", "1", 5), ("memory", "2", 9), ("observation", "1", 9)]
    assert lifecycle.mark_legacy(ids, ids, marks, 1, 9) == (marks, 1)


def test_explicit_requests_pass_the_gate(spark):
    trace = spark.createDataFrame([(1, 0), (3, 1)], "qid int, injection_rank int")
    q = spark.createDataFrame([(1, "ok thanks", True), (2, "ok thanks", None), (3, "", True), (4, "hi", False)], "qid int, query string, explicit boolean")
    assert {r.qid: r.outcome for r in supply.outcomes(trace, q).collect()} == {1: "abstained_low_quality", 2: "skipped_gate", 3: "injected", 4: "skipped_gate"}
    assert {r.outcome for r in supply.outcomes(trace, q.drop("explicit")).collect()} == {"skipped_gate"}


def test_maps_by_harness_and_unions_of_hashes(spark):
    a = spark.createDataFrame([("p", "x", "cli", ["a", "b"]), ("p", "y", "cli", None), ("p", "x", "", ["b", "c"]), ("q", "x", None, None)], "project string, event string, harness string, hashes array<string>")
    assert {r.project: r.by_event for r in evaluation.audit_maps(a, "project").collect()} == {"p": {"x": 2, "y": 1}, "q": {"x": 1}}
    assert {r.project: r.by_harness for r in evaluation.audit_maps(a, "project", of="harness").collect()} == {"p": {"cli": 2}}
    assert {r.project: r.hashes for r in evaluation.injected_union(a, "project").collect()} == {"p": ["a", "b", "c"], "q": []}


def test_tool_texts_are_unquoted(spark):
    rows = [('"ls \\"a\\"\\nb"',), ('{"cmd": "ls"}',), ("null",), ('"unfinished',), ('"a" and "b"',), (None,)]
    c = lambda x: F.lit(x)
    got = spark.createDataFrame(rows, "i string").select(capture.observation_text(c("post-tool-use"), c("sh"), F.col("i"), c(""), c(""), c(""), c(""), c(""), c("")).alias("o")).collect()
    assert [(r.o.text, r.o.fidelity) for r in got] == [('tool:sh\nls "a"\nb', "full"), ('tool:sh\n{"cmd": "ls"}', "full"), ("tool:sh", "summary"), ('tool:sh\n"unfinished', "full"), ('tool:sh\n"a" and "b"', "full"), ("tool:sh", "summary")]
