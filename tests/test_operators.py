import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions import minhash as M
from lorespark.operators import dedup, evaluation, evidence, exchange, extraction, retrieval, supply
from lorespark.sources import readers
from lorespark.streaming import capture


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_prefix_and_groups(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alphabet soup"), (3, "构建工具"), (4, "nothing here")], "id bigint, content string")
    q = spark.createDataFrame([(1, "alpha"), (2, "构建 zzz"), (3, "建构")], "qid bigint, query string")
    got = rows(retrieval.bm25(docs, q), "qid", "id", "whole")
    assert got == [(1, 1, 1), (1, 2, 1), (2, 3, 1)]


def test_precise_hits_come_first(spark):
    """A text with the whole Han group but far down in score stands before texts that hold parts of it and look alike."""
    mem = spark.createDataFrame([(1, "活库不能放同步目录里面否则损坏", 0.5, 1), (2, "活库不能放在同步的目录里面", 0.9, 9), (3, "放同步目录" + "其他文字" * 30, 0.1, 1)], "id bigint, content string, salience double, last_seen_at bigint")
    q = spark.createDataFrame([(7, "放同步目录"), (8, "活库不能放在同步目录里面"), (9, "库")], "qid bigint, query string")
    got = {}
    for r in retrieval.fused(mem, q, F.col("salience"), F.lit(True)).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.exact))
        assert abs(r.score - (r.precise + r.broad + r.fuzzy)) < 1e-12
    assert [i for i, e in got[7] if e] == [1, 3] and got[7][-1] == (2, 0)
    assert all(not e for _, e in got[8]) and {i for i, _ in got[8]} == {1, 2, 3}
    assert got[9] and all(e for _, e in got[9])


def slow_bm25(docs, query, words):
    """BM25 of Latin texts one by one: a query word matches every term it begins."""
    toks = {i: t.lower().split() for i, t in docs}
    mean, out = sum(map(len, toks.values())) / len(toks), {}
    for w in words(query):
        f = {i: sum(t.startswith(w) for t in ts) for i, ts in toks.items()}
        n = sum(v > 0 for v in f.values())
        idf = math.log((len(toks) - n + 0.5) / (n + 0.5))
        for i, v in f.items():
            if v:
                out[i] = out.get(i, 0) - max(idf, 0) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean)) - (1e-6 * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean)) if idf <= 0 else 0)
    return out


def test_ranked_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(300)]
    asked = [(i, " ".join(word() for _ in range(r.randrange(1, 6)))) for i in range(12)]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    df, q = spark.createDataFrame(docs, "id bigint, content string").repartition(3), spark.createDataFrame(asked, "qid bigint, query string")
    got = {}
    for h in retrieval.top(retrieval.ranked(df, q, 7), 7, F.col("bm25"), F.col("id")).collect():
        got.setdefault(h.qid, []).append((h.rank, h.id, h.bm25))
    for i, text in asked:
        want = sorted((round(s, 9), d) for d, s in slow_bm25(docs, text, str.split).items())[:7]
        assert [(a, b) for _, a, b in sorted(got.get(i, []))] == [(d, pytest.approx(s, abs=2e-9)) for s, d in want]
    assert retrieval.bm25(df.where("false"), q).count() == 0 and retrieval.bm25(df, q.where("false")).count() == 0


def test_scopes(spark):
    mem = spark.createDataFrame([(1, "p"), (2, ""), (3, "q")], "id bigint, project string")
    got = {s: sorted(r.id for r in mem.where(retrieval.in_scope(s, "p")).collect()) for s in ("current", "global", "project", "all", "", "odd")}
    assert got == {"current": [1, 2], "global": [2], "project": [1], "all": [1, 2, 3], "": [1], "odd": [1, 2, 3]}
    assert mem.where(retrieval.in_scope("", "")).count() == 3


def test_layers(spark):
    assert [retrieval.canonical_layer(x) for x in ("", " Memory", "recent", "ALL")] == ["memory", "memory", "observation", "both"]
    with pytest.raises(ValueError):
        retrieval.canonical_layer("edges")
    mem = spark.createDataFrame([(1, "build tool", 0.5, 1, "p"), (2, "build", 0.9, 9, "p")], "id bigint, content string, salience double, last_seen_at bigint, project string")
    obs = spark.createDataFrame([(11, "ran the build", "tool-use", "grep", 5, "p"), (12, "build again", "stop", "", 6, "q")], "id bigint, summary string, event string, tool_name string, created_at bigint, project string")
    q = spark.createDataFrame([(7, "build")], "qid bigint, query string")
    run = lambda layer, **k: [(r.id, r.layer) for r in retrieval.search(layer, mem, obs, q, F.col("salience"), F.lit(True), **k).orderBy("rank").collect()]
    assert run("memory") == [(2, "memory"), (1, "memory")] and {i for i, _ in run("recent")} == {11, 12}
    assert [x for _, x in run("both")] == ["memory", "observation", "memory", "observation"] and [i for i, _ in run("recent", scope="project", project="p")] == [11]
    assert [r.kind for r in retrieval.observation_search(obs, q, scope="project", project="p").collect()] == ["grep"]
    with pytest.raises(ValueError):
        retrieval.observation_search(obs, q, kind="fact")


def test_near_pairs_equal_brute_force(spark):
    base = "the retention job of the archive must run after midnight on every worker node"
    texts = [base, base + " x", base.replace("midnight", "midnite"), base.replace("must", "must not"), base + " 7", "a wholly different sentence about nothing in particular", base]
    mem = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id bigint, content string, project string")
    got = rows(dedup.near_pairs(mem), "a", "b")
    df = spark.createDataFrame([(i, j, texts[i], texts[j], float((M.signature(texts[i]) == M.signature(texts[j])).mean())) for i in range(len(texts) - 1) for j in range(i + 1, len(texts) - 1)], "a int, b int, x string, y string, s double")
    want = rows(df.where((F.col("s") >= 0.7) & (M.judge(F.col("x"), F.col("y"), F.col("s"), 0.7) == "")), "a", "b")
    assert got == sorted(want + [(0, 6)]) and want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.cluster for r in dedup.components(links).collect()} == {0, 100}


MEM = "content_hash string, project string, id bigint, content string, kind string, salience double, access_count bigint, updated_at bigint, last_seen_at bigint, created_at bigint, expires_at bigint, provenance string, channel string, superseded_by bigint"


def as_records(mem):
    return mem.drop("superseded_by").withColumnRenamed("id", "ord").withColumns({"origin_device": F.lit("d"), "tags": F.create_map(F.lit("k"), F.array(F.lit("v"))), "superseded": F.lit(None).cast("struct<hash:string,project:string>")})


def test_import_is_idempotent_and_convergent(spark):
    a = spark.createDataFrame([("h", "p", 1, "x", "fact", 0.5, 3, 10, 10, 5, None, None, "", None), ("g", "p", 2, "y", "task", 0.2, 1, 9, 9, 9, 50, "o", "user", None)], MEM)
    b = spark.createDataFrame([("h", "p", 3, "x", "decision", 0.7, 2, 12, 11, 4, 99, "q", "agent", None), ("z", "p", 4, " ", "fact", 0.1, 0, 1, 1, 1, None, None, "", None)], MEM)
    keys = ["content_hash", "kind", "salience", "access_count", "updated_at", "created_at"]
    new = F.col("ord") + 100
    go = lambda x, y: exchange.import_records(x, as_records(y), new)
    assert rows(go(a, b), *keys) == [("g", "task", 0.2, 1, 9, 9), ("h", "decision", 0.7, 3, 12, 4)]
    first = {r.content_hash: r for r in go(a, b).collect()}
    assert (first["h"].provenance, first["h"].channel, first["h"].was, first["h"].expires_at, first["g"].was) == ("q", "agent", "merged", None, "kept")
    again = go(go(a, b).drop("was").select(*a.columns), b)
    assert rows(again, *keys) == rows(go(a, b), *keys)
    assert [r for r in rows(go(b, a), *keys) if r[0] != "z"] == rows(go(a, b), *keys)
    tags = spark.createDataFrame([(1, "k", "old")], "memory_id bigint, key string, value string")
    assert rows(exchange.merged_tags(tags, go(a, b), as_records(b)), "memory_id", "key", "value") == [(1, "k", "old"), (1, "k", "v")]


def test_sync_verdicts(spark):
    row = lambda h, at, text: (h, "p", ord(h), text, "fact", 0.5, 1, at, at, at, None, None, "", None)
    a = spark.createDataFrame([row("a", 10, "mine"), row("b", 10, "mine"), row("c", 10, "mine"), row("d", 10, "mine")], MEM)
    b = spark.createDataFrame([row("a", 13, "far"), row("b", 7, "far"), row("c", 12, "far"), row("e", 1, "far")], MEM)
    got = {r.content_hash: (r.was, r.content, r.updated_at) for r in exchange.sync_records(a, as_records(b), F.col("ord") + 1000).collect()}
    assert got == {"a": ("remote", "far", 13), "b": ("local", "mine", 10), "c": ("conflict", "mine", 10), "d": ("kept", "mine", 10), "e": ("inserted", "far", 1)}


def test_superseding_refs(spark):
    a = spark.createDataFrame([("h", "p", 1, "x", "fact", 0.5, 3, 10, 10, 5, None, None, "", None), ("g", "p", 2, "y", "task", 0.2, 1, 9, 9, 9, 50, "o", "user", None)], MEM)
    r = as_records(a).withColumn("superseded", F.when(F.col("content_hash") == "h", F.struct(F.lit("g").alias("hash"), F.lit("p").alias("project"))).otherwise(F.struct(F.lit("g").alias("hash"), F.lit("p").alias("project"))))
    m = exchange.import_records(a, r, F.col("ord"))
    refs = exchange.superseding(m, r)
    assert rows(refs, "id", "resolved") == [(1, True), (2, False)]
    assert {q.id: q.superseded_by for q in exchange.superseded(m, refs).collect()} == {1: 2, 2: None}


def test_commit_matrix_and_grades(spark):
    cand = spark.createDataFrame([(1, 0, "fact", "project", "p", ""), (2, 0, "fact", "project", "p", ""), (3, 0, "pitfall", "project", "p", ""), (4, 0, "task", "project", "p", "next"), (5, 0, "decision", "project", "p", ""), (6, 0, "fact", "global", "p", ""), (7, 0, "odd", "", "p", "")], "id bigint, revision int, kind string, scope string, project string, task_state string")
    items = spark.createDataFrame([(1, "u", "e", "a", "direct", 1), (3, "u", "e", "a", "error", 1)], "candidate_id bigint, event_uid string, evidence_id string, archive string, role string, seq int")
    got = {r.id: (r.action, r.reasons) for r in evidence.commit_matrix(cand, items).collect()}
    assert got == {1: ("auto_commit", "auto_eligible"), 2: ("defer", "missing_evidence"), 3: ("defer", "pitfall_missing_resolution"), 4: ("auto_commit", "auto_eligible"), 5: ("human_accept", "manual_kind"), 6: ("human_accept", "global_scope"), 7: ("human_accept", "manual_kind,unknown_kind")}


def test_supply_greedy(spark):
    cols = "qid bigint, query string, q_project string, id bigint, rank int, score double, content string, kind string, project string, precise double, broad double, fuzzy double, subject boolean, noted boolean"
    hit = lambda i, c, p, pre=0.1: (1, "how to run the build tool", "p", i, i, 1.0 / i, c, "fact", p, pre, 0.1, 0.0, False, False)
    df = spark.createDataFrame([hit(1, "global one", ""), hit(2, "global two", ""), hit(3, "mine", "p"), hit(4, "Mine.", "p"), hit(5, "theirs", "q"), hit(6, "weak", "p", 0.0), hit(7, "x", "p")], cols)
    got = {r.id: (r.injection_rank, r.drop_reason) for r in supply.supply(df).collect()}
    assert got == {1: (1, ""), 2: (0, "scope_quota"), 3: (2, ""), 4: (0, "duplicate_content"), 5: (0, "cross_project"), 6: (0, "unsupported"), 7: (3, "")}


def test_recall_and_gold(spark):
    ranked = spark.createDataFrame([(1, "aabb", 1), (1, "ccdd", 3), (2, "eeff", 2)], "qid bigint, hash string, rank int")
    gold = spark.createDataFrame([(1, "aa"), (1, "cc"), (2, "zz"), (3, "aa")], "qid bigint, prefix string")
    got = {r.qid: (r.recall, r.rr, r.strict) for r in evaluation.recall_at_k(ranked, gold, 5).collect()}
    assert got == {1: (1.0, 1.0, True), 2: (0.0, 0.0, False), 3: (0.0, 0.0, False)}


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate([json.dumps({"type": "progress"}), json.dumps({"summary": "s"}), json.dumps({"uuid": "u", "message": {"role": "user", "content": [{"type": "text", "text": "<user_query>a</user_query>"}, {"type": "tool_use", "name": "grep", "input": "{}"}]}}), "nonsense"])], "source_id string, seq int, value string")
    got = [(r.seq, r.kind, r.text) for r in readers.parse_transcript(lines).orderBy("seq", "kind").collect()]
    assert got == [(1, "summary", "s"), (2, "text", "a"), (2, "tool_use", "grep {}"), (3, "unparsed", "nonsense")]
    md = "# head\n- first item of list\n  goes on here\n```\ncode line here\n```\n2. second [link](http://x) item\n| a | table |\nshort"
    got = [(r.line, r.text) for r in readers.markdown_items(spark.createDataFrame([(1, md)], "id int, text string")).orderBy("line").collect()]
    assert got == [(2, "first item of list goes on here"), (7, "second [link](http://x) item")]
    assert readers.read_jsonl(spark, str(tmp_path / "none"), readers.AUDIT).count() == 0
    ev = spark.createDataFrame([("s", 1, b"x")], "source_id string, seq int, raw binary")
    readers.write_segments(ev, str(tmp_path / "seg"))
    assert bytes(readers.read_segments(spark, str(tmp_path / "seg")).first().raw) == b"x"


def test_drafts(spark):
    out = spark.createDataFrame([(1, '[{"kind":"fact","content":"c","evidence_idx":[0]},{"kind":"odd","content":"d"}]', 1), (2, "[]", 1), (3, "no json", 1), (4, '{"kind":"task","content":"t","evidence_idx":[5]}', 1)], "id int, output string, n_evidence int")
    out = out.withColumn("output", F.replace("output", F.lit("[0]"), F.lit("[1]")))
    assert rows(extraction.parse_drafts(out), "id", "status") == [(1, "ok"), (2, "empty"), (3, "bad")]


def test_claims_batch_equals_stream(spark, tmp_path):
    data = [(1, t) for t in (0, 5, 10, 11, 15, 22, 40)] + [(2, 3)]
    df = spark.createDataFrame(data, "key bigint, ts bigint")
    batch = rows(evidence.claims(df), "key", "ts")
    assert batch == [(1, 0), (1, 11), (1, 22), (1, 40), (2, 3)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = capture.claim_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("claims_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("claims_out"), "key", "ts") == batch


def test_whole_text_is_asked(spark, tmp_path):
    from lorespark.plans import registry

    spark.createDataFrame([(1, "one two three four five six seventh eighth")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "only the seventh", "src1"), (2, "nothing of it", "src1")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.id for r in registry.rrf_fused_search(spark, str(tmp_path)).collect()] == [1]


def test_self_recall_asks_the_library(spark, tmp_path):
    from lorespark.plans import registry

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(10)), "src1") for i in (1, 2, 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.form: (r.queries, r.recall, r.mrr, r.empty_rate) for r in registry.self_recall(spark, str(tmp_path)).collect()}
    assert got == {"full": (3, 1.0, 1.0, 0.0), "part": (3, 1.0, 1.0, 0.0)}


def test_drafts_are_read_as_json(spark):
    good = '{"kind":"fact","content":"x } { y","evidence_idx":[2,1,2]}'
    outs = {
        "braces": good,
        "chatter": f"Here: {good} done\n\n  ",
        "pretty": '[\n {\n  "kind": "Task",\n  "content": " do it ",\n  "evidence_idx": [1],\n  "attributed_to": "model"\n }\n]',
        "array with a bad member": f'[{good}, {{"kind": 5, "content": "n", "evidence_idx": [1]}}]',
        "broken array": f"[{good}",
        "array and talk": f"[{good}] that is all", "two arrays": f"[{good}], [{good}]", "two on a line": good + " " + good,
        "two lines": good + "\n" + '{"kind":"fact","content":"a","evidence_idx":[9]}\nnot json',
        "no evidence": '{"kind":"fact","content":"a"}',
        "scopes": '{"kind":"fact","content":"a","scope":"galaxy","evidence_idx":[1]}\n{"kind":"fact","content":"b","scope":" Global ","evidence_idx":[1]}',
        "empty": "", "list": "[]", "blank": " \n ", "null member": "[null]", "talk": "I found nothing",
    }
    df = spark.createDataFrame([(k, v, 2) for k, v in outs.items()], "id string, output string, n_evidence int")
    got = {}
    for r in extraction.read_drafts(df).orderBy("id", "line").collect():
        got.setdefault(r.id, []).append((r.state, r.draft and (r.draft.kind, r.draft.scope, r.draft.content, r.draft.attributed_to, r.draft.evidence_idx)))
    one = ("ok", ("fact", "project", "x } { y", "", [1, 2]))
    assert got["braces"] == got["chatter"] == [one]
    assert got["pretty"] == [("ok", ("task", "project", "do it", "", [1]))]
    assert got["array with a bad member"] == got["broken array"] == got["array and talk"] == got["talk"] == got["two arrays"] == got["two on a line"] == [("bad", None)]
    assert [s for s, _ in got["two lines"]] == ["ok", "invalid", "bad"] and got["two lines"][0] == one
    assert [s for s, _ in got["no evidence"]] == ["invalid"] and [s for s, _ in got["null member"]] == ["invalid"]
    assert [(s, d[1]) for s, d in got["scopes"]] == [("invalid", "galaxy"), ("ok", "global")]
    assert not {"empty", "list", "blank"} & set(got)
    v = {r.id: (r.status, r.bad) for r in extraction.verdicts(df).collect()}
    assert v["empty"] == v["list"] == v["blank"] == ("noop", False) and v["braces"] == ("ok", False) and v["two lines"] == ("partial", False)
    assert v["broken array"] == v["talk"] == ("invalid", True) and v["no evidence"] == ("invalid", False)


def test_events_without_a_place_are_kept(spark):
    ev = spark.createDataFrame([(1, "a", "", 1, 0), (2, "b", "", 1, 0), (3, "c", "", 1, 0), (4, "", "s", 1, -1), (5, "", "s", 1, -1), (6, "d", "s", 1, 2), (7, "", "s", 1, 2), (8, "a", "s", 1, 3), (9, None, None, None, None), (10, None, None, None, None)], "ord int, event_uid string, source_id string, generation int, seq int")
    assert sorted(r.ord for r in evidence.exactly_once(ev).collect()) == [1, 2, 3, 4, 5, 6, 9, 10]


def test_a_crowd_of_near_copies_costs_its_size(spark, monkeypatch):
    """Near copies of one project and of some others: the components of all pairs from links that grow with the crowd."""
    r = random.Random(6)
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    texts = []
    for g in range(3):
        own = [w + "xyz"[g] if r.random() < 0.5 else w for w in base]
        for _ in range((400, 60, 5)[g]):
            w = list(own)
            for _ in range(r.randrange(0, 10)):
                w[r.randrange(len(w))] = "".join(r.choice("abcdef") for _ in range(5))
            texts.append(" ".join(w))
    mem = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id long, content string, project string")
    monkeypatch.setattr(dedup, "CROWD", 20)
    pairs, links = dedup.near_pairs(mem).select("a", "b"), dedup.near_links(mem).distinct()
    n = links.count()
    assert rows(dedup.components(links), "id", "cluster") == rows(dedup.components(pairs), "id", "cluster")
    assert n < pairs.count() / 3 and n < 60 * len(texts)
